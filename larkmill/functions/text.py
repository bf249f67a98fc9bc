"""Text expressions: tokens, sections, terms, dictionaries, redaction, names, fingerprints and formats."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
FTS_STOP_WORDS = ("the", "and", "or", "but", "with", "for", "of", "to", "in", "on", "at")
JOB_SKILLS = (
    "python", "java", "javascript", "react", "node.js", "sql", "mongodb", "docker", "kubernetes", "aws", "azure",
    "gcp", "terraform", "git", "machine learning", "ai", "deep learning", "tensorflow", "pytorch", "linux", "windows",
    "macos", "bash", "powershell", "ci/cd", "jenkins", "ansible", "chef", "puppet", "microservices", "rest api",
    "graphql",
)
SKILL_CATEGORIES = {
    "programming": ("python", "java", "c++", "c#", "javascript", "typescript", "go", "rust", "matlab", "sql", "r",
                    "scala", "kotlin", "swift", "c", "assembly", "vhdl", "verilog", "labview", "simulink"),
    "frameworks": ("react", "angular", "vue", "node.js", "django", "flask", "spring", "tensorflow", "pytorch",
                   "scikit-learn", "pandas", "numpy", "opencv", "ros", "gazebo", "pcl", "eigen"),
    "tools": ("docker", "kubernetes", "aws", "gcp", "azure", "terraform", "jenkins", "gitlab", "github", "jira",
              "confluence", "solidworks", "autocad", "ansys", "cadence"),
    "domains": ("machine learning", "computer vision", "robotics", "control systems", "embedded systems", "real-time",
                "simulation", "modeling", "autonomy", "sensor fusion", "slam", "path planning", "signal processing",
                "image processing", "distributed systems"),
    "methodologies": ("agile", "scrum", "devops", "ci/cd", "test-driven development", "microservices", "api design",
                      "system architecture"),
}
CONTACT_SKILLS = ("python", "java", "react", "sql", "aws", "docker", "linux", "pytorch", "tensorflow", "kubernetes")
SENIORITY_LADDER = (
    ("senior", ("senior", "sr.", "lead", "principal", "staff")),
    ("junior", ("junior", "jr.", "entry", "associate", "intern")),
    ("mid", ("mid", "intermediate", "regular")),
)
LISTING_LADDER = (
    ("senior", ("senior", "sr.", "lead", "principal", "staff")),
    ("junior", ("junior", "jr.", "entry", "graduate", "intern")),
    ("management", ("manager", "director", "vp", "vice president", "head of")),
)
SECTION_PATTERNS = {
    "education": r"(?i)\b(education|academic)\b",
    "experience": r"(?i)\b(experience|employment|work history)\b",
    "skills": r"(?i)\b(skills|technical skills|competencies)\b",
    "projects": r"(?i)\b(projects|portfolio)\b",
    "certifications": r"(?i)\b(certifications?|licenses?)\b",
    "awards": r"(?i)\b(awards?|honors?|achievements?)\b",
    "publications": r"(?i)\b(publications?|papers?)\b",
}
REDACTIONS = (
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL]"),
    (r"\(?([0-9]{3})\)?[-.\s]?([0-9]{3})[-.\s]?([0-9]{4})", "[PHONE]"),
    (r"\b([0-9]{3})[-.\s]?([0-9]{2})[-.\s]?([0-9]{4})\b", "[SSN]"),
    (r"\b\d+\s+[A-Za-z\s]+\s+(St|Street|Ave|Avenue|Rd|Road|Dr|Drive|Ln|Lane|Blvd|Boulevard)\b", "[ADDRESS]"),
)
YEARS_PATTERNS = (
    (r"(\d+)\+?\s*years?\s*(of\s*)?experience", 1),
    (r"experience.*?(\d+)\+?\s*years?", 1),
    (r"(\d+)\+?\s*years?\s*in", 1),
    (r"(\d+)\+?\s*yrs", 1),
)
BLOCKED_MARKERS = (
    "access denied", "blocked", "403 forbidden", "captcha", "challenge", "cf-browser-verification", "are you a robot",
)
PARKING_PHRASES = (
    "domain for sale", "this domain may be for sale", "parked domain", "coming soon", "under construction", "godaddy",
    "namecheap",
)
COMPANY_PHRASES = ("about us", "contact", "careers", "products", "services", "team")
JOB_TYPES = {
    "fulltime": "full-time", "parttime": "part-time", "contract": "contract", "internship": "internship",
    "temporary": "temporary",
}


def empty_if_null(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def split_words(text: Column) -> Column:
    """Words between white space; a null or blank text has none."""
    return F.filter(F.split(empty_if_null(text), r"\s+"), lambda w: w != "")


def token_estimate(text: Column) -> Column:
    """Whole part of 1.3 tokens a word."""
    return F.floor(F.size(split_words(text)) * F.lit(1.3)).cast("long")


def token_formulas(text: Column) -> dict[str, Column]:
    """The other estimates in use: three quarters of the words, the words, and an unrounded 1.3 a word."""
    n = F.size(split_words(text))
    return {"tokens_075": n * 0.75, "tokens_words": n.cast("long"), "tokens_13": n * 1.3}


def truncate_to_tokens(text: Column, most: int) -> Column:
    return F.array_join(F.slice(split_words(text), 1, int(most / 1.5)), " ")


def normalize_space(text: Column) -> Column:
    """One blank for runs of blanks and tabs, one empty line at most, trimmed."""
    lines = F.regexp_replace(empty_if_null(text), r"\n\s*\n", "\n\n")
    return F.trim(F.regexp_replace(lines, r"[ \t]+", " "))


def query_terms(text: Column, most: int = 20, stop: Iterable[str] = FTS_STOP_WORDS) -> Column:
    """The first ``most`` lower-case words over two characters that are no stop words."""
    words = F.filter(split_words(F.lower(text)), lambda w: (F.length(w) > 2) & ~w.isin(*stop))
    return F.slice(words, 1, most)


def lexemes(text: Column) -> Column:
    """Distinct lower-case alphanumeric terms of a document, for the inverted index."""
    return F.array_distinct(F.filter(F.split(F.lower(empty_if_null(text)), r"\s+"), lambda w: w != ""))


def found_terms(text: Column, terms: Iterable[str]) -> Column:
    """Those of ``terms`` that occur anywhere in the text, in their order."""
    held = lambda low: F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in terms]))
    return F.flatten(F.transform(F.array(F.lower(empty_if_null(text))), held))


def keyword_ladder(text: Column, ladder=SENIORITY_LADDER, default: str | None = None) -> Column:
    """The first rung of which a keyword occurs in the text."""
    low = F.lower(empty_if_null(text))
    out = None
    for name, words in ladder:
        hit = F.lit(False)
        for w in words:
            hit = hit | (F.instr(low, w) > 0)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(default).cast("string"))


def contains_any(text: Column, phrases: Iterable[str]) -> Column:
    low = F.lower(empty_if_null(text))
    hit = F.lit(False)
    for p in phrases:
        hit = hit | (F.instr(low, p) > 0)
    return hit


def years_of_experience(text: Column, ref_year: int, cap: int = 20) -> Column:
    """Most years named; else years since the earliest year in the text, less two for school. Capped."""
    low = F.lower(empty_if_null(text))
    named = F.lit(0)
    for pattern, group in YEARS_PATTERNS:
        hits = F.transform(F.regexp_extract_all(low, F.lit(pattern), F.lit(group)), lambda x: x.try_cast("int"))
        named = F.greatest(named, F.coalesce(F.array_max(hits), F.lit(0)))
    dates = F.transform(
        F.regexp_extract_all(empty_if_null(text), F.lit(r"(?:19|20)\d{2}"), F.lit(0)), lambda x: x.try_cast("int")
    )
    since = F.greatest(F.lit(ref_year) - F.array_min(dates) - 2, F.lit(0))
    return F.least(F.when(named > 0, named).otherwise(F.coalesce(since, F.lit(0))), F.lit(cap))


def ascii_classes(pattern: str) -> str:
    """A pattern whose word limits and white space are those of ASCII, as in SQL: to Java, ß is a letter to ``\\b``, and
    ``\\s`` takes in the vertical tab."""
    edge = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"
    space, out, inside, i = r"\t\n\f\r ", [], False, 0
    if pattern.startswith((r"\b\d", r"\b([0-9]")):  # a digit is soon looked for, what is before it is not
        out, i = [r"(?=\d)(?<!\w)"], 2
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two[0] != "\\":
            inside = (inside or two[0] == "[") and two[0] != "]"
            two = two[0]
        out.append(edge if two == r"\b" and not inside else (space if inside else f"[{space}]") if two == r"\s" else two)
        i += len(two)
    return "".join(out)


def redact(text: Column) -> Column:
    """E-mail, phone, social security number and street address, in this order."""
    out = text
    for pattern, mark in REDACTIONS:
        done = F.regexp_replace(out, "(?iu)" + ascii_classes(pattern), mark)
        out = F.when(F.contains(out, F.lit("@")), done).otherwise(out) if "@" in pattern else done
    return out


def section_starts(text: Column) -> dict[str, Column]:
    return {name: F.regexp_instr(empty_if_null(text), F.lit(p)) for name, p in SECTION_PATTERNS.items()}


def heading_words(name: str) -> str:
    """The words of a section's pattern, parted by bars."""
    return SECTION_PATTERNS[name].removeprefix(r"(?i)\b(").removesuffix(r")\b")


def sections(text: Column) -> Column:
    """A map of section name to its text: from its first heading word to the next of any other section.

    A text is searched once for each section of which it holds a word, and once more for the end of each that it has: a lambda's argument is
    computed once, where a column would be at each use.
    """
    kind = "array<struct<key:string,value:string>>"
    none = F.array().cast(kind)

    def section(body: Column, low: Column, name: str) -> Column:
        own = heading_words(name)
        others = "|".join(heading_words(other) for other in SECTION_PATTERNS if other != name)

        def cut(start: Column) -> Column:
            end = F.transform(F.array(F.regexp_instr(F.substr(body, start + 1), F.lit(rf"(?i)\b(?:{others})\b"))), lambda at: F.when(at > 0, at).otherwise(F.length(body)))
            bare = F.transform(end, lambda n: F.regexp_replace(F.substr(body, start, n), r"^\s+|\s+$", ""))
            named = F.transform(F.filter(bare, lambda x: x != ""), lambda x: F.struct(F.lit(name).alias("key"), x.alias("value")))
            return F.when(start > 0, named).otherwise(none)

        there = reduce(or_, [F.contains(low, F.lit(w.removesuffix("s?"))) for w in own.split("|")])
        start = F.when(there, F.regexp_instr(body, F.lit(SECTION_PATTERNS[name]))).otherwise(0)
        return F.flatten(F.transform(F.array(start), cut))

    def found(body: Column) -> Column:
        every = lambda low: F.concat(*[section(body, low, name) for name in SECTION_PATTERNS])
        return F.flatten(F.transform(F.array(F.lower(body)), every))

    return F.map_from_entries(F.flatten(F.transform(F.array(empty_if_null(text)), found)))


def keyword_context(text: Column, keyword: str, before: int = 50, after: int = 200) -> Column:
    """The text round the first occurrence of a keyword."""
    at = F.instr(F.lower(empty_if_null(text)), keyword)
    begin = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.substr(text, begin, at + after - begin))


def first_email(text: Column) -> Column:
    """The first address; a text without the sign of one isn't searched."""
    found = F.regexp_extract(text, ascii_classes(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"), 0)
    return F.when(F.contains(text, F.lit("@")), F.nullif(found, F.lit("")))


def first_phone(text: Column) -> Column:
    pattern = r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"
    return F.nullif(F.regexp_extract(empty_if_null(text), ascii_classes(pattern), 0), F.lit(""))


def name_line(text: Column, default: str = "Test Candidate") -> Column:
    """The first of five lines with 2 to 5 words, no digit, no @ and no heading word."""
    lines = F.slice(
        F.filter(F.transform(F.split(empty_if_null(text), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != ""), 1, 5
    )
    good = F.filter(
        lines,
        lambda x: ~x.rlike(r"[@\d]")
        & F.size(split_words(x)).between(2, 5)
        & ~F.lower(x).rlike("summary|experience|education|skills|objective"),
    )
    return F.coalesce(F.get(good, 0), F.lit(default))


def between_sentinels(text: Column, begin: str, end: str) -> Column:
    """What lies between two marks, or all of it without them."""
    return F.trim(F.substring_index(F.substring_index(text, begin, -1), end, 1))


def slug(name: Column) -> Column:
    out = F.regexp_replace(F.lower(empty_if_null(name)), r"[^\w\s-]", "")
    out = F.regexp_replace(out, r"[-\s]+", "-")
    out = F.regexp_replace(out, r"-(inc|corp|llc|ltd|company)$", "")
    return F.regexp_replace(out, r"^-+|-+$", "")


def clean_company_name(name: Column) -> Column:
    out = F.regexp_replace(F.lower(empty_if_null(name)), r"[^\w\s-]", "")
    out = F.regexp_replace(F.regexp_replace(out, r"\s+", "-"), "-+", "-")
    return F.regexp_replace(out, r"^-+|-+$", "")


def candidate_domains(name: Column) -> Column:
    """Domains a company of this name may have, in order of preference."""
    clean = clean_company_name(name)
    flat = F.replace(clean, F.lit("-"), F.lit(""))
    parts = F.split(clean, "-")
    initials = F.array_join(F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.substring(p, 1, 1)), "")
    suffixes = ("inc", "corp", "corporation", "llc", "ltd", "limited", "company", "co")
    found = [
        F.concat(clean, F.lit(".com")),
        F.when(flat != clean, F.concat(flat, F.lit(".com"))),
        F.when((F.length(clean) > 15) & (F.size(parts) > 1), F.concat(initials, F.lit(".com"))),
    ]
    found += [F.when(clean.endswith(f"-{s}"), F.concat(F.regexp_replace(clean, f"-{s}$", ""), F.lit(".com"))) for s in suffixes]
    found += [F.concat(x, F.lit(tld)) for x in (clean, flat) for tld in (".io", ".ai")]
    return F.array_compact(F.array(*found))


def company_fingerprint(name: Column) -> Column:
    return F.md5(F.lower(F.trim(name)))


def listing_fingerprint(title: Column, description: Column, location: Column, salary: Column) -> Column:
    """The first half of a SHA-256 over the parts, without separators."""
    parts = [empty_if_null(x) for x in (title, description, location, salary)]
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 32)


def short_hashes(title: Column, description: Column) -> dict[str, Column]:
    return {
        "sha16": F.substring(F.sha2(empty_if_null(description), 256), 1, 16),
        "md5_title": F.md5(F.concat(empty_if_null(title), F.lit("|"), F.substring(empty_if_null(description), 1, 500))),
    }


def resume_hash(text: Column, skills: Column, section_names: Column, contact: Column) -> Column:
    """SHA-256 over lower-cased trimmed text, sorted skills, sorted section names and contact, as canonical text."""
    return F.sha2(
        F.concat_ws(
            "|", F.lower(F.trim(empty_if_null(text))), F.array_join(F.array_sort(skills), ","),
            F.array_join(F.array_sort(section_names), ","), empty_if_null(contact),
        ),
        256,
    )


def request_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16))


def prompt_hash(prompt: Column) -> Column:
    return F.substring(F.md5(prompt), 1, 16)


def escape_html(text: Column) -> Column:
    out = empty_if_null(text)
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def salary_range(low: Column, high: Column, dash: str = "-") -> Column:
    """Zero counts as missing."""
    a, b = F.format_number(low, 0), F.format_number(high, 0)
    has_low, has_high = F.coalesce(low != 0, F.lit(False)), F.coalesce(high != 0, F.lit(False))
    return (
        F.when(has_low & has_high, F.concat(F.lit("$"), a, F.lit(f"{dash}$"), b))
        .when(has_low, F.concat(F.lit("$"), a, F.lit("+")))
        .when(has_high, F.concat(F.lit("Up to $"), b))
    )


def job_type(kind: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in JOB_TYPES.items() for x in pair])
    return F.when(kind != "", F.coalesce(F.try_element_at(known, F.lower(kind)), kind))


def truncated(text: Column, most: int = 30) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def csv_list(text: Column) -> Column:
    """Trimmed, lower-case, non-empty items of a comma-separated text."""
    items = F.transform(F.split(empty_if_null(text), ","), lambda x: F.lower(F.trim(x)))
    return F.filter(items, lambda x: x != "")


def raw_csv_list(text: Column) -> Column:
    """Items as they are, empty ones too."""
    return F.split(empty_if_null(text), ",")


def any_tag(text: Column, own_tags: Column, wanted: Column) -> Column:
    """Whether a wanted tag occurs in the text or equals an own tag; true if none is wanted."""
    low = F.lower(empty_if_null(text))
    own = F.transform(own_tags, lambda t: F.lower(t))
    return (F.size(wanted) == 0) | F.exists(wanted, lambda t: (F.instr(low, t) > 0) | F.array_contains(own, t))


def subject_line(high: Column, new: Column) -> Column:
    return (
        F.when(high > 0, F.concat(F.lit("\U0001f3af "), high.cast("string"), F.lit(" high-priority matches found!")))
        .when(new > 0, F.concat(F.lit("\U0001f4e7 "), new.cast("string"), F.lit(" new job matches for you")))
        .otherwise("\U0001f4cb Your daily job search update")
    )


def phone_format(phone: Column) -> Column:
    digits = F.regexp_replace(phone, r"[^\d]", "")

    def shown(d: Column) -> Column:
        return F.concat(
            F.lit("("), F.substring(d, 1, 3), F.lit(") "), F.substring(d, 4, 3), F.lit("-"), F.substring(d, 7, 4)
        )

    return (
        F.when(F.length(digits) == 10, shown(digits))
        .when((F.length(digits) == 11) & digits.startswith("1"), shown(F.substring(digits, 2, 10)))
        .otherwise(phone)
    )


def valid_email(x: Column) -> Column:
    return x.rlike(r"^[\w\.-]+@[\w\.-]+\.\w+$")


def valid_phone(x: Column) -> Column:
    return F.length(F.regexp_replace(x, r"[^\d]", "")).isin(10, 11)


def closest_option(value: Column, options: Column) -> Column:
    """The option equal but for case, else the first one that contains or is contained in the value."""
    low = F.lower(value)
    same = F.filter(options, lambda o: F.lower(o) == low)
    near = F.filter(options, lambda o: (F.instr(F.lower(o), low) > 0) | (F.instr(low, F.lower(o)) > 0))
    return F.coalesce(F.get(same, 0), F.get(near, 0))
