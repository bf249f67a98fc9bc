"""Text, URL, vector and chunking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkmill.functions import text as T
from larkmill.functions import urls as U
from larkmill.functions import vectors as V
from larkmill.operators import chunking as C
from larkmill.operators.retrieval import best_per_group, match_stems, match_terms, mean_vector, nearest_exact, nearest_in_lists, within_distance
from larkmill.plans import domain as D
from larkmill.plans.registry import Registry
from larkmill.session import table

R = Registry()
W = r"list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')"
STOP = "['the', 'and', 'or', 'but', 'with', 'for', 'of', 'to', 'in', 'on', 'at']"
TERMS = rf"list_filter(string_split_regex(lower(text), '\s+'), lambda w: length(w) > 2 AND NOT list_contains({STOP}, w))"
# Words frequent in the test tables stand in for the dictionaries, of which these hold none.
LOCAL_TERMS = ("the", "ung", "que", "ción", "ment", "heit", "password", "license")


def docs(spark, d):
    return table(spark, d, "documents", spread=True)


@R.add(
    f"""SELECT doc_id, CAST(floor(len(w) * 1.3::DOUBLE) AS BIGINT) AS tokens, len(w) * 0.75::DOUBLE AS tokens_075,
      len(w)::BIGINT AS tokens_words, round(len(w) * 1.3::DOUBLE, 6) AS tokens_13, array_to_string(w[1:33], ' ') AS head
    FROM (SELECT doc_id, {W} AS w FROM documents)"""
)
def token_count(spark, d):
    t = F.col("text")
    more = T.token_formulas(t)
    return docs(spark, d).select(
        "doc_id", T.token_estimate(t).alias("tokens"), more["tokens_075"].alias("tokens_075"),
        more["tokens_words"].alias("tokens_words"), F.round(more["tokens_13"], 6).alias("tokens_13"),
        T.truncate_to_tokens(t, 50).alias("head"),
    )


@R.add(
    r"""SELECT doc_id, trim(regexp_replace(regexp_replace(text, '\n\s*\n', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g')) AS text FROM documents"""
)
def normalize_text(spark, d):
    return docs(spark, d).select("doc_id", T.normalize_space(F.col("text")).alias("text"))


REDACT = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
  '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b', '[EMAIL]', 'gi'),
  '\(?([0-9]{3})\)?[-.\s]?([0-9]{3})[-.\s]?([0-9]{4})', '[PHONE]', 'gi'),
  '\b([0-9]{3})[-.\s]?([0-9]{2})[-.\s]?([0-9]{4})\b', '[SSN]', 'gi'),
  '\b\d+\s+[A-Za-z\s]+\s+(St|Street|Ave|Avenue|Rd|Road|Dr|Drive|Ln|Lane|Blvd|Boulevard)\b', '[ADDRESS]', 'gi')"""


@R.add(f"SELECT doc_id, {REDACT} AS text FROM documents")
def pii_redact(spark, d):
    return docs(spark, d).select("doc_id", T.redact(F.col("text")).alias("text"))


@R.add(
    f"""SELECT source, sum((len(t) - len(replace(t, '[EMAIL]', ''))) // 7)::BIGINT AS emails,
      sum((len(t) - len(replace(t, '[PHONE]', ''))) // 7)::BIGINT AS phones FROM (SELECT source, {REDACT} AS t FROM documents) GROUP BY source"""
)
def pii_counts(spark, d):
    red = docs(spark, d).select("source", T.redact(F.col("text")).alias("t"))
    n = lambda m: F.sum(F.regexp_count("t", F.lit(m))).cast("long")
    return red.groupBy("source").agg(n(r"\[EMAIL\]").alias("emails"), n(r"\[PHONE\]").alias("phones"))


@R.add(f"SELECT item_id, {TERMS}[1:20] AS terms FROM benchmark")
def query_terms(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.query_terms(F.col("text")).alias("terms"))


@R.add(
    "SELECT doc_id, list_filter(["
    + ", ".join(f"CASE WHEN contains(lower(text), '{t}') THEN '{t}' END" for t in LOCAL_TERMS)
    + """], lambda x: x IS NOT NULL) AS found FROM documents"""
)
def skills_dictionary(spark, d):
    return docs(spark, d).select("doc_id", T.found_terms(F.col("text"), LOCAL_TERMS).alias("found"))


@R.add(
    "SELECT kind, count(*) AS n FROM (SELECT unnest(list_filter(["
    + ", ".join(
        f"CASE WHEN contains(lower(text), '{t}') THEN '{k}' END" for k, ts in {"en": ("the ", "ing"), "de": ("und ", "ung")}.items() for t in ts
    )
    + "], lambda x: x IS NOT NULL)) AS kind FROM documents) GROUP BY kind"
)
def skills_by_category(spark, d):
    kinds = {"en": ("the ", "ing"), "de": ("und ", "ung")}
    named = lambda k: lambda x: F.lit(k)
    found = [F.transform(T.found_terms(F.col("text"), ts), named(k)) for k, ts in kinds.items()]
    return docs(spark, d).select(F.explode(F.concat(*found)).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@R.add(
    """SELECT doc_id, CASE WHEN contains(t, 'senior') OR contains(t, 'sr.') OR contains(t, 'lead') OR contains(t, 'principal') OR contains(t, 'staff') THEN 'senior'
      WHEN contains(t, 'junior') OR contains(t, 'jr.') OR contains(t, 'entry') OR contains(t, 'associate') OR contains(t, 'intern') THEN 'junior'
      WHEN contains(t, 'mid') OR contains(t, 'intermediate') OR contains(t, 'regular') THEN 'mid' END AS level
    FROM (SELECT doc_id, lower(CASE doc_id % 4 WHEN 0 THEN 'Staff ' WHEN 1 THEN 'Entry ' WHEN 2 THEN 'Mid ' ELSE '' END || text) AS t FROM documents)"""
)
def seniority_ladder(spark, d):
    k = F.col("doc_id") % 4
    head = F.when(k == 0, "Staff ").when(k == 1, "Entry ").when(k == 2, "Mid ").otherwise("")
    return docs(spark, d).select("doc_id", T.keyword_ladder(F.concat(head, "text")).alias("level"))


@R.add(
    r"""WITH t AS (SELECT doc_id, lower(CASE doc_id % 3 WHEN 0 THEN (doc_id % 30)::VARCHAR || '+ years of experience in ' WHEN 1 THEN 'since ' || (1990 + doc_id % 30)::VARCHAR || ' ' ELSE '' END || text) AS t FROM documents),
    y AS (SELECT doc_id, greatest(
      coalesce(list_max(list_transform(regexp_extract_all(t, '(\d+)\+?\s*years?\s*(of\s*)?experience', 1), lambda x: TRY_CAST(x AS INTEGER))), 0),
      coalesce(list_max(list_transform(regexp_extract_all(t, '(\d+)\+?\s*years?\s*in', 1), lambda x: TRY_CAST(x AS INTEGER))), 0)) AS named,
      list_min(list_transform(regexp_extract_all(t, '(?:19|20)\d{2}', 0), lambda x: TRY_CAST(x AS INTEGER))) AS first FROM t)
    SELECT doc_id, least(CASE WHEN named > 0 THEN named ELSE coalesce(greatest(2024 - first - 2, 0), 0) END, 20)::BIGINT AS years FROM y"""
)
def years_extraction(spark, d):
    k = F.col("doc_id") % 3
    head = (
        F.when(k == 0, F.concat((F.col("doc_id") % 30).cast("string"), F.lit("+ years of experience in ")))
        .when(k == 1, F.concat(F.lit("since "), (1990 + F.col("doc_id") % 30).cast("string"), F.lit(" ")))
        .otherwise("")
    )
    made = docs(spark, d).select("doc_id", F.concat(head, "text").alias("t"))
    return made.select("doc_id", T.years_of_experience(F.col("t"), 2024).cast("long").alias("years"))


@R.add(
    r"""SELECT doc_id, nullif(regexp_extract(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b', 0), '') AS email,
      nullif(regexp_extract(text, '\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b', 0), '') AS phone FROM documents"""
)
def contact_extraction(spark, d):
    return docs(spark, d).select("doc_id", T.first_email(F.col("text")).alias("email"), T.first_phone(F.col("text")).alias("phone"))


@R.add(
    """SELECT doc_id, substr(sha256(left(text, 30) || text || source || lang), 1, 32) AS fp,
      substr(sha256(text), 1, 16) AS sha16, md5(left(text, 30) || '|' || left(text, 500)) AS md5_title FROM documents"""
)
def fingerprint_sha256(spark, d):
    title = F.substring("text", 1, 30)
    short = T.short_hashes(title, F.col("text"))
    return docs(spark, d).select(
        "doc_id", T.listing_fingerprint(title, F.col("text"), F.col("source"), F.col("lang")).alias("fp"),
        short["sha16"].alias("sha16"), short["md5_title"].alias("md5_title"),
    )


@R.add(
    r"""SELECT s_suppkey, md5(lower(trim(s_name))) AS fp, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      lower(s_name || ' Inc'), '[^\w\s-]', '', 'g'), '[-\s]+', '-', 'g'), '-(inc|corp|llc|ltd|company)$', ''), '^-+|-+$', '', 'g') AS slug FROM supplier"""
)
def company_slug(spark, d):
    return table(spark, d, "supplier").select(
        "s_suppkey", T.company_fingerprint(F.col("s_name")).alias("fp"), T.slug(F.concat("s_name", F.lit(" Inc"))).alias("slug")
    )


@R.add(
    r"""WITH c AS (SELECT s_suppkey, regexp_replace(regexp_replace(regexp_replace(lower(s_name), '[^\w\s-]', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g') AS n FROM supplier),
    f AS (SELECT *, replace(n, '-', '') AS flat FROM c)
    SELECT s_suppkey, unnest(list_filter([n || '.com', CASE WHEN flat <> n THEN flat || '.com' END,
      CASE WHEN length(n) > 15 AND len(string_split(n, '-')) > 1 THEN array_to_string(list_transform(list_filter(string_split(n, '-'), lambda p: p <> ''), lambda p: left(p, 1)), '') || '.com' END,
      n || '.io', n || '.ai', flat || '.io', flat || '.ai'], lambda x: x IS NOT NULL)) AS domain FROM f"""
)
def company_domains(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.explode(T.candidate_domains(F.col("s_name"))).alias("domain"))


@R.add(
    """SELECT doc_id, replace(replace(replace(replace(replace(text || '<&">''', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS safe,
      CASE WHEN length(text) > 30 THEN left(text, 30) || '...' ELSE text END AS shown FROM documents"""
)
def escape_and_truncate(spark, d):
    t = F.concat("text", F.lit("<&\">'"))
    return docs(spark, d).select("doc_id", T.escape_html(t).alias("safe"), T.truncated(F.col("text")).alias("shown"))


@R.add(
    """SELECT o_orderkey, CASE WHEN a <> 0 AND b <> 0 THEN '$' || format('{:,}', a) || '-$' || format('{:,}', b) WHEN a <> 0 THEN '$' || format('{:,}', a) || '+'
      WHEN b <> 0 THEN 'Up to $' || format('{:,}', b) END AS salary
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_orderkey % 150000 END AS a, CASE WHEN o_orderkey % 6 < 2 THEN 0 ELSE o_orderkey % 190000 + 10000 END AS b FROM orders)"""
)
def salary_format(spark, d):
    k = F.col("o_orderkey")
    low = F.when(k % 4 == 0, 0).otherwise(k % 150000)
    high = F.when(k % 6 < 2, 0).otherwise(k % 190000 + 10000)
    return table(spark, d, "orders").select("o_orderkey", T.salary_range(low, high).alias("salary"))


@R.add(
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'full-time' WHEN 'click' THEN 'part-time' ELSE event_type END AS job_type FROM events"""
)
def job_type_map(spark, d):
    k = F.col("event_type")
    return table(spark, d, "events").select(
        "event_id", T.job_type(F.when(k == "view", "FullTime").when(k == "click", "parttime").otherwise(k)).alias("job_type")
    )


@R.add(
    r"""SELECT page_id, CASE WHEN starts_with(u, 'http://') OR starts_with(u, 'https://') THEN u ELSE 'https://' || u END AS url,
      regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '') AS domain
    FROM (SELECT page_id, url, split_part(regexp_replace(CASE WHEN page_id % 3 = 0 THEN replace(url, 'http://', '') ELSE url END, '/+$', ''), '#', 1) AS u FROM pages)"""
)
def url_normalize(spark, d):
    given = F.when(F.col("page_id") % 3 == 0, F.replace("url", F.lit("http://"), F.lit(""))).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", U.normalize(given).alias("url"), U.domain(F.col("url")).alias("domain"))


@R.add(
    r"""SELECT a.page_id, replace(lower(regexp_extract(a.url, '://([^/?#]*)', 1)), 'www.', '') = replace(lower(regexp_extract(b.url, '://([^/?#]*)', 1)), 'www.', '') AS same
    FROM pages a JOIN pages b ON b.page_id = a.page_id - 1"""
)
def same_domain(spark, d):
    p = table(spark, d, "pages")
    q = p.select((F.col("page_id") + 1).alias("page_id"), F.col("url").alias("other"))
    return p.join(q, "page_id").select("page_id", U.same_domain(F.col("url"), F.col("other")).alias("same"))


@R.add(
    """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'workday' WHEN 3 THEN 'ashby' WHEN 4 THEN 'icims' ELSE 'custom' END AS portal,
      CASE page_id % 6 WHEN 5 THEN 0 ELSE page_id % 6 + 1 END AS ordinal FROM pages"""
)
def portal_detect(spark, d):
    marks = ("boards.greenhouse.io/x", "jobs.lever.co/x", "acme.myworkdayjobs.com/x", "jobs.ashbyhq.com/x", "careers.icims.com/x", "")
    mark = F.element_at(F.array(*[F.lit(m) for m in marks]), (F.col("page_id") % 6 + 1).cast("int"))
    found = table(spark, d, "pages").select("page_id", U.detect_portal(F.concat("html", mark)).alias("p"))
    return found.select("page_id", "p.portal", F.col("p.ordinal").cast("long").alias("ordinal"))


@R.add(
    """SELECT page_id, round(least(CASE page_id % 5 WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 0.8::DOUBLE WHEN 2 THEN 0.7::DOUBLE WHEN 3 THEN 0.6::DOUBLE ELSE 0 END
      + CASE WHEN page_id % 5 < 2 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN page_id % 2 = 0 THEN 0.1::DOUBLE ELSE 0 END, 1.0), 6) AS score FROM pages"""
)
def career_url_score(spark, d):
    ends = F.array(*[F.lit(x) for x in ("/careers", "/jobs", "/hiring", "/join", "/about")])
    url = F.concat(F.lit("https://a.example"), F.element_at(ends, (F.col("page_id") % 5 + 1).cast("int")))
    return table(spark, d, "pages").select("page_id", F.round(U.career_url_score(url, F.col("page_id") % 2 == 0), 6).alias("score"))


@R.add(
    r"""SELECT page_id, pos::BIGINT AS pos, href FROM (SELECT page_id, unnest(h) AS href, generate_subscripts(h, 1) - 1 AS pos
      FROM (SELECT page_id, regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1) AS h FROM pages))"""
)
def page_links_explode(spark, d):
    return table(spark, d, "pages").select("page_id", F.posexplode(U.hrefs(F.col("html"))).alias("pos", "href")).select(
        "page_id", F.col("pos").cast("long").alias("pos"), "href"
    )


@R.add(
    """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) AS href FROM pages WHERE page_id % 7 <> 0
      UNION ALL SELECT page_id, '/careers/team' FROM pages WHERE page_id % 3 = 0),
    s AS (SELECT page_id, href, CASE WHEN contains(href, 'career') THEN 0.35::DOUBLE WHEN contains(href, 'job') THEN 0.35::DOUBLE
      WHEN regexp_matches(href, 'hiring|employment|opportunities|join|work|talent|recruitment|positions|openings|apply') THEN 0.3::DOUBLE ELSE 0 END
      + CASE WHEN contains(href, 'career') THEN 0.25::DOUBLE ELSE 0 END AS score FROM l)
    SELECT page_id, max(round(CASE WHEN score > 0.2 THEN score ELSE 0 END, 6)) AS best FROM s WHERE score >= 0.5 GROUP BY page_id"""
)
def career_link_best(spark, d):
    p = table(spark, d, "pages")
    found = p.where("page_id % 7 <> 0").select("page_id", F.explode(U.hrefs(F.col("html"))).alias("href"))
    found = found.union(p.where("page_id % 3 = 0").select("page_id", F.lit("/careers/team")))
    label = F.when(F.instr("href", "career") > 0, "career").otherwise("x")
    scored = found.withColumn("score", U.career_link_score(label, F.lower("href"), F.col("href")))
    return scored.where("score >= 0.5").groupBy("page_id").agg(F.max(F.round("score", 6)).alias("best"))


@R.add(
    """SELECT page_id, contains(h, 'access denied') OR contains(h, 'blocked') OR contains(h, '403 forbidden') OR contains(h, 'captcha') OR contains(h, 'challenge')
      OR contains(h, 'cf-browser-verification') OR contains(h, 'are you a robot') AS blocked, contains(h, 'coming soon') AS parked
    FROM (SELECT page_id, lower(html || CASE WHEN page_id % 9 = 0 THEN ' CAPTCHA' WHEN page_id % 9 = 1 THEN ' Coming soon' ELSE '' END) AS h FROM pages)"""
)
def page_blocked(spark, d):
    k = F.col("page_id") % 9
    h = F.concat("html", F.when(k == 0, " CAPTCHA").when(k == 1, " Coming soon").otherwise(""))
    return table(spark, d, "pages").select(
        "page_id", T.contains_any(h, T.BLOCKED_MARKERS).alias("blocked"), T.contains_any(h, T.PARKING_PHRASES).alias("parked")
    )


@R.add(
    f"""WITH w AS (SELECT doc_id, {W} AS w FROM documents),
    k AS (SELECT doc_id, w, unnest(range(0, greatest(CAST(ceil(greatest(len(w) - 384, 0) / 346) AS BIGINT), 0) + 1)) AS i FROM w WHERE len(w) > 0)
    SELECT doc_id, printf('chunk_%03d', i) AS chunk_id, i * 346 AS start, least(i * 346 + 384, len(w)) AS "end",
      CAST(floor(least(len(w) - i * 346, 384) * 1.3::DOUBLE) AS BIGINT) AS token_count, array_to_string(w[i * 346 + 1:i * 346 + 384], ' ') AS text FROM k"""
)
def chunk_sliding(spark, d):
    return C.chunk_sliding(docs(spark, d), "doc_id", "text")


@R.add(
    """WITH s AS (SELECT doc_id, string_split(text, '.') AS p FROM documents),
    k AS (SELECT doc_id, p, unnest(range(0, CAST(floor((len(p) - 1) / 3) AS BIGINT) + 1)) AS i FROM s)
    SELECT doc_id, i, text FROM (SELECT doc_id, i, trim(array_to_string(p[i * 3 + 1:i * 3 + 3], '.')) AS text FROM k) WHERE length(text) > 50"""
)
def chunk_sentences(spark, d):
    return C.chunk_sentences(docs(spark, d), "doc_id", "text")


# The texts of the tables have neither blank lines nor bullets: each line becomes a paragraph, each fifth line a bullet.
LINED = """lined AS (SELECT doc_id AS row_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i % 5 = 0 THEN '- ' || x ELSE x END), chr(10) || chr(10)) AS text FROM documents)"""


def lined(spark, d):
    marked = F.transform(F.split("text", "\n", -1), lambda x, i: F.when(i % 5 == 4, F.concat(F.lit("- "), x)).otherwise(x))
    return docs(spark, d).select(F.col("doc_id").alias("row_id"), F.array_join(marked, "\n\n").alias("text"))


def words_sql(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda w: w <> '')"


def tokens_sql(n: str) -> str:
    return f"CAST(floor(({n}) * 1.3::DOUBLE) AS BIGINT)"


def paragraphs_sql(source: str, name: str) -> str:
    """(row_id, section, i, part, w, t, fin): the paragraphs of ``source`` (row_id, section, text), their words and tokens."""
    parted = rf"""string_split(regexp_replace(regexp_replace(text, '\n\s*\n', chr(1), 'g'), '(^|\n)(\s*[•*-])', chr(1) || '\2', 'g'), chr(1))"""
    trimmed = rf"list_filter(list_transform({parted}, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '')"
    return f"""{name}_l AS (SELECT row_id, section, {trimmed} AS parts FROM {source}),
    {name}_u AS (SELECT row_id, section, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM {name}_l),
    {name}_w AS (SELECT *, len({words_sql("part")}) AS w FROM {name}_u),
    {name} AS (SELECT *, {tokens_sql("w")} AS t, sum(w) OVER (PARTITION BY row_id, section ORDER BY i) AS fin FROM {name}_w)"""


def semantic_sql(source: str, cfg: C.ChunkConfig) -> str:
    """sem (row_id, section, grp, text, token_count): a walk over the paragraphs that knows when a run was closed."""
    return f"""{paragraphs_sql(source, "pp")},
    walk AS (SELECT row_id, section, i, 1 AS grp, 0::HUGEINT AS bgn, t AS size FROM pp WHERE i = 1
      UNION ALL SELECT row_id, section, i, CASE WHEN shut THEN grp + 1 ELSE grp END, CASE WHEN shut THEN fresh ELSE bgn END,
        CASE WHEN shut THEN {tokens_sql("fin - fresh")} ELSE size + t END
      FROM (SELECT p.row_id, p.section, p.i, p.t, p.fin, g.grp, g.bgn, g.size, g.size >= {cfg.min_tokens} AND g.size + p.t > {cfg.max_tokens} AS shut,
        greatest(g.bgn, p.fin - p.w - {cfg.overlap}) AS fresh FROM walk g JOIN pp p ON p.row_id = g.row_id AND p.section = g.section AND p.i = g.i + 1)),
    line AS (SELECT row_id, section, {words_sql("string_agg(part, ' ' ORDER BY i)")} AS ws FROM pp GROUP BY row_id, section),
    runs AS (SELECT w.row_id, w.section, grp, max(bgn) AS bgn, max_by(size, w.i) AS size, min(fin - p.w) AS start, string_agg(part, chr(10) || chr(10) ORDER BY w.i) AS body
      FROM walk w JOIN pp p ON p.row_id = w.row_id AND p.section = w.section AND p.i = w.i GROUP BY w.row_id, w.section, grp),
    sem AS (SELECT r.row_id, r.section, grp, CASE WHEN bgn < start THEN array_to_string(ws[bgn + 1:start], ' ') || ' ' ELSE '' END || body AS text, size AS token_count
      FROM runs r JOIN line USING (row_id, section) WHERE size >= {cfg.min_tokens})"""


def sliding_sql(source: str, name: str, cfg: C.ChunkConfig) -> str:
    """(row_id, section, k, text, token_count): word windows of ``source``."""
    last = f"greatest(CAST(ceil((len(ws) - {cfg.words}) / {cfg.step}) AS BIGINT), 0)"
    return f"""{name}_w AS (SELECT row_id, section, {words_sql("text")} AS ws FROM {source}),
    {name}_k AS (SELECT row_id, section, ws, {last} AS last, unnest(range(0, {last} + 1)) AS k FROM {name}_w WHERE len(ws) > 0),
    {name} AS (SELECT row_id, section, k, array_to_string(ws[k * {cfg.step} + 1:k * {cfg.step} + {cfg.words}], ' ') AS text,
      {tokens_sql(f"least(len(ws) - k * {cfg.step}, {cfg.words})")} AS token_count FROM {name}_k
      WHERE k = last OR least(len(ws) - k * {cfg.step}, {cfg.words}) >= {cfg.min_tokens} / 1.3::DOUBLE)"""


SEMANTIC = C.ChunkConfig(strategy="semantic", max_tokens=200, overlap_tokens=30, min_tokens=40)


@R.add(
    f"""WITH RECURSIVE {LINED}, src AS (SELECT row_id, '' AS section, text FROM lined), {semantic_sql("src", SEMANTIC)}
    SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY grp) - 1 AS i, section, text, token_count FROM sem"""
)
def chunk_semantic(spark, d):
    return C.chunk(lined(spark, d), "row_id", "text", SEMANTIC)


# Sections of each text: all of it as experience, then all of it as skills. The word license would begin another one.
SECTIONED = """sectioned AS (SELECT row_id, trim('Experience' || chr(10) || replace(text, 'icense', 'icence'), ' ' || chr(9) || chr(10) || chr(13)) AS experience,
      trim('Skills' || chr(10) || replace(text, 'icense', 'icence'), ' ' || chr(9) || chr(10) || chr(13)) AS skills FROM {of})"""


def sectioned(df):
    text = F.replace("text", F.lit("icense"), F.lit("icence"))
    made = F.concat(F.lit("Experience\n"), text, F.lit("\nSkills\n"), text)
    return df.select("row_id", made.alias("text"))


HYBRID_CHUNKS = C.ChunkConfig(strategy="hybrid")


@R.add(
    f"""WITH RECURSIVE {LINED}, {SECTIONED.format(of="lined")},
    src AS (SELECT row_id, 'experience' AS section, 'Experience:' || chr(10) || experience AS text FROM sectioned
      UNION ALL SELECT row_id, 'skills', 'Skills:' || chr(10) || skills FROM sectioned), {semantic_sql("src", HYBRID_CHUNKS)}
    SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY section, grp) - 1 AS i, section, text, token_count FROM sem"""
)
def chunk_hybrid(spark, d):
    return C.chunk(sectioned(lined(spark, d)), "row_id", "text", HYBRID_CHUNKS)


BY_SECTION = C.ChunkConfig(strategy="section_based")
# RE2 looks nothing ahead: what follows the line break is put back, twice, as matches may touch.
ENTRY_SQL = "text"
for _pattern in C.ENTRY_STARTS:
    _follows = _pattern.replace(r"\n(?=", "").removesuffix(")")
    for _ in range(2):
        ENTRY_SQL = rf"regexp_replace({ENTRY_SQL}, '\n({_follows})', chr(1) || '\1', 'g')"


@R.add(
    f"""WITH src0 AS (SELECT doc_id AS row_id, text FROM documents), {SECTIONED.format(of="src0")},
    body AS (SELECT row_id, 'experience' AS section, experience AS text FROM sectioned UNION ALL SELECT row_id, 'skills', skills FROM sectioned),
    sized AS (SELECT *, {tokens_sql(f"len({words_sql('text')})")} AS t FROM body),
    parted AS (SELECT row_id, section, unnest(string_split({ENTRY_SQL}, chr(1))) AS text, generate_subscripts(string_split({ENTRY_SQL}, chr(1)), 1) AS e
      FROM sized WHERE t > {BY_SECTION.max_tokens} AND section = 'experience'),
    entry AS (SELECT row_id, section, e, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS text, {tokens_sql(f"len({words_sql('text')})")} AS t FROM parted),
    long AS (SELECT row_id, section || '/' || e AS section, text FROM entry WHERE t > {BY_SECTION.max_tokens}
      UNION ALL SELECT row_id, section || '/0', text FROM sized WHERE t > {BY_SECTION.max_tokens} AND section = 'skills'), {sliding_sql("long", "win", BY_SECTION)},
    every AS (SELECT row_id, section, 0 AS e, 0 AS k, text, t AS token_count FROM sized WHERE t <= {BY_SECTION.max_tokens}
      UNION ALL SELECT row_id, section, e, 0, text, t FROM entry WHERE t BETWEEN {BY_SECTION.min_tokens} AND {BY_SECTION.max_tokens}
      UNION ALL SELECT row_id, split_part(section, '/', 1), CAST(split_part(section, '/', 2) AS BIGINT), k, text, token_count FROM win)
    SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY section, e, k) - 1 AS i, section, text, token_count FROM every"""
)
def chunk_by_section(spark, d):
    return C.chunk(sectioned(docs(spark, d).select(F.col("doc_id").alias("row_id"), "text")), "row_id", "text", BY_SECTION)


SMALL = C.ChunkConfig(strategy="paragraph", max_tokens=120, min_tokens=40)


@R.add(
    f"""WITH RECURSIVE {LINED}, src AS (SELECT row_id, '' AS section, text FROM lined), {paragraphs_sql("src", "pp")},
    walk AS (SELECT row_id, i, 1 AS grp, w, t < {SMALL.min_tokens} AS small FROM pp WHERE i = 1
      UNION ALL SELECT row_id, i, CASE WHEN goes THEN grp ELSE grp + 1 END, CASE WHEN goes THEN held + w ELSE w END, small
      FROM (SELECT p.row_id, p.i, p.w, p.t < {SMALL.min_tokens} AS small, g.grp, g.w AS held, g.small AND p.t < {SMALL.min_tokens} AND {tokens_sql("g.w + p.w")} <= {SMALL.max_tokens} AS goes
        FROM walk g JOIN pp p ON p.row_id = g.row_id AND p.i = g.i + 1))
    SELECT row_id, grp - 1 AS i, '' AS section, string_agg(part, chr(10) || chr(10) ORDER BY w.i) AS text, {tokens_sql("sum(p.w)")} AS token_count
    FROM walk w JOIN pp p USING (row_id, i) GROUP BY row_id, grp"""
)
def chunk_merge_small(spark, d):
    return C.chunk(lined(spark, d), "row_id", "text", SMALL, merge=True)


@R.add(
    r"""WITH t AS (SELECT item_id, 'Intro ' || text || ' Education at ' || text || ' Skills: ' || text AS t FROM benchmark)
    SELECT item_id, trim(regexp_extract(t, '(?s)(Education .*) Skills: ', 1), ' ' || chr(10)) AS education, trim('Skills' || regexp_extract(t, '(?s) Skills(: .*)$', 1), ' ' || chr(10)) AS skills FROM t"""
)
def section_extract(spark, d):
    t = F.concat(F.lit("Intro "), "text", F.lit(" Education at "), "text", F.lit(" Skills: "), "text")
    found = table(spark, d, "benchmark").select("item_id", T.sections(t).alias("s"))
    return found.select("item_id", F.col("s.education").alias("education"), F.col("s.skills").alias("skills"))


@R.add(
    """SELECT doc_id, k::BIGINT AS pos, round(CAST('0x' || substr(sha256(text), 8 * k + 1, 8) AS BIGINT) / 4294967296.0::DOUBLE * 2 - 1, 9) AS x
    FROM documents, (SELECT unnest(range(0, 8)) AS k)"""
)
def hash_embedding(spark, d):
    vec = docs(spark, d).select("doc_id", F.posexplode(F.slice(V.hash_embedding(F.col("text")), 1, 8)).alias("pos", "x"))
    return vec.select("doc_id", F.col("pos").cast("long").alias("pos"), F.round("x", 9).alias("x"))


@R.add(
    """SELECT item_id, round(list_sum(list_transform(range(1, 385), lambda i: CASE WHEN i <= length(text) THEN ord(substr(text, i, 1)) % 256 / 256.0::DOUBLE ELSE 0 END)), 6) AS total FROM benchmark"""
)
def char_embedding_mass(spark, d):
    v = V.char_embedding(F.col("text"))
    return table(spark, d, "benchmark").select("item_id", F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@R.add(
    """WITH t AS (SELECT doc_id, text FROM documents), u AS (SELECT text, count(*) AS n, min(doc_id) AS first FROM t GROUP BY text)
    SELECT t.doc_id, u.first AS embedded_as, u.n AS copies FROM t JOIN u ON t.text = u.text"""
)
def embed_dedupe_map(spark, d):
    from larkmill.operators.embedding import dedupe_map

    return dedupe_map(docs(spark, d), "doc_id", "text")


@R.add(
    r"""WITH c AS (SELECT text FROM documents WHERE doc_id % 3 = 0)
    SELECT doc_id, CASE WHEN text IN (SELECT text FROM c) THEN 'cache' ELSE 'computed' END AS source, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))::BIGINT AS tokens,
      list_transform(range(0, 8), lambda k: round(CAST('0x' || substr(sha256(text), 8 * k + 1, 8) AS BIGINT) / 4294967296.0::DOUBLE * 2 - 1, 9)) AS vector FROM documents"""
)
def embed_batch_with_cache(spark, d):
    from larkmill.operators.embedding import embed

    cached = docs(spark, d).where("doc_id % 3 = 0").select(F.sha2("text", 256).alias("text_key"), V.hash_embedding(F.col("text"), 8).alias("vector"))
    found = embed(docs(spark, d), "doc_id", "text", "hash", dimensions=8, cache=cached)
    return found.withColumn("vector", F.transform("vector", lambda x: F.round(x, 9)))


COS = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"


@R.add(
    f"""WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0),
    s AS (SELECT a.vec_id AS query_id, b.vec_id AS base_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM q a, embeddings b WHERE a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 12) DESC, base_id) AS rank FROM s)
    SELECT query_id, rank, base_id, round(c, 6) AS score FROM r WHERE rank <= 10"""
)
def vector_topk_exact(spark, d):
    e = table(spark, d, "embeddings")
    found = nearest_exact(e.where("vec_id % 50 = 0"), "vec_id", "embedding", e, "vec_id", "embedding", 11)
    kept = found.where("query_id <> base_id")
    from larkmill.operators.retrieval import top_k

    again = top_k(kept.drop("rank"), "query_id", 10, F.desc(F.round("score", 12)), F.asc("base_id"))
    return again.select("query_id", F.col("rank").cast("long").alias("rank"), "base_id", F.round("score", 6).alias("score"))


@R.add()
def vector_topk_lists(spark, d):
    """The same by inverted lists, of which only the nearest are probed, each vector with itself; not exact, so without SQL."""
    e = table(spark, d, "embeddings")
    return nearest_in_lists(e.where("vec_id % 50 = 0"), "vec_id", "embedding", e, "vec_id", "embedding", 11)


@R.add(
    D.with_ctes(D.CHUNKS, D.RESUMES)
    + """, s AS (SELECT resume_id, job_id, round(list_cosine_similarity(resume_vector::DOUBLE[], embedding::DOUBLE[]), 6) AS score
      FROM resumes JOIN chunks ON job_id % (SELECT count(*) FROM resumes) = resume_id)
    SELECT resume_id, job_id, max(score) AS score, count(*) AS n_rows FROM s GROUP BY resume_id, job_id"""
)
def vector_max_per_job(spark, d):
    resumes = D.resumes(spark, d)
    pairs = resumes.join(D.chunks(spark, d), F.col("job_id") % resumes.count() == F.col("resume_id"))
    scored = pairs.select("resume_id", "job_id", F.round(V.cosine(F.col("resume_vector"), F.col("embedding")), 6).alias("score"))
    return best_per_group(scored, ["resume_id", "job_id"], "score")


@R.add(
    """SELECT * FROM (SELECT a.vec_id AS a, b.vec_id AS b, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dist
    FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.vec_id % 100 = 0) WHERE dist <= 1.25"""
)
def vector_l2_range(spark, d):
    """Every hundredth vector against all of its label."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    return within_distance(e.where("id % 100 = 0"), e, ["label"], 1.25)


@R.add(
    """WITH c AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i)
    SELECT label::BIGINT AS label, list(round(m, 6) ORDER BY i) AS mean FROM c GROUP BY label"""
)
def centroid_by_label(spark, d):
    m = mean_vector(table(spark, d, "embeddings"), ["label"], "embedding")
    return m.select(F.col("label").cast("long").alias("label"), F.transform("mean", lambda x: F.round(x, 6)).alias("mean"))


@R.add(
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS o, list_transform(embedding::DOUBLE[], lambda x, i: x + 0.02 * ((vec_id * 7 + i - 1) % 5)) AS n FROM embeddings),
    p AS (SELECT round(list_dot_product(a.o, b.o), 9) AS x, round(list_dot_product(a.n, b.n), 9) AS y FROM v a JOIN v b ON a.vec_id % 100 = 0 AND CASE WHEN b.vec_id % 100 = 0 THEN a.vec_id < b.vec_id ELSE true END),
    r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM p)
    SELECT round(least(1, greatest(0, (corr(rx, ry) + 1) / 2)), 6) AS compatibility, count(*) AS pairs FROM r"""
)
def similarity_preservation_spearman(spark, d):
    """Every hundredth vector with all others."""
    from larkmill.operators.embedding import similarity_preservation

    v = table(spark, d, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("old"),
        F.transform("embedding", lambda x, i: x.cast("double") + 0.02 * ((F.col("vec_id") * 7 + i) % 5)).alias("new"),
    )
    return similarity_preservation(v, "vec_id", "old", "new", F.col("vec_id") % 100 == 0)


@R.add(
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS o, list_transform(embedding::DOUBLE[], lambda x, i: x + 0.02 * ((vec_id * 7 + i - 1) % 5)) AS n FROM embeddings),
    p AS (SELECT greatest(0, least(65535, floor((list_dot_product(a.o, b.o) + 2) * 16384))) AS x, greatest(0, least(65535, floor((list_dot_product(a.n, b.n) + 2) * 16384))) AS y
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND CASE WHEN b.vec_id % 100 = 0 THEN a.vec_id < b.vec_id ELSE true END),
    r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM p),
    h AS (SELECT 0 AS side, count(*)::DOUBLE AS c FROM p GROUP BY x UNION ALL SELECT 1, count(*)::DOUBLE FROM p GROUP BY y),
    e AS (SELECT side, sqrt(sum(c * c * c - c) / (sum(c) * sum(c) * sum(c) - sum(c))) AS e FROM h GROUP BY side)
    SELECT round(least(1, greatest(0, (corr(rx, ry) + 1) / 2)), 6) AS compatibility, count(*) AS pairs, (SELECT round(sum(e), 9) FROM e) AS error FROM r"""
)
def similarity_preservation_in_classes(spark, d):
    """The same without a stored pair, to an error that is told with it."""
    from larkmill.operators.embedding import preserved_in_classes

    v = table(spark, d, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("old"),
        F.transform("embedding", lambda x, i: x.cast("double") + 0.02 * ((F.col("vec_id") * 7 + i) % 5)).alias("new"),
    )
    found = preserved_in_classes(v, "vec_id", "old", "new", F.col("vec_id") % 100 == 0, reach=2.0)
    return found.withColumn("error", F.round("error", 9))


@R.add(
    """WITH t AS (SELECT a.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
    SELECT round(coalesce(avg(abs(c)), 0.5), 6) AS compatibility, count(*) AS pairs FROM t"""
)
def paired_cosine_compatibility(spark, d):
    from larkmill.operators.embedding import paired_compatibility

    e = table(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("new"))
    return paired_compatibility(e.join(b, "vec_id"), "embedding", "new")


# Scores are lifted off exact halves of the last digit, which sums in another order may miss.
FTS = f"""WITH q AS (SELECT item_id AS query_id, list_distinct({TERMS}[1:{{n}}]) AS terms FROM benchmark),
    w AS (SELECT query_id, len(terms) AS n_terms, unnest(terms) AS term FROM q),
    t AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')) AS term FROM documents),
    c AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM w) GROUP BY doc_id, term)
    SELECT query_id, doc_id, n_terms::BIGINT AS n_terms, count(*) AS n_found, round(sum(tf / (tf + 1)) / n_terms + 1e-9::DOUBLE, 6) AS fts_score
    FROM w JOIN c USING (term) GROUP BY query_id, doc_id, n_terms"""


@R.add(FTS.format(n=20) + " HAVING count(*) = n_terms")
def fts_all_terms(spark, d):
    q = table(spark, d, "benchmark")
    found = match_terms(q, "item_id", T.query_terms(F.col("text")), docs(spark, d), "doc_id", "text", "all")
    return found.withColumn("fts_score", F.round(F.col("fts_score") + 1e-9, 6))


@R.add(FTS.format(n=20))
def fts_any_terms(spark, d):
    q = table(spark, d, "benchmark")
    found = match_terms(q, "item_id", T.query_terms(F.col("text")), docs(spark, d), "doc_id", "text", "any")
    return found.withColumn("fts_score", F.round(F.col("fts_score") + 1e-9, 6))


@R.add()
def fts_stemmed_terms(spark, d):
    """The same over Porter stems. SQL has no stemmer; a test walks over all texts."""
    found = match_stems(table(spark, d, "benchmark"), "item_id", T.query_terms(F.col("text")), docs(spark, d), "doc_id", "text")
    return found.withColumn("fts_score", F.round(F.col("fts_score") + 1e-9, 6))
