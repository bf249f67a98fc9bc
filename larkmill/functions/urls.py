"""URL expressions: hosts, normal forms, portals, tenants and career-page scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PORTAL_PATTERNS = (
    ("greenhouse", r"boards\.greenhouse\.io/|gh_src|greenhouse\.io/embed"),
    ("lever", r"jobs\.lever\.co/|lever\.co/careers"),
    ("workday", r"myworkdayjobs\.com/|wd1\.myworkdayjobs\.com"),
    ("ashby", r"jobs\.ashbyhq\.com/"),
    ("icims", r"careers\.icims\.com/"),
)
CAREER_KEYWORDS = (
    "career", "careers", "job", "jobs", "hiring", "employment", "opportunities", "join", "work", "talent",
    "recruitment", "positions", "openings", "apply",
)
ALLOWED_DOMAINS = (
    "greenhouse.io", "lever.co", "workday.com", "myworkdayjobs.com", "bamboohr.com", "successfactors.com",
    "oracle.com", "taleo.net",
)


def host(url: Column) -> Column:
    """Lower-case host with port, as between the slashes; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def domain(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def same_domain(a: Column, b: Column) -> Column:
    bare = lambda u: F.replace(host(u), F.lit("www."), F.lit(""))
    return bare(a) == bare(b)


def normalize(url: Column) -> Column:
    """Trailing slashes go first, then the fragment, then a scheme is added."""
    cut = F.split_part(F.regexp_replace(url, "/+$", ""), F.lit("#"), F.lit(1))
    return F.when(cut.startswith("http://") | cut.startswith("https://"), cut).otherwise(F.concat(F.lit("https://"), cut))


def absolute(href: Column, base: Column) -> Column:
    origin = F.regexp_extract(base, r"^https?://[^/]+", 0)
    return F.when(href.startswith("http"), href).when(href.startswith("/"), F.concat(origin, href)).otherwise(href)


def portal_base(family: str, company: Column) -> Column:
    """Where a portal family keeps the board of a company (name or domain); a full URL stays."""
    name = company if family == "workday" else F.split_part(company, F.lit("."), F.lit(1))
    pattern = {
        "greenhouse": ("https://boards.greenhouse.io/", ""),
        "lever": ("https://jobs.lever.co/", ""),
        "workday": ("https://", "/jobs"),
    }[family]
    return F.when(company.startswith("http"), company).otherwise(F.concat(F.lit(pattern[0]), name, F.lit(pattern[1])))


def detect_portal(html: Column) -> Column:
    """(portal, ordinal) of the first pattern set that matches; custom otherwise."""
    low = F.lower(F.coalesce(html, F.lit("")))
    out = None
    for k, (name, pattern) in enumerate(PORTAL_PATTERNS, 1):
        value = F.struct(F.lit(name).alias("portal"), F.lit(k).alias("ordinal"))
        out = F.when(low.rlike(pattern), value) if out is None else out.when(low.rlike(pattern), value)
    return out.otherwise(F.struct(F.lit("custom").alias("portal"), F.lit(0).alias("ordinal")))


def scraper_type(url: Column) -> Column:
    low = F.lower(url)
    return (
        F.when(low.contains("greenhouse.io"), "greenhouse")
        .when(low.contains("lever.co"), "lever")
        .when(low.contains("myworkdayjobs.com"), "workday")
        .otherwise("custom")
    )


def job_source(url: Column) -> Column:
    low = F.lower(url)
    return (
        F.when(low.contains("greenhouse"), "greenhouse")
        .when(low.contains("lever"), "lever")
        .when(low.contains("workday"), "workday")
        .otherwise("company_site")
    )


def tenant(careers_url: Column, website: Column, name: Column) -> Column:
    """Company key on its portal: from the careers URL, else the website, else the name."""
    url = F.coalesce(careers_url, F.lit(""))
    own = F.nullif(
        F.when(url.contains("greenhouse.io"), F.regexp_extract(url, r"greenhouse\.io/([^/?]+)", 1))
        .when(url.contains("lever.co"), F.regexp_extract(url, r"lever\.co/([^/?]+)", 1))
        .when(url.contains("workday"), url),
        F.lit(""),
    )
    site = F.regexp_replace(F.regexp_replace(F.lower(website), "^https?://", ""), r"^www\.", "")
    site_name = F.split_part(F.split_part(site, F.lit("/"), F.lit(1)), F.lit("."), F.lit(1))
    cleaned = F.regexp_replace(F.trim(F.regexp_replace(F.lower(name), r"[^a-zA-Z0-9\s]", "")), r"\s+", "-")
    return F.coalesce(
        own, F.when(website != "", site_name), F.when(name != "", cleaned), F.lit("unknown-company")
    )


def career_url_score(url: Column, is_html: Column) -> Column:
    low = F.lower(url)
    some = lambda *xs: low.rlike("|".join(xs))
    score = (
        F.when(low.contains("/careers"), 0.9)
        .when(low.contains("/jobs"), 0.8)
        .when(some("/hiring", "/employment", "/opportunities"), 0.7)
        .when(some("/join", "/work", "/talent"), 0.6)
        .otherwise(0.0)
    )
    exact = F.when(low.endswith("/careers") | low.endswith("/jobs"), 0.1).otherwise(0.0)
    return F.least(score + exact + F.when(is_html, 0.1).otherwise(0.0), F.lit(1.0))


def _first_keyword(text: Column, tiers: tuple[float, float, float]) -> Column:
    out = None
    for word in CAREER_KEYWORDS:
        value = tiers[0] if word in ("careers", "jobs") else tiers[1] if word in ("career", "job") else tiers[2]
        hit = F.instr(text, word) > 0
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(0.0)


def career_link_score(link_text: Column, url_path: Column, href: Column) -> Column:
    """The first keyword of the list decides for the text and for the path; 0 up to 0.2."""
    score = _first_keyword(link_text, (0.3, 0.25, 0.2)) + _first_keyword(url_path, (0.4, 0.35, 0.3))
    score = F.when(F.length(href) > 100, score * 0.8).otherwise(score)
    return F.when(score > 0.2, score).otherwise(0.0)


def allowed_domain(url: Column, domains=ALLOWED_DOMAINS) -> Column:
    """Exact or parent domain on the list; a URL with a template variable passes."""
    own = domain(url)
    hit = F.lit(False)
    for d in domains:
        hit = hit | (own == d) | own.endswith(f".{d}")
    return (url.contains("{{") & url.contains("}}")) | hit


def page_total(html: Column) -> Column:
    """Pages of a listing: the largest numeric label, else the y of "page x of y", else 1."""
    labels = F.transform(F.regexp_extract_all(html, F.lit(r">\s*(\d{1,6})\s*<"), F.lit(1)), lambda x: x.cast("int"))
    named = F.regexp_extract(F.lower(html), r"page\s+\d+\s+of\s+(\d+)", 1).try_cast("int")
    return F.coalesce(F.array_max(labels), named, F.lit(1))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"<a\s[^>]*href=\"([^\"]*)\""), F.lit(1))
