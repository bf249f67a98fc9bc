"""Literal cases of the scalar functions."""

import json

import pytest
from pyspark.sql import functions as F

from larkmill.functions import arrays as A
from larkmill.functions import dates as DT
from larkmill.functions import scores as S
from larkmill.functions import text as T
from larkmill.functions import urls as U
from larkmill.functions import vectors as V
from larkmill.functions.stemming import stem
from larkmill.operators import chunking as C
from larkmill.operators import templates as TP


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("write a@b.com or c.d@e.org", "write [EMAIL] or [EMAIL]"),
        ("call (555) 123-4567", "call [PHONE]"),
        ("id 123-45-6789 end", "id [SSN] end"),
        ("at 12 Oak Street now", "at [ADDRESS] now"),
        ("at 12 Oak Ln", "at [ADDRESS]"),
        ("", ""),
        (None, None),
        ("example.com and extension 1234", "example.com and extension 1234"),
    ],
)
def test_redact(spark, text, want):
    assert value(spark, T.redact(F.lit(text).cast("string"))) == want


def test_cosine(spark):
    vec = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    cos = lambda a, b: value(spark, V.cosine(a, b))
    assert cos(vec(1, 2), vec(2, 4)) == pytest.approx(1)
    assert cos(vec(1, 0), vec(0, 1)) == pytest.approx(0)
    assert cos(vec(1, 0), vec(-1, 0)) == pytest.approx(-1)
    assert cos(vec(0, 0), vec(1, 0)) == 0
    assert cos(vec(1), vec(1, 0)) == 0


@pytest.mark.parametrize(("url", "low", "high"), [("https://a/careers", 0.8, 1), ("https://a/jobs", 0.7, 1), ("https://a/hiring", 0.6, 1), ("https://a/about", -1, 0.5)])
def test_career_url(spark, url, low, high):
    score = value(spark, U.career_url_score(F.lit(url), F.lit(True)))
    assert low < score <= high


def test_career_link_about_is_zero(spark):
    assert value(spark, U.career_link_score(F.lit("about us"), F.lit("/about"), F.lit("/about"))) == 0


def test_same_domain_and_normal_form(spark):
    assert value(spark, U.same_domain(F.lit("https://www.a.com/x"), F.lit("http://a.com")))
    assert not value(spark, U.same_domain(F.lit("https://a.com"), F.lit("https://b.com")))
    assert value(spark, U.normalize(F.lit("a.com/#x"))) == "https://a.com/"
    assert value(spark, U.normalize(F.lit("http://a.com///"))) == "http://a.com"


@pytest.mark.parametrize(
    ("careers", "site", "name", "want"),
    [
        ("https://boards.greenhouse.io/acme?x", None, None, "acme"),
        ("https://jobs.lever.co/beta/1", None, None, "beta"),
        ("https://x.workday.com/y", None, None, "https://x.workday.com/y"),
        ("https://other/x", "https://www.gamma.com/z", None, "gamma"),
        ("", None, "My Firm, Inc.", "my-firm-inc"),
        ("", None, None, "unknown-company"),
    ],
)
def test_tenant(spark, careers, site, name, want):
    lit = lambda x: F.lit(x).cast("string")
    assert value(spark, U.tenant(lit(careers), lit(site), lit(name))) == want


@pytest.mark.parametrize("name", ["profile.email", "profile.first_name", "files.resume", "answers.a1", "company_host"])
def test_allowed_variables(spark, name):
    assert value(spark, TP.allowed_variable(F.lit(name)))


@pytest.mark.parametrize("name", ["profile.password", "profile.secret_key", "profile.token", "system.x", "profile.", "answers.1a", "__x__", "files.a-b"])
def test_rejected_variables(spark, name):
    assert not value(spark, TP.allowed_variable(F.lit(name)))


def test_sanitize(spark):
    assert value(spark, TP.sanitize(F.lit('a "b" <c>'))) == "a &quot;b&quot; &lt;c&gt;"
    assert value(spark, TP.sanitize(F.lit("https://a.b/c?d=e@f g"), "url")) == "https://a.b/c?d=e@f%20g"
    assert value(spark, TP.sanitize(F.lit("<script>x</script>"))) is None


def test_slug_salary_and_phone(spark):
    assert value(spark, T.slug(F.lit("Acme & Sons, Inc"))) == "acme-sons"
    assert value(spark, T.salary_range(F.lit(1234.5), F.lit(0.0))) == "$1,234+"
    assert value(spark, T.salary_range(F.lit(1000.0), F.lit(2000.0), " - ")) == "$1,000 - $2,000"
    assert value(spark, T.salary_range(F.lit(0.0), F.lit(None).cast("double"))) is None
    assert value(spark, T.phone_format(F.lit("1-555-123-4567"))) == "(555) 123-4567"


def test_years(spark):
    assert value(spark, T.years_of_experience(F.lit("7+ years of experience, 3 yrs"), 2024)) == 7
    assert value(spark, T.years_of_experience(F.lit("since 2015"), 2024)) == 7
    assert value(spark, T.years_of_experience(F.lit("60 years in"), 2024)) == 20
    assert value(spark, T.years_of_experience(F.lit(None).cast("string"), 2024)) == 0


def test_experience_and_action(spark):
    exp = lambda y, s: value(spark, S.experience_score(F.lit(y), F.lit(s).cast("string")))
    assert exp(5.0, "senior") == 1 and exp(2.5, "Lead") == pytest.approx(0.35) and exp(0.0, "mid") == pytest.approx(0.1)
    assert exp(3.0, None) == 0.5
    assert value(spark, S.action(F.lit(90), F.lit(0.85))) == "APPLY_HIGH"
    assert value(spark, S.action(F.lit(90), F.lit(0.1))) == "SKIP"


def test_seniority_fit(spark):
    fit = lambda y, s: value(spark, S.seniority_fit(F.lit(float(y)), F.lit(s)))
    assert fit(3, "mid") == 1 and fit(1, "mid") == 0.5 and fit(30, "mid") == 0.7 and fit(7, "mid") == pytest.approx(0.9)


def test_dates_and_arrays(spark):
    assert value(spark, DT.month(F.lit("2020"))) == "2020-01"
    assert value(spark, DT.is_current(F.lit(" NOW ")))
    assert value(spark, F.date_format(DT.parse_any(F.lit("Mon, 05 Feb 2024 10:00:00 GMT")), "yyyy-MM-dd HH")) == "2024-02-05 10"
    assert value(spark, F.date_format(DT.parse_any(F.lit("1704067200")), "yyyy-MM-dd")) == "2024-01-01"
    assert value(spark, A.missing({"a": F.lit(""), "b": F.lit("x"), "c": F.lit(None).cast("string")})) == ["a", "c"]
    assert value(spark, A.dotted(F.lit('{"a":{"b":3}}'), "a.b")) == "3"


@pytest.mark.parametrize(
    ("word", "want"),
    [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"),
     ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("goodness", "good"), ("adjustment", "adjust"),
     ("adoption", "adopt"), ("controll", "control"), ("rate", "rate"), ("sky", "sky"), ("happy", "happi")],
)
def test_stem(word, want):
    assert stem(word) == want


def test_chunks():
    cfg = C.ChunkConfig(max_tokens=100, overlap_tokens=20, min_tokens=10)
    words = " ".join(f"w{i}" for i in range(500))
    parts = C.sliding(words, cfg)
    assert all(n <= 100 for _, n in parts)
    assert " ".join(parts[0][0].split()[-cfg.overlap :]) == " ".join(parts[1][0].split()[: cfg.overlap])
    assert parts[-1][0].endswith("w499")
    assert C.merge_small([("a b", 2), ("c d", 2), ("x " * 30, 39), ("e", 1)], cfg) == [("a b\n\nc d", 5), ("x " * 30, 39), ("e", 1)]
    assert C.semantic("", cfg) == [] and C.sliding("", cfg) == []
    packed = C.semantic("\n\n".join("word " * 40 for _ in range(4)), cfg)
    assert len(packed) > 1 and all(n >= cfg.min_tokens for _, n in packed)
    assert [s for s, _, _ in C.by_section("x", {"skills": "python sql"}, cfg)] == ["skills"]


def test_sections(spark):
    found = value(spark, T.sections(F.lit("Intro. Experience at X. Skills: y")))
    assert found == {"experience": "Experience at X.", "skills": "Skills: y"}


def test_field_rules(spark):
    form = TP.FormBuilder("t", "p").section("s").field("f", "a.b", css_selector="#f", transform="title").to_json()
    people = spark.createDataFrame([(1, json.dumps({"a": {"b": "ann lee"}})), (2, "{}"), (3, "not json")], "id int, data string")
    rows = TP.map_fields(spark.createDataFrame([(1, form)], "k int, body string"), "k", "body", people, "id", "data").collect()
    assert {r["id"]: r["value"] for r in rows} == {1: "Ann Lee", 2: None, 3: None}
