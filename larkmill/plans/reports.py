"""Reports: digests, reviews, version differences, templates, dates and nested values."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from larkmill.functions import dates as DT
from larkmill.functions import text as T
from larkmill.operators import digest as DG
from larkmill.operators import review as RV
from larkmill.operators import templates as TP
from larkmill.plans import domain as D
from larkmill.plans.registry import Registry
from larkmill.session import table

R = Registry()
PORTAL_ROWS = [
    (1, json.dumps({"version": "1", "meta": {"description": "d", "author": "a"}, "start": {"url": "https://boards.greenhouse.io/x"},
                    "steps": [{"id": "s1", "action": "type", "selector": "#e", "value": "{{ profile.email }}"}]})),
    (2, json.dumps({"version": "1", "meta": {}, "start": {"url": "https://evil.example/x"},
                    "steps": [{"action": "script", "script": "window.open()"}, {"id": "w", "action": "wait", "timeoutMs": 20000},
                              {"id": "c", "action": "click", "value": "{{profile.password}}"}]})),
    (3, json.dumps({"version": "1", "meta": {"description": "d"}, "start": {"url": "https://{{company_host}}/x"},
                    "steps": [{"id": f"s{i}", "action": "click", "selector": "a"} for i in range(101)]})),
]
OF_SUPPLIERS = "SELECT s_suppkey AS id, t.* EXCLUDE (k) FROM supplier JOIN "


def portal_templates(spark, d):
    """A template for each supplier: a sound one, a dangerous one, or one with too many steps."""
    body = F.element_at(F.array(*[F.lit(b) for _, b in PORTAL_ROWS]), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), body.alias("body"))


FORM = (
    TP.FormBuilder("t1", "greenhouse").section("main")
    .field("name", "name", css_selector="#n", transform="upper")
    .field("mail", "contact.email", css_selector="#m", rules=["email_format"])
    .field("phone", "contact.phone", css_selector="#p", transform="format_phone", default_value="5551234567")
    .field("lang", "lang", css_selector="#l", field_type="select", options=["German", "English", "de", "fr"])
    .field("extra", "lang", css_selector="#x", condition="lang == 'en'")
    .to_json()
)


@R.add(
    D.with_ctes(D.MATCHES)
    + """SELECT resume_id, count(*) FILTER (i) AS new_matches, count(*) FILTER (i AND action = 'APPLY_HIGH') AS high_priority, count(*) FILTER (i AND action = 'REVIEW') AS pending
    FROM (SELECT *, scored_at >= TIMESTAMP '2024-01-14' AND scored_at < TIMESTAMP '2024-01-15' AS i FROM matches) GROUP BY resume_id"""
)
def digest_daily(spark, d):
    start, end = DG.previous_day(F.lit("2024-01-15 09:30:00").cast("timestamp_ntz"))
    return DG.counters(D.matches(spark, d), "resume_id", "scored_at", start, end)


ESCAPED = """replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')"""


@R.add(
    D.with_ctes(D.COMPANIES, D.JOBS, D.MATCHES)
    + f"""SELECT resume_id, new_matches, high_priority, pending, CASE WHEN high_priority > 0 THEN '🎯 ' || high_priority || ' high-priority matches found!' WHEN new_matches > 0 THEN '📧 ' || new_matches || ' new job matches for you'
        ELSE '📋 Your daily job search update' END AS subject, coalesce('<ul>' || items || '</ul>', '<p>No new matches.</p>') AS html
    FROM (SELECT resume_id, count(*) FILTER (i) AS new_matches, count(*) FILTER (i AND action = 'APPLY_HIGH') AS high_priority, count(*) FILTER (i AND action = 'REVIEW') AS pending,
        string_agg('<li><b>' || {ESCAPED.format("title")} || '</b> ' || {ESCAPED.format("company")} || ' (' || llm_score || ', ' || action || ')</li>', '' ORDER BY rank) FILTER (i AND rank <= 5) AS items
      FROM (SELECT *, row_number() OVER (PARTITION BY resume_id, i ORDER BY llm_score DESC, final_score DESC, job_id) AS rank
        FROM (SELECT *, scored_at >= TIMESTAMP '2024-01-14' AND scored_at < TIMESTAMP '2024-01-15' AS i FROM matches JOIN jobs USING (job_id) JOIN companies USING (company_id)))
      GROUP BY resume_id)"""
)
def digest_rendered(spark, d):
    m = D.matches(spark, d).join(D.jobs(spark, d), "job_id").join(D.companies(spark, d), "company_id")
    start, end = DG.previous_day(F.lit("2024-01-15 09:30:00").cast("timestamp_ntz"))
    return DG.digest(m, "resume_id", "scored_at", start, end)


@R.add(
    """SELECT conv_id, turn, role, CASE role WHEN 'system' THEN 'pending' WHEN 'user' THEN 'in_progress' ELSE 'completed' END AS status,
      CASE role WHEN 'system' THEN turn % 2 = 0 WHEN 'user' THEN true ELSE turn % 2 = 1 END AS ok FROM conversations"""
)
def review_transitions(spark, d):
    status = F.when(F.col("role") == "system", "pending").when(F.col("role") == "user", "in_progress").otherwise("completed")
    odd = F.col("turn") % 2 == 1
    new = F.when((F.col("role") == "system") & odd, "accepted").when(F.col("role") == "system", "in_progress")
    new = new.when(F.col("role") == "user", "completed").when(odd, "accepted").otherwise("pending")
    return table(spark, d, "conversations").select("conv_id", "turn", "role", status.alias("status"), RV.valid_transition(status, new).alias("ok"))


@R.add(
    """WITH RECURSIVE v AS (
      SELECT item_id, text AS body, 1 AS version, NULL::INTEGER AS parent_version, 2.5::DOUBLE AS cost_cents, CAST('0x' || substr(md5(text), 1, 2) AS BIGINT) % 40 + 60 AS score FROM benchmark
      UNION ALL
      SELECT item_id, b, version + 1, version, cost_cents + 7.5, CAST('0x' || substr(md5(b), 1, 2) AS BIGINT) % 40 + 60
      FROM (SELECT *, body || ' [rev ' || (version + 1) || ']' AS b FROM v WHERE score < 80 AND version < 3))
    SELECT item_id, version, parent_version, score, CASE WHEN score >= 80 THEN 'accepted' WHEN version >= 3 THEN 'completed' ELSE 'in_progress' END AS status, cost_cents FROM v"""
)
def review_loop(spark, d):
    return RV.review_loop(table(spark, d, "benchmark"), "item_id", "text")


DIFF = """WITH p AS (SELECT doc_id, text AS a, CASE doc_id % 3 WHEN 0 THEN text || chr(10) || 'new' WHEN 1 THEN replace(text, 'the', 'THE') ELSE split_part(text, chr(10), 1) END AS b FROM documents),
    l AS (SELECT doc_id, string_split(a, chr(10)) AS a, string_split(b, chr(10)) AS b FROM p),
    x AS (SELECT doc_id, a, b, unnest(range(1, greatest(len(a), len(b)) + 1)) AS i FROM l)"""


@R.add(
    DIFF
    + """ SELECT doc_id, i AS line_num, CASE WHEN i > len(a) THEN 'added' WHEN i > len(b) THEN 'removed' ELSE 'modified' END AS kind, a[i] AS old_line, b[i] AS new_line
    FROM x WHERE i > len(a) OR i > len(b) OR a[i] <> b[i]"""
)
def version_line_diff(spark, d):
    k = F.col("doc_id") % 3
    new = F.when(k == 0, F.concat("text", F.lit("\nnew"))).when(k == 1, F.replace("text", F.lit("the"), F.lit("THE"))).otherwise(F.split_part("text", F.lit("\n"), F.lit(1)))
    return RV.line_diff(table(spark, d, "documents").select("doc_id", "text", new.alias("new")), "doc_id", "text", "new")


@R.add(
    OF_SUPPLIERS + """(VALUES (2, 'Start URL not allowed: https://evil.example/x'), (2, 'Step 0: Dangerous script'), (2, 'Step 2: Disallowed variable profile.password in value'), (3, 'Too many steps: 101')) t(k, violation) ON s_suppkey % 3 + 1 = k"""
)
def template_violations(spark, d):
    return TP.security_violations(portal_templates(spark, d), "id", "body")


@R.add(
    OF_SUPPLIERS + """(VALUES (2, 'Missing description'), (2, 'Missing author'), (3, 'Missing author'), (2, 'Step 1: Missing id'), (2, 'Step 2: Long wait'), (2, 'Step 3: Missing selector'), (2, 'Unsafe variable: profile.password')) t(k, issue) ON s_suppkey % 3 + 1 = k"""
)
def template_lint(spark, d):
    return TP.lint(portal_templates(spark, d), "id", "body")


@R.add(
    OF_SUPPLIERS + """(VALUES (1, 'Template ID is required'), (1, 'Section s: field a: Selector or xpath is required'), (1, 'Section s: field a: radio needs options'), (1, 'Duplicate field ID: a'), (1, 'Section e: At least one field is required'),
      (1, 'Section s: field a: Invalid transform twist')) t(k, error) ON s_suppkey % 2 = k"""
)
def form_template_errors(spark, d):
    bad = (
        TP.FormBuilder("", "p").section("s").field("a", field_type="radio").field("a", css_selector="#a", transform="twist").section("e").to_json()
    )
    body = F.when(F.col("s_suppkey") % 2 == 1, bad).otherwise(FORM)
    return TP.form_errors(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), body.alias("body")), "id", "body")


@R.add(
    """SELECT 1 AS template, doc_id, f AS field_id, CASE f WHEN 'name' THEN upper(source) WHEN 'mail' THEN CASE WHEN doc_id % 2 = 0 THEN 'a' || doc_id || '@example.com' END WHEN 'phone' THEN '(555) 123-4567'
      WHEN 'lang' THEN CASE lang WHEN 'en' THEN 'English' WHEN 'es' THEN NULL ELSE lang END ELSE lang END AS value
    FROM documents, (SELECT unnest(['name', 'mail', 'phone', 'lang', 'extra']) AS f) WHERE f <> 'extra' OR lang = 'en'"""
)
def field_mapping(spark, d):
    mail = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("a"), F.col("doc_id").cast("string"), F.lit("@example.com"))).otherwise("none")
    data = F.to_json(F.struct(F.col("source").alias("name"), F.struct(mail.alias("email")).alias("contact"), "lang"))
    people = table(spark, d, "documents").select("doc_id", data.alias("data"))
    form = spark.createDataFrame([(1, FORM)], "template int, body string")
    return TP.map_fields(form, "template", "body", people, "doc_id", "data")


@R.add(
    """SELECT item_id, 'Hi ' || replace(replace(replace(replace(left(text, 30), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || ' {{answers.other}}' AS text, ['profile.name', 'answers.other'] AS vars FROM benchmark"""
)
def template_substitution(spark, d):
    tpl = F.lit("Hi {{ profile.name }} {{answers.other}}")
    values = F.create_map(F.lit("profile.name"), F.substring("text", 1, 30))
    return table(spark, d, "benchmark").select("item_id", TP.substitute(tpl, values).alias("text"), TP.variables(tpl).alias("vars"))


@R.add(
    """WITH c AS (SELECT o_orderkey, o_custkey % (SELECT count(*) FROM supplier) + 1 AS company_id FROM orders WHERE o_custkey % (SELECT count(*) FROM supplier) + 1 IN (SELECT s_suppkey FROM supplier)),
    t AS (SELECT p_partkey AS template_id, p_partkey % 5 AS portal_id, p_size AS version FROM part WHERE p_partkey % 2 = 0)
    SELECT o_orderkey AS job_id, template_id, version::BIGINT AS version FROM c JOIN t ON portal_id = company_id % 5 QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY version DESC, template_id) = 1"""
)
def application_plan(spark, d):
    n = table(spark, d, "supplier").count()
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), (F.col("o_custkey") % n + 1).alias("company_id"))
    configs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("company_id"), (F.col("s_suppkey") % 5).alias("portal_id"))
    parts = table(spark, d, "part").select(
        F.col("p_partkey").alias("template_id"), (F.col("p_partkey") % 5).alias("portal_id"), F.col("p_size").cast("long").alias("version"),
        (F.col("p_partkey") % 2 == 0).alias("is_active"),
    )
    return TP.plan_applications(jobs, configs, parts)


@R.add(
    """SELECT event_id, date_diff('hour', ts, TIMESTAMP '2024-06-01')::BIGINT AS crude, CAST(floor((epoch(TIMESTAMP '2024-06-01') - epoch(ts)) / 3600) AS BIGINT) AS hours,
      CAST(floor((epoch(TIMESTAMP '2024-06-01') - epoch(ts)) / 86400) AS BIGINT) AS days FROM events"""
)
def hours_and_days_since(spark, d):
    ref = F.lit("2024-06-01").cast("timestamp_ntz")
    crude = (F.unix_timestamp(F.date_trunc("hour", ref)) - F.unix_timestamp(F.date_trunc("hour", "ts"))) / 3600
    return table(spark, d, "events").select(
        "event_id", crude.cast("long").alias("crude"), DT.hours_since(F.col("ts"), ref).alias("hours"), DT.days_since(F.col("ts"), ref).alias("days")
    )


@R.add(
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '2019-01' WHEN 1 THEN '2020-07' END AS started, doc_id % 5 = 2 AS current, doc_id % 5 IN (3, 4) AS bad FROM documents"""
)
def month_normaliser(spark, d):
    k = F.col("doc_id") % 5
    raw = F.when(k == 0, "2019").when(k == 1, " 2020-07 ").when(k == 2, "Present").when(k == 3, "2020-13").otherwise("soon")
    return table(spark, d, "documents").select(
        "doc_id", DT.month(raw).alias("started"), DT.is_current(raw).alias("current"), DT.bad_month(raw).alias("bad")
    )


@R.add(
    """SELECT event_id, json_extract_string(props, '$.k') AS k, event_id % 2 = 0 AS has_b, CASE WHEN event_id % 2 = 0 THEN [1, 2] ELSE [3] END AS longer, coalesce(nullif('', ''), event_type) AS first FROM events"""
)
def nested_lookup_and_merge(spark, d):
    from larkmill.functions import arrays as A

    even = F.col("event_id") % 2 == 0
    a = F.array(F.lit(3))
    b = F.when(even, F.array(F.lit(1), F.lit(2))).otherwise(F.array().cast("array<int>"))
    return table(spark, d, "events").select(
        "event_id", A.dotted(F.col("props"), "k").alias("k"), (F.size(b) > 0).alias("has_b"), A.longer(a, b).alias("longer"),
        A.first_filled(F.lit(""), F.col("event_type")).alias("first"),
    )


@R.add(
    r"""WITH l AS (SELECT doc_id, text, list_filter(list_transform(string_split_regex(text, '\r?\n'), lambda x: trim(x)), lambda x: x <> '')[1:5] AS ls FROM documents),
    g AS (SELECT *, list_filter(ls, lambda x: NOT regexp_matches(x, '[@\d]') AND len(list_filter(string_split_regex(x, '\s+'), lambda w: w <> '')) BETWEEN 2 AND 5
        AND NOT regexp_matches(lower(x), 'summary|experience|education|skills|objective')) AS good FROM l)
    SELECT doc_id, coalesce(good[1], 'Test Candidate') AS full_name, nullif(regexp_extract(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b', 0), '') AS email,
      nullif(regexp_extract(text, '\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b', 0), '') AS phone,
      array_to_string(list_filter(["""
    + ", ".join(f"CASE WHEN contains(lower(text), '{k}') THEN '{k}' END" for k in T.CONTACT_SKILLS)
    + """], lambda x: x IS NOT NULL), ',') AS skills FROM g"""
)
def report_contacts(spark, d):
    """Deterministic extraction of names, contacts and skills, as JSON under a contract and read back from it."""
    t = F.col("text")
    parsed = F.struct(
        T.name_line(t).alias("full_name"), T.first_email(t).alias("email"), T.first_phone(t).alias("phone"),
        T.found_terms(t, T.CONTACT_SKILLS).alias("skills"),
    )
    said = table(spark, d, "documents").select("doc_id", F.to_json(parsed).alias("body"))
    contract = "full_name string, email string, phone string, skills array<string>"
    read = said.select("doc_id", F.from_json("body", contract).alias("p"))
    return read.select("doc_id", "p.full_name", "p.email", "p.phone", F.array_join("p.skills", ",").alias("skills"))


@R.add(
    """SELECT n_name AS "table", c AS "column", s AS side FROM nation, (VALUES ('salary', 'documented'), ('url', 'actual')) x(c, s)"""
)
def schema_docs_difference(spark, d):
    nation = table(spark, d, "nation").select(F.col("n_name").alias("table"))
    md = nation.select("table", F.concat(F.lit("# "), "table", F.lit("\n| Column | Type |\n| --- | --- |\n| `id` | uuid |\n| salary | text |\n")).alias("text"))
    actual = nation.select("table", F.explode(F.array(F.lit("id"), F.lit("url"))).alias("column"))
    return TP.schema_difference(TP.markdown_columns(md, "table", "text"), actual)
