"""Composite pipelines, JSON recovery, configuration and metrics as queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from larkmill import config as CF
from larkmill.functions import jsons as J
from larkmill.operators import metrics as MT
from larkmill.operators import pipelines as PL
from larkmill.operators.chunking import ChunkConfig
from larkmill.plans import domain as D
from larkmill.plans.registry import Registry
from larkmill.plans.texts import sliding_sql
from larkmill.session import table

R = Registry()


@R.add(
    """WITH f AS (SELECT doc_id, min(doc_id) OVER w AS first, bool_or(doc_id % 7 = 0) OVER w AS known FROM documents WINDOW w AS (PARTITION BY lower(trim(text))))
    SELECT CASE WHEN first <> doc_id OR known THEN 'duplicate' ELSE 'created' END AS status, count(*) AS n FROM f GROUP BY 1"""
)
def resume_ingest_status(spark, d):
    files = table(spark, d, "documents").select(F.col("doc_id").alias("resume_id"), "text")
    empty = spark.createDataFrame([], "content_hash string")
    known = PL.ingest_resumes(files.where("resume_id % 7 = 0"), empty).parents.select("content_hash")
    done = PL.ingest_resumes(files, known)
    return done.parents.groupBy("status").agg(F.count("*").alias("n"))


INGEST = ChunkConfig(max_tokens=200, overlap_tokens=20)


@R.add(
    f"""WITH f AS (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY lower(trim(text))) AS first FROM documents WHERE lang = 'en'),
    src AS (SELECT doc_id AS row_id, '' AS section, text FROM f WHERE first = doc_id AND length(trim(text)) > 50), {sliding_sql("src", "win", INGEST)}
    SELECT row_id AS resume_id, k AS i, token_count, 'computed' AS source, 64 AS dims FROM win"""
)
def resume_ingest_vectors(spark, d):
    files = table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("resume_id"), "text")
    done = PL.ingest_resumes(files, spark.createDataFrame([], "content_hash string"), INGEST)
    return done.chunks.join(done.vectors.select("chunk_id", "source", "vector"), "chunk_id").select("resume_id", "i", "token_count", "source", F.size("vector").alias("dims"))


@R.add(
    """WITH old AS (SELECT doc_id, text FROM documents WHERE doc_id % 2 = 0), new AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 3 = 0)
    SELECT CASE WHEN new.doc_id IS NULL THEN 'kept' WHEN old.doc_id IS NULL THEN 'created' WHEN old.text <> new.text THEN 'updated' ELSE 'duplicate' END AS status, count(*) AS n
    FROM old FULL JOIN new USING (doc_id) GROUP BY 1"""
)
def job_ingest_status(spark, d):
    docs = table(spark, d, "documents")
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    side = lambda df, t: df.select(
        F.col("doc_id").alias("job_id"), F.concat(F.lit("https://a.example/j/"), F.col("doc_id").cast("string")).alias("url"),
        F.lit("t").alias("title"), F.lit("x").alias("location"), F.lit(None).cast("string").alias("salary"), t.alias("description"),
    )
    from larkmill.functions.text import listing_fingerprint

    old = side(docs.where("doc_id % 2 = 0"), F.col("text"))
    fp = listing_fingerprint(F.col("title"), F.col("description"), F.col("location"), F.col("salary"))
    stored = old.withColumn("fp", fp).withColumn("change_count", F.lit(0).cast("long"))
    done = PL.ingest_jobs(side(docs.where("doc_id % 3 = 0"), text), stored)
    return done.parents.groupBy("status").agg(F.count("*").alias("n"))


@R.add(
    """SELECT s_suppkey AS company_id, replace(lower(s_name), '#', '') || '.com' AS domain, CASE WHEN s_suppkey % 2 = 0 THEN 'https://www.' || replace(lower(s_name), '#', '') || '.com/careers' END AS careers_url,
      CASE WHEN s_suppkey % 5 = 0 THEN 'lever' ELSE 'custom' END AS portal FROM supplier WHERE s_suppkey % 3 <> 0"""
)
def company_discovery(spark, d):
    s = table(spark, d, "supplier")
    name = F.concat(F.replace(F.lower("s_name"), F.lit("#"), F.lit("")), F.lit(".com"))
    html = F.concat(
        F.when(F.col("s_suppkey") % 2 == 0, '<a href="/careers">Careers</a>').otherwise('<a href="/x">x</a>'),
        F.when(F.col("s_suppkey") % 5 == 0, '<iframe src="https://jobs.lever.co/x">').otherwise(""),
        F.when(F.col("s_suppkey") % 3 == 0, "This domain may be for sale").otherwise(""),
    )
    pages = s.select(F.concat(F.lit("https://www."), name, F.lit("/")).alias("url"), html.alias("html"))
    return PL.discover_companies(D.companies(spark, d), pages)


@R.add(
    """SELECT 'u' || c_custkey || '@x.org' AS email, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 4 <> 0 THEN c_name || ' Jr' ELSE c_name END AS full_name,
      CASE WHEN c_custkey % 2 = 1 AND c_custkey % 3 = 0 AND c_custkey % 4 <> 0 THEN 'created' WHEN c_custkey % 3 = 0 AND c_custkey % 4 <> 0 THEN 'updated' ELSE 'kept' END AS status
    FROM customer WHERE c_custkey % 2 = 0 OR (c_custkey % 3 = 0 AND c_custkey % 4 <> 0)"""
)
def user_sync(spark, d):
    c = table(spark, d, "customer")
    mail = F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@x.org"))
    old = c.where("c_custkey % 2 = 0").select(mail.alias("email"), F.col("c_name").alias("full_name"))
    name = F.when(F.col("c_custkey") % 4 != 0, F.concat("c_name", F.lit(" Jr"))).otherwise(" ")
    new = c.where("c_custkey % 3 = 0 AND (c_custkey % 4 <> 0 OR c_custkey % 2 = 0)").select(F.upper(mail).alias("email"), name.alias("full_name"))
    return PL.sync_users(old, new)


@R.add(
    D.with_ctes(D.MATCHES)
    + """SELECT doc_id AS job_id, max(final_score) AS best FROM documents JOIN matches ON job_id = doc_id WHERE doc_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY doc_id ORDER BY best DESC, job_id LIMIT 25"""
)
def bulk_apply_plan(spark, d):
    jobs = table(spark, d, "documents").select(F.col("doc_id").alias("job_id"))
    apps = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("job_id"))
    return PL.bulk_plan(jobs, apps, D.matches(spark, d), 25)


@R.add(
    """SELECT * FROM (SELECT 'doc' AS kind, doc_id AS id FROM documents ORDER BY md5(doc_id || '-42'), doc_id LIMIT 20)
    UNION ALL SELECT * FROM (SELECT 'item', item_id FROM benchmark ORDER BY md5(item_id || '-42'), item_id LIMIT 20)"""
)
def random_sample_two_tables(spark, d):
    a = table(spark, d, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"))
    b = table(spark, d, "benchmark").select(F.lit("item").alias("kind"), F.col("item_id").alias("id"))
    return PL.sample_two(a, b, "id", 40)


@R.add(
    """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '{"a":' || turn || '}' WHEN 1 THEN '{"b":' || turn || '}' WHEN 2 THEN '{"c":{"d":' || turn || '}}' END AS found FROM conversations"""
)
def lenient_json(spark, d):
    k, n = F.col("turn") % 4, F.col("turn").cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit('{"a":'), n, F.lit("}")))
        .when(k == 1, F.concat(F.lit('So:\n```json\n{"b":'), n, F.lit("}\n```\nDone.")))
        .when(k == 2, F.concat(F.lit('Answer {"c":{"d":'), n, F.lit("}} and more }")))
        .otherwise("none { here")
    )
    return table(spark, d, "conversations").select("conv_id", "turn", J.recover_json(text).alias("found"))


CONFIG_SCHEMA = {
    "type": "object", "required": ["user"], "additionalProperties": False,
    "properties": {
        "user": {"type": "object", "required": ["email"], "properties": {"email": {"type": "string", "pattern": "@"}}},
        "matching": {"type": "object", "properties": {"vector_top_k": {"type": "integer", "minimum": 1}}},
    },
}


@R.add(
    """SELECT s_suppkey::VARCHAR AS id, violation FROM supplier JOIN (VALUES (2, '$.user.email: doesn''t match the pattern'), (2, '$.matching.vector_top_k: below the minimum'), (3, '$.user: missing'), (3, '$.x: not allowed'), (0, '$: not JSON')) t(k, violation) ON s_suppkey % 4 = k"""
)
def json_schema_violations(spark, d):
    bodies = ("{", '{"user":{"email":"a@b"}}', '{"user":{"email":"ab"},"matching":{"vector_top_k":0}}', '{"x":1}')
    body = F.element_at(F.array(*[F.lit(b) for b in bodies]), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return J.schema_violations(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), body.alias("body")), "id", "body", CONFIG_SCHEMA)


@R.add(
    """SELECT s_suppkey, name, value FROM supplier, LATERAL (VALUES ('llm.model', CASE WHEN s_suppkey % 2 = 0 THEN 'big' ELSE 'small' END), ('llm.top', (s_suppkey % 7)::VARCHAR), ('user', s_name)) t(name, value)"""
)
def config_layers(spark, d):
    """Each supplier's own settings over those of all, as rows."""

    def layered(parts):
        for part in parts:
            rows = []
            for key, name in zip(part["s_suppkey"], part["s_name"], strict=True):
                own = {"llm": {"model": "big"}} if key % 2 == 0 else None
                merged = CF.merge_layers({"llm": {"model": "small", "top": 5}, "user": "none"}, own, {"user": name}, {"llm": {"top": int(key % 7)}})
                rows += [(key, *leaf) for leaf in CF.flatten(merged)]
            yield pd.DataFrame(rows, columns=["s_suppkey", "name", "value"])

    return table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name").mapInPandas(layered, "s_suppkey long, name string, value string")


@R.add(
    """WITH RECURSIVE o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events WHERE value IS NOT NULL),
    f AS (SELECT event_type, r, value AS ema, value AS peak FROM o WHERE r = 1
      UNION ALL SELECT o.event_type, o.r, f.ema * (1 - 0.1::DOUBLE) + o.value * 0.1::DOUBLE, CASE WHEN o.value > f.peak THEN o.value * 0.95::DOUBLE + f.peak * 0.05::DOUBLE ELSE f.peak END FROM f JOIN o ON o.event_type = f.event_type AND o.r = f.r + 1)
    SELECT event_type, max(r) AS n, round(arg_max(ema, r), 6) AS ema, round(arg_max(peak, r), 6) AS peak FROM f GROUP BY event_type"""
)
def metric_moving_average(spark, d):
    e = table(spark, d, "events").where("value IS NOT NULL")
    found = MT.moving_average(e, "event_type", ["ts", "event_id"], "value")
    return found.select("event_type", "n", F.round("ema", 6).alias("ema"), F.round("peak", 6).alias("peak"))


@R.add(
    """WITH m AS (SELECT event_id, ['matching.duration_seconds', 'scraping.block_rate', 'other'][event_id % 3 + 1] AS name, value / 10 AS value FROM events)
    SELECT event_id, name, value, t AS threshold, CASE WHEN value < t * 1.5 THEN 'warning' ELSE 'critical' END AS severity
    FROM (SELECT *, CASE name WHEN 'matching.duration_seconds' THEN 10.0 WHEN 'scraping.block_rate' THEN 0.1 END::DOUBLE AS t FROM m) WHERE value > t"""
)
def alert_thresholds(spark, d):
    names = F.array(*[F.lit(x) for x in ("matching.duration_seconds", "scraping.block_rate", "other")])
    m = table(spark, d, "events").select("event_id", F.element_at(names, (F.col("event_id") % 3 + 1).cast("int")).alias("name"), (F.col("value") / 10).alias("value"))
    return MT.alerts(m, "name", "value", MT.ALERT_THRESHOLDS)


@R.add("SELECT item_id, len(chunks)::BIGINT AS n_chunks, left(text, 500) AS preview FROM (SELECT b.item_id, b.text, list(c.vec_id) FILTER (c.vec_id IS NOT NULL) AS chunks FROM benchmark b LEFT JOIN embeddings c ON c.vec_id % 40 = b.item_id GROUP BY b.item_id, b.text) WHERE chunks IS NOT NULL")
def resume_show(spark, d):
    chunks = table(spark, d, "embeddings").groupBy((F.col("vec_id") % 40).alias("item_id")).agg(F.count("*").alias("n_chunks"))
    return table(spark, d, "benchmark").join(chunks, "item_id").select("item_id", "n_chunks", F.substring("text", 1, 500).alias("preview"))
