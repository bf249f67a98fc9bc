"""Queries of text, date and bookkeeping functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkmill.functions import dates as DT
from larkmill.functions import text as T
from larkmill.functions import urls as U
from larkmill.functions import vectors as V
from larkmill.operators import embedding as E
from larkmill.operators import review as RV
from larkmill.operators.metrics import collected
from larkmill.plans.registry import Registry
from larkmill.session import table
from larkmill.sources.html_pages import within_pages

R = Registry()


@R.add(
    """SELECT doc_id, CASE WHEN instr(lower(text), 'the') > 0 THEN substr(text, greatest(instr(lower(text), 'the') - 50, 1),
      instr(lower(text), 'the') + 200 - greatest(instr(lower(text), 'the') - 50, 1)) END AS context FROM documents"""
)
def keyword_contexts(spark, d):
    return table(spark, d, "documents").select("doc_id", T.keyword_context(F.col("text"), "the").alias("context"))


@R.add(
    r"""WITH l AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda w: w <> '')) AS w FROM documents)
    SELECT doc_id, len(w)::BIGINT AS n, md5(array_to_string(list_sort(w), ' ')) AS digest FROM l"""
)
def document_lexemes(spark, d):
    found = T.lexemes(F.col("text"))
    return table(spark, d, "documents").select(
        "doc_id", F.size(found).cast("long").alias("n"), F.md5(F.array_join(F.sort_array(found), " ")).alias("digest")
    )


@R.add("""SELECT doc_id, md5(trim(text)) AS resume, md5(trim(source)) AS job FROM documents""")
def prompt_parts(spark, d):
    """Prompts of whole texts, taken apart again by their marks."""
    prompt = F.concat(F.lit("Judge.\n<<RESUME>> "), "text", F.lit(" <</RESUME>> against <<JOB>>"), "source", F.lit("<</JOB>> now."))
    made = table(spark, d, "documents").select("doc_id", prompt.alias("p"))
    part = lambda name: F.md5(T.between_sentinels(F.col("p"), f"<<{name}>>", f"<</{name}>>"))
    return made.select("doc_id", part("RESUME").alias("resume"), part("JOB").alias("job"))


@R.add(
    """WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'https://own.example/' || s_suppkey WHEN s_suppkey % 2 = 0 THEN 'co' || s_suppkey || '.example.com' ELSE 'co' || s_suppkey END AS c FROM supplier)
    SELECT s_suppkey, CASE WHEN c LIKE 'http%' THEN c ELSE 'https://boards.greenhouse.io/' || split_part(c, '.', 1) END AS greenhouse,
      CASE WHEN c LIKE 'http%' THEN c ELSE 'https://jobs.lever.co/' || split_part(c, '.', 1) END AS lever, CASE WHEN c LIKE 'http%' THEN c ELSE 'https://' || c || '/jobs' END AS workday,
      CASE WHEN s_suppkey % 3 = 0 THEN 'lever' ELSE 'company_site' END AS source FROM s"""
)
def portal_bases(spark, d):
    k = F.col("s_suppkey")
    name = F.concat(F.lit("co"), k.cast("string"))
    company = F.when(k % 5 == 0, F.concat(F.lit("https://own.example/"), k.cast("string"))).when(k % 2 == 0, F.concat(name, F.lit(".example.com"))).otherwise(name)
    url = F.when(k % 3 == 0, "https://jobs.Lever.co/x").otherwise("https://own.example/x")
    return table(spark, d, "supplier").select(
        "s_suppkey", *[U.portal_base(family, company).alias(family) for family in ("greenhouse", "lever", "workday")], U.job_source(url).alias("source")
    )


@R.add(
    """SELECT doc_id, 'emb_' || substr(sha256(text || '|' || lang), 1, 16) AS request, substr(md5(text), 1, 16) AS prompt,
      round(len(string_split(text, ' ')) / 1000 * 0.0001::DOUBLE, 12) AS cost FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL"""
)
def request_ids(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").where("text IS NOT NULL AND lang IS NOT NULL").select(
        "doc_id", T.request_id("emb_", t, F.col("lang")).alias("request"), T.prompt_hash(t).alias("prompt"),
        F.round(V.token_cost(F.size(F.split(t, " ", -1)), 0.0001), 12).alias("cost"),
    )


@R.add("SELECT event_id, date_trunc('second', ts) AS at FROM events")
def dates_of_any_form(spark, d):
    """Times as feeds write them, read back: like mail headers, in seconds, or as ISO with Z."""
    ts, k = F.col("ts").cast("timestamp"), F.col("event_id") % 3
    said = (
        F.when(k == 0, F.concat(F.lit("Mon, "), F.date_format(ts, "d MMM yyyy HH:mm:ss"), F.lit(" GMT")))
        .when(k == 1, F.unix_timestamp(ts).cast("string")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    )
    return table(spark, d, "events").select("event_id", DT.parse_any(said).cast("timestamp_ntz").alias("at"))


@R.add(
    """SELECT doc_id, doc_id // 25 AS page, doc_id % 40 AS total FROM documents WHERE doc_id // 25 <= 30 AND doc_id // 25 <= doc_id % 40"""
)
def pages_within(spark, d):
    listed = table(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 25).alias("page"), (F.col("doc_id") % 40).alias("total"))
    return within_pages(listed, "page", 30, "total")


@R.add("SELECT event_type, count(*) AS rows, round(sum(value), 4) AS sum, max(value) AS max FROM events GROUP BY event_type")
def metrics_observed(spark, d):
    """What was observed of each kind of event while they were written to a store."""
    return collected(table(spark, d, "events"), "event_type", "value").withColumn("sum", F.round("sum", 4))


@R.add(
    """SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 1) THEN 'in_progress' WHEN doc_id % 4 = 2 THEN 'pending' ELSE 'pending' END AS status, doc_id % 4 IN (0, 1) AS taken FROM documents"""
)
def transitions_applied(spark, d):
    """Reviews asked to move on: half of them validly, some to where they can't go, some not at all."""
    docs = table(spark, d, "documents").select("doc_id")
    state = docs.select("doc_id", F.lit("pending").alias("status"))
    k = F.col("doc_id") % 4
    asked = docs.where(k < 3).select("doc_id", F.when(k < 2, "in_progress").otherwise("completed").alias("new_status"))
    return RV.apply_transitions(state, asked, "doc_id")


@R.add(
    """SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'v' || ((SELECT count(DISTINCT label) FROM embeddings) + 1) || '.0' ELSE 'v1.0' END AS embedding_version, vec_id % 3 <> 0 AS needs_reembedding FROM embeddings"""
)
def migration_marked_done(spark, d):
    """A version that follows those there are; vectors that have come under it are done."""
    vectors = table(spark, d, "embeddings")
    version = E.next_version_id(vectors.select("label").distinct())
    old = E.mark_legacy(vectors.select("vec_id", F.lit("v1.0").alias("embedding_version")), version)
    return E.mark_done(old, vectors.where("vec_id % 3 = 0"), "vec_id", version)


@R.add(
    "SELECT a.vec_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS far FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"
)
def neighbour_distances(spark, d):
    v = table(spark, d, "embeddings")
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return v.join(after, "vec_id").select("vec_id", F.round(V.l2(F.col("embedding"), F.col("next")), 6).alias("far"))
