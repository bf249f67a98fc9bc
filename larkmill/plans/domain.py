"""The matching domain on the test tables: jobs, companies, chunks, resumes and matches, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkmill.functions import scores as S
from larkmill.session import table

LEVELS = ("entry", "junior", "mid", "senior", "staff", "principal")


def digits(value, start: int, length: int):
    """A number from the hex digits of an MD5."""
    return F.conv(F.substring(F.md5(value), start, length), 16, 10).cast("long")


def companies(spark: SparkSession, d: str) -> DataFrame:
    supplier, nation = table(spark, d, "supplier"), table(spark, d, "nation")
    return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("company_id"), F.col("s_name").alias("company"), F.col("n_name").alias("location")
    )


COMPANIES = """companies AS (
  SELECT s_suppkey AS company_id, s_name AS company, n_name AS location
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def jobs(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "supplier").count()
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    return table(spark, d, "documents", spread=True).select(
        F.col("doc_id").alias("job_id"), (F.col("doc_id") % n + 1).alias("company_id"),
        F.array_join(F.slice(words, 1, 5), " ").alias("title"), F.col("text").alias("description"), "source", "n_chars",
        F.element_at(F.array(*[F.lit(x) for x in LEVELS]), (F.col("doc_id") % 6 + 1).cast("int")).alias("seniority"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).alias("posted_date"),
        F.array_distinct(F.slice(F.transform(words, lambda w: F.lower(w)), 1, 8)).alias("skills"),
    )


JOBS = r"""job_words AS (
  SELECT *, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS w FROM documents),
jobs AS (
  SELECT doc_id AS job_id, doc_id % (SELECT count(*) FROM supplier) + 1 AS company_id,
    array_to_string(w[1:5], ' ') AS title, text AS description, source, n_chars,
    ['entry', 'junior', 'mid', 'senior', 'staff', 'principal'][doc_id % 6 + 1] AS seniority,
    DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS posted_date,
    list_transform(w[1:8], lambda x: lower(x)) AS skills_raw
  FROM job_words)"""


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Three vectors for each job."""
    vectors = table(spark, d, "embeddings")
    n = vectors.count()
    spots = table(spark, d, "documents").select(
        F.col("doc_id").alias("job_id"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("chunk_index")
    )
    keyed = spots.withColumn("vec_id", F.pmod(F.col("job_id") * 7 + F.col("chunk_index") * 13, F.lit(n)))
    return keyed.join(vectors, "vec_id").select("job_id", "chunk_index", "vec_id", "embedding")


CHUNKS = """chunks AS (
  SELECT job_id, chunk_index, vec_id, embedding FROM (
    SELECT doc_id AS job_id, c AS chunk_index, (doc_id * 7 + c * 13) % (SELECT count(*) FROM embeddings) AS vec_id
    FROM documents, (SELECT unnest([0, 1, 2]) AS c)) JOIN embeddings USING (vec_id))"""


def resumes(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("resume_vector"))
    items = table(spark, d, "benchmark").join(vectors, F.col("item_id") == F.col("vec_id"))
    return items.select(
        F.col("item_id").alias("resume_id"), F.col("text").alias("fulltext"),
        (F.col("item_id") % 12).cast("double").alias("years"), "resume_vector",
    )


RESUMES = """resumes AS (
  SELECT item_id AS resume_id, text AS fulltext, CAST(item_id % 12 AS DOUBLE) AS years, embedding AS resume_vector
  FROM benchmark JOIN embeddings ON item_id = vec_id)"""


def matches(spark: SparkSession, d: str) -> DataFrame:
    """Three scored resumes for each job, by hash."""
    n = table(spark, d, "benchmark").count()
    pairs = table(spark, d, "documents").select(
        F.col("doc_id").alias("job_id"), F.explode(F.array(F.lit(1), F.lit(5), F.lit(11))).alias("k")
    )
    keyed = pairs.select("job_id", F.pmod(F.col("job_id") * F.col("k") + F.col("k"), F.lit(n)).alias("resume_id"))
    keyed = keyed.distinct()
    key = F.concat_ws("-", "job_id", "resume_id")
    scored = keyed.select(
        "*", (digits(key, 1, 4) % 1000 / 1000.0).alias("fts_score"), (digits(key, 5, 4) % 1000 / 1000.0).alias("vector_score"),
        (digits(key, 9, 4) % 101).alias("llm_score"),
        F.timestamp_seconds(F.lit(1704067200) + digits(key, 13, 5) % 2592000).cast("timestamp_ntz").alias("scored_at"),
    )
    final = F.round(S.final_score(F.col("fts_score"), F.col("vector_score"), F.col("llm_score")), 6)
    return scored.withColumn("final_score", final).withColumn("action", S.action(F.col("llm_score"), F.col("final_score")))


MATCHES = """pairs AS (
  SELECT DISTINCT doc_id AS job_id, (doc_id * k + k) % (SELECT count(*) FROM benchmark) AS resume_id
  FROM documents, (SELECT unnest([1, 5, 11]) AS k)),
keyed AS (SELECT *, md5(job_id || '-' || resume_id) AS h FROM pairs),
scored AS (
  SELECT job_id, resume_id, CAST('0x' || substr(h, 1, 4) AS BIGINT) % 1000 / 1000.0::DOUBLE AS fts_score,
    CAST('0x' || substr(h, 5, 4) AS BIGINT) % 1000 / 1000.0::DOUBLE AS vector_score,
    CAST('0x' || substr(h, 9, 4) AS BIGINT) % 101 AS llm_score,
    TIMESTAMP '2024-01-01' + to_seconds(CAST('0x' || substr(h, 13, 5) AS BIGINT) % 2592000) AS scored_at
  FROM keyed),
finals AS (
  SELECT *, round(0.2::DOUBLE * fts_score + 0.3::DOUBLE * vector_score + 0.5::DOUBLE * (llm_score / 100.0::DOUBLE), 6) AS final_score FROM scored),
matches AS (
  SELECT *, CASE WHEN llm_score >= 85 AND final_score >= 0.8 THEN 'APPLY_HIGH'
    WHEN llm_score >= 70 AND final_score >= 0.6 THEN 'APPLY_MEDIUM'
    WHEN llm_score >= 60 AND final_score >= 0.4 THEN 'REVIEW' ELSE 'SKIP' END AS action
  FROM finals)"""


def with_ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
