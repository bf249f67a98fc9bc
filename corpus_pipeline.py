"""From documents to packed bins: language ID, line dedup, near-dedup, mixing, packing.

Each stage reads all that its predecessor kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkmill.llm.language import UNDETERMINED, held_out, identify, learn
from larkmill.llm.line_windows import dedup_lines
from larkmill.llm.mixture import mix_sources, take_copies
from larkmill.llm.packing import pack_documents
from larkmill.llm.simhash import first_rows
from larkmill.session import remove, scratch_dir, table

# A text whose best language gives it less, in nats for each character, is in none of the learned ones: prose of the test
# tables has -1.2 to -3, with secrets in it -5.1, Chinese or Greek -14.
LEAST_FIT = -8.0
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a determined language go, and those that no learned language explains; the model learns from
    labelled documents not held out. Where none may teach, there is no verdict, and all stay."""
    may_teach = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    model = learn(may_teach)
    if model is None:
        return docs.select(*COLUMNS)
    found = identify(docs, model, keep=COLUMNS)
    explained = F.coalesce(F.col("fit") >= LEAST_FIT, F.lit(True))
    return found.where((F.col("lang_pred") != UNDETERMINED) & explained).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose later occurrences of repeated windows; documents of which no word is left go."""
    found = dedup_lines(docs.select(*COLUMNS))
    left = found.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    changed = F.col("n_removed") > 0
    return left.select(
        "row.doc_id", "text", "row.lang", "row.source",
        F.when(changed, F.length("text").cast("long")).otherwise(F.col("row.n_chars")).alias("n_chars"),
    )


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: of the least id, nulls last, then text hash, then the other columns."""
    # Without nulls, so that the grouping and the join deal the rows out once. Repeats of a row shrink before that.
    key = lambda th: [F.col("doc_id").isNull().alias("k_none"), F.coalesce("doc_id", F.lit(0)).alias("k_id"), th.alias("k_th")]
    found = first_rows(docs)
    keep = found.select(*key(F.col("th")))
    packed = docs.select(*key(F.xxhash64("text")), F.struct("doc_id", "lang", "source", "n_chars", "text").alias("row"))
    once = packed.groupBy("k_none", "k_id", "k_th").agg(F.min("row").alias("row"))
    return once.join(keep, ["k_none", "k_id", "k_th"], "left_semi").select(*[f"row.{c}" for c in COLUMNS])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    return take_copies(docs.select(*COLUMNS), mix_sources(docs), "doc_id", "source", "text")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document: where it lies in which bin."""
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("packing", packing),
]
# SQL can't express the language model, the draws of the mixture or the successor search.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written to the shared folder and read again by the next. What a stage has
    read goes once its own result is written, the rest when the application ends."""
    docs, before = table(spark, sf_dir, "documents", spread=True), None
    folder = scratch_dir(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
