"""Line dedup by overlapping three-line windows.

The lines of a text that hold a word are taken in order, trimmed; each run of ``window`` consecutive ones is hashed.
A window whose hash occurs earlier in the corpus (by document id, text hash, then position) is a later occurrence, and
every line it covers is removed; overlapping covers are merged. The first occurrence of every line of a repeated passage
stays, since each removed line equals one at an earlier place.

Defined cases: a null text stays null; texts with fewer lines than a window are left alone; rows sharing a document
id and a text are one document, so repeats of a row don't count as later occurrences; different texts under one id are
documents of their own; so are all rows without an id, and of those with the same text one keeps its lines (these rows
are counted and spelt out again, so none of them need meet in a task); a null id orders first; blank lines are never
removed; all columns of the input pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkmill.llm.words import SPACE_CLASS, bind, different_rows
from larkmill.session import cut_lineage

RUN = 1024


def _trimmed(text: Column) -> Column:
    return F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n", -1),
        lambda x: F.regexp_replace(x, rf"^{SPACE_CLASS}+|{SPACE_CLASS}+$", ""),
    )


def line_windows(text: Column, window: int = 3) -> Column:
    """Structs (h, i) of each window over the lines that hold a word; i counts those lines from 0."""
    return bind(
        F.filter(_trimmed(text), lambda x: x != ""),
        lambda lines: F.when(
            F.size(lines) >= window,
            F.transform(
                F.sequence(F.lit(1), F.size(lines) - (window - 1)),
                lambda i: F.struct(F.xxhash64(F.slice(lines, i, window)).alias("h"), (i - 1).alias("i")),
            ),
        ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
    )


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """What tells documents apart, without nulls: the same columns serve windows and joins, so rows are dealt once."""
    return [
        doc_id.isNull().alias("k_none"), F.coalesce(doc_id.cast("string"), F.lit("")).alias("k_id"), text.alias("k_th"),
    ]


def later_windows(docs: DataFrame, doc_id: str, text: str, window: int = 3) -> DataFrame:
    """(w_id, w_th, starts): per document, by id and text hash, the positions of windows that occurred before."""
    found = docs.select(
        F.col(doc_id).alias("w_id"), F.xxhash64(F.col(text)).alias("w_th"), F.inline(line_windows(F.col(text), window))
    )
    place = F.struct(F.col("w_id").alias("d"), F.col("w_th").alias("t"), F.col("i").alias("i"))
    first = found.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("n")).where(F.col("n") > 1)
    # Cut here, the join deals both of its sides anew, and a window that is everywhere can be split.
    first = cut_lineage(first.select(F.col("h").alias("f_h"), "first"))
    later = found.join(first, F.col("h") == F.col("f_h"))
    return later.where(place > F.col("first")).groupBy("w_id", "w_th").agg(F.collect_set("i").alias("starts"))


def _rows_without_id(docs: DataFrame, text: str) -> tuple[DataFrame, Column]:
    """All rows of ``docs`` as (row), and whether another of the same text, the least by a hash of the row, comes
    before."""
    rows = different_rows(docs)
    least = rows.groupBy(F.xxhash64(F.col("row")[text]).alias("l_th")).agg(F.min("hash").alias("least"))
    marked = rows.join(cut_lineage(least), F.xxhash64(F.col("row")[text]) == F.col("l_th"))
    # Runs of a row's repeats are dealt out before they are spelt out.
    runs = marked.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))).alias("run"))
    first = F.col("run") * RUN
    each = runs.repartition("hash", "run").select(
        "row", F.explode(F.sequence(first, F.least(first + RUN, F.col("n")) - 1)).alias("k"), (F.col("hash") != F.col("least")).alias("later")
    )
    return each, F.col("later") | (F.col("k") > 0)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 3) -> DataFrame:
    """(row, text, n_lines, n_removed): ``row`` is the whole input row, ``text`` what is left of its text."""
    def keyed(rows: DataFrame, repeat: Column) -> DataFrame:
        own = F.col("row")
        return rows.select("row", *row_key(own[doc_id], F.xxhash64(own[text])), repeat.alias("repeat"))

    packed = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    ranked = keyed(docs.where(F.col(f"`{doc_id}`").isNotNull()).select(packed), F.lit(False))
    without = docs.where(F.col(f"`{doc_id}`").isNull())
    if not without.isEmpty():
        ranked = ranked.union(keyed(*_rows_without_id(without, text)))
    found = later_windows(docs.select(doc_id, text), doc_id, text, window)
    starts = found.select(*row_key(F.col("w_id"), F.col("w_th")), "starts")
    joined = ranked.join(starts, ["k_none", "k_id", "k_th"], "left")
    body = F.col(f"row.{text}")
    worded = bind(
        _trimmed(body),
        lambda lines: F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda j: F.get(lines, j) != ""),
    )
    with_places = joined.withColumn("_worded", worded)
    gone = bind(
        F.col("_worded"),
        lambda at: F.when(F.col("repeat") & (F.size(at) >= window), at).otherwise(
            F.array_distinct(
                F.flatten(F.transform(F.coalesce("starts", F.array().cast("array<int>")), lambda s: F.slice(at, s + 1, window)))
            )
        ),
    )
    marked = with_places.select("row", F.size("_worded").alias("n_lines"), gone.alias("_gone"))
    left = bind(
        F.split(body, "\n", -1),
        lambda lines: F.array_join(
            F.transform(
                F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone")), lambda j: F.get(lines, j)
            ),
            "\n",
        ),
    )
    return marked.select(
        "row",
        F.when((F.size("_gone") == 0) | body.isNull(), body).otherwise(left).alias("text"),
        F.col("n_lines").cast("long").alias("n_lines"),
        F.size("_gone").cast("long").alias("n_removed"),
    )
