"""Quality rules with cross-document line frequency, in DataFrame functions only.

Every line is normalised (lower case, white space collapsed, trimmed) and hashed. A line found in more than
``max_docs`` different documents of one host is boilerplate there and is removed; a document left with too few words,
or with too small a share of its words, is rejected as depleted.

Texts are read once: the base measures and the hashes of the lines are written to the shared folder, and what follows
works on those. Only lines with over ``max_docs`` rows of a host can be common, so only these are counted by document.

Defined cases: a null text has no words and fails the base rules; a null host is a host of its own; rows that share an
id are one document when lines are counted, however often they are repeated and whatever their texts; rows without an
id are documents of their own; every row gets a result from its own host and text; blank lines never count; an empty
table gives an empty result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkmill.llm.words import WORD, bind
from larkmill.session import cut_lineage

SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class LineRules:
    min_words: int = 20
    window: int = 8
    max_repeat_percent: int = 30
    max_docs: int = 20  # documents of a host that may share a line
    min_left_words: int = 20
    min_left_percent: int = 50


def window_hashes(words: Column, window: int) -> Column:
    """A hash of each ``window`` words in a row. Hashes of single words are joined to those of two, of four and so on, so
    every word is read once; two of the widest that overlap make the window."""

    def joined(hashes: Column, step: int) -> Column:
        return bind(
            hashes,
            lambda h: F.zip_with(
                F.slice(h, 1, F.greatest(F.size(h) - step, F.lit(0))), F.slice(h, 1 + step, F.greatest(F.size(h) - step, F.lit(0))),
                lambda x, y: F.xxhash64(x, y),
            ),
        )

    hashes, width = F.transform(words, lambda w: F.xxhash64(w)), 1
    while 2 * width <= window:
        hashes, width = joined(hashes, width), 2 * width
    return joined(hashes, window - width) if width < window else hashes


def repeated_words(words: Column, window: int) -> Column:
    """Words that lie in a ``window``-word window found twice or more among ``words``, the first one included."""

    def covered(found: Column) -> Column:
        twice = F.filter(
            found,
            lambda e, j: (F.get(found, j - 1)["h"] == e["h"]) | (F.get(found, j + 1)["h"] == e["h"]),
        )
        starts = F.array_sort(F.transform(twice, lambda e: e["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            starts,
            start,
            lambda acc, p: F.struct(
                (acc["n"] + p + window - F.greatest(acc["end"], p)).alias("n"), (p + window).alias("end")
            ),
            lambda acc: acc["n"],
        )

    def of(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(bind(pairs, covered))

    return bind(window_hashes(words, window), of).cast("long")


def base_rules(docs: DataFrame, text: str, rules: LineRules = LineRules()) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    body = F.coalesce(F.col(text), F.lit(""))
    with_word = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    measured = docs.withColumns(
        {
            "_w": F.regexp_extract_all(body, F.lit(WORD), F.lit(0)),
            "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": bind(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        }
    )
    counted = measured.withColumns(
        {
            "n_words": F.size("_w").cast("long"), "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_repeat_words": repeated_words(F.col("_w"), rules.window),
        }
    ).drop("_w")
    failed = (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")
    )
    return counted.withColumn("base_failed", failed)


def line_entries(text: Column) -> Column:
    """Hash and word count of each normalised line that holds a word."""
    flat = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09\x0B-\x0D]+", " "))
    lines = F.filter(F.transform(F.split(flat, "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(
        lines, lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, " ", -1)).cast("long").alias("w"))
    )


def common_lines(lines: DataFrame, max_docs: int) -> DataFrame:
    """(c_host, c_h) of ``lines`` (row, doc_id, host, h) that over ``max_docs`` different documents of a host hold."""
    often = lines.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > max_docs)
    # Cut here, both sides of the joins with it are dealt anew, and a line that is everywhere can be split.
    often = cut_lineage(often.select(F.col("host").alias("c_host"), F.col("h").alias("c_h")))
    document = F.struct("doc_id", F.when(F.col("doc_id").isNull(), F.col("row")))
    counted = (
        lines.join(often, F.col("host").eqNullSafe(F.col("c_host")) & (F.col("h") == F.col("c_h")))
        .groupBy("c_host", "c_h").agg(F.count_distinct(document).alias("n"))
    )
    return cut_lineage(counted.where(F.col("n") > max_docs).drop("n"))


def apply_line_rules(
    docs: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text", rules: LineRules = LineRules()
) -> DataFrame:
    """One row per document: the base measures, n_common_lines, n_left_words and kept."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text"))
    measured = base_rules(slim, "text", rules).withColumn("entries", line_entries(F.col("text"))).drop("text")
    measured = cut_lineage(measured.withColumn("row", F.monotonically_increasing_id()))
    lines = measured.select("row", "doc_id", "host", F.inline("entries"))
    common = common_lines(lines, rules.max_docs)
    lost = (
        lines.join(common, F.col("host").eqNullSafe(F.col("c_host")) & (F.col("h") == F.col("c_h")))
        .groupBy(F.col("row").alias("l_row")).agg(F.sum("w").alias("lost_w"), F.count("*").alias("lost_n"))
    )
    joined = measured.drop("entries", "host").join(lost, F.col("row") == F.col("l_row"), "left")
    left = F.col("n_words") - F.coalesce("lost_w", F.lit(0))
    return (
        joined.withColumns({"n_left_words": left, "n_common_lines": F.coalesce("lost_n", F.lit(0))})
        .withColumn(
            "kept",
            ~F.col("base_failed")
            & (F.col("n_left_words") >= rules.min_left_words)
            & (100 * F.col("n_left_words") >= rules.min_left_percent * F.col("n_words")),
        )
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
            "n_common_lines", "n_left_words",
        )
    )
