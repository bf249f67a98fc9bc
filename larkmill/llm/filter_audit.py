"""Filter interaction audit: what each filter removes, in every order of the filters, from one histogram of masks.

Native expressions set a bit for each filter a row fails; the bit of repeated texts comes from the least id of each
text. Rows are counted by part and mask, 32 cells a part for five filters, and every order of the filters is worked
out from the cells alone: a row is removed by the first filter of the order that it fails.

Texts are read once: id, part, mask and a SHA-256 digest of each are written to the shared folder. Texts are identical
where digests are. Rows equal in all of these are counted before they are dealt out, and rows meet their text's least id
by digest and id together, so neither a text that is everywhere nor a row that is repeated comes to one task.

Defined cases: a null text is empty, so it equals an empty one; a null part is the part of the empty string; a row
without an id fails no test of a smaller id, sets none, and bears no label; repeats of a row, and other rows under an id
with the same text, have no smaller id among them, and each counts; of several labels of an id the largest counts, null
labels say nothing; parts are those of the rows, so an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkmill.llm.words import bind, words
from larkmill.session import cut_lineage

REPEATED = "E"


def few_words(text: Column, words: Column) -> Column:
    return F.size(words) < 100


def few_different_words(text: Column, words: Column) -> Column:
    return 100 * F.size(F.array_distinct(words)) < 80 * F.size(words)


def many_capitals(text: Column, words: Column) -> Column:
    return 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text)


def marked(text: Column, words: Column) -> Column:
    return text.rlike("[#$%&*|]")


# Bits in this order, the test for repeated texts after them.
FILTERS: dict[str, Callable[[Column, Column], Column]] = {
    "A": few_words, "B": few_different_words, "C": many_capitals, "D": marked,
}


def failure_mask(text: Column, filters: dict[str, Callable[[Column, Column], Column]] = FILTERS) -> Column:
    """A bit for each of ``filters`` that the text fails."""

    def bits(found: Column) -> Column:
        return sum((F.when(f(text, found), F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(filters.values())), F.lit(0))

    return bind(words(text), bits)


def masked_rows(
    docs: DataFrame, labels: DataFrame, doc_id: str, text: str, part: str, filters: dict[str, Callable[[Column, Column], Column]]
) -> DataFrame:
    """(part, mask, n, good, toxic): like rows counted, with the bit of repeated texts."""
    body = F.coalesce(F.col(text), F.lit(""))
    thin = docs.select(
        F.col(doc_id).isNull().alias("k_none"),
        F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(body)).alias("k_id"),  # without an id, dealt by text
        F.unhex(F.sha2(body, 256)).alias("digest"), F.coalesce(F.col(part), F.lit("")).alias("part"),
        failure_mask(body, filters).alias("own"),
    )
    rows = thin.groupBy("k_none", "k_id", "digest", "part").agg(F.max("own").alias("own"), F.count("*").alias("n"))
    rows = cut_lineage(rows)
    first = rows.where(~F.col("k_none")).groupBy("digest").agg(F.min("k_id").alias("f_id"))
    first = first.select(F.lit(False).alias("f_none"), "f_id", F.col("digest").alias("f_digest"))
    said = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(
        *[F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long")).alias(alias) for c, alias in (("quality", "good"), ("toxic", "toxic"))]
    )
    # Cut here, so that an id of very many texts can be split.
    said = cut_lineage(said).select(F.lit(False).alias("l_none"), "l_id", "good", "toxic")
    known = rows.join(
        first, (F.col("digest") == F.col("f_digest")) & (F.col("k_id") == F.col("f_id")) & (F.col("k_none") == F.col("f_none")), "left"
    ).join(said, (F.col("k_id") == F.col("l_id")) & (F.col("k_none") == F.col("l_none")), "left")
    repeated = ~F.col("k_none") & F.col("f_id").isNull()
    return known.select(
        "part", (F.col("own") + F.when(repeated, 1 << len(filters)).otherwise(0)).alias("mask"), "n",
        *[(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")],
    )


def orders(letters: str) -> list[dict]:
    """Every step of every order: its filter's bit, and the bits of those before it."""
    bit = {x: 1 << k for k, x in enumerate(letters)}
    return [
        {"filter_order": "".join(order), "step": k + 1, "bit": bit[order[k]], "before": sum(bit[x] for x in order[:k])}
        for order in permutations(letters)
        for k in range(len(order))
    ]


def audit_filters(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    part: str = "lang",
    filters: dict[str, Callable[[Column, Column], Column]] = FILTERS,
    repeated: str = REPEATED,
) -> DataFrame:
    """One row for each part, order of the filters and step of the order.

    kept, removed, redundant (fails this filter, removed earlier), unique_fails (fails this one only), good_lost and
    toxic_lost (removed here, so labelled) are counts of rows. shapley is what the filter removes, summed over all
    orders: a row that fails m filters falls to each of them in one of m orders.
    """
    letters = "".join(filters) + repeated
    cells = masked_rows(docs, labels, doc_id, text, part, filters).groupBy("part", "mask").agg(
        *[F.sum(c).cast("long").alias(c) for c in ("n", "good", "toxic")]
    )
    by_part = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    plan = F.from_json(F.lit(json.dumps(orders(letters))), "array<struct<filter_order:string,step:int,bit:int,before:int>>")
    steps = by_part.select("part", "cells", F.inline(plan))
    bit, before = F.col("bit"), F.col("before")
    none = F.lit(0).cast("long")

    def total(which: Callable[[Column], Column], value: Callable[[Column], Column] = lambda c: c["n"]) -> Column:
        return F.aggregate("cells", none, lambda acc, c: acc + F.when(which(c["mask"]), value(c)).otherwise(none))

    fails = lambda mask: mask.bitwiseAND(bit) != 0
    stands = lambda mask: mask.bitwiseAND(before) == 0
    here = lambda mask: fails(mask) & stands(mask)
    all_orders = math.factorial(len(letters))
    return steps.select(
        "part", "filter_order", "step",
        total(lambda m: ~fails(m) & stands(m)).alias("kept"), total(here).alias("removed"),
        total(lambda m: fails(m) & ~stands(m)).alias("redundant"), total(lambda m: m == bit).alias("unique_fails"),
        total(here, lambda c: c["good"]).alias("good_lost"), total(here, lambda c: c["toxic"]).alias("toxic_lost"),
        total(fails, lambda c: (c["n"] * all_orders / F.bit_count(c["mask"])).cast("long")).alias("shapley"),
    )
