"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be taken target / source_size times: a whole number of copies and a fraction. The
fractions are rounded jointly. Within a bucket of a source, documents are paired in order of falling size and words are
moved at random from the fraction of one to that of the other until one becomes 0 or 1; a large document is paired with
as many smaller ones at once as that takes. The moves keep the words of the bucket and the expectation of each
fraction. At most one document of a bucket stays open, and open ones of up to ``fan`` buckets are rounded together on the
next level of a reduction tree, until one is left for each source. That one is rounded to the nearer side, so a
source's words miss its target by half a document at most; its own expectation is the only one that isn't kept.

Buckets follow a hash of the document and its number among equal ones, about ``bucket_rows`` in each, so neither a hot
source nor a document that is repeated without end gathers in a task. Draws are seeded by source, bucket and level:
reruns agree on any partitioning. Targets are found on the table of sources, of any length: only the words that a unit
of weight gets reach the driver.

Defined cases: a null text has size 0 and is taken 0 times; a null source is the last source; repeated rows are items
of their own; a null id is allowed; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkmill.llm.batches import gathered
from larkmill.llm.words import counted, n_words
from larkmill.operators.tables import global_row_number
from larkmill.session import cut_lineage

TINY = 1e-9


@dataclass(frozen=True)
class MixRules:
    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    share: float = 1.5
    most: float = 2.0
    bucket_rows: int = 1000
    fan: int = 64
    seed: int = 7


def with_targets(sources: DataFrame, rules: MixRules = MixRules()) -> DataFrame:
    """``sources`` (source, source_size) with weight and target: words by weight in code-point order, null last.

    A source gets the least of its limit and its weight times a unit. The unit grows, as what limited sources leave is
    shared anew, until no further source is limited.
    """
    numbered = global_row_number(sources.withColumn("none", F.col("source").isNull()), ["none", "source"]).drop("none")
    turn = F.pmod(F.col("row") - 1, F.lit(len(rules.weights))).cast("int")
    weighed = cut_lineage(numbered.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in rules.weights]), turn)).drop("row"))
    limit, unit, before = rules.most * F.col("source_size"), 0.0, -1
    while True:
        over = unit * F.col("weight") >= limit
        found = weighed.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(over, F.col("source_size"))).alias("limited"),
            F.sum(F.when(~over, F.col("weight"))).alias("free"), F.count_if(over).alias("n"),
        ).first()
        if found["n"] == before or not found["free"]:
            break
        before = found["n"]
        unit = (rules.share * found["all"] - rules.most * (found["limited"] or 0)) / found["free"]
    return weighed.withColumn("target", F.least(limit, unit * F.col("weight")))


def pivot(sizes: list[int], parts: list[float], draw: random.Random) -> tuple[list[float], int | None]:
    """Rounds fractions, largest sizes first as given; returns them and the index of the one still open, if any.

    The first open document is paired with the next, or with as many of the next as can give or take all the words that
    make it 0 or 1. Each gives or takes in proportion to its words times its distance from 0 or 1, in both directions
    alike, so that expectations stay. If all the rest can't, one pair moves words until either becomes 0 or 1.
    """
    size, part = np.array(sizes, dtype=np.float64), np.array(parts, dtype=np.float64)
    part[(part < TINY) | (part > 1 - TINY)] = np.round(part[(part < TINY) | (part > 1 - TINY)])
    todo = np.flatnonzero((part > 0) & (part < 1))
    while len(todo) > 1:
        own, rest = todo[0], todo[1:]
        words, up = size[own], part[own]
        need = max(up, 1 - up) * words
        slack = size[rest] * np.minimum(part[rest], 1 - part[rest])
        reach = int(np.searchsorted(slack.cumsum(), need * (1 - 1e-12))) + 1
        if reach <= len(rest):
            pool, share = rest[:reach], slack[:reach] / slack[:reach].sum()
            step = (1 - up) * words if draw.random() < up else -up * words
            part[own] = 1.0 if step > 0 else 0.0
            part[pool] -= step * share / size[pool]
        else:
            other = rest[0]
            gain = min((1 - up) * words, part[other] * size[other])
            loss = min(up * words, (1 - part[other]) * size[other])
            step = gain if draw.random() * (gain + loss) < loss else -loss
            part[own] += step / words
            part[other] -= step / size[other]
            pool = np.array([own, other])
        part[pool] = np.where(part[pool] < TINY, 0.0, np.where(part[pool] > 1 - TINY, 1.0, part[pool]))
        todo = todo[(part[todo] > 0) & (part[todo] < 1)]
    return part.tolist(), int(todo[0]) if len(todo) else None


ITEM = pa.schema(
    [
        ("doc_id", pa.int64()), ("source", pa.string()), ("th", pa.int64()), ("size", pa.int64()),
        ("base", pa.int64()), ("part", pa.float64()), ("node", pa.int64()), ("open", pa.bool_()),
    ]
)
ITEM_DDL = "doc_id long, source string, th long, size long, base long, part double, node long, open boolean"


def _round(level: int, fan: int, seed: int, last: bool):
    def run(items: pa.Table) -> pa.Table:
        items = items.sort_by([("size", "descending"), ("doc_id", "ascending"), ("th", "ascending"), ("part", "ascending")])
        source, node = items["source"][0].as_py(), items["node"][0].as_py()
        draw = random.Random(f"{seed}|{source!r}|{level}|{node}")
        parts, open_at = pivot(items["size"].to_pylist(), items["part"].to_pylist(), draw)
        if last and open_at is not None:
            parts[open_at], open_at = float(parts[open_at] >= 0.5), None
        columns = {name: items[name] for name in ITEM.names} | {
            "part": pa.array(parts, pa.float64()),
            "node": pa.array([node // fan] * len(parts), pa.int64()),
            "open": pa.array([i == open_at for i in range(len(parts))], pa.bool_()),
        }
        return pa.table(columns, schema=ITEM)

    return run


def mix_sources(
    docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", rules: MixRules = MixRules()
) -> DataFrame:
    """(doc_id, source, th, size, source_size, target, copies): th is a hash of the text."""
    items = cut_lineage(
        docs.select(
            F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"),
            F.xxhash64(F.col(text)).alias("th"), n_words(F.col(text)).alias("size"),
        )
    )
    by_source = items.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    buckets = F.ceil(F.col("n") / rules.bucket_rows).cast("long")
    rates = cut_lineage(
        with_targets(by_source, rules).select(F.col("source").alias("r_source"), "source_size", "target", buckets.alias("buckets"))
    )
    known = rates.agg(F.max("buckets").alias("most"), F.sum("buckets").alias("all")).first()
    most, groups = int(known["most"] or 1), int(known["all"] or 0)
    # Equal items are counted and numbered again, so that each gets a bucket of its own.
    each = counted(items, ["doc_id", "source", "th", "size"], "same")
    rated = each.join(rates, each["source"].eqNullSafe(rates["r_source"]))
    ratio = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(ratio + 1e-9)
    start = rated.select(
        "doc_id", "source", "th", "size", whole.alias("base"),
        F.when(ratio - whole < 1e-9, 0.0).otherwise(ratio - whole).alias("part"),
        F.pmod(F.xxhash64("doc_id", "th", "size", "same", F.lit(rules.seed)), "buckets").alias("node"),
        F.lit(True).alias("open"),
    )
    todo, level, done = start, 0, []
    while True:
        last = most <= 1
        run = _round(level, rules.fan, rules.seed, last)
        rounded = todo.groupBy("source", "node").applyInArrow(run, ITEM_DDL)
        if not last:
            rounded = cut_lineage(gathered(rounded, groups, 8))
            groups = -(-groups // rules.fan)
        done.append(rounded.where(~F.col("open")))
        if last:
            break
        todo, level, most = rounded.where("open"), level + 1, -(-most // rules.fan)
    settled = done[0]
    for more in done[1:]:
        settled = settled.union(more)
    return settled.join(rates, settled["source"].eqNullSafe(rates["r_source"])).select(
        "doc_id", "source", "th", "size", "source_size", "target",
        (F.col("base") + F.col("part").cast("long")).alias("copies"),
    )


def _group_key(doc_id: Column, source: Column, text_hash: Column) -> list[Column]:
    """Id, source and text hash without nulls."""
    none = F.concat(doc_id.isNull().cast("string"), source.isNull().cast("string"))
    return [
        F.coalesce(doc_id, F.lit(0)).alias("k_id"), F.coalesce(source, F.lit("")).alias("k_source"), none.alias("k_none"),
        text_hash.alias("k_th"),
    ]


def take_copies(docs: DataFrame, mixed: DataFrame, doc_id: str, source: str, text: str) -> DataFrame:
    """The rows of ``docs``, each as often as ``mixed`` says.

    Rows that share id, source and text are numbered within the partition they lie in and these are numbered by their
    counts, so that no such group has to meet in a task. Of the group's copies, the last rows get the larger number.
    """
    own = ["k_id", "k_source", "k_none", "k_th"]
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        *_group_key(F.col(doc_id).cast("long"), F.col(source), F.xxhash64(F.col(text))),
    )
    groups = mixed.select(*_group_key(F.col("doc_id"), F.col("source"), F.col("th")), "copies").groupBy(*own)
    # All rows of a group have the same ratio, so their copies differ by one at most.
    sizes = groups.agg(F.count("*").alias("n"), F.min("copies").alias("few"), F.sum("copies").alias("sum"))
    groups = cut_lineage(sizes.select(*own, "n", "few", (F.col("sum") - F.col("n") * F.col("few")).alias("more")))
    one = packed.join(groups.where("n = 1"), own).select("row", F.col("few").alias("copies"))
    several = groups.where("n > 1")
    if not several.isEmpty():
        held = cut_lineage(packed.join(several, own).withColumn("at", F.spark_partition_id()))
        before = Window.partitionBy(*own).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        parts = held.groupBy(*own, "at").agg(F.count("*").alias("here"))
        parts = cut_lineage(parts.select(*own, "at", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("before")))
        inside = F.row_number().over(Window.partitionBy(*own, "at").orderBy(F.lit(1)))
        ranked = held.withColumn("place", inside).join(parts, [*own, "at"])
        last = F.col("before") + F.col("place") > F.col("n") - F.col("more")
        one = one.union(ranked.select("row", (F.col("few") + last.cast("long")).alias("copies")))
    copied = one.where(F.col("copies") > 0).select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return copied.select("row.*")
