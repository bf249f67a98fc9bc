"""Best-fit packing of documents into fixed bins, constrained by conflicts.

A document longer than a bin is cut into full pieces, which fill bins of their own, and a rest. Pieces are dealt by
hash of the document, and its number among equal ones, into shards of about ``shard_rows`` documents, so that no source,
copy group or repeated row gathers in a task; within a shard they are placed in order of falling size. Bins are kept
ordered by what is left in them and carry two bitmaps: the duplicate clusters they hold, and for each source as many
bits as documents it may have there. The search starts at the tightest bin that has room and goes on to the next larger
until one has no conflict; else a new bin is opened. Pieces that agree in size, source and cluster are placed in a row:
what one of them was refused by refuses the next, so that its search goes on where the last one ended.

Defined cases: a null text has no words and one piece of size 0; a null source is a source; repeated rows are
documents of their own, in one cluster and so in different bins; a null id is allowed; an empty table gives an empty
result; nothing is dropped; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkmill.llm.words import SPACE_CLASS, counted, n_words
from larkmill.session import cut_lineage


@dataclass(frozen=True)
class PackRules:
    capacity: int = 2048
    per_source: int = 2
    shard_rows: int = 4000


DDL = "doc_id long, source string, piece long, start long, size long, bin_id long, at long"
SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("source", pa.string()), ("piece", pa.int64()), ("start", pa.int64()),
     ("size", pa.int64()), ("bin_id", pa.int64()), ("at", pa.int64())]
)


class Bins:
    """Open bins ordered by what is left in them."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.left: list[tuple[int, int]] = []
        self.clusters: list[int] = []
        self.sources: list[int] = []
        self.last: tuple[int, int, int] | None = None
        self.after = (0, -1)

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset) for a piece; source and cluster are small local numbers."""
        bit, shift = 1 << cluster, source * self.per_source
        full = (1 << self.per_source) - 1
        begin = self.after if self.last == (size, source, cluster) else (size, -1)
        for k in range(bisect_left(self.left, begin), len(self.left)):
            room, own = self.left[k]
            held = self.sources[own] >> shift & full
            if not self.clusters[own] & bit and held != full:
                del self.left[k]
                self.after = (room, own)
                break
        else:
            room, own, held = self.capacity, len(self.clusters), 0
            self.clusters.append(0)
            self.sources.append(0)
            self.after = (self.capacity, own)  # the bin itself holds the cluster, and no other had room
        self.last = (size, source, cluster)
        self.clusters[own] |= bit
        self.sources[own] |= (held + 1) << shift
        insort(self.left, (room - size, own))
        return own, self.capacity - room


def pack(items: list[tuple[int, int, int]], capacity: int, per_source: int) -> list[list[tuple[int, int, int, int]]]:
    """For each (size, source, cluster), its pieces as (start, size, bin, offset)."""
    bins = Bins(capacity, per_source)
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in items]
    rests = []
    for k, (size, source, cluster) in enumerate(items):
        fulls = size // capacity
        for p in range(fulls):
            out[k].append((p * capacity, capacity, *bins.place(capacity, source, cluster)))
        if size % capacity or not size:
            rests.append((-(size % capacity), cluster, source, k))
    for negative, cluster, source, k in sorted(rests):
        out[k].append((items[k][0] // capacity * capacity, -negative, *bins.place(-negative, source, cluster)))
    return out


def duplicate_cluster(text: Column) -> Column:
    """Texts that agree but for letter case and white space share a cluster."""
    flat = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"{SPACE_CLASS}+", " ")
    return F.xxhash64(F.trim(flat))


def pack_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    cluster: Column | None = None,
    rules: PackRules = PackRules(),
) -> DataFrame:
    """(doc_id, source, piece, start, size, bin_id, at): words [start, start + size) lie at ``at`` in a bin."""
    cluster = duplicate_cluster(F.col(text)) if cluster is None else cluster
    items = cut_lineage(
        docs.select(
            F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"),
            n_words(F.col(text)).alias("size"), cluster.alias("cluster"), F.xxhash64(F.col(text)).alias("th"),
        )
    )
    shards = max(1, -(-items.count() // rules.shard_rows))
    capacity, per_source = rules.capacity, rules.per_source

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([(c, "ascending") for c in ("doc_id", "th", "source", "size", "cluster")])
        shard = part["shard"][0].as_py()
        codes = [{}, {}]
        local = [
            [codes[k].setdefault(x, len(codes[k])) for x in part[name].to_pylist()]
            for k, name in enumerate(("source", "cluster"))
        ]
        placed = pack(list(zip(part["size"].to_pylist(), *local, strict=True)), capacity, per_source)
        rows = [
            (k, p, start, size, shard << 32 | own, at)
            for k, pieces in enumerate(placed)
            for p, (start, size, own, at) in enumerate(pieces)
        ]
        took = pa.array([r[0] for r in rows], pa.int64())
        rest = [pa.array([r[i] for r in rows], pa.int64()) for i in range(1, 6)]
        return pa.table([part["doc_id"].take(took), part["source"].take(took), *rest], schema=SCHEMA)

    # Equal items are counted and numbered again, so that they are spread over the shards.
    each = counted(items, ["doc_id", "source", "size", "cluster", "th"], "same")
    dealt = each.withColumn("shard", F.pmod(F.xxhash64("doc_id", "th", "size", "same"), F.lit(shards)))
    return dealt.drop("same").groupBy("shard").applyInArrow(run, DDL)
