"""SimHash near-duplicates by pigeonhole blocks.

Distinct fingerprints are cut into ``blocks`` blocks. Two that differ in at most ``distance`` bits agree in at least
``blocks - distance`` of them, so each fingerprint is keyed by every such choice of blocks, and those with the same
key are compared by Hamming distance. Any number of blocks over ``distance`` finds the same pairs; more make finer
keys, so the number follows the count of distinct fingerprints. Within a key only a spanning forest of the links is
emitted. A key with over ``max_group`` fingerprints is not compared there: its fingerprints are keyed again, by
``distance`` more blocks (at most three times ``distance``) that begin at other bits, and compared whatever their number.

Links are between fingerprints only. Rows that share an id are not linked for that: with different texts they may lie
in different components, each with its own row in the result.

Defined cases: a null or blank text has the fingerprint zero, linked like any other; a null id takes part but is never
the least of a component (an all-null component has a null id); rows that share an id are told apart by their
fingerprints; repeated rows each get a row; texts are read whole; input columns other than the id and the text are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkmill.llm.batches import bound_batches, gathered
from larkmill.llm.components import components
from larkmill.session import cut_lineage

BITS = 64
SEED = 42


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The fingerprint of a text as an unsigned integer: a bit is set if over half the shingle hashes set it."""
    if not text:
        return 0
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(line, SEED)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
        hashes = [digest(line[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.array(hashes[at : at + 65536], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, hashed: bool = False
) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long of the same bits; if ``hashed``, th too, a hash of the text."""
    names = ["doc_id", "th"] if hashed else ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), shingle) for t in batch.column("text")]
            fps = pa.array(np.array(found, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), fps], [*names, "fp"])

    bound_batches(docs.sparkSession)
    slim = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("th")
    )
    return slim.select(*names, "text").mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "fp"]))


def block_count(n: int, distance: int) -> int:
    """Blocks for ``n`` fingerprints: enough for keys of about log2(n) bits."""
    blocks = distance + 2
    while blocks < 3 * distance and BITS * (blocks - distance) // blocks < math.log2(max(n, 2)) - 2:
        blocks += 1
    return blocks


def block_keys(fp: Column, blocks: int, distance: int, turn: int = 0) -> Column:
    """An array of long keys, one for each choice of ``blocks - distance`` blocks of the bits, turned by ``turn``."""
    if turn:
        fp = F.shiftleft(fp, turn).bitwiseOR(F.shiftrightunsigned(fp, BITS - turn))
    edges = [i * BITS // blocks for i in range(blocks + 1)]
    parts = [
        F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << (high - low)) - 1))
        for low, high in zip(edges, edges[1:], strict=False)
    ]
    chosen = combinations(range(blocks), blocks - distance)
    return F.array(*[F.xxhash64(F.lit(k), *[parts[i] for i in pick]) for k, pick in enumerate(chosen)])


def forest(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all of ``fps`` within ``distance`` of each other, directly or over others: a spanning forest."""
    left, right = [], []
    rest = fps
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = np.bitwise_count(rest ^ x) <= distance
            if near.any():
                new = rest[near]
                left.append(np.full(len(new), x))
                right.append(new)
                todo.extend(new)
                rest = rest[~near]
    none = np.empty(0, fps.dtype)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _compare(distance: int, max_group: int | None):
    """Over rows (key, fp) sorted by key: links (a, b), and (fp, null) for those in keys of over ``max_group``."""

    def groups(keys: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        two = starts[sizes == 2]
        a, b = fps[two], fps[two + 1]
        near = np.bitwise_count(a ^ b) <= distance
        yield a[near], b[near]
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            yield forest(fps[s : s + n], distance)

    def out(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        right = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), right], ["a", "b"])

    def linked(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        a, b = zip(*groups(keys, fps), strict=True)
        return out(np.concatenate(a), np.concatenate(b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, big = np.empty(0, np.int64), np.empty(0, np.uint64), None
        for batch in batches:
            keys = np.r_[keys, batch.column("key").to_numpy()]
            fps = np.r_[fps, batch.column("fp").to_numpy().view(np.uint64)]
            if not len(keys):
                continue
            last = int(np.searchsorted(keys, keys[-1]))
            if big is not None:
                over = len(keys) if keys[-1] == big else int(np.searchsorted(keys, big, "right"))
                yield out(fps[:over], None)
                keys, fps, last = keys[over:], fps[over:], max(0, last - over)
                big = big if not len(keys) else None
            if last:
                yield linked(keys[:last], fps[:last])
                keys, fps = keys[last:], fps[last:]
            if max_group is not None and len(keys) > max_group:
                big = keys[-1]
                yield out(fps, None)
                keys, fps = keys[:0], fps[:0]
        if len(keys):
            yield linked(keys, fps)

    return run


def fingerprint_links(
    distinct: DataFrame, n: int, distance: int, max_group: int = 4096, part_rows: int = 200_000
) -> DataFrame:
    """(a, b): links between ``n`` distinct fingerprints (column fp) that join all within ``distance``."""
    blocks = block_count(n, distance)

    def round_of(fps: DataFrame, blocks: int, most: int | None, turn: int = 0) -> DataFrame:
        keyed = fps.select(F.explode(block_keys(F.col("fp"), blocks, distance, turn)).alias("key"), "fp")
        dealt = keyed.repartition("key")
        if most is not None:
            dealt = gathered(dealt, n * math.comb(blocks, distance), part_rows)
        return dealt.sortWithinPartitions("key", "fp").mapInArrow(_compare(distance, most), "a long, b long")

    first = cut_lineage(round_of(distinct, blocks, max_group))
    links = first.where(F.col("b").isNotNull())
    deferred = first.where(F.col("b").isNull()).select(F.col("a").alias("fp")).distinct()
    if deferred.isEmpty():
        return links
    finer = max(blocks, min(blocks + distance, 3 * distance))
    return links.union(round_of(deferred, finer, None, BITS // (2 * finer)))


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = 4,
    distance: int = 4,
    max_group: int = 4096,
    part_rows: int = 50_000,
) -> DataFrame:
    """(doc_id, fp, component_id): the least id reachable over links of at most ``distance`` differing bits."""
    marked = cut_lineage(with_fingerprints(docs, doc_id, text, shingle))
    rows = marked.count()
    distinct = cut_lineage(gathered(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), rows, part_rows))
    links = fingerprint_links(distinct.select("fp"), distinct.count(), distance, max_group)
    # Nodes are fingerprints; a root's component takes the least id of all its fingerprints.
    found = components(links, "a", "b")
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n"))
    # Cut here, the join deals both of its sides anew, and a root with a large share of the fingerprints can be split.
    least = cut_lineage(gathered(least.where(F.col("n") > 1).drop("n"), rows, part_rows))
    linked = rooted.join(least, "root").select(F.col("fp").alias("l_fp"), "component_id")
    ids = distinct.join(linked, distinct["fp"] == linked["l_fp"], "left").select(
        F.col("fp").alias("d_fp"), F.coalesce("component_id", "first_id").alias("component_id")
    )
    # Cut here, both sides of the last join are dealt anew, and a fingerprint shared by many documents can be split.
    ids = cut_lineage(gathered(ids, rows, part_rows))
    return marked.join(ids, marked["fp"] == ids["d_fp"]).select("doc_id", "fp", "component_id")


def first_rows(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = 4,
    distance: int = 4,
    max_group: int = 4096,
    part_rows: int = 50_000,
) -> DataFrame:
    """(doc_id, th): for each component one row, of the least id, nulls last, then the least hash of the text.

    Components are those of ``near_duplicates``, also where no row has an id.
    """
    marked = cut_lineage(with_fingerprints(docs, doc_id, text, shingle, hashed=True))
    rows = marked.count()
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    distinct = cut_lineage(gathered(marked.groupBy("fp").agg(F.min(place).alias("first")), rows, part_rows))
    links = fingerprint_links(distinct.select("fp"), distinct.count(), distance, max_group)
    found = components(links, "a", "b")
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left").select("first", F.coalesce("root", "fp").alias("root"))
    return rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.th")
