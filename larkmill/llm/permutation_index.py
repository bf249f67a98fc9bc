"""Approximate nearest neighbours by a permutation index.

Up to ``pivots`` vectors, none close to another, are drawn from a bounded sample. Each vector is represented by its
``prefix`` nearest pivots in order. It lies in the cell of its nearest pivot, and within a cell it is posted to the
inverted file of every pivot of its order, with its place there. A query goes to the cells of the first ``reach``
pivots of its own order, walks the files of its first ``prefix`` pivots there, which adds up the footrule distance of the
truncated orders, and compares its vector with all those whose footrule is within a cut. With places a and b of a pivot
in two orders, a shared pivot lessens the footrule by 2 * (prefix - max(a, b)), so the walk only meets shared pivots.

``reach`` and the cut are fitted: the true neighbours of up to ``calibrate`` sampled queries are found by comparing
these with all vectors, and each of the two lets through all but (1 - recall) / 2 of them. So the work follows what the
vectors are like, at any size: few cells and a narrow cut where they lie in groups, most cells where they have no
structure. A cut by distance, not by count, leaves no dense group out. ``recall=1`` makes the search exact.

Cells are dealt into shards of at most about ``shard_rows`` vectors, or ``shard_bytes``, less where that makes under
``shards`` of them: large cells are split by hash, small ones that lie near each other share a shard. A task holds one
shard and streams the queries past it; vectors are copied once for each ``block_rows`` queries, queries once for each
shard they visit. Where queries are a fixed share of the rows and vectors have no structure, a query visits most shards,
so the copies grow with the square of the rows, divided by the rows a shard holds: the shards are as large as memory
allows to keep that small, and it is small only where vectors lie in groups.

Inner products are turned into angles by one more component, which makes all vectors equally long and is 0 in queries,
so the order by pivots holds for vectors of any length. That length is just above the 99th percentile of the sample's;
the few longer vectors are compared with every query.

Defined cases: vectors that are null, empty, zero, of another dimension than most, or hold a null or non-finite
component take no part, nor do null ids; rows sharing an id count once, with the least vector; of equal scores the
smaller id comes first, and a product that isn't a number comes last; a query gets ``k`` rows, or all candidates if
there are fewer; an empty table gives an empty result; other columns are ignored, whatever their names. Pivots, the
sampled queries with ``k`` neighbours each, and a count for each pivot reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkmill.llm.batches import gathered
from larkmill.session import cut_lineage


@dataclass(frozen=True)
class PermutationRules:
    pivots: int = 256
    prefix: int = 64
    sample: int = 1024
    apart: float = 0.8  # pivots with a larger cosine are taken for one
    calibrate: int = 100
    recall: float = 0.96
    shard_rows: int = 65_536
    shard_bytes: int = 128 << 20  # of vectors and inverted files
    shards: int = 16  # so many tasks at least, if each has ``least_rows``
    least_rows: int = 1024
    block_rows: int = 262_144
    part_rows: int = 5000
    seed: int = 11


def usable(vector: Column) -> Column:
    big = F.lit(float("inf"))
    return F.coalesce(
        F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists(vector, lambda x: x != 0),
        F.lit(False),
    )


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def norms(vectors: np.ndarray) -> np.ndarray:
    most = np.abs(vectors).max(axis=1)
    return most * np.linalg.norm(vectors / most[:, None], axis=1)


def spread(unit: np.ndarray, most: int, apart: float) -> np.ndarray:
    """Places of up to ``most`` unit vectors in their order, none within cosine ``apart`` of one before it: a dense
    group of vectors gives one pivot, not many that crowd out others."""
    chosen: list[int] = []
    for i, x in enumerate(unit):
        if len(chosen) < most and (not chosen or (unit[chosen] @ x).max() <= apart):
            chosen.append(i)
    return np.array(chosen, np.int64)


def chained(pivots: np.ndarray) -> np.ndarray:
    """The pivots in an order in which each is the nearest to the one before among those left."""
    near = pivots @ pivots.T
    out, left = [0], np.ones(len(pivots), bool)
    for _ in range(1, len(pivots)):
        left[out[-1]] = False
        out.append(int(np.where(left, near[out[-1]], -np.inf).argmax()))
    return pivots[out]


@dataclass(frozen=True)
class Pivots:
    """Pivots on the unit sphere of one dimension more, and the length that vectors are brought to."""

    matrix: np.ndarray
    length: float
    prefix: int

    def lengthened(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of length 1 with the further component, and which of them were too long for it."""
        long = norms(vectors) > self.length
        own = vectors / self.length
        square = np.einsum("ij,ij->i", np.where(long[:, None], 0.0, own), np.where(long[:, None], 0.0, own))
        return np.c_[own, np.sqrt(np.maximum(0.0, 1 - square))], long

    def orders(self, vectors: np.ndarray) -> np.ndarray:
        """The numbers of all pivots for each of the vectors, nearest first."""
        return np.argsort(-(vectors @ self.matrix.T), axis=1, kind="stable").astype(np.uint16)

    def queries(self, vectors: np.ndarray) -> np.ndarray:
        """The orders of queries. Only directions count, so that no product grows over all bounds."""
        return self.orders(np.c_[vectors / np.abs(vectors).max(axis=1, keepdims=True), np.zeros(len(vectors))])


def draw_pivots(sample: np.ndarray, n: int, rules: PermutationRules) -> Pivots:
    """Pivots from a sample of ``n`` vectors; a quarter of these at most, so that small tables are pruned as well."""
    sizes = norms(sample)
    length = 1.01 * float(np.quantile(sizes, 0.99, method="higher"))
    usual = sample[sizes <= length]
    unit, _ = Pivots(np.empty((0, 0)), length, 0).lengthened(usual)
    chosen = unit[spread(unit, max(1, min(rules.pivots, n // 4)), rules.apart)]
    return Pivots(chained(chosen), length, max(1, min(rules.prefix, len(chosen) // 2)))


def agreement(codes: np.ndarray, order: np.ndarray, prefix: int) -> np.ndarray:
    """Half of what the footrule of truncated orders ``codes`` (rows) to the one of ``order`` lacks to the largest."""
    place = np.full(int(max(codes.max(initial=0), order.max(initial=0))) + 1, prefix)
    place[order[:prefix]] = np.arange(prefix)
    return (prefix - np.maximum(place[codes], np.arange(prefix))).sum(axis=1)


class Shard:
    """Vectors with their inverted files: for each pivot the vectors that have it in their order, and their places."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, always: np.ndarray, pivots: int):
        self.ids, self.vectors, self.always = ids, vectors, always
        self.prefix = codes.shape[1]
        posted = codes.ravel()
        by_pivot = np.argsort(posted, kind="stable")
        self.starts = np.searchsorted(posted[by_pivot], np.arange(pivots + 1))
        self.members = (by_pivot // self.prefix).astype(np.int32)
        self.weights = (self.prefix - by_pivot % self.prefix).astype(np.int32)

    def shared(self, order: np.ndarray) -> np.ndarray:
        """The ``agreement`` of each vector with a query, by a walk over the query's inverted files."""
        out = np.zeros(len(self.ids), np.int32)
        for place, pivot in enumerate(order[: self.prefix]):
            low, high = self.starts[pivot], self.starts[pivot + 1]
            out[self.members[low:high]] += np.minimum(self.weights[low:high], self.prefix - place)
        return out

    def search(self, q_id: int, q: np.ndarray, order: np.ndarray, k: int, cut: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the nearest, and how many vectors were compared."""
        shared = self.shared(order)
        taken = (shared >= cut) | self.always
        if len(shared) > k + 1:  # k rows at least, whatever the cut
            taken[np.argpartition(-shared, k)[: k + 1]] = True
        else:
            taken[:] = True
        near = np.flatnonzero(taken & (self.ids != q_id))
        ids, scores = self.ids[near], np.einsum("ij,j->i", self.vectors[near], q)
        ranked = np.where(np.isnan(scores), -np.inf, scores)
        if len(ids) > k:
            some = np.flatnonzero(ranked >= np.partition(ranked, -k)[-k])
            ids, scores, ranked = ids[some], scores[some], ranked[some]
        best = np.lexsort((ids, -ranked))[:k]
        return ids[best], scores[best], len(near)


def deal_cells(counts: np.ndarray, shard_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The first shard of each cell and the number of its shards: large cells have several, neighbours share one."""
    first, parts = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    shard, filled = 0, 0
    for cell, n in enumerate(counts.tolist()):
        if n > shard_rows or filled + n > shard_rows:
            shard, filled = shard + (filled > 0), 0
        first[cell] = shard
        if n > shard_rows:
            parts[cell] = -(-n // shard_rows)
            shard += int(parts[cell])
        else:
            filled += n
    return first, parts


def nearest(
    table: DataFrame,
    is_query: Column,
    k: int,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    rules: PermutationRules = PermutationRules(),
) -> DataFrame:
    """(query_id, rank, vec_id, score, compared) of the ``k`` nearest found of each row where ``is_query`` (over column
    vec_id); compared is the number of vectors that were compared with the query exactly."""
    spark = table.sparkSession
    kind = "array<float>" if dict(table.dtypes)[vector] == "array<float>" else "array<double>"
    slim = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast(kind).alias("v")).where(
        F.col("vec_id").isNotNull() & usable(F.col("v"))
    )
    sized = slim.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, vec_id long, score double, compared long"
    if sized is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, compared long")
    rows = slim.where(F.size("v") == sized["d"]).groupBy("vec_id").agg(F.min("v").alias("v"))
    rows = cut_lineage(gathered(rows, int(sized["count"]), rules.part_rows))
    known = rows.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    n, n_queries = int(known["n"]), int(known["q"])
    by_hash = F.xxhash64("vec_id", F.lit(rules.seed))
    drawn = rows.orderBy(by_hash, "vec_id").limit(rules.sample).select("v").collect()
    pivots = draw_pivots(np.array([r["v"] for r in drawn], dtype=np.float64), n, rules)
    count, prefix = len(pivots.matrix), pivots.prefix
    shared = spark.sparkContext.broadcast(pivots)  # a bounded number of vectors

    def represent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                own, long = shared.value.lengthened(_matrix(batch.column("v")))
                codes = shared.value.orders(own)[:, :prefix]
                cell = np.where(long, count, codes[:, 0]).astype(np.int32)
                packed = pa.array([x.tobytes() for x in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), packed], ["vec_id", "v", "cell", "codes"])

    indexed = cut_lineage(rows.mapInArrow(represent, f"vec_id long, v {kind}, cell int, codes binary"))
    asked = rows.where(is_query)
    counts = np.zeros(count + 1, np.int64)
    for r in indexed.groupBy("cell").count().collect():
        counts[r["cell"]] = r["count"]
    reach, cut = count, 0
    if rules.recall < 1 and n > k + 1:
        some = asked.orderBy(by_hash, "vec_id").limit(rules.calibrate).collect()
        reach, cut = fitted_cuts(indexed, pivots, [(r["vec_id"], r["v"]) for r in some], k, rules.recall)
    fitting = min(rules.shard_rows, max(1, rules.shard_bytes // (8 * int(sized["d"]) + 18 * prefix)))
    first, parts = deal_cells(counts, min(fitting, max(rules.least_rows, n // rules.shards)))
    blocks = max(1, -(-n_queries // rules.block_rows))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            orders = shared.value.queries(_matrix(batch.column("v")))
            shards = []
            for order in orders:
                enough = int(np.searchsorted(counts[order].cumsum(), k + 1)) + 1
                cells = [*order[: max(reach, enough)].tolist(), *([count] if counts[count] else [])]
                shards.append(np.unique(np.concatenate([np.arange(first[c], first[c] + parts[c]) for c in cells])))
            packed = pa.array([x[:prefix].tobytes() for x in orders], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, packed, pa.array(shards, pa.list_(pa.int64()))], ["vec_id", "v", "codes", "shards"]
            )

    at = lambda values: F.get(F.array(*[F.lit(int(x)) for x in values]), F.col("cell")).cast("long")
    shard = at(first) + F.pmod(F.xxhash64("vec_id"), at(parts))
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("long")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    columns = ["shard", "block", "asks", "vec_id", "v", "codes", "always"]
    left = indexed.select(
        shard.alias("shard"), every.alias("block"), F.lit(False).alias("asks"), "vec_id", "v", "codes", (F.col("cell") == count).alias("always")
    )
    right = asked.mapInArrow(visit, f"vec_id long, v {kind}, codes binary, shards array<long>").select(
        F.explode("shards").alias("shard"), block.alias("block"), F.lit(True).alias("asks"), "vec_id", "v", "codes", F.lit(False).alias("always")
    )
    dealt = left.union(right).select(*columns).repartition("shard", "block").sortWithinPartitions("shard", "block", "asks", "vec_id")

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], bool, pa.RecordBatch]]:
        """The runs of one shard, block and kind of row in turn."""
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns[:3]], axis=1)
            edges = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1), True]) if len(keys) else [0]
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                yield (int(keys[low, 0]), int(keys[low, 1])), bool(keys[low, 2]), batch.slice(low, high - low)

    def unpacked(part: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes = np.frombuffer(b"".join(part["codes"].to_pylist()), np.uint16).reshape(len(part), -1)
        return part["vec_id"].to_numpy(), _matrix(part["v"]), codes

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, files = None, [], None
        for own, asks, part in parted(batches):
            if own != key:
                key, held, files = own, [], None
            if not asks:
                held.append(part)
                continue
            if held:
                whole = pa.Table.from_batches(held)
                files, held = Shard(*unpacked(whole), whole["always"].to_numpy(), count), []
            if files is None:
                continue
            out: list[list[np.ndarray]] = [[], [], [], []]
            for q_id, q, order in zip(*unpacked(part), strict=True):
                ids, scores, compared = files.search(q_id, q, order, k, cut)
                told = np.r_[np.array([compared]), np.zeros(max(0, len(ids) - 1), np.int64)][: len(ids)]
                for column, values in zip(out, (np.full(len(ids), q_id), ids, scores, told), strict=True):
                    column.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["query_id", "vec_id", "score", "compared"])

    near = dealt.mapInArrow(search, schema)
    own = Window.partitionBy("query_id")
    best = own.orderBy(F.desc(F.nanvl("score", F.lit(float("-inf")))), "vec_id")
    ranked = near.withColumns({"rank": F.row_number().over(best), "compared": F.sum("compared").over(own)})
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "compared")


def fitted_cuts(
    indexed: DataFrame, pivots: Pivots, queries: list[tuple[int, list[float]]], k: int, recall: float
) -> tuple[int, int]:
    """How many cells a query visits, and the least agreement of orders, from the true neighbours of ``queries``."""
    count, prefix = len(pivots.matrix), pivots.prefix
    if not queries:
        return count, 0
    ids, vectors = np.array([i for i, _ in queries]), np.array([v for _, v in queries], dtype=np.float64)
    orders = pivots.queries(vectors)
    place = np.argsort(orders, axis=1)
    shared = indexed.sparkSession.sparkContext.broadcast((ids, vectors, orders, place))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, orders, place = shared.value
        best = [(np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)) for _ in ids]
        for batch in batches:
            if not len(batch):
                continue
            own, cell = batch.column("vec_id").to_numpy(), batch.column("cell").to_numpy()
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint16).reshape(len(batch), -1)
            scores = np.nan_to_num(_matrix(batch.column("v")) @ vectors.T, nan=-np.inf)
            for j, q_id in enumerate(ids):
                at = np.flatnonzero(own != q_id)
                if len(at) > k:
                    at = at[np.argpartition(-scores[at, j], k - 1)[:k]]
                long = cell[at] == count
                agrees = np.where(long, prefix * (prefix + 1) // 2, agreement(codes[at], orders[j], prefix))
                visit = np.where(long, 0, place[j][np.minimum(cell[at], count - 1)])
                joined = [np.concatenate(x) for x in zip(best[j], (scores[at, j], own[at], agrees, visit), strict=True)]
                top = np.lexsort((joined[1], -joined[0]))[:k]
                best[j] = tuple(x[top] for x in joined)
        made = [np.repeat(np.arange(len(ids)), [len(b[0]) for b in best]), *(np.concatenate(x) for x in zip(*best, strict=True))]
        kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(made, kinds, strict=True)], ["q", "score", "vec_id", "agrees", "visit"]
        )

    found = indexed.mapInArrow(compare, "q long, score double, vec_id long, agrees long, visit long")
    place_of = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    true = found.withColumn("rank", place_of).where(F.col("rank") <= k).select("agrees", "visit").collect()
    if not true:
        return count, 0
    miss = (1 - recall) / 2
    cut = int(np.quantile([r["agrees"] for r in true], miss, method="lower"))
    return 1 + int(np.quantile([r["visit"] for r in true], 1 - miss, method="higher")), cut
