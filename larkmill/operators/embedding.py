"""Embedding batches with de-duplication and cache, embedder registry, versions and compatibility."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkmill.functions import vectors as V
from larkmill.functions.text import split_words
from larkmill.operators.retrieval import against_all
from larkmill.session import cut_lineage

# Extension point: name to an expression (text, dimensions) -> array of double. A pandas UDF serves as well.
EMBEDDERS: dict[str, Callable[[Column, int], Column]] = {"hash": V.hash_embedding, "chars": V.char_embedding}


def register_embedder(name: str, build: Callable[[Column, int], Column]) -> None:
    EMBEDDERS[name] = build


def dedupe_map(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """Each row with the first row of the same text and the number of copies. Only hashes are shuffled."""
    keyed = df.select(row_id, F.sha2(text, 256).alias("k"))
    first = keyed.groupBy("k").agg(F.min(row_id).alias("embedded_as"), F.count("*").alias("copies"))
    return keyed.join(first, "k").select(row_id, "embedded_as", "copies")


def embed(
    df: DataFrame, row_id: str, text: str, embedder: str = "hash", dimensions: int = 1536, cache: DataFrame | None = None
) -> DataFrame:
    """(row_id, source, tokens, vector): each distinct text is embedded once unless the cache (text_key, vector) has it."""
    keyed = df.select(row_id, F.sha2(text, 256).alias("text_key"), text)
    distinct = keyed.groupBy("text_key").agg(F.any_value(text).alias("body"))
    if cache is None:
        cache = df.sparkSession.createDataFrame([], "text_key string, vector array<double>")
    known = cache.groupBy("text_key").agg(F.any_value("vector").alias("vector")).withColumn("source", F.lit("cache"))
    fresh = distinct.join(known, "text_key", "left_anti").select(
        "text_key", EMBEDDERS[embedder](F.col("body"), dimensions).alias("vector"), F.lit("computed").alias("source")
    )
    vectors = known.select("text_key", "vector", "source").union(fresh)
    tokens = F.size(split_words(F.col(text))).cast("long").alias("tokens")
    return keyed.select(row_id, "text_key", tokens).join(vectors, "text_key").select(row_id, "source", "tokens", "vector")


def _packed(values: np.ndarray) -> tuple[int, bytes]:
    """The least of some whole numbers, and how far each lies above it, in as few bytes as the largest needs."""
    least = int(values.min())
    above = (values - least).astype("<u8")
    width = max(1, -(-int(above.max()).bit_length() // 8))
    return least, above.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(least: int, held: bytes, n: int) -> np.ndarray:
    wide = np.zeros((n, 8), np.uint8)
    wide[:, : len(held) // n] = np.frombuffer(held, np.uint8).reshape(n, -1)
    return wide.view("<i8").ravel() + least


def _parted(keys: np.ndarray, *columns: np.ndarray):
    """Each different key with its rows of the columns."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    columns = [c[order] for c in columns]
    edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True]) if len(keys) else [0]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        yield int(keys[low]), *(c[low:high] for c in columns)


def _twice_ranks(codes: np.ndarray) -> np.ndarray:
    """Twice the mean place of each among all, from 1."""
    _, own, n = np.unique(codes, return_inverse=True, return_counts=True)
    return (2 * (n.cumsum() - n) + n + 1)[own]


class _Ranges:
    """Ranges of codes that hold like numbers of pairs, by a sample. A code as frequent as a range is one of its own,
    in which all ranks are equal, so that its pairs need not meet."""

    def __init__(self, sample: np.ndarray, n: int):
        inner = np.sort(sample)[(np.arange(1, n) * len(sample)) // n]
        often = inner[1:][inner[1:] == inner[:-1]]
        self.edges = np.unique(np.r_[inner, often + 1]).astype(np.int64)
        self.alone = np.r_[False, np.diff(self.edges) == 1, False][: len(self.edges) + 1]

    def of(self, codes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, codes, side="right").astype(np.uint16 if len(self.edges) < 1 << 16 else np.int64)


_PAIRS = pa.schema(
    [("stage", pa.int32()), ("salt", pa.int32()), ("first", pa.int32()), ("second", pa.int32()), ("n", pa.int64()), ("x0", pa.int64()),
     ("x", pa.binary()), ("y0", pa.int64()), ("y", pa.binary()), ("sx", pa.float64()), ("sxx", pa.float64())]
)
_PAIR_COLUMNS = "stage int, salt int, first int, second int, n long, x0 long, x binary, y0 long, y binary, sx double, sxx double"
_SUMS = ("sx", "sy", "sxx", "syy", "sxy")


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_PAIRS)
    return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, _PAIRS, strict=True)], schema=_PAIRS)


def _by_second(first: int, rank: np.ndarray, y: np.ndarray, ranges: _Ranges) -> list[tuple]:
    """The pairs of a first range, dealt by their second one; sums are all that is told of those that need no rank there."""
    rows = []
    for second, own_rank, own_y in _parted(ranges.of(y), rank, y):
        head = (2, (first * 31 + second) % 1021) if ranges.alone[second] else (1, 0)
        if ranges.alone[second]:
            wide = own_rank.astype(float)
            rows.append((*head, first, second, len(own_y), None, None, None, None, float(wide.sum()), float(wide @ wide)))
        else:
            rows.append((*head, first, second, len(own_y), *_packed(own_rank), *_packed(own_y), None, None))
    return rows


class _Classes:
    """Equal classes of codes, a power of two wide, that cover all similarities of vectors up to some length. A place is a
    code above the least; what is no finite number has places of its own."""

    def __init__(self, reach: float, most: int = 1 << 20):
        self.least = -math.ceil(reach * 1e9 * (1 + 1e-9)) - 1
        self.last = -2 * self.least
        self.shift = max(0, (self.last + 3).bit_length() - (most.bit_length() - 1))
        self.number = ((self.last + 2) >> self.shift) + 1

    def places(self, similarities: np.ndarray) -> np.ndarray:
        """Whole numbers, as floats, in the place of the similarities."""
        np.multiply(similarities, 1e9, out=similarities)
        np.rint(similarities, out=similarities)
        np.subtract(similarities, self.least, out=similarities)
        if not np.isfinite(similarities.sum()):
            np.nan_to_num(similarities, copy=False, nan=self.last + 2, posinf=self.last + 1, neginf=0)
        return similarities


def _spans(counts: np.ndarray, width: int, size: int) -> list[tuple[int, int]]:
    """Runs of classes, of which a task keeps either each pair, in 8 bytes, or two numbers for each code, in 12, and
    ``size`` bytes at most, or one class."""
    told, found = counts.cumsum(), []
    at = int(np.searchsorted(told, 1))
    while at < len(counts):
        before = int(told[at]) - int(counts[at])
        end = max(at + 1, int(np.searchsorted(told, before + size // 8, side="right")), min(len(counts), at + size // (12 * width)))
        last = int(np.searchsorted(told[:end], told[end - 1]))  # no empty classes at the end
        found.append((at, last + 1))
        at = int(np.searchsorted(told, told[end - 1] + 1))
    return found


def _by_place(keys: np.ndarray, bits: int, step: int = 1 << 20):
    """Sorted keys of a place and a class, so many at a time: the places, how many keys each has, the classes, and where each
    place begins. Equal places stay together."""
    at = 0
    while at < len(keys):
        end = len(keys) if at + step >= len(keys) else int(np.searchsorted(keys, ((keys[at + step] >> bits) + 1) << bits))
        places = keys[at:end] >> bits
        edges = np.flatnonzero(np.r_[True, places[1:] != places[:-1]])
        yield places[edges], np.diff(np.r_[edges, end - at]), keys[at:end] & ((1 << bits) - 1), edges
        at = end


_SUMMED = "side int, n long, squares double, products double, hidden double"


def similarity_preservation(df: DataFrame, row_id: str, old: str, new: str, is_query: Column, range_pairs: int = 32 << 20) -> DataFrame:
    """Spearman correlation of pairwise similarities under two versions, mapped to [0, 1]; 0.5 under 45 pairs.

    The pairs are those of the rows where ``is_query`` with all others, each once. Similarities are whole billionths. No
    pair is shuffled or written, as it is cheaper to multiply again. First all pairs are counted in a million classes a
    side, which gives each class its mean rank. Then a task for each range of similarities meets all pairs, keeps those
    in its range (8 bytes for ``range_pairs`` of them at most) and gives them their exact ranks.

    With ranks R and S and class means A and B, the sum of R S is that of R B + A (S - B) + (R - A) (S - B). The
    first two are summed exactly, R B by the ranges of the one side, A (S - B) by those of the other; the last is at most
    the root of the sums of (R - A)^2 and (S - B)^2, which the ranges tell too. Where this leaves the sixth digit
    open, or there are more queries than a task should hold or similarities without bounds, ``_preserved_by_shuffle``
    tells the result.
    """
    spark = df.sparkSession
    rows = df.select(F.col(row_id).cast("long").alias("id"), F.concat(old, new, F.array(is_query.cast("double"))).alias("v"))
    known = cut_lineage(rows.repartition(spark.sparkContext.defaultParallelism))
    queries = known.where(F.element_at("v", -1) > 0)
    exact = _preserved_without_shuffle(known, queries, range_pairs)
    if exact is None:
        return _preserved_by_shuffle(known, queries, min(range_pairs, 4 << 20))
    return spark.createDataFrame([exact], "compatibility double, pairs long")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _preserved_without_shuffle(known: DataFrame, queries: DataFrame, range_pairs: int, most_queries: int = 128 << 20) -> tuple[float, int] | None:
    spark = known.sparkSession
    context = spark.sparkContext

    def lengths(batches):
        for b in batches:
            x = _matrix(b["v"]) if b.num_rows else np.zeros((0, 1))
            half = x.shape[1] // 2
            norms = [np.linalg.norm(s, axis=1) for s in (x[:, :half], x[:, half:-1])]
            top = [float(n[np.isfinite(n)].max(initial=0.0)) for n in norms]
            asked = x[:, -1] > 0
            of_asked = [float(n[asked & np.isfinite(n)].max(initial=0.0)) for n in norms]
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "asked": [int(asked.sum())], "size": [x.shape[1]], "x": [top[0]], "y": [top[1]], "qx": [of_asked[0]], "qy": [of_asked[1]]})

    told = known.mapInArrow(lengths, "n long, asked long, size long, x double, y double, qx double, qy double")
    told = told.agg(F.sum("n").alias("n"), F.sum("asked").alias("asked"), F.max("size").alias("size"), *[F.max(c).alias(c) for c in ("x", "y", "qx", "qy")]).first()
    if not told["asked"]:
        return 0.5, 0
    reach = (told["x"] * told["qx"], told["y"] * told["qy"])
    if told["asked"] * told["size"] * 8 > most_queries or max(reach) * 1e9 > 1 << 50:
        return None
    sides = [_Classes(r) for r in reach]
    width = [1 << s.shift for s in sides]
    drawn = queries.toArrow()
    q_all, ids_all, half = _matrix(drawn["v"]), drawn["id"].to_numpy(), told["size"] // 2
    cuts = (slice(0, half), slice(half, -1))
    asked = context.broadcast((np.ascontiguousarray(ids_all), np.ascontiguousarray(q_all[:, cuts[0]]), np.ascontiguousarray(q_all[:, cuts[1]])))

    def blocks(batch: pa.RecordBatch, rows: int = 1024, step: int = 128):
        """(queries of both sides, rows of both sides, pairs that don't count or None) in small blocks."""
        q_ids, *q = asked.value
        x, ids = _matrix(batch["v"]), batch["id"].to_numpy()
        for own in (x[:, -1] > 0, ~(x[:, -1] > 0)):
            some, some_ids = x[own], ids[own]
            both = [np.ascontiguousarray(some[:, c]) for c in cuts]
            for a in range(0, len(some), rows):
                for k in range(0, len(q_ids), step):
                    twice = q_ids[k : k + step, None] >= some_ids[None, a : a + rows] if some[0, -1] > 0 else None
                    yield [v[k : k + step] for v in q], [v[a : a + rows] for v in both], twice

    def count(batches):
        n = [np.zeros(s.number, np.int64) for s in sides]
        for batch in batches:
            for q, x, twice in blocks(batch) if batch.num_rows else ():
                for k, side in enumerate(sides):
                    at = side.places(q[k] @ x[k].T).astype(np.int64) >> side.shift
                    np.add.at(n[k], at.ravel() if twice is None else at[~twice], 1)
        for k, counted in enumerate(n):
            for part in range(0, len(counted), 1 << 16):
                some = counted[part : part + (1 << 16)]
                if some.any():
                    least, packed = _packed(some)
                    yield pa.RecordBatch.from_pydict({"side": pa.array([k], pa.int32()), "part": pa.array([part], pa.int32()), "size": pa.array([len(some)], pa.int32()), "least": [least], "packed": [packed]})

    def added(key: tuple, rows: pa.Table) -> pa.Table:
        total = sum(_unpacked(*r) for r in zip(*(rows[c].to_pylist() for c in ("least", "packed", "size")), strict=True))
        least, packed = _packed(total)
        return pa.table({"side": [key[0].as_py()], "part": [key[1].as_py()], "size": [len(total)], "least": [least], "packed": [packed]}, schema=counts_schema)

    counts_schema = pa.schema([("side", pa.int32()), ("part", pa.int32()), ("size", pa.int32()), ("least", pa.int64()), ("packed", pa.binary())])
    met = known.mapInArrow(count, "side int, part int, size int, least long, packed binary")
    counts = [np.zeros(s.number, np.int64) for s in sides]
    for r in met.groupBy("side", "part").applyInArrow(added, "side int, part int, size int, least long, packed binary").collect():
        counts[r["side"]][r["part"] : r["part"] + r["size"]] = _unpacked(r["least"], bytes(r["packed"]), r["size"])
    pairs = int(counts[0].sum())
    if pairs < 45:
        return 0.5, pairs
    size = 8 * min(range_pairs, max(1 << 20, pairs // context.defaultParallelism))
    if any(min(8 * int(n.max()), 12 * w) > max(2 * size, 256 << 20) for n, w in zip(counts, width, strict=True)):
        return None
    # Ranks are told about their mean, as shares of all pairs.
    means = [(n.cumsum() - n / 2 - pairs / 2) / pairs for n in counts]
    ranks = context.broadcast(means)
    spans = [(k, low, high, int(n[:low].sum()), int(n[low:high].sum())) for k, n in enumerate(counts) for low, high in _spans(n, width[k], size)]

    def rank(batches):
        span = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if span is None:
                span = batch["span"][0].as_py()
                k, low, high, before, expected = spans[span]
                side, other = sides[k], sides[1 - k]
                first, end = low << side.shift, high << side.shift
                dense = 12 * (end - first) <= 8 * expected
                bits = other.number.bit_length()
                mean, means_there = ranks.value[k], ranks.value[1 - k]
                if dense:
                    n, w = np.zeros(end - first, np.uint32 if pairs < 1 << 32 else np.int64), np.zeros(end - first)
                else:
                    keys, filled = np.empty(expected + 1024, np.int64), 0
            elif batch["span"][0].as_py() != span:
                raise ValueError("a task is for one range")
            for q, x, twice in blocks(batch):
                at = side.places(q[k] @ x[k].T)
                kept = (at >= first) & (at < end)
                if twice is not None:
                    kept &= ~twice
                flat = np.flatnonzero(kept)
                if not len(flat):
                    continue
                i, j = np.divmod(flat, at.shape[1])
                if len(flat) * 16 > at.size:
                    met = (q[1 - k] @ x[1 - k].T)[i, j]
                else:
                    met = np.einsum("ij,ij->i", q[1 - k][i], x[1 - k][j])
                there = other.places(met).astype(np.int64) >> other.shift
                own = at.ravel()[flat].astype(np.int64) - first
                if dense:
                    np.add.at(n, own, n.dtype.type(1))  # a 1 of another type takes 25 times as long
                    np.add.at(w, own, means_there[there])
                else:
                    if filled + len(own) > len(keys):
                        keys = np.r_[keys[:filled], np.empty(len(own) + (1 << 16), np.int64)]
                    keys[filled : filled + len(own)] = own << bits | there
                    filled += len(own)
        if span is None:
            return
        sums, summed = np.zeros(3), 0

        def add(places: np.ndarray, counted: np.ndarray, weights: np.ndarray) -> None:
            nonlocal sums, summed
            counted = counted.astype(np.int64)
            exact = (before + summed + counted.cumsum() - counted / 2 - pairs / 2) / pairs
            off = exact - mean[(places + first) >> side.shift]
            # By the first side R B, by the second A (S - B).
            sums += [float(counted @ exact**2), float(weights @ (off if k else exact)), float(counted @ off**2)]
            summed += int(counted.sum())

        if dense:
            for a in range(0, len(n), 1 << 20):
                at = np.flatnonzero(n[a : a + (1 << 20)])
                add(at + a, n[at + a], w[at + a])
        else:
            keys = keys[:filled]
            keys.sort()
            for places, counted, classes, edges in _by_place(keys, bits):
                add(places, counted, np.add.reduceat(means_there[classes], edges))
        yield pa.RecordBatch.from_pydict({"side": pa.array([k], pa.int32()), "n": [summed], "squares": [sums[0]], "products": [sums[1]], "hidden": [sums[2]]})

    found, zip_parts = [], "spark.sql.unionOutputPartitioning"
    said = spark.conf.get(zip_parts, None)
    spark.conf.set(zip_parts, "false")  # one task reads all rows for a range, and Spark 4.1 would make one of them all
    try:
        for at in range(0, len(spans), 128):
            some = [known.select("id", "v", F.lit(k).alias("span")).coalesce(1) for k in range(at, min(len(spans), at + 128))]
            found += functools.reduce(DataFrame.union, some).mapInArrow(rank, _SUMMED).collect()
    finally:
        spark.conf.unset(zip_parts) if said is None else spark.conf.set(zip_parts, said)
    asked.destroy()
    ranks.destroy()
    total = lambda name, *which: math.fsum(r[name] for r in found if r["side"] in which)
    spread = math.sqrt(total("squares", 0) * total("squares", 1))
    if not spread:
        return 0.0, pairs
    # A product that is summed in another order may leave its range: a pair too few or too many.
    astray = sum(abs(total("n", k) - pairs) for k in (0, 1)) / pairs
    error = math.sqrt(total("hidden", 0) * total("hidden", 1)) / spread / 2 + 12 * astray
    score = (total("products", 0, 1) / spread + 1) / 2
    least, most = (round(min(1.0, max(0.0, s)), 6) for s in (score - error, score + error))
    return (least, pairs) if least == most else None


def _preserved_by_shuffle(known: DataFrame, queries: DataFrame, range_pairs: int) -> DataFrame:
    """The same by pairs that are shuffled; blocks of queries meet shards of all rows.

    The pairs go to ranges of the first similarity, of about ``range_pairs`` each, where they get their ranks within it,
    and with these to ranges of the second, where products are summed for each pair of ranges: what stands before a range
    is added to its ranks in the end. So a pair is shuffled twice, in about seven bytes each time, and no task holds more
    than a range; the pairs themselves grow with queries times rows.
    """
    spark = known.sparkSession

    def codes(x: np.ndarray, q: np.ndarray) -> list[np.ndarray]:
        half = x.shape[1] // 2
        found = (q[:, :half] @ x[:, :half].T, q[:, half:-1] @ x[:, half:-1].T)
        return [np.nan_to_num(np.rint(s * 1e9), nan=9.1e18, posinf=9e18, neginf=-9e18).clip(-9e18, 9.1e18).astype(np.int64) for s in found]

    def drawn(rows: DataFrame, most: int) -> np.ndarray:
        return np.array([r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(most).collect()])

    some, asked = drawn(known, 2048), drawn(queries, 256)
    n = max(1, -(-known.count() * queries.count() // range_pairs)) if len(asked) else 1
    x_ranges, y_ranges = (_Ranges(c.ravel(), n) for c in (codes(some, asked) if len(asked) else [np.zeros(1, np.int64)] * 2))

    def compare(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, step: int = 256) -> dict[str, pa.ChunkedArray]:
        parts = []
        for at in range(0, len(q_ids) if len(ids) else 0, step):
            own, own_ids = q[at : at + step], q_ids[at : at + step]
            once = np.where(x[None, :, -1] > 0, own_ids[:, None] < ids[None, :], True)
            parts.append([c[once] for c in codes(x, own)])
        rows = []
        if parts:
            a, b = (np.concatenate(c) for c in zip(*parts, strict=True))
            for first, own_a, own_b in _parted(x_ranges.of(a), a, b):
                if x_ranges.alone[first]:
                    dealt = _by_second(first, np.zeros(len(own_b), np.int64), own_b, y_ranges)
                    rows += [(r[0], (r[1] + k) % 1021, *r[2:]) for k, r in enumerate(dealt)]
                else:
                    rows.append((0, 0, first, -1, len(own_a), *_packed(own_a), *_packed(own_b), None, None))
        found = _table(rows)
        return dict(zip(found.column_names, found.columns, strict=True))

    def held(rows: pa.Table, name: str) -> np.ndarray:
        every = zip(*(rows[c].to_pylist() for c in (f"{name}0", name, "n")), strict=True)
        return np.concatenate([_unpacked(*r) for r in every])

    def rank_first(key: tuple, rows: pa.Table) -> pa.Table:
        if key[0].as_py() > 0:
            return rows
        return _table(_by_second(key[2].as_py(), _twice_ranks(held(rows, "x")), held(rows, "y"), y_ranges))

    def rank_second(key: tuple, rows: pa.Table) -> pa.Table:
        if key[0].as_py() > 1:
            zero = np.zeros(len(rows))
            return pa.table({"first": rows["first"], "second": rows["second"], "n": rows["n"], "sx": rows["sx"], "sy": zero, "sxx": rows["sxx"], "syy": zero, "sxy": zero})
        first = np.repeat(rows["first"].to_numpy(), rows["n"].to_numpy())
        x, y = held(rows, "x").astype(float), _twice_ranks(held(rows, "y")).astype(float)
        count = np.bincount(first)
        at = np.flatnonzero(count)
        sums = {k: np.bincount(first, weights=w)[at] for k, w in zip(_SUMS, (x, y, x * x, y * y, x * y), strict=True)}
        second = np.full(len(at), key[2].as_py(), np.int32)
        return pa.table({"first": at.astype(np.int32), "second": second, "n": count[at], **sums})

    met = against_all(queries, known, [], compare, _PAIR_COLUMNS, block_rows=4096, shard_rows=2048)
    # What passes through a step is spread by its salt and its second range.
    later = F.when(F.col("stage") > 0, F.col("second"))
    once = met.groupBy("stage", "salt", F.coalesce(later, "first").alias("at")).applyInArrow(rank_first, _PAIR_COLUMNS)
    sums = ", ".join(f"{k} double" for k in _SUMS)
    whole = once.withColumn("salt", F.when(F.col("stage") > 1, F.col("salt")).otherwise(0))
    cells = whole.groupBy("stage", "salt", "second").applyInArrow(rank_second, f"first int, second int, n long, {sums}")
    cells = cut_lineage(cells.groupBy("first", "second").agg(F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in _SUMS]))

    def bases(side: str, ranges: _Ranges) -> tuple[int, DataFrame]:
        """The pairs, and twice what is to be added to the ranks of each range, about the mean of all."""
        told = sorted((r["at"], r["n"]) for r in cells.groupBy(F.col(side).alias("at")).agg(F.sum("n").alias("n")).collect())
        pairs, before, rows = sum(k for _, k in told), 0, []
        for at, k in told:
            rows.append((at, float(2 * before - pairs - 1 + (k + 1 if ranges.alone[at] else 0))))
            before += k
        return pairs, spark.createDataFrame(rows, f"{side} int, base_{side} double")

    pairs, first = bases("first", x_ranges)
    second = bases("second", y_ranges)[1]
    u, v, k = F.col("base_first"), F.col("base_second"), F.col("n")
    total = cells.join(first, "first").join(second, "second").agg(
        F.sum(k * u * u + 2 * u * F.col("sx") + F.col("sxx")).alias("xx"), F.sum(k * v * v + 2 * v * F.col("sy") + F.col("syy")).alias("yy"),
        F.sum(k * u * v + u * F.col("sy") + v * F.col("sx") + F.col("sxy")).alias("xy"),
    )
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("xy") / F.sqrt(F.nullif("xx", F.lit(0.0))) / F.sqrt(F.nullif("yy", F.lit(0.0))) + 1) / 2))
    return total.select(F.round(F.lit(0.5) if pairs < 45 else score, 6).alias("compatibility"), F.lit(pairs).cast("long").alias("pairs"))


def preserved_in_classes(df: DataFrame, row_id: str, old: str, new: str, is_query: Column, classes: int = 65_536, reach: float = 1.0) -> DataFrame:
    """(compatibility, pairs, error): ``similarity_preservation`` of many pairs without keeping one.

    The pairs are met twice, in blocks. First each block counts its similarities in ``classes`` equal classes from
    ``-reach`` to ``reach``, those beyond in the outer ones; the counts of all blocks give every class its mean rank. Then
    the blocks sum products of these ranks. What leaves a block is at most two numbers a class, whatever the pairs, and
    what goes to the tasks are the ranks, 16 bytes a class.

    That is the correlation of similarities rounded to their classes. Mean ranks are the exact ranks' projection, and a
    class of c pairs hides c (c - 1) (c + 1) / 12 of their sum of squares at most. Where the hidden shares of the two
    versions are e * e and f * f, the exact correlation differs by less than 2 (e + f), so the score, half of it, by less
    than ``error`` = e + f. Under 45 pairs the score is 0.5, and so it is where all similarities of a version lie in one
    class. Rows without an id take no part, nor those whose vectors are null, have parts that are null or no finite
    numbers, or other lengths than most have.
    """
    if classes < 2 or reach <= 0:
        raise ValueError("there are two classes or more, and the reach is above 0")
    o, n = F.col(old).cast("array<double>"), F.col(new).cast("array<double>")
    sound = lambda v: v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    known = df.where(F.col(row_id).isNotNull() & F.coalesce(sound(o) & sound(n), F.lit(False)))
    size = known.groupBy(F.size(o).alias("a"), F.size(n).alias("b")).count().orderBy(F.desc("count"), "a", "b").first()
    width = (size["a"], size["b"]) if size else (0, 0)
    known = known.where((F.size(o) == width[0]) & (F.size(n) == width[1]))
    asked = F.coalesce(is_query, F.lit(False)).cast("double")
    both = cut_lineage(known.select(F.col(row_id).alias("id"), F.concat(o, n, F.array(asked)).alias("v")))
    half = width[0]

    def places(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, step: int = 64):
        """The classes of a block's pairs under both versions, for so many queries at a time."""
        place = lambda s: np.clip(np.floor((s + reach) * (classes / (2 * reach))), 0, classes - 1).astype(np.int64)
        for at in range(0, len(q_ids) if len(ids) else 0, step):
            own, some = q[at : at + step], q_ids[at : at + step]
            once = np.where(x[None, :, -1] > 0, some[:, None] < ids[None, :], True)
            yield place((own[:, :half] @ x[:, :half].T)[once]), place((own[:, half:-1] @ x[:, half:-1].T)[once])

    def count(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray) -> dict[str, np.ndarray]:
        n = np.zeros((2, classes), np.int64)
        for both_sides in places(ids, x, q_ids, q):
            for side, held in enumerate(both_sides):
                n[side] += np.bincount(held, minlength=classes)
        side, place = np.nonzero(n)
        return {"side": side, "place": place, "n": n[side, place]}

    queries = both.where(F.element_at("v", -1) > 0)
    told = against_all(queries, both, [], count, "side long, place long, n long").groupBy("side", "place").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros((2, classes))
    n[told["side"].to_numpy(np.int64), told["place"].to_numpy(np.int64)] = told["n"].to_numpy(np.float64)
    pairs = int(n[0].sum())
    score, error = 0.5, 0.0
    if pairs >= 45:
        # Ranks about their mean, as shares of all pairs, so that the sums stay small.
        rank = (n.cumsum(axis=1) - n / 2 - pairs / 2) / pairs
        spread = (n * rank**2).sum(axis=1)

        def product(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray) -> dict[str, np.ndarray]:
            return {"xy": np.array([sum(float(rank[0][a] @ rank[1][b]) for a, b in places(ids, x, q_ids, q))])}

        if spread.min() > 0:
            xy = against_all(queries, both, [], product, "xy double").agg(F.sum("xy")).first()[0]
            score = min(1.0, max(0.0, (xy / float(np.sqrt(spread[0] * spread[1])) + 1) / 2))
            error = float(np.sqrt(((n**3 - n).sum(axis=1)) / (float(pairs) ** 3 - pairs)).sum())
        else:
            error = 0.5
    return df.sparkSession.createDataFrame([(round(score, 6), pairs, min(1.0, error))], "compatibility double, pairs long, error double")


def paired_compatibility(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.agg(
        F.round(F.coalesce(F.avg(F.abs(V.cosine(F.col(old), F.col(new)))), F.lit(0.5)), 6).alias("compatibility"),
        F.count("*").alias("pairs"),
    )


def active_version(versions: DataFrame, default: tuple[str, int] = ("v1.0", 3072)) -> DataFrame:
    """The newest version that isn't deprecated, or the default."""
    spark = versions.sparkSession
    live = versions.where(F.col("deprecated_at").isNull()).select("version_id", "dimensions", "created_at", F.lit(0).alias("o"))
    other = spark.createDataFrame([default], "version_id string, dimensions int").select(
        "version_id", "dimensions", F.lit(None).cast("timestamp_ntz").alias("created_at"), F.lit(1).alias("o")
    )
    first = live.unionByName(other).orderBy("o", F.desc("created_at"), F.desc("version_id")).limit(1)
    return first.select("version_id", "dimensions")


def next_version_id(versions: DataFrame) -> str:
    return f"v{versions.count() + 1}.0"


def mark_legacy(chunks: DataFrame, version: str) -> DataFrame:
    """Chunks of another version need re-embedding."""
    return chunks.withColumn("needs_reembedding", ~F.col("embedding_version").eqNullSafe(F.lit(version)))


def mark_done(chunks: DataFrame, done: DataFrame, key: str, version: str) -> DataFrame:
    hit = done.select(key).distinct().withColumn("_done", F.lit(True))
    joined = chunks.join(hit, key, "left")
    return joined.withColumns(
        {
            "embedding_version": F.when(F.col("_done"), version).otherwise(F.col("embedding_version")),
            "needs_reembedding": F.when(F.col("_done"), False).otherwise(F.col("needs_reembedding")),
        }
    ).drop("_done")


def migration_progress(chunks: DataFrame, per_thousand: float = 0.0001) -> DataFrame:
    """Per version: chunks, pending ones, tokens (100 where unknown) and the cost of the pending."""
    tokens = F.coalesce("token_count", F.lit(100))
    pending = F.when(F.col("needs_reembedding"), tokens).otherwise(0)
    return chunks.groupBy("embedding_version").agg(
        F.count("*").alias("chunks"), F.count_if("needs_reembedding").alias("pending"), F.sum(tokens).alias("tokens"),
        F.round(F.sum(pending) / 1000 * per_thousand, 9).alias("cost"),
    )
