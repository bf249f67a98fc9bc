"""Lexical and vector retrieval for batches of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from larkmill.functions import text as T
from larkmill.functions.stemming import stem_column
from larkmill.session import cut_lineage, small_or_not


def postings(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The inverted index (doc_id, term, tf) over lower-case words."""
    terms = docs.select(F.col(doc_id).alias("doc_id"), F.explode(T.split_words(F.lower(text))).alias("term"))
    return terms.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def match_terms(
    queries: DataFrame, query_id: str, terms: Column, docs: DataFrame, doc_id: str, text: str, mode: str = "all"
) -> DataFrame:
    """(query_id, doc_id, n_terms, n_found, fts_score) of documents with all (or any) terms of a query.

    The score is the mean of tf / (tf + 1) over the query's distinct terms. Documents are filtered by the query terms
    before anything is shuffled by document, and where the terms are few, as a count tells, before anything is shuffled.
    """
    asked = queries.select(F.col(query_id).alias("query_id"), F.array_distinct(terms).alias("terms"))
    wanted = small_or_not(cut_lineage(asked.select("query_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("q_term"))))
    words = docs.select(F.col(doc_id).alias("doc_id"), F.explode(T.split_words(F.lower(text))).alias("term"))
    asked_for = small_or_not(cut_lineage(wanted.select("q_term").distinct()))
    needed = words.join(asked_for, F.col("term") == F.col("q_term"), "left_semi")
    return _scores(needed.groupBy("doc_id", "term").agg(F.count("*").alias("tf")), wanted, mode, docs.count())


def _scores(counted: DataFrame, wanted: DataFrame, mode: str, n_docs: int, pairs: int = 2_000_000) -> DataFrame:
    """Scores of ``counted`` (doc_id, term, tf) of ``n_docs`` documents for ``wanted`` (query_id, n_terms, q_term).

    Documents meet most queries, so their pairs are far more than what they come from, by whose size Spark would cut its
    tasks. Documents are dealt to tasks of no more than about ``pairs`` pairs, where few terms are sent to all tasks and
    pairs are added up without a shuffle of their own.
    """
    n_queries = wanted.select("query_id").distinct().count()
    tasks = max(wanted.sparkSession.sparkContext.defaultParallelism, -(-n_docs * n_queries // pairs))
    counted = counted.repartition(tasks, "doc_id")
    hits = counted.join(wanted, F.col("term") == F.col("q_term"))
    scored = hits.groupBy("query_id", "doc_id", "n_terms").agg(
        F.count("*").alias("n_found"), F.sum(F.col("tf") / (F.col("tf") + 1)).alias("mass")
    )
    kept = scored.where(F.col("n_found") == F.col("n_terms")) if mode == "all" else scored
    return kept.select(
        "query_id", "doc_id", F.col("n_terms").cast("long").alias("n_terms"), "n_found",
        (F.col("mass") / F.col("n_terms")).alias("fts_score"),
    )


def match_stems(
    queries: DataFrame, query_id: str, terms: Column, docs: DataFrame, doc_id: str, text: str, mode: str = "all"
) -> DataFrame:
    """As ``match_terms``, over Porter stems.

    Only different words are stemmed. A query's stems are widened to all words of the documents that share one, and
    these are looked for, so that no text reaches a Python worker.
    """
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(terms)).alias("term"))
    words = docs.select(F.col(doc_id).alias("doc_id"), T.split_words(F.lower(text)).alias("words"))
    known = words.select(F.explode(F.array_distinct("words")).alias("term")).union(asked.select("term")).distinct()
    stems = cut_lineage(known.select(F.col("term").alias("word"), stem_column(F.col("term")).alias("stem")))
    meant = asked.join(stems, F.col("term") == F.col("word")).groupBy("query_id").agg(F.collect_set("stem").alias("stems"))
    wanted = small_or_not(cut_lineage(meant.select("query_id", F.size("stems").alias("n_terms"), F.explode("stems").alias("q_term"))))
    wide = small_or_not(cut_lineage(stems.join(wanted.select("q_term").distinct(), F.col("stem") == F.col("q_term"), "left_semi")))
    found = words.select("doc_id", F.explode("words").alias("said")).join(wide, F.col("said") == F.col("word"))
    return _scores(found.groupBy("doc_id", F.col("stem").alias("term")).agg(F.count("*").alias("tf")), wanted, mode, docs.count())


def top_k(df: DataFrame, by: str, k: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; the order must be total."""
    numbered = df.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return numbered.where(F.col(rank) <= k)


def nearest_exact(
    queries: DataFrame, query_id: str, query_vector: str, base: DataFrame, base_id: str, base_vector: str, k: int,
    metric: str = "cosine", block_rows: int = 2048, shard_rows: int = 16384, cells: int = 1 << 21,
) -> DataFrame:
    """(query_id, rank, base_id, score): exact nearest vectors by cosine or negative L2, ties to the smaller id. Null
    vectors take no part.

    Up to ``block_rows`` queries are sent to the tasks, which compare what they read and send on ``k`` rows a query, so no
    vector is shuffled. More queries are dealt in blocks that meet shards of the base, each pair in a task of its own.
    A task holds about ``cells`` scores at a time, of as many queries as that allows.
    """
    asked = queries.select(F.col(query_id).cast("long").alias("id"), F.col(query_vector).cast("array<double>").alias("v")).where("v IS NOT NULL")
    own = base.select(F.col(base_id).cast("long").alias("id"), F.col(base_vector).cast("array<double>").alias("v")).where("v IS NOT NULL")
    schema = "qid long, bid long, score double"

    def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def compared(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        if metric == "cosine":
            return _unit(q) @ _unit(x).T
        square = (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * q @ x.T
        return -np.sqrt(np.maximum(square, 0))

    def best(ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first ``k`` of each row. Scores that agree to 12 places are ties; the smaller id goes first."""
        rounded = scores.round(12)
        if scores.shape[1] > 4 * k:  # all that may be among them, ties with the last one too
            last = -np.partition(-rounded, k - 1, axis=1)[:, k - 1 : k]
            width = int((rounded >= last).sum(axis=1).max())
            some = np.argpartition(-rounded, width - 1, axis=1)[:, :width]
            ids, scores, rounded = (np.take_along_axis(m, some, 1) for m in (ids, scores, rounded))
        order = np.lexsort((ids, -rounded), axis=1)[:, :k]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)

    def added(ids: np.ndarray, scores: np.ndarray, q: np.ndarray, own: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first ``k`` of each query after the vectors ``x`` too, for some queries at a time."""
        rows, parts = max(1, cells // (len(own) + ids.shape[1])), []
        for i in range(0, len(q), rows):
            some = slice(i, i + rows)
            more = np.broadcast_to(own, (len(q[some]), len(own)))
            parts.append(best(np.concatenate([ids[some], more], 1), np.concatenate([scores[some], compared(q[some], x)], 1)))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    few = asked.limit(block_rows + 1).toArrow()
    if len(few) <= block_rows:
        q_ids, q = few["id"].to_numpy(), matrix(few["v"]) if len(few) else np.zeros((0, 1))
        sent = base.sparkSession.sparkContext.broadcast((q_ids, q))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q_ids, q = sent.value
            ids, scores = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0))
            for batch in batches:
                if len(batch) and len(q):
                    ids, scores = added(ids, scores, q, batch.column("id").to_numpy(), matrix(batch.column("v")))
            if ids.size:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, ids.shape[1])), pa.array(ids.ravel()), pa.array(scores.ravel())], ["qid", "bid", "score"])

        near = own.mapInArrow(scan, schema)
    else:
        n_queries, n_base = asked.count(), own.count()
        blocks, shards = max(1, -(-n_queries // block_rows)), max(1, -(-n_base // shard_rows))
        every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        part = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
        left = asked.select("id", "v", part(blocks).alias("block"), every(shards).alias("shard"))
        right = own.select("id", "v", part(shards).alias("shard"), every(blocks).alias("block"))

        def search(own: pa.Table, asked: pa.Table) -> pa.Table:
            if not len(own) or not len(asked):
                return pa.table({"qid": pa.array([], pa.int64()), "bid": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
            none = np.zeros((len(asked), 0))
            ids, scores = added(none.astype(np.int64), none, matrix(asked["v"]), own["id"].to_numpy(), matrix(own["v"]))
            return pa.table({"qid": np.repeat(asked["id"].to_numpy(), ids.shape[1]), "bid": ids.ravel(), "score": scores.ravel()})

        near = right.groupBy("shard", "block").cogroup(left.groupBy("shard", "block")).applyInArrow(search, schema)
    ranked = top_k(near, "qid", k, F.desc(F.round("score", 12)), F.asc("bid"))
    return ranked.select(
        F.col("qid").alias("query_id"), F.col("rank").cast("long").alias("rank"), F.col("bid").alias("base_id"), "score"
    )


def against_all(
    queries: DataFrame, base: DataFrame, keys: list[str], compare, schema: str, block_rows: int = 2048, shard_rows: int = 16384
) -> DataFrame:
    """What ``compare(ids, vectors, query_ids, query_vectors)`` finds where blocks of queries meet shards of all rows.

    Both sides are (id, v, *keys), and only rows with equal keys meet. Rows of the result are dicts of arrays by column.
    """
    blocks = max(1, -(-queries.count() // block_rows))
    shards = max(1, -(-base.count() // shard_rows))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    row = lambda df: df.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"), *keys)
    asked = row(queries).select("*", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("_block"), every(shards).alias("_shard"))
    own = row(base).select("*", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("_shard"), every(blocks).alias("_block"))

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        sides = [(t["id"].to_numpy(), matrix(t["v"]) if len(t) else np.zeros((0, 1))) for t in (left, right)]
        return pa.table(compare(*sides[0], *sides[1]))

    by = [*keys, "_shard", "_block"]
    return own.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(meet, schema)


def within_distance(queries: DataFrame, base: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """(a, b, dist): each query a with every other row b of equal keys at most ``radius`` away, by L2 to six places."""

    def compare(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray) -> dict[str, np.ndarray]:
        if not len(ids) or not len(q_ids):
            return {"a": np.empty(0, np.int64), "b": np.empty(0, np.int64), "dist": np.empty(0)}
        square = (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * q @ x.T
        i, j = np.nonzero(square <= (radius + 1e-3) ** 2)  # a little more; then exactly
        exact = np.round(np.sqrt(((q[i] - x[j]) ** 2).sum(1)), 6)
        kept = (exact <= radius) & (q_ids[i] != ids[j])
        return {"a": q_ids[i][kept], "b": ids[j][kept], "dist": exact[kept]}

    return against_all(queries, base, keys, compare, "a long, b long, dist double")


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def list_centres(sample: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Centres of ``lists`` groups of directions: means of what is nearest, from evenly spaced rows of the sample on."""
    unit = _unit(sample)
    centres = unit[np.unique(np.linspace(0, len(unit) - 1, min(lists, len(unit))).astype(int))]
    for _ in range(rounds):
        own = (unit @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        centres = np.where(np.bincount(own, minlength=len(centres))[:, None] > 0, _unit(sums), centres)
    return centres


def nearest_in_lists(
    queries: DataFrame, query_id: str, query_vector: str, base: DataFrame, base_id: str, base_vector: str, k: int,
    lists: int = 64, probes: int | None = None, sample: int = 4096, recall: float = 0.97, fit_queries: int = 64, shard_rows: int = 16384,
) -> DataFrame:
    """(query_id, rank, base_id, score): nearest vectors by cosine from the lists that a query probes.

    Every vector lies in the list of its nearest centre; centres are fitted on a bounded sample. Without ``probes``, as
    many lists are probed as let through the share ``recall`` of the true neighbours of up to ``fit_queries`` queries.
    Null vectors take no part. ``nearest_exact`` compares all.
    """
    spark = base.sparkSession
    own = base.where(F.col(base_vector).isNotNull()).select(F.col(base_id).cast("long").alias("id"), F.col(base_vector).cast("array<double>").alias("v"))
    asked = queries.where(F.col(query_vector).isNotNull()).select(F.col(query_id).cast("long").alias("id"), F.col(query_vector).cast("array<double>").alias("v"))
    drawn = own.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    if not drawn:
        return spark.createDataFrame([], "query_id long, rank long, base_id long, score double")
    centres = list_centres(np.array([r["v"] for r in drawn]), lists)

    def ordered(most: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
                    near = np.argsort(-(_unit(v) @ centres.T), axis=1, kind="stable")[:, :most]
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.tolist(), pa.list_(pa.int64()))], ["id", "v", "lists"])

        return run

    row = "id long, v array<double>, lists array<long>"
    listed = cut_lineage(own.mapInArrow(ordered(1), row).select("id", "v", F.get("lists", 0).alias("list")))
    if probes is None:
        some = asked.orderBy(F.xxhash64("id"), "id").limit(fit_queries)
        true = nearest_exact(some, "id", "v", own, "id", "v", k).join(listed.select(F.col("id").alias("base_id"), "list"), "base_id")
        places = some.mapInArrow(ordered(len(centres)), row).select(F.col("id").alias("query_id"), "lists")
        found = true.join(places, "query_id").select(F.array_position("lists", F.col("list")).alias("place")).collect()
        probes = int(np.quantile([r["place"] for r in found], recall, method="higher")) if found else len(centres)
    probing = asked.mapInArrow(ordered(probes), row).select("id", "v", F.explode("lists").alias("list"))

    def compare(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray) -> dict[str, np.ndarray]:
        if not len(ids) or not len(q_ids):
            return {"query_id": np.empty(0, np.int64), "base_id": np.empty(0, np.int64), "score": np.empty(0)}
        scores, take = _unit(q) @ _unit(x).T, min(k, len(ids))
        order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores.round(12)), axis=1)[:, :take]
        return {"query_id": np.repeat(q_ids, take), "base_id": ids[order].ravel(), "score": np.take_along_axis(scores, order, 1).ravel()}

    near = against_all(probing, listed, ["list"], compare, "query_id long, base_id long, score double", shard_rows=shard_rows * len(centres))
    ranked = top_k(near, "query_id", k, F.desc(F.round("score", 12)), F.asc("base_id"))
    return ranked.select("query_id", F.col("rank").cast("long").alias("rank"), "base_id", "score")


def best_per_group(df: DataFrame, keys: list[str], score: str, top: int = 3) -> DataFrame:
    """The largest score of each group, over its ``top`` best rows, with how many there were."""
    numbered = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score))))
    return numbered.where(F.col("_r") <= top).groupBy(*keys).agg(F.max(score).alias(score), F.count("*").alias("n_rows"))


def mean_vector(df: DataFrame, keys: list[str], vector: str, held: int = 20_000) -> DataFrame:
    """The element-wise mean of each group's vectors, as an array in order. Null components count for nothing; a place
    that some vectors lack is the mean of the others.

    Every task adds up what it reads, by key, and sends on a sum for each key it met (or for ``held`` of them at a time);
    the sums of a key, no more than there are tasks, are added up once more.
    """
    fields = [df.schema[k] for k in keys]
    partial = StructType([*fields, StructField("sums", ArrayType(DoubleType())), StructField("counts", ArrayType(LongType()))])
    whole = StructType([*fields, StructField("mean", ArrayType(DoubleType()))])

    def added(sums: dict, key: tuple, total: np.ndarray, count: np.ndarray) -> None:
        if key in sums:
            old, n = sums[key]
            if len(old) < len(total):
                old, n, total, count = total, count, old, n
            old, n = old.copy(), n.copy()
            old[: len(total)] += total
            n[: len(count)] += count
            total, count = old, n
        sums[key] = (total, count)

    def told(sums: dict) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in sums], to_arrow_type(f.dataType)) for i, f in enumerate(fields)]
        lists = [pa.array([v[j].tolist() for v in sums.values()], pa.list_(kind)) for j, kind in enumerate((pa.float64(), pa.int64()))]
        return pa.RecordBatch.from_arrays([*columns, *lists], [*keys, "sums", "counts"])

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            column = batch.column("_v")
            offsets = column.offsets.to_numpy()
            flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
            there = column.values.is_valid().to_numpy(zero_copy_only=False)
            flat = np.where(there, flat, 0.0)
            places = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True)) if keys else [()] * len(batch)
            codes = {key: i for i, key in enumerate(dict.fromkeys(places))}
            own, lengths = np.array([codes[p] for p in places], np.int64), np.diff(offsets)
            for length in np.unique(lengths):  # vectors of one length are a matrix
                at = np.flatnonzero(lengths == length)
                cells = offsets[at][:, None] + np.arange(length)
                total, count = np.zeros((len(codes), length)), np.zeros((len(codes), length), np.int64)
                np.add.at(total, own[at], flat[cells])
                np.add.at(count, own[at], there[cells].astype(np.int64))
                met = np.unique(own[at])
                by_code = list(codes)
                for code in met:
                    added(sums, by_code[code], total[code], count[code])
            if len(sums) > held:
                yield told(sums)
                sums = {}
        if sums:
            yield told(sums)

    def finish(part: pa.Table) -> pa.Table:
        sums: dict = {}
        for total, count in zip(part["sums"].to_pylist(), part["counts"].to_pylist(), strict=True):
            added(sums, (), np.array(total), np.array(count, np.int64))
        total, count = sums[()]
        mean = [t / n if n else None for t, n in zip(total.tolist(), count.tolist(), strict=True)]
        return pa.table([*(part[k][:1] for k in keys), pa.array([mean], pa.list_(pa.float64()))], [*keys, "mean"])

    slim = df.where(F.col(vector).isNotNull()).select(*keys, F.col(vector).cast("array<double>").alias("_v"))
    return slim.mapInArrow(sum_up, partial).groupBy(*keys).applyInArrow(finish, whole)
