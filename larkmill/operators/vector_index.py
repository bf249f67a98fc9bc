"""A stored vector index: lists round centres, residuals as product codes, exact rerank; rows are added without a refit.

Centres and codes are fitted once on a bounded sample, about as many lists as the square root of the rows. A vector, made
1 long, lies in the list of its nearest centre; what is left of it is cut in parts of a few components, and of each part
the nearest of 256 code words is kept, a byte. A query's product with a vector is then its product with the centre plus
one table entry a part, so a search reads bytes, not vectors; the best ``rerank`` times ``k`` of each query are compared
exactly with the vectors that lie beside the codes in columns of their own.

Lists are dealt into shards by their counts, which the log holds, so a dense list is the work of several tasks. How many
lists a query probes is fitted to the true neighbours of a few sampled queries when the index is built.

Null vectors, those of another dimension, without a direction or with components that aren't finite take no part, nor do
null ids. Ids that the index holds aren't added again; rows that share an id count once, with the least vector.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkmill.functions.vectors import cosine
from larkmill.operators.retrieval import list_centres, nearest_exact, top_k
from larkmill.session import cut_lineage, ship
from larkmill.sources.commits import CommitConflict, CommitLog

ROW = "id long, list int, codes binary, v array<float>"


@dataclass(frozen=True)
class VectorRules:
    min_lists: int = 16
    max_lists: int = 4096
    sample_per_list: int = 64  # vectors drawn to fit, for each list
    part_size: int = 2  # components that share a code
    words: int = 256
    buckets: int = 32  # folders that lists are dealt to
    shard_rows: int = 65_536
    block_queries: int = 2048
    fit_queries: int = 64
    recall: float = 0.97
    rerank: int = 10


@dataclass(frozen=True)
class VectorModel:
    centres: np.ndarray  # lists x dimension
    words: np.ndarray  # parts x words x part size

    def parted(self, v: np.ndarray) -> np.ndarray:
        """Vectors cut in parts, the last one filled up with zeros."""
        parts, _, size = self.words.shape
        return np.pad(v, ((0, 0), (0, parts * size - v.shape[1]))).reshape(len(v), parts, size)

    def coded(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of each unit vector, and its codes."""
        lists = (v @ self.centres.T).argmax(axis=1)
        rest = self.parted(v - self.centres[lists])
        codes = np.empty(rest.shape[:2], np.uint8)
        for p, words in enumerate(self.words):
            codes[:, p] = ((words * words).sum(1) - 2 * rest[:, p] @ words.T).argmin(axis=1)
        return lists, codes

    def estimates(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Products of the query with what the codes say of residuals."""
        table = np.einsum("pwd,pd->pw", self.words, self.parted(q[None])[0])
        return table[np.arange(codes.shape[1]), codes].sum(axis=1)


def code_words(rest: np.ndarray, words: int, rounds: int = 8) -> np.ndarray:
    """Up to ``words`` means of what is nearest among parts of vectors, from evenly spaced rows on."""
    found = rest[np.unique(np.linspace(0, len(rest) - 1, min(words, len(rest))).astype(int))].copy()
    for _ in range(rounds):
        own = ((found * found).sum(1) - 2 * rest @ found.T).argmin(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, own, rest)
        n = np.bincount(own, minlength=len(found))[:, None]
        found = np.where(n > 0, sums / np.maximum(n, 1), found)
    return np.pad(found, ((0, words - len(found)), (0, 0)), mode="edge")


def fitted(sample: np.ndarray, lists: int, rules: VectorRules) -> VectorModel:
    """A model of unit vectors."""
    centres = list_centres(sample, lists)
    parts = -(-sample.shape[1] // rules.part_size)
    rough = VectorModel(centres, np.zeros((parts, rules.words, rules.part_size)))
    rest = rough.parted(sample - centres[(sample @ centres.T).argmax(axis=1)])
    return VectorModel(centres, np.stack([code_words(rest[:, p], rules.words) for p in range(parts)]))


def _usable(vector: Column) -> Column:
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(column: pa.Array) -> np.ndarray:
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


class VectorIndex:
    """An index below ``path``; what it consists of is in its log."""

    def __init__(self, spark: SparkSession, path: str, rules: VectorRules = VectorRules()):
        ship(spark)
        self.spark, self.path, self.rules, self.log = spark, path, rules, CommitLog(spark, path)

    def _slim(self, rows: DataFrame, row_id: str, vector: str) -> DataFrame:
        slim = rows.select(F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"))
        return slim.where(F.col("id").isNotNull() & _usable(F.col("v")))

    def add(self, base: DataFrame, row_id: str, vector: str, k: int = 20) -> None:
        """Adds rows. The first ones also fit the model, and the number of probes for ``k`` neighbours."""
        rows = self._slim(base, row_id, vector)
        state = self.log.latest()[1]
        if state:
            rows = rows.where(F.size("v") == state["size"]).join(self.rows(state).select("id"), "id", "left_anti")
        rows = cut_lineage(rows.groupBy("id").agg(F.min("v").alias("v")))
        if not state:
            sized = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
            if sized is None:
                return
            rows = rows.where(F.size("v") == sized["d"])
            model = self._fit(rows, sized["count"])
            state = {"size": sized["d"], "model": self._keep(model), "probes": len(model.centres), "buckets": self.rules.buckets, "generations": [], "counts": {}}
        else:
            model = self.model(state)
        shared = self.spark.sparkContext.broadcast(model)  # of bounded size

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    lists, codes = shared.value.coded(_unit(batch.column("v")))
                    packed = pa.array([c.tobytes() for c in codes], pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lists, pa.int32()), packed, batch.column("v")], ["id", "list", "codes", "v"])

        name = f"generation-{uuid.uuid4().hex}"
        listed = cut_lineage(rows.select("id", "v").mapInArrow(code, ROW))
        fresh = {r["list"]: r["count"] for r in listed.groupBy("list").count().collect()}  # at most as many as there are lists
        if not fresh:
            return
        parts = -(-max(fresh.values()) // self.rules.shard_rows)
        dealt = listed.withColumn("bucket", F.col("list") % state["buckets"]).repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(parts)))
        dealt.sortWithinPartitions("bucket", "list", "id").write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        first = not state["generations"]

        def added(now: dict) -> dict:
            now = now or state
            if now["model"] != state["model"]:
                raise CommitConflict("another writer has fitted the index")
            counts = dict(now["counts"])
            for x, n in fresh.items():
                counts[str(x)] = counts.get(str(x), 0) + n
            return now | {"counts": counts, "generations": [*now["generations"], name]}

        _, now = self.log.update(added)
        if first:
            probes = self._fitted_probes(now, model, k)
            self.log.update(lambda own: own | {"probes": probes})

    def _fit(self, rows: DataFrame, n: int) -> VectorModel:
        lists = max(min(self.rules.min_lists, n), min(self.rules.max_lists, math.isqrt(n)))
        drawn = rows.orderBy(F.xxhash64("id"), "id").limit(lists * self.rules.sample_per_list).select("v").toArrow()
        return fitted(_unit(drawn["v"].combine_chunks()), lists, self.rules)

    def _keep(self, model: VectorModel) -> str:
        name = f"model-{uuid.uuid4().hex}"
        parts = [(n, list(m.shape), bytearray(m.astype(np.float64).tobytes())) for n, m in (("centres", model.centres), ("words", model.words))]
        self.spark.createDataFrame(parts, "name string, shape array<long>, data binary").coalesce(1).write.parquet(f"{self.path}/{name}")
        return name

    def model(self, state: dict | None = None) -> VectorModel:
        rows = self.spark.read.parquet(f"{self.path}/{(state or self.log.latest()[1])['model']}").collect()
        return VectorModel(**{r["name"]: np.frombuffer(r["data"]).reshape(r["shape"]) for r in rows})

    def rows(self, state: dict, lists: set[int] | None = None) -> DataFrame:
        """The rows of all lists, or those of some; folders without any of these aren't read."""
        found = self.spark.read.schema(f"{ROW}, bucket int")
        whole = None
        for name in state["generations"]:
            part = found.option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
            whole = part if whole is None else whole.unionByName(part)
        if lists is not None and len(lists) < len(state["counts"]):
            whole = whole.where(F.col("bucket").isin(sorted({x % state["buckets"] for x in lists})) & F.col("list").isin(sorted(lists)))
        return whole

    def _fitted_probes(self, state: dict, model: VectorModel, k: int) -> int:
        """So many lists as let through all but ``1 - recall`` of the true neighbours of sampled rows."""
        rows = self.rows(state)
        some = rows.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(self.rules.fit_queries).select("id", "v").collect()
        asked = self.spark.createDataFrame([(r["id"], r["v"]) for r in some], "id long, v array<float>")
        true = nearest_exact(asked, "id", "v", rows, "id", "v", k + 1).where("query_id <> base_id")
        pairs = true.join(rows.select(F.col("id").alias("base_id"), "list"), "base_id").select("query_id", "list").collect()
        order = {r["id"]: np.argsort(np.argsort(-(_unit(pa.array([r["v"]], pa.list_(pa.float32()))) @ model.centres.T)[0])) for r in some}
        places = [int(order[p["query_id"]][p["list"]]) for p in pairs]
        return 1 + int(np.quantile(places, self.rules.recall, method="higher")) if places else len(model.centres)

    def search(self, queries: DataFrame, query_id: str, vector: str, k: int, probes: int | None = None) -> DataFrame:
        """(query_id, rank, base_id, score): the nearest found by cosine, ties to the smaller id."""
        state, rules = self.log.latest()[1], self.rules
        none = self.spark.createDataFrame([], "query_id long, rank long, base_id long, score double")
        if not state:
            return none
        model = self.model(state)
        asked = self._slim(queries, query_id, vector).where(F.col("v").isNotNull() & (F.size("v") == state["size"]))
        n_queries = asked.count()
        if not n_queries:
            return none
        blocks = -(-n_queries // rules.block_queries)
        counts = {int(x): n for x, n in state["counts"].items()}
        shards = {x: -(-n // rules.shard_rows) for x, n in counts.items()}
        shared = self.spark.sparkContext.broadcast(model)
        most = min(probes or state["probes"], len(model.centres))

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    near = np.argsort(-(_unit(batch.column("v")) @ shared.value.centres.T), axis=1, kind="stable")[:, :most]
                    held = [[x for x in row if x in counts] for row in near.tolist()]
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held, pa.list_(pa.int32()))], ["id", "v", "lists"])

        dealt = self.spark.createDataFrame(sorted(shards.items()), "list int, shards int")  # a row for each list
        visits = cut_lineage(
            asked.mapInArrow(visit, "id long, v array<float>, lists array<int>")
            .select("id", "v", F.explode("lists").alias("list"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
        )
        lists = {r["list"] for r in visits.select("list").distinct().collect()}
        rows = self.rows(state, lists)
        left = rows.select("id", "list", "codes").join(F.broadcast(dealt), "list").select(
            "id", "codes", "list", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int").alias("shard"),
            F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        )
        right = visits.join(F.broadcast(dealt), "list").select("id", "v", "list", "block", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
        wanted = k * rules.rerank

        def compare(own: pa.Table, asked: pa.Table) -> pa.Table:
            out: list[list] = [[], [], [], []]
            if len(own) and len(asked):
                ids, codes = own["id"].to_numpy(), np.frombuffer(b"".join(own["codes"].to_pylist()), np.uint8).reshape(len(own), -1)
                list_no = own["list"][0].as_py()
                q = _unit(asked["v"].combine_chunks())
                base = q @ shared.value.centres[list_no]
                for q_id, x, start in zip(asked["id"].to_pylist(), q, base, strict=True):
                    about = start + shared.value.estimates(x, codes)
                    best = np.argpartition(-about, wanted)[:wanted] if len(about) > wanted else np.arange(len(about))
                    for column, values in zip(out, (np.full(len(best), q_id), ids[best], np.full(len(best), list_no), about[best]), strict=True):
                        column.append(values)
            joined = [np.concatenate(c) if c else np.empty(0) for c in out]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64())
            return pa.table([pa.array(c, t) for c, t in zip(joined, kinds, strict=True)], ["query_id", "base_id", "list", "about"])

        by = ["list", "shard", "block"]
        near = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(compare, "query_id long, base_id long, list int, about double")
        some = top_k(near, "query_id", wanted, F.desc("about"), F.asc("base_id")).drop("rank")
        vectors = rows.select(F.col("id").alias("base_id"), "list", F.col("v").alias("bv"))
        both = some.join(vectors, ["list", "base_id"]).join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("qv")), "query_id")
        exact = both.select("query_id", "base_id", cosine(F.col("qv"), F.col("bv")).alias("score"))
        ranked = top_k(exact, "query_id", k, F.desc(F.round("score", 12)), F.asc("base_id"))
        return ranked.select("query_id", F.col("rank").cast("long").alias("rank"), "base_id", "score")
