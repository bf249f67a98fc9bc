"""Incremental ingest: each micro-batch is merged into a stored table by its fingerprints."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkmill.operators.tables import upsert
from larkmill.session import cut_lineage, remove
from larkmill.sources.commits import CommitConflict, CommitLog


class IncrementalTable:
    """A stored table in buckets of its key, with a log.

    A batch writes new files for the buckets that it changes, and then commits them together with its number. What the
    table is, stands in the log alone: a session that opens the folder later goes on from the last commit, files of a
    batch that never came to its commit are no part of the table, and a batch whose number is committed changes nothing
    when it comes again. Of two writers that change the table at once, the second merges again from the first's commit.
    Files that a commit replaced stay until the one after it, for readers of the state before.

    ``combine(stored, batch)`` makes of a batch the rows to take in, given the stored ones of its buckets: sums, say.
    """

    def __init__(
        self, spark, path: str, key: str, fingerprint: str, columns: list[str], empty: DataFrame, buckets: int = 16,
        combine: Callable[[DataFrame, DataFrame], DataFrame] | None = None, source: str = "stream",
    ):
        self.spark, self.path, self.key, self.fingerprint, self.columns = spark, path, key, fingerprint, columns
        self.empty = empty.withColumn("change_count", F.lit(0).cast("long"))
        self.log, self.combine, self.source = CommitLog(spark, path), combine, source
        self.buckets = self.log.latest()[1].get("n_buckets", buckets)

    @property
    def written(self) -> dict[int, list[str]]:
        """The folders of each bucket that are there: the one before, and the current one."""
        state = self.log.latest()[1]
        return {int(b): [*[f for f in state["replaced"] if f.endswith(f"/bucket={b}")], name] for b, name in state.get("buckets", {}).items()}

    def _read(self, state: dict, only: set[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/{name}" for b, name in state.get("buckets", {}).items() if only is None or int(b) in only]
        return self.spark.read.schema(self.empty.schema).parquet(*paths) if paths else self.empty

    def current(self) -> DataFrame:
        """The table as of the last commit."""
        return self._read(self.log.latest()[1])

    def merge(self, batch: DataFrame, number: int, tries: int = 10) -> bool:
        """Takes in batch ``number`` of this table's source; whether it did, and hadn't before."""
        own = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        touched: set[int] | None = None
        for _ in range(tries):
            version, state = self.log.latest()
            if number <= state.get("batches", {}).get(self.source, -1):
                return False
            if touched is None:
                batch = cut_lineage(batch)
                touched = {r["bucket"] for r in batch.select(own.alias("bucket")).distinct().collect()}
            stored, name = self._read(state, touched), f"batch-{number}-{uuid.uuid4().hex}"
            taken = self.combine(stored, batch) if self.combine else batch
            merged = upsert(stored, taken, self.key, self.fingerprint, self.columns).select(*self.empty.columns, own.alias("bucket"))
            merged.write.partitionBy("bucket").parquet(f"{self.path}/{name}")
            old = state.get("buckets", {})
            new = {
                "n_buckets": self.buckets, "batches": state.get("batches", {}) | {self.source: number},
                "buckets": old | {str(b): f"{name}/bucket={b}" for b in touched}, "replaced": [old[str(b)] for b in touched if str(b) in old],
            }
            try:
                self.log.commit(version, new)
            except CommitConflict:
                remove(self.spark, f"{self.path}/{name}")
                continue
            for folder in state.get("replaced", []):
                remove(self.spark, f"{self.path}/{folder}")
            return True
        raise CommitConflict(f"batch {number} found another writer's commit {tries} times")


def changed_only(stream: DataFrame, stored: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Stream rows that are new or whose fingerprint differs from the stored one: what has to be embedded again."""
    old = stored.select(F.col(key).alias("_k"), F.col(fingerprint).alias("_fp"))
    joined = stream.join(old, F.col(key) == F.col("_k"), "left")
    return joined.where(F.col("_fp").isNull() | (F.col(fingerprint) != F.col("_fp"))).drop("_k", "_fp")
