"""Metrics of running streams: counted by the tasks of each micro-batch, told with its progress, kept as a table.

A histogram is a handful of aggregates that Spark keeps beside the rows as they pass, so nothing is read twice and no
row comes to the driver. A listener takes what the progress of a micro-batch tells, a few numbers for each metric and
batch, and ``flush`` writes them to a stored table with a log.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from larkmill.sources.commits import CommitLog

MEASURES = "query string, batch long, metric string, upto double, n long, rows long, missing long, total double, rows_read long"


def histogram(df: DataFrame, metric: str, value: str, bounds: list[float]) -> DataFrame:
    """The same rows, observed as ``metric``: rows, null values, the sum of those that are numbers, and how many values
    lie above each bound's predecessor and up to it. Values over the last bound have a class of their own, and so NaN,
    which Spark orders above all numbers."""
    if not bounds or sorted(set(bounds)) != list(bounds):
        raise ValueError("the bounds of a histogram rise")
    v = F.col(value).cast("double")
    lows, highs = [None, *bounds], [*bounds, None]
    inside = lambda low, high: (F.lit(True) if low is None else v > low) & (F.lit(True) if high is None else v <= high)
    classes = [F.count_if(v.isNotNull() & inside(a, b)).alias(f"class_{i}") for i, (a, b) in enumerate(zip(lows, highs, strict=True))]
    return df.observe(
        metric, F.count(F.lit(1)).alias("rows"), F.count_if(v.isNull()).alias("missing"),
        F.coalesce(F.sum(F.when(~F.isnan(v), v)), F.lit(0.0)).alias("total"), *classes,
    )


class Collector(StreamingQueryListener):
    """Collects the histograms of all streams that tell them, by query and batch; ``bounds`` has those of each metric.

    A batch that is run again after a restart is told again under its number and counts once, as last told. What is held
    between two flushes are the classes of the batches since.
    """

    def __init__(self, spark: SparkSession, path: str, bounds: dict[str, list[float]]):
        super().__init__()
        self.spark, self.path, self.bounds = spark, path, bounds
        self.log = CommitLog(spark, path)
        self._lock, self._held, self._ended = threading.Condition(), {}, set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        with self._lock:
            for metric, told in p.observedMetrics.items():
                if metric in self.bounds:
                    self._held[str(p.id), int(p.batchId), metric] = (told.asDict(), int(p.numInputRows))

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            self._ended.add(str(event.runId))
            self._lock.notify_all()

    def wait(self, query: StreamingQuery, seconds: float = 120.0) -> None:
        """Until all that a query has told is here; its end comes after its last progress. TimeoutError if it doesn't."""
        run = str(query.runId)
        with self._lock:
            if not self._lock.wait_for(lambda: run in self._ended, seconds):
                raise TimeoutError(f"the end of run {run} wasn't told within {seconds} s")

    def flush(self) -> int:
        """Adds what is held to the table; how many batches' metrics that are. If the write fails, all is still held."""
        with self._lock:
            held = dict(self._held)
        if not held:
            return 0
        rows = []
        for (query, batch, metric), (told, read) in sorted(held.items()):
            for i, upto in enumerate([*self.bounds[metric], float("inf")]):
                rows.append((query, batch, metric, float(upto), told[f"class_{i}"], told["rows"], told["missing"], told["total"], read))
        name = f"flush-{uuid.uuid4().hex}"
        self.spark.createDataFrame(rows, MEASURES).coalesce(1).write.parquet(f"{self.path}/{name}")
        self.log.update(lambda state: {"files": [*state.get("files", []), name]})
        with self._lock:
            for key, told in held.items():
                if self._held.get(key) is told:
                    del self._held[key]
        return len(held)

    def table(self) -> DataFrame:
        """All batches flushed so far, each as last told."""
        return measures(self.spark, self.path)


def measures(spark: SparkSession, path: str) -> DataFrame:
    """The table of a collector, from its log alone."""
    files = CommitLog(spark, path).latest()[1].get("files", [])
    if not files:
        return spark.createDataFrame([], MEASURES)
    order = F.create_map(*[F.lit(x) for i, f in enumerate(files) for x in (f, i)])
    read = spark.read.schema(MEASURES).parquet(*[f"{path}/{f}" for f in files])
    whole = read.withColumn("flush", order[F.regexp_extract(F.input_file_name(), r"(flush-[0-9a-f]{32})/[^/]*$", 1)])
    last = F.max("flush").over(Window.partitionBy("query", "batch", "metric"))
    return whole.withColumn("_last", last).where("flush = _last").drop("flush", "_last")
