"""Structured Streaming twins of the event queries, and the runner that drains a source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkmill.session import scratch_dir


def event_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A parquet folder as a stream, its naive times read as UTC."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def landed(events: DataFrame, drops: int = 4) -> str:
    """The events as a folder of files in order of time, as a stream's source finds them: so many drops, each of a stretch
    of time, one after the other; a second is never cut, as walks by second take its rows by their ids. Rows without a
    time come last. All tasks read the events; only what a drop holds goes to the task that writes its file."""
    folder = scratch_dir(events.sparkSession, "landed")
    at = F.coalesce(F.unix_seconds(F.col("ts").cast("timestamp")).cast("double"), F.lit(float("inf")))
    edges = events.select(at.alias("at")).approxQuantile("at", [k / drops for k in range(1, drops)], 0.01)
    low = None
    for high in [*sorted(set(edges)), None]:
        part = events if low is None else events.where(at >= low)
        (part if high is None else part.where(at < high)).repartition(1).write.mode("append").parquet(folder)
        low = high
    return folder


def tumbling(events: DataFrame, delay: str = "1 day", width: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts and sums by window and kind, late rows dropped past the watermark."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    grouped = events.withWatermark("ts", delay).groupBy(w.alias("w"), "event_type")
    out = grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def session_counts(events: DataFrame, key: str, gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    grouped = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), key)
    return grouped.agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("started"), key, "n")


SKETCH = 400  # a sketch of no more values than this is exact; of more, ranks err by about 0.7 % with 99 % confidence


def sketches(events: DataFrame, key: str, value: str, width: str = "5 minutes", delay: str = "1 day") -> DataFrame:
    """(start, key, sketch): a quantile sketch of the values of each key and window. Sketches merge."""
    w = F.window("ts", width)
    grouped = events.withWatermark("ts", delay).where(F.col(value).isNotNull()).groupBy(w.alias("w"), key)
    return grouped.agg(F.kll_sketch_agg_double(F.col(value).cast("double"), SKETCH).alias("sketch")).select(F.col("w.start").alias("start"), key, "sketch")


def sliding_quantile(base: DataFrame, key: str, share: float, minutes: int = 5, span: int = 12) -> DataFrame:
    """(start, key, n, quantile) of windows of ``span`` base windows, one beginning with each: their sketches merged."""
    step = F.make_interval(mins=F.lit(minutes))
    begins = F.sequence(F.col("start") - F.make_interval(mins=F.lit(minutes * (span - 1))), F.col("start"), step)
    merged = base.select(F.explode(begins).alias("start"), key, "sketch").groupBy("start", key).agg(F.kll_merge_agg_double("sketch", SKETCH).alias("sketch"))
    return merged.select(
        "start", key, F.kll_sketch_get_n_double("sketch").alias("n"), F.kll_sketch_get_quantile_double("sketch", F.lit(share)).alias("quantile")
    )


def values(events: DataFrame, key: str, value: str, width: str = "5 minutes", delay: str = "1 day") -> DataFrame:
    """(start, key, held): the values of each key and window themselves, for quantiles that must be exact at any number."""
    w = F.window("ts", width)
    grouped = events.withWatermark("ts", delay).where(F.col(value).isNotNull()).groupBy(w.alias("w"), key)
    return grouped.agg(F.collect_list(F.col(value).cast("double")).alias("held")).select(F.col("w.start").alias("start"), key, "held")


def sliding_quantile_exact(base: DataFrame, key: str, share: float, minutes: int = 5, span: int = 12) -> DataFrame:
    """As ``sliding_quantile``, of ``values``: the least of a window's values that so large a share of them doesn't exceed.
    The values of one window and key are held at once."""
    step = F.make_interval(mins=F.lit(minutes))
    begins = F.sequence(F.col("start") - F.make_interval(mins=F.lit(minutes * (span - 1))), F.col("start"), step)
    merged = base.select(F.explode(begins).alias("start"), key, "held").groupBy("start", key).agg(F.sort_array(F.flatten(F.collect_list("held"))).alias("held"))
    n = F.size("held").cast("long")
    at = F.greatest(F.ceil(n * F.lit(share) - 1e-9), F.lit(1)).cast("int")
    return merged.select("start", key, n.alias("n"), F.element_at("held", at).alias("quantile"))


def hysteresis(windows: DataFrame, key: str, value: str, high: float, low: float) -> DataFrame:
    """``windows`` with ``firing``: an alert begins above ``high`` and ends below ``low``; between, it stays as it was."""
    said = F.when(F.col(value) > high, True).when(F.col(value) < low, False)
    upto = Window.partitionBy(key).orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    return windows.withColumn("firing", F.coalesce(F.last(said, ignorenulls=True).over(upto), F.lit(False)))


def alerts(windowed: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Windows whose total exceeds the threshold of their kind; critical from one and a half times of it."""
    limit = F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv])[F.col("event_type")]
    over = windowed.withColumn("threshold", limit).where(F.col("total") > F.col("threshold"))
    return over.withColumn("severity", F.when(F.col("total") >= 1.5 * F.col("threshold"), "critical").otherwise("warning"))


def first_by_key(events: DataFrame, keys: list[str], delay: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark: a cache that forgets old keys."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over all input there is into files of the shared folder, and reads these.

    Every micro-batch has a folder by its number, so one that is repeated writes the same again. A complete result is
    the last of them, an appended one all together.
    """
    spark, schema = stream.sparkSession, stream.schema
    folder = scratch_dir(spark, "stream")
    done: list[str] = []

    def write(batch: DataFrame, number: int) -> None:
        path = f"{folder}/batch-{number}"
        batch.write.mode("overwrite").parquet(path)
        if path not in done:
            done.append(path)

    writer = stream.writeStream.outputMode(mode).foreachBatch(write).trigger(availableNow=True)
    writer.option("checkpointLocation", f"{folder}/checkpoint").start().awaitTermination()
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(done[-1:] if mode == "complete" else done))


def each_batch(stream: DataFrame, apply, checkpoint: str) -> None:
    """Calls ``apply(batch, number)`` for each micro-batch over all input there is."""
    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
