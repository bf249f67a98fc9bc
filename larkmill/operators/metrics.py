"""Metrics: ordered averages, alerts, and observation of running queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from larkmill.operators.tables import global_row_number
from larkmill.session import scratch_dir

# Metric names and the values that raise an alert.
ALERT_THRESHOLDS = {
    "matching.duration_seconds": 10.0, "vector_search.p95_latency_ms": 100.0, "llm.daily_spend_usd": 80.0,
    "scraping.block_rate": 0.1, "database.connection_pool_utilization": 0.8,
}


JUMPS = 16  # 0.05 to this power is nothing beside a double


def moving_average(df: DataFrame, key: str, order: list[str], value: str, alpha: float = 0.1, bucket_rows: int = 65_536) -> DataFrame:
    """(key, n, ema, peak): exponential moving average, and the damped maximum that moves 95 % of the way up.

    Rows are numbered over all keys and folded in buckets of ``bucket_rows``, so a key of any length is spread; only the
    summaries of its buckets meet. A bucket turns the average e into ``decay * e + add``. It turns the maximum p into the
    largest of ``0.05 ** k * p + best[k]``, where k counts the moves up: each value is taken or passed over, and as
    every way to choose is monotone in p, the largest outcome is the true one.
    """
    kind = df.schema[key].dataType.simpleString()
    numbered = global_row_number(df.select(F.col(key), *order, F.col(value).cast("double").alias("_v")), [key, *order])
    dealt = numbered.select(key, F.col("row").alias("_row"), F.floor(F.col("row") / bucket_rows).alias("_bucket"), "_v")

    def fold(part: pa.Table) -> pa.Table:
        part = part.sort_by("_row")
        values = part["_v"].to_numpy()
        powers = (1 - alpha) ** np.arange(len(values) - 1, -1, -1.0)
        best = np.full(JUMPS, -np.inf)
        best[0] = 0.0
        for x in values:
            best[1:] = np.maximum(best[1:], best[:-1] * 0.05 + x * 0.95)
        row = {
            key: part[key][:1], "_bucket": part["_bucket"][:1], "n": pa.array([len(values)]), "first": pa.array(values[:1]),
            "decay": pa.array([(1 - alpha) ** len(values)]), "add": pa.array([float(alpha * (powers @ values))]),
            "best": pa.array([best.tolist()], pa.list_(pa.float64())),
        }
        return pa.table(row)

    def combine(part: pa.Table) -> pa.Table:
        rows = part.sort_by("_bucket").to_pylist()
        ema = peak = rows[0]["first"]
        for r in rows:
            ema = r["decay"] * ema + r["add"]
            peak = float(np.max(0.05 ** np.arange(JUMPS) * peak + np.array(r["best"])))
        return pa.table({key: part[key][:1], "n": [sum(r["n"] for r in rows)], "ema": [ema], "peak": [peak]})

    summary = f"`{key}` {kind}, _bucket long, n long, first double, decay double, add double, best array<double>"
    buckets = dealt.groupBy(key, "_bucket").applyInArrow(fold, summary)
    return buckets.groupBy(key).applyInArrow(combine, f"`{key}` {kind}, n long, ema double, peak double")


def alerts(df: DataFrame, name: str, value: str, thresholds: dict[str, float]) -> DataFrame:
    """Values over the threshold of their metric; critical from one and a half times of it."""
    limit = F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv])
    over = df.withColumn("threshold", F.try_element_at(limit, F.col(name))).where(F.col(value) > F.col("threshold"))
    return over.withColumn("severity", F.when(F.col(value) < F.col("threshold") * 1.5, "warning").otherwise("critical"))


def observed(df: DataFrame, name: str, value: str) -> tuple[DataFrame, Observation]:
    """The same rows, with count, sum and maximum of a column there once an action has run."""
    watch = Observation(name)
    v = F.col(value)
    return df.observe(watch, F.count("*").alias("rows"), F.sum(v).alias("sum"), F.max(v).alias("max")), watch


def collected(df: DataFrame, kind: str, value: str) -> DataFrame:
    """(kind, rows, sum, max) as observed while the rows of each kind are appended to a store. A kind is a run of its
    own, so there should be few."""
    folder = scratch_dir(df.sparkSession, "observed")
    rows = []
    for r in df.select(kind).distinct().orderBy(kind).collect():
        own, watch = observed(df.where(F.col(kind).eqNullSafe(F.lit(r[kind]))), f"{kind}-{len(rows)}", value)
        own.write.mode("append").parquet(folder)
        rows.append((r[kind], *(watch.get[c] for c in ("rows", "sum", "max"))))
    fields = df.schema
    return df.sparkSession.createDataFrame(rows, f"`{kind}` {fields[kind].dataType.simpleString()}, rows long, sum double, max double")
