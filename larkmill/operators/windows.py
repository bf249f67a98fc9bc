"""Ordered operators: budgets, quotas, streaks, sessions, order statistics and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEFORE = (Window.unboundedPreceding, -1)


def within_budget(df: DataFrame, keys: list[str], order: list[Column], cost: str, budget: float) -> DataFrame:
    """Rows reached before the budget was spent: the last one may overshoot. ``spent`` is what went before."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*BEFORE)
    spent = df.withColumn("spent", F.coalesce(F.sum(cost).over(w), F.lit(0.0)))
    return spent.where(F.round("spent", 9) < budget)


def prefix_that_fits(df: DataFrame, keys: list[str], order: list[Column], size: str, budget: float) -> DataFrame:
    """Rows up to the first whose running sum exceeds the budget. Sizes aren't negative, so no later sum fits again."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running", F.sum(size).over(w)).where(F.col("running") <= budget)


def recent_error_rate(df: DataFrame, key: str, order: list[str], failed: Column, last: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - last, 0)
    counted = df.select("event_id", key, F.count("*").over(w).alias("calls"), F.count_if(failed).over(w).alias("errors"))
    return counted.withColumn("error_rate", F.round(F.col("errors") / F.col("calls"), 6))


def sliding_limit(df: DataFrame, row_id: str, key: str, ts: str, seconds: int, limit: int) -> DataFrame:
    """Calls in the window that ends with each call, and how long a caller over the limit has to wait."""
    at = df.select(row_id, key, F.unix_seconds(F.col(ts).cast("timestamp")).alias("s"))
    w = Window.partitionBy(key).orderBy("s").rangeBetween(-seconds, 0)
    seen = at.select(row_id, key, "s", F.count("*").over(w).alias("calls"), F.min("s").over(w).alias("oldest"))
    over = F.col("calls") > limit
    return seen.select(
        row_id, key, "calls", over.alias("limited"),
        F.when(over, F.col("oldest") + seconds - F.col("s")).otherwise(0).alias("wait_s"),
    )


def fixed_quota(df: DataFrame, key: str, ts: str, quota: int) -> DataFrame:
    used = df.groupBy(key, F.date_trunc("day", ts).cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("used"))
    return used.withColumn("over", F.greatest(F.col("used") - quota, F.lit(0)))


def failure_streaks(df: DataFrame, row_id: str, key: str, order: list[str], failed: Column, limit: int) -> DataFrame:
    """Consecutive failures up to each row, and whether they open the circuit."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = df.withColumn("_bad", failed).withColumn("_island", F.sum(F.when(F.col("_bad"), 0).otherwise(1)).over(w))
    run = Window.partitionBy(key, "_island").orderBy(*order)
    counted = marked.withColumn("_n", F.count_if("_bad").over(run))
    return counted.select(
        row_id, key, F.when(F.col("_bad"), F.col("_n")).otherwise(0).alias("streak"),
        (F.col("_bad") & (F.col("_n") >= limit)).alias("opened"),
    )


def sessions(df: DataFrame, key: str, ts: str, gap_minutes: int) -> DataFrame:
    """Activity without a gap over the limit. The gap itself still belongs to the session, so a second is added."""
    w = F.session_window(F.col(ts), f"{gap_minutes * 60} seconds 1 microsecond")
    found = df.groupBy(key, w.alias("w")).agg(F.min(ts).alias("started"), F.max(ts).alias("last_seen"), F.count("*").alias("n"))
    return found.drop("w")


def order_statistic(df: DataFrame, key: str, value: str, ts: str, row_id: str, share: float) -> DataFrame:
    """Count, least, largest, latest and the value at index floor(n * share) of each group's sorted values."""
    by_value = Window.partitionBy(key).orderBy(value, row_id)
    ranked = df.select(
        F.col(key).alias("name"), value, ts, row_id, F.row_number().over(by_value).alias("r"),
        F.count("*").over(Window.partitionBy(key)).alias("n"),
    )
    at = F.floor(F.col("n") * share) + 1
    return ranked.groupBy("name").agg(
        F.max("n").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"),
        F.max_by(value, F.struct(ts, row_id)).alias("current"), F.max(F.when(F.col("r") == at, F.col(value))).alias("p95"),
    )


def batches(df: DataFrame, row_id: str, size: int) -> DataFrame:
    """A batch number for each row in order of its id, without a global window: sorted partitions are counted first."""
    from larkmill.operators.tables import global_row_number

    numbered = global_row_number(df.select(row_id), [row_id])
    return numbered.select(row_id, ((F.col("row") - 1) / size).cast("long").alias("batch"))


def oldest_share(df: DataFrame, order: list[str], parts: int) -> DataFrame:
    """Rows by tenth (or another part) from the oldest; the first part is what a full cache evicts."""
    from larkmill.operators.tables import global_row_number

    numbered = global_row_number(df.select(*order), order)
    total = numbered.agg(F.count("*").alias("total"))
    at = numbered.join(F.broadcast(total))
    base, extra = F.floor(F.col("total") / parts), F.col("total") % parts
    row = F.col("row") - 1
    part = F.when(row < extra * (base + 1), F.floor(row / (base + 1))).otherwise(F.floor((row - extra) / F.greatest(base, F.lit(1))))
    return at.groupBy((part + 1).alias("tenth")).agg(F.count("*").alias("n")).withColumn("evicted", F.col("tenth") == 1)
