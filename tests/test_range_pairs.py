"""Pairs within a tolerance: tasks follow the pairs, not the rows, and gaps are rounded as by the decimal function."""

import random

import pytest
from pyspark.sql import functions as F

from larkmill.operators.tables import range_pairs


def test_a_band_with_most_pairs_is_several_tasks(spark):
    rows = spark.range(9000).select("id", F.lit("g").alias("g"), F.lit(0.5).alias("v")).coalesce(1)
    found = range_pairs(rows, "g", "id", "v", 0.02).groupBy(F.spark_partition_id()).count().collect()
    each = [r["count"] for r in found]
    assert sum(each) == 9000 * 8999
    assert max(each) < sum(each) / 2


@pytest.mark.parametrize("task_pairs", [50, 16 << 20])
def test_gaps_are_rounded_as_before(spark, task_pairs):
    draw = random.Random(3)
    values = [draw.choice([draw.random(), k / 2e6, round(draw.random(), 6), k / 50]) for k in range(400)] + [None, float("nan")]
    rows = spark.createDataFrame([(k, draw.choice(["g", "h", None]), v) for k, v in enumerate(values)], "i long, g string, v double")
    other = rows.select(F.col("i").alias("j"), F.col("g").alias("h"), F.col("v").alias("w"))
    gap = F.round(F.abs(F.col("v") - F.col("w")), 6)
    want = rows.join(other, (F.col("g") == F.col("h")) & (F.col("i") != F.col("j"))).where(gap <= 0.02).select("i", "g", "j", gap)
    found = [tuple(r) for r in range_pairs(rows, "g", "i", "v", 0.02, task_pairs=task_pairs).collect()]
    assert sorted(found) == sorted(tuple(r) for r in want.collect()) and len(found) > 1000


def test_no_rows(spark):
    assert range_pairs(spark.createDataFrame([], "i long, g string, v double"), "g", "i", "v", 0.02).count() == 0
