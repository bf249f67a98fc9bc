"""Histograms of a stream's micro-batches against its files; batches told again; what a lost session leaves."""

import math
import random

import pytest
from pyspark.sql import functions as F

from larkmill.streaming.collector import Collector, histogram, measures

BOUNDS = [-1.0, 0.0, 2.5]


def classes(values):
    """How many lie up to each bound and above the one before; NaN above all."""
    found = [0] * (len(BOUNDS) + 1)
    for x in values:
        if x is not None:
            found[next((i for i, b in enumerate(BOUNDS) if x <= b), len(BOUNDS))] += 1
    return found


def run(spark, folder, place, table):
    kept = Collector(spark, table, {"m": BOUNDS})
    spark.streams.addListener(kept)
    try:
        stream = spark.readStream.schema("id long, x double").option("maxFilesPerTrigger", 1).parquet(folder)
        out = histogram(stream, "m", "x", BOUNDS).writeStream.format("noop").option("checkpointLocation", place)
        query = out.trigger(availableNow=True).start()
        query.awaitTermination()
        kept.wait(query)
    finally:
        spark.streams.removeListener(kept)
    return kept


def test_batches_equal_their_files(spark, tmp_path):
    rnd = random.Random(3)
    folder, table = str(tmp_path / "in"), str(tmp_path / "table")
    drops = [[rnd.choice([None, math.nan, -1.0, 0.0, 2.5, rnd.uniform(-3, 4)]) for _ in range(n)] for n in (40, 1, 25)]
    for i, drop in enumerate(drops):
        spark.createDataFrame([(i, x) for x in drop], "id long, x double").coalesce(1).write.mode("append").parquet(folder)
    kept = run(spark, folder, str(tmp_path / "c"), table)
    assert kept.flush() == 3 and kept.flush() == 0
    rows = measures(spark, table).collect()
    assert len(rows) == 3 * (len(BOUNDS) + 1) and len({r["query"] for r in rows}) == 1
    got = {b: [r["n"] for r in sorted((r for r in rows if r["batch"] == b), key=lambda r: r["upto"])] for b in range(3)}
    # A source takes its files by time, and equal times in no said order.
    assert sorted(got.values()) == sorted(classes(drop) for drop in drops)
    for drop in drops:
        own = next(r for r in rows if r["rows"] == len(drop))
        assert own["rows_read"] == len(drop) and own["missing"] == sum(x is None for x in drop)
        assert own["total"] == pytest.approx(sum(x for x in drop if x is not None and not math.isnan(x)))
    # A restart from the checkpoint tells no batch again; a new file is the fourth.
    spark.createDataFrame([(9, 1.0)], "id long, x double").coalesce(1).write.mode("append").parquet(folder)
    again = run(spark, folder, str(tmp_path / "c"), table)
    assert again.flush() == 1
    assert [r["batch"] for r in measures(spark, table).groupBy("batch").count().orderBy("batch").collect()] == [0, 1, 2, 3]


def test_a_batch_told_again_counts_once(spark, tmp_path):
    kept = Collector(spark, str(tmp_path / "t"), {"m": [1.0]})
    assert kept.table().count() == 0
    for n in (5, 7):
        kept._held["q", 0, "m"] = ({"class_0": n, "class_1": 1, "rows": n + 1, "missing": 0, "total": 0.5}, n + 1)
        kept.flush()
    assert sorted((r["upto"], r["n"], r["rows"]) for r in kept.table().collect()) == [(1.0, 7, 8), (math.inf, 1, 8)]


def test_a_failed_flush_keeps_all(spark, tmp_path):
    kept = Collector(spark, str(tmp_path / "t"), {"m": [1.0]})
    kept._held["q", 0, "m"] = ({"class_0": 1, "class_1": 1, "rows": 2, "missing": 0, "total": 0.5}, 2)

    def broken(change):
        raise OSError("no store")

    update, kept.log.update = kept.log.update, broken
    with pytest.raises(OSError):
        kept.flush()
    assert kept.table().count() == 0  # the file is there, but no state names it
    kept.log.update = update
    assert kept.flush() == 1 and kept.table().agg(F.sum("n")).first()[0] == 2


def test_bounds_rise(spark):
    for bad in ([], [1.0, 1.0], [2.0, 1.0]):
        with pytest.raises(ValueError):
            histogram(spark.range(1), "m", "id", bad)
