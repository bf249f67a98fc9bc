"""The stored table with its log: restarts, replays, lost batches and writers that meet."""

import threading

import pytest
from pyspark.sql import functions as F

from larkmill.sources.commits import CommitConflict
from larkmill.streaming import windows
from larkmill.streaming.ingest import IncrementalTable


def opened(spark, path, **how):
    def added(stored, batch):
        known = stored.select(F.col("k").alias("o"), F.col("n").alias("before"))
        summed = batch.join(known, F.col("k") == F.col("o"), "left").select("k", (F.col("n") + F.coalesce("before", F.lit(0))).alias("n"))
        return summed.withColumn("fp", F.col("n").cast("string"))

    return IncrementalTable(spark, str(path), "k", "fp", ["n"], spark.createDataFrame([], "k long, fp string, n long"), buckets=3, combine=added, **how)


def counts(spark, pairs):
    return spark.createDataFrame(pairs, "k long, n long")


def test_restart_and_replay(spark, tmp_path):
    path = tmp_path / "t"
    assert opened(spark, path).merge(counts(spark, [(1, 2), (2, 1)]), 0)
    assert opened(spark, path).merge(counts(spark, [(2, 4), (9, 1)]), 1)
    for number in (0, 1):  # replayed after a restart
        assert not opened(spark, path).merge(counts(spark, [(1, 50)]), number)
    again = opened(spark, path)
    assert {r["k"]: r["n"] for r in again.current().collect()} == {1: 2, 2: 5, 9: 1}
    other = opened(spark, path, source="other")  # another source has numbers of its own
    assert other.merge(counts(spark, [(1, 1)]), 0)
    assert {r["k"]: r["n"] for r in again.current().collect()} == {1: 3, 2: 5, 9: 1}


def test_a_batch_lost_before_its_commit(spark, tmp_path, monkeypatch):
    path = tmp_path / "t"
    opened(spark, path).merge(counts(spark, [(1, 2)]), 0)
    dying = opened(spark, path)
    monkeypatch.setattr(dying.log, "commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        dying.merge(counts(spark, [(1, 5), (3, 1)]), 1)
    assert {r["k"]: r["n"] for r in opened(spark, path).current().collect()} == {1: 2}
    assert opened(spark, path).merge(counts(spark, [(1, 5), (3, 1)]), 1)
    assert {r["k"]: r["n"] for r in opened(spark, path).current().collect()} == {1: 7, 3: 1}


def test_writers_that_meet(spark, tmp_path):
    path = tmp_path / "t"
    tables = [opened(spark, path, source=f"s{i}") for i in range(3)]
    batches = [counts(spark, [(k, i + 1) for k in range(6)]) for i in range(3)]
    work = [threading.Thread(target=t.merge, args=(b, 0)) for t, b in zip(tables, batches, strict=True)]
    for w in work:
        w.start()
    for w in work:
        w.join()
    assert {r["k"]: r["n"] for r in opened(spark, path).current().collect()} == dict.fromkeys(range(6), 6)
    stuck = opened(spark, path)
    stuck.log.commit = lambda *_: (_ for _ in ()).throw(CommitConflict)
    with pytest.raises(CommitConflict):
        stuck.merge(batches[0], 7, tries=2)
    files = [p for p in path.rglob("*.parquet") if "batch-7" in str(p)]
    assert not files


def test_landed_files_lie_in_order_of_time(spark, tmp_path):
    rows = [(i, f"2024-01-{1 + i % 28:02d} 00:00:00") for i in range(200)]
    events = spark.createDataFrame(rows, "event_id long, t string").select("event_id", F.col("t").cast("timestamp_ntz").alias("ts"))
    folder = windows.landed(events, 4)
    seen = []
    stream = windows.event_stream(spark, folder, events.schema)
    windows.each_batch(stream, lambda b, n: seen.append(tuple(b.agg(F.min("ts"), F.max("ts"), F.count("*")).first())), str(tmp_path / "c"))
    assert len(seen) == 4 and sum(n for *_, n in seen) == 200
    assert all(a[1] < b[0] for a, b in zip(seen, seen[1:], strict=False))
