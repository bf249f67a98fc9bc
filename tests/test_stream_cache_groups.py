"""Users of the stream's cache share calls of Python and of the state; users who share a group, and those without an id, are told apart."""

import datetime as dt

from larkmill.streaming import windows
from larkmill.streaming.cache import CacheRules, cached

START = dt.datetime(2024, 1, 1)


def test_many_users_in_few_groups(spark, tmp_path):
    rows = [(k, START + dt.timedelta(seconds=k), None if k % 1300 == 0 else k % 1300, "view") for k in range(2600)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").coalesce(1).write.parquet(f"{tmp_path}/e")
    stream = cached(windows.event_stream(spark, f"{tmp_path}/e", spark.read.parquet(f"{tmp_path}/e").schema), rules=CacheRules(seconds=86_400))
    told = []

    def keep(batch, number):
        told.extend(batch.collect())

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert {r["event_id"]: (r["user_id"], r["outcome"]) for r in told} == {k: (u, "miss" if k < 1300 else "hit") for k, _, u, _ in rows} and len(told) == 2600
    state = spark.read.format("statestore").option("path", f"{tmp_path}/c").option("stateVarName", "put").load()
    assert state.count() <= 510  # each user had a state of its own


def test_all_tasks_read_what_lands(spark, monkeypatch):
    from pyspark.sql import DataFrame

    coalesced = []
    monkeypatch.setattr(DataFrame, "coalesce", lambda df, n: coalesced.append(n) or df.repartition(n))
    folder = windows.landed(spark.createDataFrame([(k, START + dt.timedelta(hours=k)) for k in range(40)], "event_id long, ts timestamp_ntz"))
    read = spark.read.parquet(folder)
    assert not coalesced and read.count() == 40 and len(read.inputFiles()) == 4
