"""Topics: exactly once with failing tasks, lost commits and restarts; order by key; readers that go on."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from larkmill.streaming import topics, windows
from larkmill.streaming.topics import Topic

SCHEMA = "event_id long, user_id long, good boolean"


def land(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def messages(df):
    return topics.keyed(df, F.col("user_id"), F.to_json(F.struct("event_id")), ["event_id"], 3)


def published(spark, path):
    return Counter(r["value"] for r in topics.read_topic(spark, str(path)).collect())


def rows_of(low, high):
    return [(i, i % 7, i % 5 > 0) for i in range(low, high)]


def test_a_failing_task_repeats_nothing(spark, tmp_path):
    for k in range(3):
        land(spark, tmp_path / "e", rows_of(100 * k, 100 * k + 100))
    marker = str(tmp_path / "failed")

    @F.udf("string")
    def once(value):
        import os

        if '"event_id":150' in value and not os.path.exists(marker):
            open(marker, "w").close()
            raise RuntimeError("a lost executor")
        return value

    def run():
        sent = messages(stream(spark, tmp_path / "e")).withColumn("value", once("value"))
        topics.publish(sent, str(tmp_path / "t"), "w", str(tmp_path / "c"))

    with pytest.raises(Exception, match="a lost executor"):
        run()
    assert len(published(spark, tmp_path / "t")) == 100  # the first batch alone
    run()
    assert published(spark, tmp_path / "t") == Counter(f'{{"event_id":{i}}}' for i in range(300))
    assert Topic(str(tmp_path / "t")).latest() == {"w": 2}
    # The sink has committed, the stream's own commit is lost: the batch comes again and is dropped.
    (tmp_path / "c/commits/2").unlink()
    (tmp_path / "c/commits/.2.crc").unlink(missing_ok=True)
    run()
    assert published(spark, tmp_path / "t") == Counter(f'{{"event_id":{i}}}' for i in range(300))
    held = {n for _, _, n in Topic(str(tmp_path / "t")).committed({}, {"w": 2})}
    left = {p.name for p in (tmp_path / "t/messages").glob("*.parquet")}
    assert held <= left


def test_keys_stay_in_order_and_bad_events_are_kept(spark, tmp_path):
    for k in range(4):
        land(spark, tmp_path / "e", rows_of(50 * k, 50 * k + 50) + ([(1000, None, None)] if k == 2 else []))
    topics.publish_or_bury(stream(spark, tmp_path / "e"), F.col("good"), F.col("user_id"), ["event_id"], str(tmp_path / "t"), str(tmp_path / "c"))
    live = topics.read_topic(spark, str(tmp_path / "t/live")).collect()
    by_key = {}
    for r in sorted(live, key=lambda r: (r["batch"], r["partition"], r["position"])):
        by_key.setdefault(r["key"], []).append(int(r["value"].split('"event_id":')[1].split(",")[0]))
    assert all(own == sorted(own) for own in by_key.values())
    assert sorted(i for own in by_key.values() for i in own) == [i for i in range(200) if i % 5]
    assert len({(r["key"], r["partition"]) for r in live}) == 7
    dead = topics.read_topic(spark, str(tmp_path / "t/dead")).collect()
    assert len(dead) == 41 and [r["value"] for r in dead if r["key"] is None] == ['{"event_id":1000}']


def test_readers_go_on_from_their_checkpoint(spark, tmp_path):
    seen, runs = Counter(), []

    def keep(batch, number):
        rows = batch.collect()
        runs.append(len(rows))
        seen.update(r["value"] for r in rows)

    for k in range(3):
        land(spark, tmp_path / "e", rows_of(40 * k, 40 * k + 40))
        topics.publish(messages(stream(spark, tmp_path / "e")), str(tmp_path / "t"), "w", str(tmp_path / "c"))
        windows.each_batch(topics.subscribe(spark, str(tmp_path / "t")), keep, str(tmp_path / "r"))
    windows.each_batch(topics.subscribe(spark, str(tmp_path / "t")), keep, str(tmp_path / "r"))
    assert seen == Counter(f'{{"event_id":{i}}}' for i in range(120)) and [n for n in runs if n] == [40, 40, 40]


def test_a_topic_without_messages(spark, tmp_path):
    assert topics.read_topic(spark, str(tmp_path / "none")).count() == 0
