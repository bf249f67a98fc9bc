"""The cache over a stream against a walk, over several micro-batches, with restarts; what its timers leave."""

import datetime as dt
import random

from larkmill.streaming import windows
from larkmill.streaming.cache import CacheRules, cached

START = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string"


def walk(rows, rules):
    held, out = {}, {}
    for event, ts, user, kind in sorted(rows, key=lambda r: (r[1], r[0])):
        own = {k: v for k, v in held.get(user, {}).items() if (ts - v).total_seconds() < rules.seconds}
        if kind == rules.invalidating:
            out[event], own = "cleared", {}
        elif kind in own:
            out[event] = "hit"
        else:
            out[event], own[kind] = "miss", ts
            if len(own) > rules.capacity:
                del own[min(own, key=lambda k: (own[k], k))]
        held[user] = own
    return out


def run(spark, folder, checkpoint, rules):
    seen = {}
    stream = cached(windows.event_stream(spark, str(folder), spark.createDataFrame([], SCHEMA).schema), rules=rules)

    def keep(batch, number):
        for r in batch.collect():
            assert r["event_id"] not in seen
            seen[r["event_id"]] = r["outcome"]

    query = stream.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True)
    query.start().awaitTermination()
    return seen


def test_cache_matches_a_walk_and_goes_on_after_a_restart(spark, tmp_path):
    rnd = random.Random(6)
    rules = CacheRules(seconds=3 * 3600, capacity=2)
    rows = [(i, START + dt.timedelta(minutes=rnd.randint(0, 4000)), rnd.randint(0, 5), rnd.choice(["view", "click", "buy", "error"])) for i in range(400)]
    rows.sort(key=lambda r: r[1])
    want = walk(rows, rules)
    got = {}
    for part in range(4):  # a file a time; the first two in one run, then a run each from the checkpoint
        own = [r for r in rows if part == (r[1] - START).total_seconds() // 60 // 1001]
        spark.createDataFrame(own, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
        if part:
            got |= run(spark, tmp_path / "e", tmp_path / "c", rules)
    assert got == want and {"hit", "miss", "cleared"} <= set(got.values())


def test_timers_remove_what_has_expired(spark, tmp_path):
    rules = CacheRules(seconds=3600, capacity=5)
    rows = [(1, START, 1, "view"), (2, START, 2, "view"), (3, START + dt.timedelta(days=5), 3, "view"), (4, START + dt.timedelta(days=9), 3, "view")]
    for row in rows:
        spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    assert run(spark, tmp_path / "e", tmp_path / "c", rules) == dict.fromkeys((1, 2, 3, 4), "miss")
    state = spark.read.format("statestore").option("path", str(tmp_path / "c")).option("stateVarName", "put").load()
    assert {r["key"]["user_id"] for r in state.select("key").collect()} == {3}
