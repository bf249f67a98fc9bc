"""Similar names by brute force, vector means by walks, quantile sketches within their bound, alerts and late rows."""

import datetime as dt
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkmill.operators.retrieval import mean_vector
from larkmill.operators.trigrams import similar_names, trigrams
from larkmill.streaming import windows


def grams(name):
    return {f"  {w} "[i : i + 3] for w in re.findall(r"[^\W_]+", name.lower()) for i in range(len(w) + 1)}


@pytest.mark.parametrize("least", [0.25, 0.5, 0.8, 1.0])
def test_similar_names_match_brute_force(spark, least):
    rnd = random.Random(4)
    pool = ["acme", "acne", "North", "north-east", "labs", "lab", "é", "data", "datum", "x"]
    names = {" ".join(rnd.choice(pool) for _ in range(rnd.randint(1, 4))) for _ in range(150)} | {"", "--", "Acme", "ACME", "acme acme"}
    df = spark.createDataFrame([(n,) for n in names] * 2 + [(None,)], "name string").repartition(5)
    got = {(r["a"], r["b"]): r["similarity"] for r in similar_names(df, "name", least).collect()}
    want = {}
    for a in names:
        for b in names:
            x, y = grams(a), grams(b)
            if a.encode() < b.encode() and x and y and len(x & y) / len(x | y) >= least - 1e-12:
                want[a, b] = len(x & y) / len(x | y)
    assert got == pytest.approx(want) and got.keys() == want.keys()
    some = F.col("name").startswith("a")
    asked = {(r["a"], r["b"]) for r in similar_names(df, "name", least, some).collect()}
    assert asked == {p for a, b in want for p in ((a, b), (b, a)) if p[0].startswith("a")}
    with pytest.raises(ValueError):
        similar_names(df, "name", 0)


def test_similar_names_compare_few_pairs(spark):
    """A thousand names of a common word and an own one: only those that share a rare trigram meet."""
    df = spark.createDataFrame([(f"company {i:04d}x{i * 7919 % 10007:05d}",) for i in range(1000)], "name string")
    assert similar_names(df, "name", 0.8).count() >= 0
    plan = similar_names(df, "name", 0.8)._jdf.queryExecution().toString()
    assert not re.search(r"CartesianProduct|BroadcastNestedLoop|Python", plan)
    assert df.select(trigrams(F.col("name")).alias("g")).where(F.size("g") == 0).count() == 0


def test_mean_vectors_match_a_walk(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice(["a", "b", None]), rnd.randint(0, 3), [rnd.choice([None, rnd.uniform(-1, 1)]) for _ in range(rnd.choice([0, 3, 5]))]) for _ in range(400)]
    rows += [("a", 1, None), ("only null", 1, None), ("none", 0, [None, None])]
    df = spark.createDataFrame(rows, "k string, n int, v array<double>").repartition(7)
    for held in (20_000, 2):
        got = {(r["k"], r["n"]): r["mean"] for r in mean_vector(df, ["k", "n"], "v", held).collect()}
        want = {}
        for key in {(k, n) for k, n, v in rows if v is not None}:
            own = [v for k, n, v in rows if (k, n) == key and v is not None]
            size = max(map(len, own))
            cells = [[v[i] for v in own if len(v) > i and v[i] is not None] for i in range(size)]
            want[key] = [sum(c) / len(c) if c else None for c in cells]
        assert got.keys() == want.keys()
        for key, mean in want.items():
            assert [x is None for x in got[key]] == [x is None for x in mean]
            assert np.allclose([x for x in got[key] if x is not None], [x for x in mean if x is not None])


def test_mean_vectors_shuffle_sums_only(spark):
    df = spark.range(4000).select((F.col("id") % 3).alias("k"), F.array(*[F.rand(i) for i in range(8)]).alias("v")).repartition(5)
    means = mean_vector(df, ["k"], "v")
    means.collect()
    plan = means._jdf.queryExecution().executedPlan()
    written = [int(m) for m in re.findall(r"shuffleRecordsWritten[^0-9]*(\d+)", plan.toString())]
    stages = plan.toString()
    assert "MapInArrow" in stages and "FlatMapGroupsInArrow" in stages and "Generate" not in stages
    assert not written or min(written) <= 15


START = dt.datetime(2024, 3, 1)
SCHEMA = "event_id long, ts timestamp_ntz, kind string, value double"


def test_merged_sketches_keep_their_bound(spark):
    rnd = random.Random(5)
    rows = [(i, START + dt.timedelta(seconds=rnd.randint(0, 3599)), "a", rnd.gauss(0, 1)) for i in range(30_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.col("ts").cast("timestamp"))
    w = F.window("ts", "5 minutes")
    base = df.groupBy(w.alias("w"), "kind").agg(F.kll_sketch_agg_double("value", windows.SKETCH).alias("sketch")).select(F.col("w.start").alias("start"), "kind", "sketch")
    values = np.sort([r[3] for r in rows])
    for share in (0.05, 0.5, 0.95):
        whole = windows.sliding_quantile(base, "kind", share).orderBy(F.desc("n")).first()
        assert whole["n"] == 30_000
        assert abs(np.searchsorted(values, whole["quantile"]) / len(values) - share) < 0.014  # twice the bound of one sketch
    small = windows.sliding_quantile(base, "kind", 0.5).count()
    assert small == 23  # twelve base windows, each in twelve


def test_late_rows_past_the_watermark_are_dropped(spark, tmp_path):
    drops = [[(1, 0, 1.0), (2, 10, 2.0)], [(3, 60 * 24 * 3, 5.0)], [(7, 60 * 24 * 3 + 2, 6.0)], [(4, 1, 9.0), (5, 60 * 24 * 3 + 1, 7.0)], [(6, 60 * 24 * 9, 1.0)]]
    for part in drops:
        rows = [(i, START + dt.timedelta(minutes=m), "a", v) for i, m, v in part]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    stream = windows.event_stream(spark, str(tmp_path / "e"), spark.createDataFrame([], SCHEMA).schema)
    base = windows.drain(windows.sketches(stream, "kind", "value"), "append")
    got = {r["start"]: r["n"] for r in base.select(F.col("start").cast("timestamp_ntz").alias("start"), F.kll_sketch_get_n_double("sketch").alias("n")).collect()}
    late = START + dt.timedelta(days=3)
    assert got == {START: 1, START + dt.timedelta(minutes=10): 1, late: 3}  # the fourth event came too late; the last window is open


def test_alerts_hold_between_the_limits(spark):
    values = [1, 5, 11, 7, 8, 3, 7, 12, 7, None, 2]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)] + [("b", 0, 7)], "k string, start int, v int")
    got = {(r["k"], r["start"]): r["firing"] for r in windows.hysteresis(df, "k", "v", 10, 4).collect()}
    assert [got["a", i] for i in range(len(values))] == [False, False, True, True, True, False, False, True, True, True, False] and not got["b", 0]


def test_a_search_deals_names_to_shards_and_not_by_trigram(spark):
    """Names of one common word: a join by trigrams would bring all of them to the task of that word's."""
    df = spark.range(600).select(F.concat(F.lit("common common "), F.col("id").cast("string")).alias("name"), (F.col("id") % 100 == 0).alias("asked"))
    found = similar_names(df, "name", 0.4, F.col("asked"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan
    want = {(a, b) for a in range(0, 600, 100) for b in range(600) if a != b and len(grams(f"common {a}") & grams(f"common {b}")) >= 0.4 * len(grams(f"common {a}") | grams(f"common {b}"))}
    assert {(int(r["a"].split()[-1]), int(r["b"].split()[-1])) for r in found.collect()} == want and len(want) > 1000
