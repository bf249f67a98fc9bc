"""Cases in which larger tables told a query from its SQL, or in which a step grew faster than its input."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import functions as F

from larkmill.functions import text as T
from larkmill.operators import retrieval as R
from larkmill.operators import tables as TB
from larkmill.operators import templates as TP
from larkmill.streaming import limits, windows


def test_applications_take_the_newest_of_all_portals(spark):
    jobs = spark.createDataFrame([(1, 1), (2, 2), (2, 1), (3, 3), (4, 9)], "job_id int, company_id int")
    configs = spark.createDataFrame([(1, 10), (2, 10), (2, 20), (3, 30)], "company_id int, portal_id int")
    rows = [(5, 10, 1, True), (6, 10, 3, True), (4, 10, 3, True), (7, 10, 9, False), (8, 20, 4, True), (9, 20, None, True), (3, 30, None, True)]
    templates = spark.createDataFrame(rows, "template_id int, portal_id int, version long, is_active boolean")
    found = TP.plan_applications(jobs, configs, templates)
    assert {tuple(r) for r in found.collect()} == {(1, 4, 3), (2, 8, 4), (3, 3, None)}
    # Jobs of one portal with many templates: no join makes a row for each of both.
    many = spark.range(500).selectExpr("id AS template_id", "1 AS portal_id", "id AS version", "true AS is_active")
    plan = TP.plan_applications(spark.range(300).selectExpr("id AS job_id", "1 AS company_id"), spark.createDataFrame([(1, 1)], "company_id int, portal_id int"), many)
    assert plan.count() == 300
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("company_id") < text.index("min(struct(none")  # templates are grouped below the joins


def test_range_pairs_at_the_edge_of_two_bands(spark):
    rows = [(i, "g", i / 100) for i in range(0, 101)]  # 0.58 / 0.02 falls short of 29
    found = TB.range_pairs(spark.createDataFrame(rows, "i int, g string, v double"), "g", "i", "v", 0.02)
    got = [(r["i"], r["other_job"]) for r in found.collect()]
    want = {(a, b) for a in range(101) for b in range(101) if 0 < abs(a - b) <= 2}
    assert len(got) == len(want) and set(got) == want


def test_redaction_knows_the_word_limits_of_sql(spark):
    import duckdb

    from larkmill.plans.texts import REDACT

    texts = [
        "in 77.250.53.96 das ist die stßä auf", "12 Oak\x0bStreet", "12 Oak Street\x0b", "ä12 Oak Roadü", "éa@b.com", "a@b.comé", "ü123-45-6789ß", "a@b.co\u212a", "5 x \u017ft",
        "12  a\fb\rSt", "555\x0b123\x0b4567", "5551234567", "1 Ave 2 Lane", "a\u0301@b.com\u0301", "\u0661\u0662 Oak St", "555.123 4567",
    ]
    found = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", T.redact(F.col("text")).alias("t"))
    got = [r["t"] for r in found.orderBy("i").collect()]
    assert got == [duckdb.execute(f"SELECT {REDACT} FROM (SELECT ?::VARCHAR AS text)", [x]).fetchone()[0] for x in texts]
    assert got[0] == "in 77.250.53.[ADDRESS]ßä auf"


def test_bucket_gains_whole_tokens_and_seconds_are_not_cut(spark, tmp_path):
    """Gains of days in thirds and sevenths must make a token when a day is full; calls of one second go by their ids."""
    begin, rows = 1704067200, []
    for user in range(1, 41):
        at = begin
        for k in range(40):
            at += (86400 // 3, 86400 // 7 + user, 86400 - 86400 // 7 - user, 7 * user, 86400 - 7 * user)[(k + user) % 5]
            rows.append((user * 100 + k, user, float(at)))
    rows += [(9000 - k, 99 if k % 2 else None, begin + 86400 * 8 + k / 100) for k in range(400)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, s double").selectExpr("event_id", "user_id", "'view' AS event_type", "timestamp_millis(CAST(round(s * 1000) AS LONG)) AS ts")
    stream = windows.event_stream(spark, windows.landed(events), events.schema)
    got = {r["event_id"]: (r["user_id"], r["tokens"], r["allowed"]) for r in windows.drain(limits.token_bucket(stream, "user_id", 2.0, Fraction(1, 86400)), "append").collect()}
    want, now = {}, {}
    for s, i, user in sorted((float(int(s)), i, user) for i, user, s in rows):
        level = min(2.0, now[user][0] + (s - now[user][1]) / 86400) if user in now else 2.0
        now[user] = (level - 1 if level >= 1 else level, s)
        want[i] = (user, now[user][0], level >= 1)
    assert got == want


def test_p95_of_busy_hours_is_exact(spark, tmp_path):
    """Hours of more values than a sketch holds exactly."""
    import duckdb

    from larkmill.plans import streams

    rows = "SELECT id AS event_id, timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id % 9000) AS ts, id % 7 AS user_id, if(id % 3 = 0, 'view', 'click') AS event_type, if(id % 11 > 0, (id * 7919 % 100003) / 1000.0D, NULL) AS value FROM range(30000)"
    spark.sql(rows).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(tuple(r) for r in streams.stream_p95_alerts(spark, str(tmp_path)).collect())
    duckdb.execute(f"CREATE OR REPLACE TEMP VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == sorted(duckdb.execute(streams.R.sql["stream_p95_alerts"]).fetchall()) and max(r[2] for r in got) > 4000


def test_nearest_in_slices_of_queries(spark):
    """The same rows however few scores a task may hold, on both ways."""
    rows = [(i, [float((i * 7 + j * 3) % 11 - 5) + 0.5 for j in range(4)]) for i in range(120)]  # with ties
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    runs = [{}, {"cells": 64}, {"cells": 64, "block_rows": 16, "shard_rows": 32}, {"block_rows": 16, "shard_rows": 32}]
    found = [{(r["query_id"], r["rank"], r["base_id"], round(r["score"], 9)) for r in R.nearest_exact(df.where("id % 3 = 0"), "id", "v", df, "id", "v", 7, **how).collect()} for how in runs]
    assert len(found[0]) == 40 * 7 and all(f == found[0] for f in found)


def test_pairs_of_documents_and_queries_set_the_tasks(spark):
    """Tasks follow the pairs, not the postings that they are made of; pairs aren't shuffled."""
    counted = spark.range(400).selectExpr("id AS doc_id", "'a' AS term", "id % 3 + 1 AS tf")
    wanted = F.broadcast(spark.range(50).selectExpr("id AS query_id", "1 AS n_terms", "'a' AS q_term"))
    found = R._scores(counted, wanted, "all", 400, pairs=100)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(doc_id") == 1
    assert "Exchange hashpartitioning(query_id" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.rdd.getNumPartitions() == 200 and found.count() == 400 * 50
    assert {r["fts_score"] for r in found.where("doc_id = 7").collect()} == {2 / 3}
