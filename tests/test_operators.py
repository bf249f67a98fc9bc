"""Operators against plain versions, and their plans."""

import json
import random

import numpy as np
from pyspark.sql import functions as F

from larkmill.operators import metrics as MT
from larkmill.operators import tables as TB
from larkmill.operators import windows as W
from larkmill.operators.feedback import WeightModel, heuristic_model
from larkmill.operators.retrieval import match_terms, nearest_in_lists, within_distance
from larkmill.plans.files import make_pdf
from larkmill.sources import html_pages as H
from larkmill.sources import readers as S
from larkmill.sources.paged import read_paged
from larkmill.sources.pdf import pdf_text
from larkmill.sources.sinks import split_dead_letters
from larkmill.streaming import limits, windows
from larkmill.streaming.ingest import IncrementalTable


def test_first_seen_matches_loop(spark):
    rnd = random.Random(3)
    rows = [(i, f"u{rnd.randint(0, 40)}", f"t{rnd.randint(0, 40)}") for i in range(120)]
    us, ts, want = set(), set(), []
    for i, u, t in rows:
        if u not in us and t not in ts:
            us.add(u)
            ts.add(t)
            want.append(i)
    df = spark.createDataFrame(rows, "i int, u string, t string")
    assert sorted(r["i"] for r in TB.first_seen(df, "i", ["u", "t"]).collect()) == want


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, fp string, change_count long")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, fp string")
    once = TB.upsert(old, new, "k", "fp", [])
    assert {(r["k"], r["status"], r["change_count"]) for r in once.collect()} == {(1, "kept", 0), (2, "updated", 1), (3, "created", 0)}
    again = TB.upsert(once.select("k", "fp", "change_count"), new, "k", "fp", [])
    assert {r["status"] for r in again.collect()} == {"kept", "duplicate"}


def test_budget_overshoots_once(spark):
    df = spark.createDataFrame([("a", i, 3.0) for i in range(6)], "g string, i int, c double")
    kept = W.within_budget(df, ["g"], [F.asc("i")], "c", 7.0)
    assert sorted(r["i"] for r in kept.collect()) == [0, 1, 2]
    assert sorted(r["i"] for r in W.prefix_that_fits(df, ["g"], [F.asc("i")], "c", 7.0).collect()) == [0, 1]


def test_row_numbers(spark):
    df = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(10_000)).alias("x"), "id")
    rows = TB.global_row_number(df, ["x", "id"]).orderBy("x", "id").collect()
    assert [r["row"] for r in rows] == list(range(1, 1001))


def test_average_ranks(spark):
    rnd = random.Random(2)
    xs = [rnd.randint(0, 30) / 7 for _ in range(400)]
    df = spark.createDataFrame([(x,) for x in xs], "x double").repartition(6)
    got = {r["value"]: r["rank"] for r in TB.average_ranks(df, "x").collect()}
    assert got == {x: sum(y < x for y in xs) + (xs.count(x) + 1) / 2 for x in set(xs)}


def test_moving_average_over_buckets(spark):
    """A fold value by value, against buckets of seven rows that run over keys."""
    rnd = random.Random(7)
    rows = [(rnd.choice("abc"), i, rnd.choice((rnd.uniform(-5, 5), rnd.uniform(0, 100)))) for i in range(200)]
    got = {r["k"]: r for r in MT.moving_average(spark.createDataFrame(rows, "k string, i int, v double"), "k", ["i"], "v", bucket_rows=7).collect()}
    for k in "abc":
        values = [v for key, _, v in rows if key == k]
        ema = peak = values[0]
        for v in values[1:]:
            ema = ema * 0.9 + v * 0.1
            peak = v * 0.95 + peak * 0.05 if v > peak else peak
        assert got[k]["n"] == len(values)
        assert abs(got[k]["ema"] - ema) < 1e-9 and abs(got[k]["peak"] - peak) < 1e-9
    empty = spark.createDataFrame([], "k string, i int, v double")
    assert MT.moving_average(empty, "k", ["i"], "v").count() == 0


def test_within_distance(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.uniform(0, 1) for _ in range(3)], rnd.choice((1, 2, None))) for i in range(90)] + [(90, [0.5, 0.5, 0.5], 1), (91, [0.5, 0.5, 0.5], 1)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    got = {(r["a"], r["b"], r["dist"]) for r in within_distance(df.where("id % 3 = 0"), df, ["label"], 0.4).collect()}
    far = lambda x, y: round(sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) ** 0.5, 6)
    want = {(i, j, far(x, y)) for i, x, m in rows for j, y, n in rows if i % 3 == 0 and i != j and m == n and far(x, y) <= 0.4}
    assert got == want and (90, 91, 0.0) in got


def test_lists_find_neighbours(spark):
    """Inverted lists against all pairs, on vectors in groups; a few lists are probed. All lists are an exact search."""
    rnd = np.random.default_rng(8)
    centres = rnd.normal(size=(20, 16))
    v = centres[rnd.integers(0, 20, 3000)] + 0.4 * rnd.normal(size=(3000, 16))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(5000, None)], "id long, v array<double>")
    asked, unit = df.where("id % 50 = 0"), v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {q: set(np.argsort(-(unit @ unit[q]), kind="stable")[:10].tolist()) for q in range(0, 3000, 50)}

    def recall(**how):
        got = {}
        for r in nearest_in_lists(asked, "id", "v", df, "id", "v", 10, lists=32, **how).collect():
            got.setdefault(r["query_id"], set()).add(r["base_id"])
        return np.mean([len(got[q] & want[q]) / 10 for q in want])

    assert recall() >= 0.95 and recall(probes=8) >= 0.9 and recall(probes=32, shard_rows=20) == 1.0
    empty = df.limit(0)
    assert nearest_in_lists(asked, "id", "v", empty, "id", "v", 3).count() == 0 == nearest_in_lists(empty, "id", "v", df, "id", "v", 3).count()


def test_range_pairs_meet_once(spark):
    rows = [(i, "g", round(v, 3)) for i, v in enumerate([0.1, 0.12, 0.139, 0.2, 0.2])]
    got = {(r["i"], r["other_job"]) for r in TB.range_pairs(spark.createDataFrame(rows, "i int, g string, v double"), "g", "i", "v", 0.02).collect()}
    want = {(a, b) for a, _, x in rows for b, _, y in rows if a != b and abs(x - y) <= 0.02 + 1e-9}
    assert got == want


def test_filters_reach_the_scan(spark, small):
    from larkmill.plans.relational import filter_equality

    plan = filter_equality(spark, small)._jdf.queryExecution().toString()
    assert "EqualTo(lang,en)" in plan and "text" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "d long, text string")
    q = spark.createDataFrame([(1, "alpha beta")], "q long, text string")
    assert match_terms(q, "q", F.split("text", " "), docs, "d", "text").count() == 0


def test_weights_round_trip():
    m = heuristic_model()
    assert WeightModel.from_json(m.to_json()) == m
    assert m.importance()[0][0] == "llm_score"


def test_seed_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,domain,website\nAcme,,acme.com\nBeta,beta.io,\n")
    (tmp_path / "b.json").write_text(json.dumps({"companies": [{"name": "Acme", "domain": "acme.com"}]}))
    (tmp_path / "c.json").write_text(json.dumps([{"name": "Gamma", "website": "g.com"}]))
    (tmp_path / "d.txt").write_text("# comment\nDelta\n\n")
    (tmp_path / "e.yaml").write_text("name: Eps\nwebsite: e.com\ncareers:\n  url: https://e.com/jobs\n")
    rows = lambda f: [(r["name"], r["domain"]) for r in S.read_seeds(spark, str(tmp_path / f)).collect()]
    assert rows("a.csv") == [("Acme", "acme.com"), ("Beta", "beta.io")]
    assert rows("b.json") == [("Acme", "acme.com")] and rows("c.json") == [("Gamma", "g.com")]
    assert rows("d.txt") == [("Delta", None)] and rows("e.yaml") == [("Eps", "e.com")]


def test_documents(spark, tmp_path):
    import zipfile

    (tmp_path / "a.txt").write_text("one  two")
    (tmp_path / "b.bin").write_bytes(b"x")
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f"<w:document {ns}><w:body><w:p><w:r><w:t>Para</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", body)
    got = {r["path"].rsplit("/", 1)[-1]: (r["text"], r["error"]) for r in S.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == ("one two", None) and got["d.docx"] == ("Para\nx | y", None)
    assert "unsupported" in got["b.bin"][1] and S.document_text("c.txt", b"") == (None, "empty file")


def test_pdf_text():
    pages = [["One (in brackets) \\ line", "caf\xe9"], [], ["last"]]
    want = "One (in brackets) \\ line\ncaf\xe9\nlast"
    for deflate in (True, False):
        assert pdf_text(make_pdf(pages, deflate)) == want
    body = b"%PDF-1.4\n1 0 obj << /Type /Pages /Kids [2 0 R] >> endobj 2 0 obj << /Parent 1 0 R /Contents [3 0 R] >> endobj\n"
    body += b"3 0 obj << >> stream\nBT [(He) -20 (llo)] TJ T* <4142> Tj (\\101\\)) ' ET\nendstream endobj"
    assert pdf_text(body) == "Hello\nAB\nA)"
    assert S.document_text("x.pdf", b"none")[1] and S.document_text("x.pdf", make_pdf([["a"]]))[0] == "a"


def test_paged_source(spark, tmp_path):
    for n in range(2):
        (tmp_path / f"p{n}.json").write_text(json.dumps({"results": [{"id": n * 10 + i} for i in range(3)]}))
    rows = read_paged(spark, str(tmp_path / "p{page}.json"), 4).collect()
    assert [(r["page"], r["position"]) for r in sorted(rows)] == [(p, i) for p in range(2) for i in range(3)]


def test_selectors():
    page = '<div id="top"><div class="posting x"><div class="posting-name"><h5>Dev</h5></div><div class="posting-categories"><span class="location">Rome</span></div><a class="posting-btn-submit" href="/a">go</a></div></div>'
    assert H.postings(page, H.LIST_SELECTORS["lever"]) == [
        {"title": "Dev", "location": "Rome", "department": None, "job_type": None, "link": "/a", "description": None}
    ]


def test_dead_letters(spark):
    good, bad = split_dead_letters(spark.createDataFrame([(1,), (2,), (None,)], "x int"), F.col("x") == 1)
    assert good.count() == 1 and bad.count() == 2


def folded(rows, step, now):
    out = {}
    for s, i, kind in sorted(rows):
        now, said = step(now, s, kind)
        out[i] = said
    return out


def test_limits_fold_over_batches(spark, tmp_path):
    """Call by call, against streams of several files in order of time, the state carried from one to the next."""
    rnd = random.Random(9)
    at, rows = 1704067200, []
    for i in range(160):
        at += rnd.choice((0, 1, 20, 59, 60, 61, 400))
        rows.append((i, rnd.randint(1, 3), at, rnd.choice(("error", "error", "view"))))
    for n in range(4):
        part = spark.createDataFrame(rows[n * 40 : n * 40 + 40], "event_id long, user_id long, s long, event_type string")
        part.select("event_id", "user_id", "event_type", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    schema = spark.read.parquet(str(tmp_path / "e")).schema

    def quota(now, s, kind):
        begun, used = (s, 1) if now is None or s - now[0] > 120 else (now[0], now[1] + 1)
        return (begun, used), (used, used <= 3)

    def bucket(now, s, kind):
        level = 2.0 if now is None else min(2.0, now[0] + (s - now[1]) / 60)
        return (level - (level >= 1), s), (level - (level >= 1), level >= 1)

    def breaker(now, s, kind):
        streak, opened = now or (0, None)
        if opened is not None and s - opened < 60:
            return (streak, opened), ("rejected",)
        streak = streak + 1 if kind == "error" else 0
        return (streak, s if streak >= 2 else None), ("failed" if kind == "error" else "passed",)

    runs = {
        "quota": (lambda e: limits.quota(e, "user_id", 2, 3), quota, ("used", "allowed")),
        "bucket": (lambda e: limits.token_bucket(e, "user_id", 2.0, 1 / 60), bucket, ("tokens", "allowed")),
        "breaker": (lambda e: limits.circuit_breaker(e, "user_id", 2, 60.0), breaker, ("outcome",)),
    }
    for build, step, columns in runs.values():
        stream = windows.event_stream(spark, str(tmp_path / "e"), schema)
        got = {r["event_id"]: tuple(r[c] for c in columns) for r in windows.drain(build(stream), "append").collect()}
        want = {}
        for user in (1, 2, 3):
            want |= folded([(s, i, kind) for i, u, s, kind in rows if u == user], step, None)
        assert got.keys() == want.keys()
        for i, said in want.items():
            assert all(abs(a - b) < 1e-9 if isinstance(b, float) else a == b for a, b in zip(got[i], said, strict=True))


def test_incremental_table_keeps_two_versions(spark, tmp_path):
    table = IncrementalTable(spark, str(tmp_path / "t"), "k", "fp", ["n"], spark.createDataFrame([], "k long, fp string, n long"), buckets=3)
    state = {}
    for number in range(4):
        rows = [(k, f"f{k * number % 3}", k + number) for k in range(number, 12, number + 1)]
        batch = spark.createDataFrame(rows, "k long, fp string, n long")
        table.merge(batch, number)
        table.merge(batch, number)  # a repeated batch
        state |= {k: (fp, n) for k, fp, n in rows}
    assert {r["k"]: (r["fp"], r["n"]) for r in table.current().collect()} == state
    assert all(len(x) <= 2 for x in table.written.values())
