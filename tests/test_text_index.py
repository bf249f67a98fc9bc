"""The stored text index against a scan, its plan, the commit log, and ranks against brute force over all stretches."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from larkmill.operators import ranking
from larkmill.operators.text_index import IndexRules, TextIndex, search_terms
from larkmill.sources.commits import CommitConflict, CommitLog

WORD = re.compile(r"[^\W_]+")


def test_commit_log(spark, tmp_path):
    log = CommitLog(spark, f"{tmp_path}/t", keep=3)
    assert log.latest() == (0, {})
    assert log.commit(0, {"files": ["a"]}) == 1 and log.latest() == (1, {"files": ["a"]})
    with pytest.raises(CommitConflict):
        log.commit(0, {"files": ["b"]})
    other = CommitLog(spark, f"{tmp_path}/t")
    tried = []

    def add(state):
        if not tried:  # another writer comes first
            other.commit(1, {"files": [*state["files"], "z"]})
        tried.append(1)
        return {"files": [*state["files"], "c"]}

    assert log.update(add) == (3, {"files": ["a", "z", "c"]}) and len(tried) == 2
    assert log.update(lambda state: None)[0] == 3
    for k in range(3, 8):
        log.commit(k, {"k": k})
    assert log.numbers() == [6, 7, 8] and not list(tmp_path.glob("t/_log/.*.tmp"))


def corpus(rnd, n=300):
    pool = [f"w{i}" for i in range(60)] + ["the", "Über", "日本", "x1"]
    rows = [(i, " ".join(rnd.choice(pool) + rnd.choice(["", ",", "\n"]) for _ in range(int(rnd.expovariate(1 / 15))))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "w1 " * 500)]


def walk(rows, queries, mode):
    out = {}
    for q, terms in queries:
        for i, text in rows:
            counts = Counter(w.lower() for w in WORD.findall(text or ""))
            hit = [counts[t] for t in terms if counts[t]]
            if hit and (mode == "any" or len(hit) == len(terms)):
                out.setdefault(q, []).append((-round(sum(n / (n + 1) for n in hit), 9), i, len(hit)))
    return {q: [(i, n) for _, i, n in sorted(found)] for q, found in out.items()}


@pytest.mark.parametrize("mode", ["any", "all"])
def test_index_equals_a_scan(spark, tmp_path, mode):
    rnd = random.Random(3)
    rows = corpus(rnd)
    queries = [(q, rnd.sample([f"w{i}" for i in range(62)] + ["über", "日本"], rnd.randint(1, 3))) for q in range(25)] + [(90, ["nowhere"]), (91, ["w1", "nowhere"])]
    index = TextIndex(spark, f"{tmp_path}/i", IndexRules(buckets=8, block_docs=16, slice_docs=100))
    docs = spark.createDataFrame(rows + [(None, "w1 w2")], "doc_id long, text string").repartition(3)
    index.append(docs.where("doc_id < 120"))
    again = TextIndex(spark, f"{tmp_path}/i", IndexRules(buckets=99))  # opened anew, with what it was made with
    assert again.rules.buckets == 8
    again.append(docs.where("doc_id >= 100 or doc_id is null").union(docs.where("doc_id = 130")))
    again.append(docs)  # all are there
    assert len(again.log.latest()[1]["generations"]) == 2
    assert {(r["doc_id"], r["n_words"]) for r in again.lengths().collect()} == {(i, len(WORD.findall(t or ""))) for i, t in rows}
    asked = spark.createDataFrame(queries, "q long, terms array<string>")
    want = walk(rows, queries, mode)
    for k, first in ((5, 1), (1000, 2)):
        got = {}
        for r in sorted(again.top_k(asked, "q", F.col("terms"), k, mode, first).collect(), key=lambda r: r["rank"]):
            got.setdefault(r["query_id"], []).append((r["doc_id"], r["n_found"]))
        assert got == {q: found[:k] for q, found in want.items()}
    places = {(r["query_id"], r["doc_id"]): [tuple(e) for e in r["entries"]] for r in again.matches(asked, "q", F.col("terms"), mode).collect()}
    terms = dict(queries)
    texts = dict(rows)
    assert set(places) == {(q, i) for q, found in want.items() for i, _ in found}
    for (q, i), found in places.items():
        words = [w.lower() for w in WORD.findall(texts[i])]
        assert found == [(p, terms[q].index(w)) for p, w in enumerate(words, 1) if w in terms[q]]


def test_index_without_documents(spark, tmp_path):
    index = TextIndex(spark, f"{tmp_path}/i")
    asked = spark.createDataFrame([(1, ["a"])], "q long, terms array<string>")
    none = spark.createDataFrame([(None, "a")], "doc_id long, text string")
    index.append(none)
    assert index.lengths() is None and index.top_k(asked, "q", F.col("terms"), 3).count() == 0
    assert index.matches(asked, "q", F.col("terms")).count() == 0


def test_search_reads_the_asked_buckets_only(spark, tmp_path):
    index = TextIndex(spark, f"{tmp_path}/i", IndexRules(buckets=16, block_docs=8))
    index.append(spark.createDataFrame([(i, f"word{i % 50} and text{i}") for i in range(100)], "doc_id long, text string"))
    asked = spark.createDataFrame([(1, ["word7"])], "q long, terms array<string>")
    _, _, buckets = index._wanted(asked, "q", F.col("terms"))
    rows = index.rows(buckets)
    plan = rows._jdf.queryExecution().toString()
    assert len(buckets) == 1 and f"(bucket#" in plan and "PartitionFilters: [isnotnull(bucket" in plan
    folders = {re.search(r"bucket=([^/]+)", f)[1] for f in rows.inputFiles()}
    assert len(folders) > 1  # the table has more; the scan lists what its filter leaves
    scanned = rows._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scanned.selectedPartitions().totalNumberOfFiles() < 16 + 2


def brute_covers(entries, n):
    found = []
    for i in range(len(entries)):
        for j in range(i, len(entries)):
            if {s for _, s in entries[i : j + 1]} == set(range(n)):
                found.append((i, j))
    minimal = [(i, j) for i, j in found if not any(a >= i and b <= j and (a, b) != (i, j) for a, b in found)]
    return [(entries[i][0], entries[j][0], j - i + 1) for i, j in minimal]


def test_ranks_match_brute_force(spark):
    rnd = random.Random(12)
    rows = []
    for k in range(150):
        n = rnd.randint(1, 4)
        places = sorted(rnd.sample(range(1, rnd.choice([12, 60, 400])), rnd.randint(1, 11)))
        rows.append((k, n, [(p, rnd.randrange(n)) for p in places]))
    df = spark.createDataFrame(rows, "k int, n long, entries array<struct<pos:int,slot:int>>")
    e, n = F.col("entries"), F.col("n")
    found = df.withColumn("found", ranking.covers(e, n)).select(
        "k", "found", ranking.cover_density(F.col("found")).alias("cd"), ranking.proximity_rank(e, n).alias("near"), ranking.frequency_rank(e, n).alias("freq")
    )
    given = {k: (n, entries) for k, n, entries in rows}
    for r in found.collect():
        n, entries = given[r["k"]]
        covers = brute_covers(entries, n)
        assert [tuple(c) for c in r["found"]] == covers
        total = sum(0.1 / (1 + (b - a + 1 - m)) for a, b, m in covers)
        assert r["cd"] == pytest.approx(total / (total + 1))
        freq = sum(0.1 * sum(1 / j**2 for j in range(1, sum(s == t for _, s in entries) + 1)) for t in range(n)) / 1.64493406685 / n
        assert r["freq"] == pytest.approx(freq)
        left = 1.0
        for i, (p, s) in enumerate(entries):
            for q, t in entries[:i]:
                if s != t and p - q <= 100:
                    left *= 1 - 0.1 * math.sqrt(1 / (1.005 + 0.05 * math.exp((p - q) / 1.5 - 2)))
        assert r["near"] == pytest.approx(freq if n < 2 else 1 - left)


def test_headlines(spark):
    text = " ".join(f"t{i}" for i in range(1, 101))
    rows = [(1, text, [(50, 0), (53, 1)]), (2, text, [(2, 0), (4, 1)]), (3, text, [(1, 0), (90, 1)]), (4, text, [(99, 0), (100, 1)])]
    df = spark.createDataFrame(rows, "k int, text string, entries array<struct<pos:int,slot:int>>")
    shown = ranking.headline(F.split("text", " "), F.col("entries"), ranking.covers(F.col("entries"), F.lit(2)), most=10)
    got = {r["k"]: r["h"] for r in df.select("k", shown.alias("h")).collect()}
    assert got[1] == "t47 t48 t49 <b>t50</b> t51 t52 <b>t53</b> t54 t55 t56"
    assert got[2] == "t1 <b>t2</b> t3 <b>t4</b> t5 t6 t7 t8 t9 t10"
    assert got[3] == "<b>t1</b> " + " ".join(f"t{i}" for i in range(2, 11))
    assert got[4] == "t95 t96 t97 t98 <b>t99</b> <b>t100</b>"


def test_search_terms(spark):
    df = spark.createDataFrame([("The quick, Quick fox-hound of 日本語 an x",), (None,)], "text string")
    assert [r[0] for r in df.select(search_terms(F.col("text"))).collect()] == [["quick", "fox", "hound", "日本語"], []]
