"""Queries over tables made here, larger in one respect than the test tables."""

import random
from collections import Counter

from pyspark.sql import functions as F

import __spark_entry__ as entry
from larkmill.functions.stemming import stem
from larkmill.functions.text import FTS_STOP_WORDS, query_terms
from larkmill.operators.retrieval import match_stems

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ASKED = "harbour lantern copper violin meadow glacier"


def write(df, folder, name):
    df.write.parquet(f"{folder}/{name}.parquet")


def test_stemmed_terms_take_the_whole_query(spark, tmp_path):
    docs = [(1, ASKED + " more"), (2, "harbour lantern copper and nothing else"), (3, "Harbours lanterns coppers violins meadows glaciers")]
    write(spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], DOCS), tmp_path, "documents")
    write(spark.createDataFrame([(7, ASKED)], "item_id long, text string"), tmp_path, "benchmark")
    rows = entry.queries()["fts_stemmed_terms"](spark, str(tmp_path)).collect()
    assert sorted((r["query_id"], r["doc_id"], r["n_terms"]) for r in rows) == [(7, 1, 6), (7, 3, 6)]


def test_stemmed_scores_match_a_walk(spark, tmp_path):
    rnd = random.Random(5)
    pool = "connect connected connection connecting relate relational related run running runs the of ponies pony Sky skies über 12".split()
    docs = [(i, " ".join(rnd.choice(pool) for _ in range(rnd.randint(0, 30)))) for i in range(80)] + [(80, None)]
    asked = [(i, " ".join(rnd.choice(pool) for _ in range(rnd.randint(1, 4)))) for i in range(12)] + [(12, "the of"), (13, None)]
    d = spark.createDataFrame(docs, "d long, text string").repartition(3)
    q = spark.createDataFrame(asked, "q long, text string")
    for mode in ("all", "any"):
        got = {(r["query_id"], r["doc_id"]): (r["n_terms"], r["n_found"], round(r["fts_score"], 9)) for r in match_stems(q, "q", query_terms(F.col("text")), d, "d", "text", mode).collect()}
        want = {}
        for i, text in asked:
            terms = {stem(w) for w in (text or "").lower().split() if len(w) > 2 and w not in FTS_STOP_WORDS}
            for j, body in docs:
                tf = Counter(stem(w) for w in (body or "").lower().split())
                hit = [tf[x] for x in terms if tf[x]]
                if hit and (mode == "any" or len(hit) == len(terms)):
                    want[i, j] = (len(terms), len(hit), round(sum(n / (n + 1) for n in hit) / len(terms), 9))
        assert got == want


def test_stage_counts_under_the_default_limits(spark, small, tmp_path):
    """150 jobs hold all terms of a resume and 30 only the first three: 150, 100 and 20 pass the first three stages."""
    texts = [ASKED] * 150 + ["harbour lantern copper"] * 30
    write(spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS), tmp_path, "documents")
    write(spark.createDataFrame([(7, ASKED)], "item_id long, text string"), tmp_path, "benchmark")
    write(spark.createDataFrame([(1, "one", 5)], "s_suppkey long, s_name string, s_nationkey int"), tmp_path, "supplier")
    write(spark.createDataFrame([(5, "north")], "n_nationkey int, n_name string"), tmp_path, "nation")
    write(spark.read.parquet(f"{small}/embeddings.parquet"), tmp_path, "embeddings")
    got = {r["stage"]: r["n"] for r in entry.queries()["hybrid_stage_counts"](spark, str(tmp_path)).collect()}
    assert (got["fts"], got["vector"], got["judge"]) == (150, 100, 20)
