"""The registered corpus queries: contracts, SQL twins, and the pipeline stage by stage."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larkmill.llm.queries import ORACLE_SQL, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    found = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    df = QUERIES[name](spark, small)
    assert sorted(columns) == sorted(df.columns)
    shape = lambda rows, names: Counter(tuple(str(r[names.index(c)]) for c in sorted(names)) for r in rows)
    assert shape(df.collect(), df.columns) == shape(found.fetchall(), columns)


@pytest.mark.parametrize("name", ["op1_line_frequency_rules", "op3_line_window_dedup", "op11_filter_audit", "op13_fill_middle"])
def test_sql_on_odd_rows(spark, tmp_path, name):
    """Repeated rows, reused and missing ids, null hosts and texts."""
    line = "the same line of boilerplate in all of them with quite a number of words that go on and on until it ends here"
    rows = [(i % 30, f"{line}\n{' '.join(f'w{i % 30}x{j}' for j in range(25))}", "en", (None, "a", "b")[i % 3], 1) for i in range(150)]
    rows += [(40 + i % 7, f"p{i % 3}\nq\n \nr\ns{i % 2}\n{line}", "en", "a", 1) for i in range(14)]
    rows += [(None, f"{line}\nshort\nand more\nthan that", "en", "c", i) for i in range(22)] + [(7, f"{line}\n{line}", None, "d", 1)] * 25 + [(8, None, "en", "a", None), (9, "", None, None, 0)]
    rows += [(-i, f"\U0001f600 ß<{'PSM'[i % 3]}{'>' * (i % 2)} A&B " + "<" * i, ("", None)[i % 2], "e", i) for i in range(40)]
    rows += [(60 + i, " ".join(f"w{j}" for j in range(120)) + " X" * i, "en", "e", i) for i in range(30)] * 2
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, i % 2, (i // 2) % 2) for i in range(-20, 80)] + [(3, 0, None), (4, None, 1), (None, 1, 1), (500, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    found = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    df = QUERIES[name](spark, str(tmp_path))
    shape = lambda rows, names: Counter(tuple(str(r[names.index(c)]) for c in sorted(names)) for r in rows)
    assert shape(df.collect(), df.columns) == shape(found.fetchall(), columns)


CONTRACT = {
    "op1": "doc_id:bigint n_words:bigint word_chars:bigint n_symbols:bigint n_dup_lines:bigint n_repeat_words:bigint base_failed:boolean kept:boolean",
    "op2": "doc_id:bigint n_assign:bigint n_access:bigint n_hex:bigint base_sha256:string spans:string",
    "op4": "doc_id:bigint held_out:boolean lang_pred:string score:double",
    "op5": "doc_id:bigint size:bigint source_size:bigint target:double taken:bigint",
    "op6": "doc_id:bigint fingerprint:string component_id:bigint",
    "op7": "page_id:bigint url:string text:string n_chars:bigint",
    "op9": "query_id:bigint rank:int vec_id:bigint score:double",
    "op11": "part:string filter_order:string step:int kept:bigint removed:bigint redundant:bigint unique_fails:bigint good_lost:bigint toxic_lost:bigint shapley:bigint",
    "op12": "doc_id:bigint n_words:bigint n_base:bigint first_word:bigint last_word:bigint base_labels:string labels:string score:double",
    "op13": "doc_id:bigint n:bigint form:string prefix_chars:bigint middle_chars:bigint output_sha256:string restored_sha256:string",
}


@pytest.mark.parametrize("op", sorted(CONTRACT))
def test_contract(spark, small, op):
    name = next(n for n in QUERIES if n.startswith(f"{op}_"))
    kinds = dict(QUERIES[name](spark, small).dtypes)
    assert {c: kinds.get(c) for c in (x.split(":")[0] for x in CONTRACT[op].split())} == dict(x.split(":") for x in CONTRACT[op].split())


def test_languages_held_out(spark, small):
    import zlib

    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = QUERIES["op4_language_unigrams"](spark, small).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([docs[r["doc_id"]] == r["lang_pred"] for r in rows if r["held_out"]]) > 0.95


def test_main_text_is_the_article(spark, small):
    import html

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in QUERIES["op7_main_text_trees"](spark, small).collect():
        body = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        body = re.sub(r"</?[a-z][^>]*>", "", re.sub(r"</?(?:h1|p|br)\b[^>]*>", " ", body))
        assert r["text"] == " ".join(html.unescape(body).split()) and r["n_chars"] == len(r["text"])


def test_nearest_recall(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    ids, v = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=float)
    got = {}
    for r in QUERIES["op9_permutation_index"](spark, small).collect():
        got.setdefault(r["query_id"], []).append(r)
    recall = []
    for q in np.flatnonzero(ids % 20 == 0):
        scores = v @ v[q]
        best = [i for i in np.lexsort((ids, -scores)) if i != q][:20]
        recall.append(len({r["vec_id"] for r in got[ids[q]]} & set(ids[best])) / 20)
        assert sorted(r["rank"] for r in got[ids[q]]) == list(range(1, 21))
    assert np.mean(recall) >= 0.9


def test_pipeline_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, small).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.count() > 0
        if k < 4:
            assert docs.dtypes == spark.read.parquet(f"{small}/documents.parquet").dtypes
        if k == 2:
            from larkmill.llm.simhash import near_duplicates

            kept = {r["doc_id"] for r in docs.collect()}
            groups = near_duplicates(before).groupBy("component_id").agg(F.collect_set("doc_id").alias("ids")).collect()
            assert all(len(kept & set(g["ids"])) == 1 for g in groups)
        if k == 3:
            assert max(Counter(r["doc_id"] for r in docs.collect()).values()) <= 2
        if k == 4:
            sizes = {r["doc_id"]: len(WORD.findall(r["text"])) for r in before.collect()}
            copies = Counter(r["doc_id"] for r in before.collect())
            total = Counter()
            for r in docs.collect():
                total[r["doc_id"]] += r["size"]
            assert total == Counter({i: n * copies[i] for i, n in sizes.items()})


def test_pipeline_takes_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "the word and the other", "en", "a", 22), (3, "the word and more", None, "b", 17), (3, "the word and more", None, "b", 17)]
    for given in (rows, []):
        docs = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long")
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "unused")
        docs.collect()


def test_pipeline_takes_clashing_columns(spark, small):
    """Columns that bear names the stages use inside change nothing and don't come through."""
    plain = spark.read.parquet(f"{small}/documents.parquet")
    names = ("row", "k_id", "k_none", "k_th", "th", "h", "fp", "repeat", "copies", "rank", "lang_pred", "size", "cluster", "n")
    docs = plain.select("*", *[F.lit(k).alias(c) for k, c in enumerate(names)])
    for _, stage in corpus_pipeline.STAGES[:4]:
        own = stage(spark, docs, small)
        assert own.columns == plain.columns
        assert Counter(map(tuple, own.collect())) == Counter(map(tuple, stage(spark, plain, small).collect()))
    packed = corpus_pipeline.packing(spark, docs, small)
    assert Counter(map(tuple, packed.collect())) == Counter(map(tuple, corpus_pipeline.packing(spark, plain, small).collect()))


def test_near_dedup_keeps_one_row_of_each_group(spark):
    """Rows without an id, repeated rows and reused ids among the copies."""
    rnd = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rnd.integers(0, 10**6, 60)) for _ in range(7)]
    ids = [[None] * 3, [4, None, 4], [2, 2, 2], [None, 9, 8], [None], [5], [5, None]]
    rows = [(i, t, "en", "s", len(t)) for t, own in zip(texts, ids, strict=True) for i in own]
    rows += [(None, texts[0].upper(), "en", "s", 1), (1, texts[1].upper(), None, "s", 1), (2, texts[2].upper(), "de", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    left = corpus_pipeline.near_dedup(spark, docs, "unused").collect()
    assert sorted(r["text"].lower() for r in left) == sorted(texts)
    got = {r["text"].lower(): r["doc_id"] for r in left}
    assert [got[t] for t in texts] == [None, 1, 2, 8, None, 5, 5]
    assert all(tuple(r) in rows for r in left)


def test_language_stage_rejects_what_no_language_explains(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    foreign = [(10**6 + i, t, None, "a", len(t)) for i, t in enumerate(("幸福的家庭都是相似的 不幸的家庭", "1234 56", "the and of with"))]
    docs = docs.union(spark.createDataFrame(foreign, docs.schema))
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, small).collect()}
    want = {r["doc_id"] for r in docs.collect()} - {10**6, 10**6 + 1}
    assert kept == want


def test_pipeline_without_labels_keeps_documents(spark):
    rows = [(i, t, None, "a", 1) for i, t in enumerate(("the word and the other", "und noch ein Satz", "7 8", "", None))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    first = corpus_pipeline.language_id(spark, docs, "unused")
    assert first.count() == 5 and first.dtypes == docs.dtypes
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "unused")
    assert docs.count() > 0


def test_run(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 0
