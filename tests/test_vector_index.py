"""The stored vector index against all pairs: recall, rows added later, dense lists, odd vectors."""

import numpy as np
import pytest

from larkmill.operators.vector_index import VectorIndex, VectorRules, fitted


def grouped(rnd, n, size=16, groups=40):
    centres = rnd.normal(size=(groups, size))
    weight = np.r_[0.4, np.full(groups - 1, 0.6 / (groups - 1))]  # one group holds 40 % of all rows
    return centres[rnd.choice(groups, n, p=weight)] + 0.3 * rnd.normal(size=(n, size))


def recall(index, asked, v, ids, k=20, **how):
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = {}
    for r in index.search(asked, "id", "v", k, **how).collect():
        got.setdefault(r["query_id"], []).append(r)
    found = []
    for q, rows in got.items():
        scores = unit @ unit[list(ids).index(q)]
        best = set(np.array(ids)[np.lexsort((ids, -scores.round(12)))[:k]].tolist())
        found.append(len(best & {r["base_id"] for r in rows}) / k)
        assert sorted(r["rank"] for r in rows) == list(range(1, k + 1))
        assert all(r["score"] == pytest.approx(scores[list(ids).index(r["base_id"])], abs=1e-5) for r in rows)
    return np.mean(found), len(got)


def test_recall_with_rows_added_later(spark, tmp_path):
    rnd = np.random.default_rng(1)
    v = grouped(rnd, 6000).astype(np.float32)
    ids = np.arange(6000)
    odd = [(9001, None), (9002, [0.0] * 16), (9003, [1.0] * 5), (9004, [float("nan")] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + odd, "id long, v array<float>")
    rules = VectorRules(shard_rows=100)
    index = VectorIndex(spark, f"{tmp_path}/i", rules)
    assert index.search(df, "id", "v", 5).count() == 0
    index.add(df.where("id % 3 = 0 or id > 9000"), "id", "v")
    model = index.log.latest()[1]["model"]
    again = VectorIndex(spark, f"{tmp_path}/i", rules)
    again.add(df.union(df.where("id = 1")), "id", "v")
    again.add(df, "id", "v")  # all are there
    state = again.log.latest()[1]
    assert state["model"] == model and len(state["generations"]) == 2 and sum(state["counts"].values()) == 6000
    assert max(state["counts"].values()) > 2 * rules.shard_rows  # a dense list is several tasks' work
    assert state["probes"] < len(again.model().centres)
    asked = df.where("id % 40 = 0 or id > 9000 or id is null")
    found, n = recall(again, asked, v.astype(float), ids)
    assert n == 150 and found >= 0.95
    found, _ = recall(again, asked, v.astype(float), ids, probes=10_000)
    assert found >= 0.97


def test_a_search_reads_the_probed_lists_only(spark, tmp_path):
    rnd = np.random.default_rng(2)
    v = grouped(rnd, 2000)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<float>")
    index = VectorIndex(spark, f"{tmp_path}/i")
    index.add(df, "id", "v")
    state = index.log.latest()[1]
    plan = index.rows(state, {3}).select("id", "codes")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "(bucket#" in plan and " = 3)" in plan
    assert "v:array" not in plan.split("ReadSchema")[-1].split("\n")[0]


def test_codes_estimate_products():
    rnd = np.random.default_rng(3)
    v = grouped(rnd, 3000, size=17)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    model = fitted(v, 30, VectorRules())
    lists, codes = model.coded(v)
    assert codes.shape == (3000, 9)  # 17 components in parts of two
    q = v[7]
    about = (q @ model.centres.T)[lists] + model.estimates(q, codes)
    assert np.abs(about - v @ q).mean() < 0.02


def test_test_vectors(spark, small):
    from larkmill.plans.catalog import QUERIES

    rows = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    ids, v = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=float)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = {}
    for r in QUERIES["vector_index_top_k"](spark, small).collect():
        got.setdefault(r["query_id"], set()).add(r["base_id"])
    asked = [i for i in ids if i % 50 == 0]
    assert set(got) == set(asked)
    near = [set(ids[np.lexsort((ids, -(unit @ unit[list(ids).index(q)]).round(12)))[:20]].tolist()) for q in asked]
    assert np.mean([len(got[q] & best) / 20 for q, best in zip(asked, near, strict=True)]) >= 0.9


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_exact_search_both_ways(spark, metric):
    """Few queries against a scan, and more in blocks against shards, with ties and null vectors."""
    from larkmill.operators.retrieval import nearest_exact

    rnd = np.random.default_rng(5)
    v = rnd.integers(-2, 3, size=(400, 4)).astype(float)
    v[(v == 0).all(axis=1)] = 1.0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None)], "id long, v array<double>").repartition(5)
    asked = df.where("id % 20 = 0")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = set()
    for q in range(0, 400, 20):
        scores = unit @ unit[q] if metric == "cosine" else -np.linalg.norm(v - v[q], axis=1)
        want |= {(q, r + 1, int(i)) for r, i in enumerate(np.lexsort((np.arange(400), -scores.round(12)))[:7])}
    for how in ({}, {"block_rows": 6, "shard_rows": 90}):
        got = {(r["query_id"], r["rank"], r["base_id"]) for r in nearest_exact(asked, "id", "v", df, "id", "v", 7, metric, **how).collect()}
        assert got == want
    assert nearest_exact(asked.limit(0), "id", "v", df, "id", "v", 7).count() == 0
    assert nearest_exact(asked, "id", "v", df.limit(0), "id", "v", 7).count() == 0
