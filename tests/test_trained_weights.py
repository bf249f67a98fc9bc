"""Logistic weights against Newton steps over all rows, and what is told of the scores against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkmill.operators import feedback as FB


def made(spark, n, seed=4):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        x = [rnd.gauss(0, 1 + k) for k in range(len(FB.FEATURES))]
        y = rnd.random() < 1 / (1 + np.exp(-(1.5 * x[0] - 0.5 * x[1] + 0.3 - 1)))
        rows.append((i, i % 7, *x, bool(y) if i % 11 else None))
    names = ", ".join(f"`{f}` double" for f in FB.FEATURES)
    return spark.createDataFrame(rows, f"job_id long, resume_id long, {names}, got_interview boolean")


def newton(x, y, c):
    """The minimum of the balanced loss with the squares of all weights but the last, by Newton's steps."""
    n, pos = len(y), y.sum()
    x = np.hstack([(x - x.mean(0)) / x.std(0), np.ones((n, 1))])
    own = np.where(y == 1, n / (2 * pos), n / (2 * (n - pos)))
    keep = np.diag([1.0] * (x.shape[1] - 1) + [0.0]) / (c * n)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        slope = x.T @ (own * (p - y)) / own.sum() + keep @ w
        w -= np.linalg.solve((x * (own * p * (1 - p))[:, None]).T @ x / own.sum() + keep, slope)
    return w


def test_weights_equal_newton(spark):
    df = made(spark, 600)
    split = F.pmod(F.xxhash64("job_id", "resume_id", F.lit(42)), F.lit(5))
    part = df.where(split != 0).where("got_interview IS NOT NULL").toPandas()
    model = FB.train(df)
    w = newton(part[list(FB.FEATURES)].to_numpy(float), part["got_interview"].to_numpy(float), 1.0)
    assert model.version == "logistic_v1"
    assert [model.weights[f] for f in FB.FEATURES] == pytest.approx(w[:-1], abs=2e-3)
    known = df.where("got_interview IS NOT NULL").select(model.score().alias("p"), "got_interview")
    told, rows = FB.evaluate(known, "p", "got_interview").first(), known.collect()
    good, bad = ([r["p"] for r in rows if r["got_interview"] is y] for y in (True, False))
    auc = sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))
    assert told["n"] == len(rows) and told["auc"] == pytest.approx(auc, abs=1e-6)
    assert told["accuracy"] == pytest.approx(sum((r["p"] >= 0.5) == r["got_interview"] for r in rows) / len(rows), abs=1e-6)


def test_few_rows_or_one_class_take_the_fixed_weights(spark):
    assert FB.train(made(spark, 60)).version == "heuristic_v1"
    assert FB.train(made(spark, 400).withColumn("got_interview", F.lit(True))).version == "heuristic_v1"
