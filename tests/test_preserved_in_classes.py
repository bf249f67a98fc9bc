"""Rank correlation by classes against one over all pairs, within the error that it tells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkmill.operators.embedding import preserved_in_classes

SCHEMA = "id long, a array<double>, b array<double>"


def mean_ranks(values):
    _, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
    return (counts.cumsum() - (counts - 1) / 2)[inverse]


def exact(rows, every):
    """The score of the rank correlation over the pairs of each ``every``-th row with all others, each pair once."""
    x, y = [], []
    for i, a, b in rows:
        for j, c, d in rows:
            if i % every == 0 and i != j and (j % every or i < j):
                x.append(np.dot(a, c))
                y.append(np.dot(b, d))
    return (np.corrcoef(mean_ranks(np.array(x)), mean_ranks(np.array(y)))[0, 1] + 1) / 2, len(x)


def made(n, noise, seed=1):
    rnd = np.random.default_rng(seed)
    a = rnd.normal(size=(n, 6))
    b = np.hstack([a, rnd.normal(size=(n, 3)) * noise])  # the new version has more dimensions
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    return [(i, p.tolist(), q.tolist()) for i, (p, q) in enumerate(zip(unit(a), unit(b), strict=True))]


def told(spark, rows, every, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return preserved_in_classes(df, "id", "a", "b", F.col("id") % every == 0, **more).first()


@pytest.mark.parametrize("noise", [0.1, 1.0, 4.0])
@pytest.mark.parametrize("classes", [16, 512, 65_536])
def test_lies_within_its_error(spark, noise, classes):
    rows = made(120, noise)
    want, pairs = exact(rows, 5)
    got = told(spark, rows, 5, classes=classes)
    assert got["pairs"] == pairs and abs(got["compatibility"] - want) <= got["error"] + 1e-6
    if classes == 65_536:
        assert got["error"] < 0.05 and abs(got["compatibility"] - want) < 1e-4


def test_ties_count_as_one_class(spark):
    """Two directions only: the similarities are 1 or 0, told without loss."""
    rows = [(i, [1.0, 0.0] if i % 3 else [0.0, 1.0], [1.0, 0.0] if i % 4 else [0.0, 1.0]) for i in range(40)]
    got = told(spark, rows, 4)
    want, pairs = exact(rows, 4)
    assert got["pairs"] == pairs and got["compatibility"] == pytest.approx(want, abs=1e-6)


def test_odd_rows_take_no_part(spark):
    rows = made(60, 1.0)
    odd = [(None, *rows[0][1:]), (100, None, rows[0][2]), (105, [1.0] * 6, None), (110, [1.0] * 5, [1.0] * 9), (115, [None] * 6, [1.0] * 9)]
    odd += [(120, [float("nan")] * 6, [1.0] * 9), (125, [1.0] * 6, [float("inf")] * 9), (130, [], [])]
    assert told(spark, rows + odd, 5) == told(spark, rows, 5)


def test_too_few_or_all_alike(spark):
    for rows in ([], made(3, 1.0), [(0, None, None)]):
        assert told(spark, rows, 1)["compatibility"] == 0.5
    alike = told(spark, [(i, [1.0], [1.0]) for i in range(20)], 1)
    assert (alike["compatibility"], alike["pairs"], alike["error"]) == (0.5, 190, 0.5)
    with pytest.raises(ValueError):
        told(spark, [], 1, classes=1)


def test_values_beyond_the_reach(spark):
    """All lie in the outer classes; the error owns up to what that hides."""
    rows = [(i, (np.array(a) * 9).tolist(), b) for i, a, b in made(60, 1.0)]
    want, _ = exact(rows, 5)
    got = told(spark, rows, 5)
    assert abs(got["compatibility"] - want) <= got["error"]
