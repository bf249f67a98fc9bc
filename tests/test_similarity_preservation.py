"""Rank correlation of similarities: pairs go through ranges, with ranks as of all pairs together."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkmill.operators.embedding import similarity_preservation


def ranks(x):
    _, own, n = np.unique(x, return_inverse=True, return_counts=True)
    return (n.cumsum() - (n - 1) / 2)[own]


def by_hand(old, new, asked):
    x, y = (np.round([v[i] @ v[j] for i in asked for j in range(len(v)) if j not in asked or i < j], 9) for v in (old, new))
    return round(float(np.corrcoef(ranks(x), ranks(y))[0, 1] + 1) / 2, 6), len(x)


def made(kind):
    rng = np.random.default_rng(5)
    old = rng.normal(size=(120, 4))
    if kind == "copies":  # most similarities are equal on one side, many on both
        old[30:] = old[30]
        new = np.where(rng.random((120, 4)) < 0.2, 1.0, old)
        new[70:] = new[70]
        return old, new
    return old, old + rng.normal(size=(120, 4)) * 0.3


@pytest.mark.parametrize("kind", ["spread", "copies"])
@pytest.mark.parametrize("range_pairs", [40, 1 << 22])
def test_ranks_over_many_ranges_are_those_of_all_pairs(spark, kind, range_pairs):
    old, new = made(kind)
    rows = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(old, new, strict=True))], "i long, a array<double>, b array<double>")
    found = similarity_preservation(rows, "i", "a", "b", F.col("i") % 9 == 0, range_pairs=range_pairs).first()
    assert (found["compatibility"], found["pairs"]) == by_hand(old, new, range(0, 120, 9))


def test_few_pairs_and_equal_similarities(spark):
    rows = lambda n: spark.range(n).select(F.col("id").alias("i"), F.array(F.lit(1.0)).alias("a"), F.array(F.lit(2.0)).alias("b"))
    assert tuple(similarity_preservation(rows(5), "i", "a", "b", F.col("i") >= 0).first()) == (0.5, 10)
    assert tuple(similarity_preservation(rows(20), "i", "a", "b", F.col("i") >= 0, range_pairs=20).first()) == (0.0, 190)
    assert tuple(similarity_preservation(rows(5), "i", "a", "b", F.col("i") > 9).first()) == (0.5, 0)


def shuffled(spark):
    executors = spark._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))


def test_no_pair_is_shuffled(spark):
    rng = np.random.default_rng(7)
    old = rng.normal(size=(3000, 4))
    new = old + rng.normal(size=(3000, 4)) * 0.3
    rows = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(old, new, strict=True))], "i long, a array<double>, b array<double>")
    before = shuffled(spark)
    found = similarity_preservation(rows, "i", "a", "b", F.col("i") % 5 == 0, range_pairs=1 << 17).first()
    assert (found["compatibility"], found["pairs"]) == by_hand(old, new, range(0, 3000, 5))
    assert shuffled(spark) - before < 6 * found["pairs"]  # 1.6 million pairs; the counts of classes are as many as ever


@pytest.mark.parametrize("kind", ["spread", "copies"])
def test_ranges_keep_pairs_or_counts_of_codes(spark, kind, monkeypatch):
    """Short vectors have few codes, which are counted; where similarities have no bound, all pairs are shuffled."""
    from larkmill.operators import embedding

    old, new = made(kind)
    table = lambda u, v: spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(u, v, strict=True))], "i long, a array<double>, b array<double>")
    told = []
    shuffle = embedding._preserved_by_shuffle
    monkeypatch.setattr(embedding, "_preserved_by_shuffle", lambda *of: told.append(1) or shuffle(*of))
    for scale, by_shuffle in ((1e-4, 0), (1, 0), (1e4, 1)):
        told.clear()
        found = similarity_preservation(table(old * scale, new * scale), "i", "a", "b", F.col("i") % 9 == 0, range_pairs=40).first()
        assert (found["compatibility"], found["pairs"]) == by_hand(old * scale, new * scale, range(0, 120, 9))
        assert len(told) == by_shuffle


def test_rows_without_numbers_rank_last(spark):
    old, new = made("spread")
    old[3, 1], new[7, 2] = np.nan, np.inf
    rows = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(old, new, strict=True))], "i long, a array<double>, b array<double>")
    found = similarity_preservation(rows, "i", "a", "b", F.col("i") % 9 == 0, range_pairs=40).first()
    order = lambda x: np.nan_to_num(x, nan=1e12, posinf=1e11, neginf=-1e11)
    x, y = (order(np.round([v[i] @ v[j] for i in range(0, 120, 9) for j in range(120) if j % 9 or i < j], 9)) for v in (old, new))
    assert (found["compatibility"], found["pairs"]) == (round(float(np.corrcoef(ranks(x), ranks(y))[0, 1] + 1) / 2, 6), len(x))
