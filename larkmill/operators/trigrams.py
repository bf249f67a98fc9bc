"""Similar names by trigrams: a threshold join with a prefix filter, verified exactly.

A name's trigrams are those of its words in lower case, two blanks before each and one after; the similarity of two names
is the share of common ones among all of theirs. Two names that are similar enough share one of the rarest trigrams of
each, so names meet at those alone; where they meet, sizes and the place of the trigram tell most pairs that can't be
similar enough, and the rest are compared. A pair that shares several of these is told at the first one only.

A search for some names meets all in shards instead, each with lists of its names by trigram.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkmill.functions.text import empty_if_null
from larkmill.session import cut_lineage


def trigrams(text: Column) -> Column:
    """The different trigrams of a text; one without a letter or digit has none."""
    words = F.regexp_extract_all(F.lower(empty_if_null(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    of_word = F.transform(
        words,
        lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))),
    )
    return F.array_distinct(F.flatten(of_word))


def packed(gram: Column) -> Column:
    """A trigram as a number, 21 bits for each of its characters: numbers are compared faster than strings."""
    code = lambda i: F.ascii(F.substring(gram, i, 1)).cast("long")
    return F.shiftleft(code(1), 42) + F.shiftleft(code(2), 21) + code(3)


def similarity(a: Column, b: Column) -> Column:
    """Of two arrays of trigrams; 0 if both are empty."""
    common = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - common
    return F.when(every > 0, common / every).otherwise(F.lit(0.0))


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The items of all lists, and how many each has."""
    held = column.combine_chunks()
    return held.flatten().to_numpy(zero_copy_only=False), held.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _common(names: pa.Table, asked: pa.Table, least: float) -> pa.Table:
    """What similar names a shard has for each that is asked for: its names are listed by trigram, and those on the lists
    of a name's trigrams are counted."""
    if not len(names) or not len(asked):
        return pa.table({"a": pa.array([], pa.string()), "b": pa.array([], pa.string()), "similarity": np.zeros(0)})
    grams, sizes = _flat(names["grams"])
    of_asked, asked_sizes = _flat(asked["a_grams"])
    words, word = np.unique(grams, return_inverse=True)
    owners = np.repeat(np.arange(len(sizes)), sizes)[np.argsort(word, kind="stable")]
    lists = np.searchsorted(np.sort(word), np.arange(len(words) + 1))
    at = np.searchsorted(words, of_asked)
    there = at < len(words)
    there[there] = words[at[there]] == of_asked[there]
    ends = asked_sizes.cumsum()
    left, right, score = [], [], []
    for i, (low, high) in enumerate(zip(ends - asked_sizes, ends, strict=True)):
        held = [owners[lists[k] : lists[k + 1]] for k in at[low:high][there[low:high]]]
        if not held:
            continue
        common = np.bincount(np.concatenate(held), minlength=len(sizes))
        near = np.flatnonzero(common * (1 + least) >= (sizes + asked_sizes[i]) * least - 1e-6)  # a little more; then exactly
        share = common[near] / (sizes[near] + asked_sizes[i] - common[near])
        kept = share >= least - 1e-12
        left.append(np.full(kept.sum(), i))
        right.append(near[kept])
        score.append(share[kept])
    every = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    found = pa.table({
        "a": asked["a_name"].take(pa.array(every(left, np.int64))), "b": names["name"].take(pa.array(every(right, np.int64))),
        "similarity": every(score, float),
    })
    return found.filter(pc.not_equal(found["a"], found["b"]))


def _searched(names: DataFrame, least: float, block_rows: int = 8192, shard_rows: int = 32_768) -> DataFrame:
    """Blocks of the names asked for meet shards of all names, so that no task's work follows how frequent a trigram is."""
    held = cut_lineage(names.select("name", "asked", F.transform(trigrams(F.col("name")), packed).alias("grams")).where(F.size("grams") > 0))
    blocks = max(1, -(-held.where("asked").count() // block_rows))
    shards = max(1, -(-held.count() // shard_rows))
    own = lambda n: F.pmod(F.xxhash64("name"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = held.select("name", "grams", own(shards).alias("shard"), every(blocks).alias("block"))
    right = held.where("asked").select(F.col("name").alias("a_name"), F.col("grams").alias("a_grams"), every(shards).alias("shard"), own(blocks).alias("block"))  # other names, as both sides are of one table
    by = ("shard", "block")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(lambda a, b: _common(a, b, least), "a string, b string, similarity double")


def similar_names(df: DataFrame, name: str, least: float, asked: Column | None = None) -> DataFrame:
    """(a, b, similarity) of different names with a similarity of at least ``least``, over 0: of all, with a < b, or of
    those of which a row is ``asked`` for, a, with all others. Equal names are one; null names, and those without
    trigrams, are similar to none.

    All with all, the work is that of the names that share one of their rarest trigrams, so it follows how long names are
    against how high ``least`` is: over many names of few syllables a low one makes most pairs meet. A search meets all
    names in shards, and counts what is in common there (``_searched``)."""
    if not 0 < least <= 1:
        raise ValueError("the least similarity lies above 0 and up to 1")
    wanted = F.lit(True) if asked is None else F.coalesce(asked, F.lit(False))
    names = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.bool_or(wanted).alias("asked"))
    if asked is not None:
        return _searched(names, least)
    grams = names.select("name", F.explode(F.transform(trigrams(F.col("name")), packed)).alias("gram"))
    counts = cut_lineage(grams.groupBy("gram").agg(F.count("*").alias("n"))).withColumnRenamed("gram", "c_gram")
    ranked = grams.join(counts, F.col("gram") == F.col("c_gram")).groupBy("name").agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("ranked"))
    size = F.size("ranked")
    # As many of the rarest as can't all be missing from a name that is similar enough.
    first = size - F.ceil(size * F.lit(least) - 1e-9).cast("int") + 1
    held = cut_lineage(ranked.select("name", F.transform("ranked", lambda r: r["gram"]).alias("grams"), F.transform(F.slice("ranked", 1, first), lambda r: r["gram"]).alias("rare")))
    posted = held.select("name", "grams", "rare", F.posexplode("rare").alias("place", "key"))
    side = lambda x: posted.select(F.col("key").alias(f"{x}_key"), *[F.col(c).alias(f"{x}_{c}") for c in ("name", "grams", "rare", "place")])
    small, large = F.least(F.size("a_grams"), F.size("b_grams")), F.greatest(F.size("a_grams"), F.size("b_grams"))
    total = F.size("a_grams") + F.size("b_grams")
    # What two names can still share from this trigram on, if it is the first that they share.
    rest = F.least(F.size("a_grams") - F.col("a_place"), F.size("b_grams") - F.col("b_place"))
    met = side("a").join(side("b"), (F.col("a_key") == F.col("b_key")) & (F.col("a_name") < F.col("b_name"))).where(
        (small >= least * large - 1e-9) & (rest >= total * least / (1 + least) - 1e-9)
    )
    # Both are in one order, the rarest first, and so is what they share.
    at_first = F.get(F.array_intersect("a_rare", "b_rare"), 0) == F.col("a_key")
    found = met.where(at_first).withColumn("similarity", similarity(F.col("a_grams"), F.col("b_grams")))
    return found.where(F.col("similarity") >= least - 1e-12).select(F.col("a_name").alias("a"), F.col("b_name").alias("b"), "similarity")
