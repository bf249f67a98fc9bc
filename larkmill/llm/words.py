"""Native word and row expressions shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def words(text: Column) -> Column:
    """The words of a text in order; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, though ``body`` uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def counted(items: DataFrame, keys: list[str], number: str, run: int = 65_536) -> DataFrame:
    """The rows of ``items``, which are equal where ``keys`` are, with their number among equal ones from 0.

    Equal rows are counted, not gathered; runs of numbers are dealt out before they are spelt out.
    """
    groups = items.groupBy(*keys).agg(F.count("*").alias("_n"))
    runs = groups.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / run))).alias("_run"))
    dealt = runs.repartition(*keys, "_run")
    first = F.col("_run") * run
    return dealt.select(*keys, F.explode(F.sequence(first, F.least(first + run, F.col("_n")) - 1)).alias(number))


def different_rows(df: DataFrame) -> DataFrame:
    """(row, hash, n): each different row of ``df`` once, a hash of it, and how often it is there. Equal rows are counted
    before they are dealt out. Columns that can't be compared are compared by their JSON."""
    kinds = [(c, "map<" in kind or "variant" in kind) for c, kind in df.dtypes]
    odd = {f"_j{i}": F.to_json(F.struct(F.col(f"`{c}`"))) for i, (c, other) in enumerate(kinds) if other}
    own = [f"`{c}`" for c, other in kinds if not other] + list(odd)
    grouped = df.withColumns(odd).groupBy(*own).agg(
        F.count("*").alias("_n"), *[F.any_value(F.col(f"`{c}`")).alias(c) for c, other in kinds if other]
    )
    return grouped.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.xxhash64(*own).alias("hash"), F.col("_n").alias("n")
    )
