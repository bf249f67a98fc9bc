"""Writing results: appends, parent with children, merges into a stored table, dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larkmill.session import cut_lineage


def append(df: DataFrame, path: str, *partition: str) -> None:
    df.write.mode("append").partitionBy(*partition).parquet(path)


def write_family(parents: DataFrame, children: DataFrame, key: str, path: str) -> None:
    """Parents and the children that have one, from plans that are computed once."""
    kept = cut_lineage(parents)
    kept.write.mode("append").parquet(f"{path}/parents")
    children.join(kept.select(key), key, "left_semi").write.mode("append").parquet(f"{path}/children")


def write_csv(df: DataFrame, path: str) -> StructType:
    """CSV with a header, for bulk loads; returns the schema to load it under."""
    df.write.option("header", True).csv(path)
    return df.schema


def replace(df: DataFrame, path: str) -> None:
    """Overwrites a table that ``df`` itself may be read from: the result is written beside it first."""
    cut_lineage(df).write.mode("overwrite").parquet(path)


def split_dead_letters(df: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the others with their content as JSON; a null verdict is a bad one."""
    ok = F.coalesce(valid, F.lit(False))
    dead = df.where(~ok).select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("payload"))
    return df.where(ok), dead
