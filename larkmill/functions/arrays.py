"""Nested values: dotted paths, merges and missing fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dotted(json_text: Column, path: str) -> Column:
    """The value at a dotted path of a JSON text, as text; null where it leads nowhere."""
    return F.try_variant_get(F.try_parse_json(json_text), "$." + path, "string")


def longer(a: Column, b: Column) -> Column:
    """The longer list; the first of equals."""
    size = lambda x: F.coalesce(F.size(x), F.lit(0))
    return F.when(size(b) > size(a), b).otherwise(a)


def first_filled(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def missing(fields: dict[str, Column]) -> Column:
    """Names of the empty ones, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(v.cast("string"), F.lit("")).isin("", "[]"), F.lit(k)) for k, v in fields.items()]))


def overlay(a: Column, b: Column) -> Column:
    """Map ``a`` with the entries of ``b`` over it."""
    only_a = F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k))
    return F.map_concat(only_a, b)
