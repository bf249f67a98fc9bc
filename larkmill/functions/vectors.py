"""Vector expressions in double precision, and the deterministic embedders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_double(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 where the lengths differ or a norm is zero."""
    scale = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (scale > 0), dot(a, b) / scale).otherwise(0.0)


def l2(a: Column, b: Column) -> Column:
    gap = F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x))


def hash_embedding(text: Column, dimensions: int = 1536) -> Column:
    """Eight numbers in [-1, 1) from the SHA-256 of the text, then zeros."""
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)
    head = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("double") / float(16**8) * 2 - 1 for i in range(8)]
    return F.concat(F.array(*head), F.array_repeat(F.lit(0.0), dimensions - 8))


def char_embedding(text: Column, dimensions: int = 384) -> Column:
    """Code of each of the first characters modulo 256, over 256, padded with zeros."""
    codes = F.transform(F.split(F.substring(text, 1, dimensions), ""), lambda c: (F.ascii(c) % 256) / 256.0)
    codes = F.when(F.length(text) > 0, codes).otherwise(F.array().cast("array<double>"))
    return F.slice(F.concat(codes, F.array_repeat(F.lit(0.0), dimensions)), 1, dimensions)


def token_cost(tokens: Column, per_thousand: float) -> Column:
    return tokens / 1000 * per_thousand
