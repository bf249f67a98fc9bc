"""JSON in texts: lenient recovery, and schema checks over rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from larkmill.config import schema_errors


def first_object(text: str) -> str | None:
    """The first stretch of balanced braces that is JSON. Braces are counted as they stand, in strings too."""
    begin = text.find("{")
    depth = 0
    for i in range(begin, len(text)) if begin >= 0 else ():
        depth += (text[i] == "{") - (text[i] == "}")
        if depth == 0 and text[i] == "}":
            part = text[begin : i + 1]
            try:
                json.loads(part)
            except ValueError:
                continue
            return part
    return None


def _objects(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: first_object(t) if isinstance(t, str) else None)


def recover_json(text: Column) -> Column:
    """JSON text of an answer: all of it, a fenced block, or the first balanced object; null if there is none."""
    is_json = lambda x: F.try_parse_json(x).isNotNull()
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    whole, fenced = strip(text), strip(F.regexp_extract(text, r"(?s)```json(.*?)```", 1))
    # Only what neither way reads goes to Python.
    hard = F.when(~is_json(whole) & ~((fenced != "") & is_json(fenced)), text)
    balanced = F.pandas_udf(_objects, StringType())(hard)
    return F.when(is_json(whole), whole).when((fenced != "") & is_json(fenced), fenced).otherwise(balanced)


def schema_violations(df: DataFrame, key: str, body: str, schema: dict) -> DataFrame:
    """(key, violation) of JSON documents that break a schema, or can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, text in zip(batch["k"], batch["b"], strict=True):
                try:
                    found = schema_errors(json.loads(text), schema)
                except (ValueError, TypeError):
                    found = ["$: not JSON"]
                rows += [(name, x) for x in found]
            yield pd.DataFrame(rows, columns=[key, "violation"])

    slim = df.select(F.col(key).cast("string").alias("k"), F.col(body).alias("b"))
    return slim.mapInPandas(run, f"{key} string, violation string")
