"""Sizes of Arrow batches that carry whole texts, and of partitions that are written to be read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkmill.session import ship

RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Lowers the session's Arrow batches to ``rows`` records and ``size`` bytes, if they are larger: the default of
    10,000 records may be gigabytes of long texts. Spark reads both when a query starts. Also sends the package."""
    ship(spark)
    for name, most in ((RECORDS, rows), (BYTES, size)):
        said = spark.conf.get(name).lower().removesuffix("b")
        now = int(said) if said.isdigit() else 0  # a size with a larger unit
        if not 0 < now <= most:
            spark.conf.set(name, str(most))


def gathered(df: DataFrame, rows: int, per_part: int) -> DataFrame:
    """``df``, of known size, in no more partitions than it takes: a small table isn't written as hundreds of files."""
    return df.coalesce(max(1, -(-rows // per_part)))
