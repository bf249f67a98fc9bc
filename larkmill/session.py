"""Session helpers: building a session, reading tables, cutting lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def build_session(app: str = "larkmill", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine expects; on a cluster, use the cluster's own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LARKMILL_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application: their Python workers import from it.

    Spark copies the archive itself, so no folder has to be shared for it.
    """
    context, root = spark.sparkContext, Path(__file__).resolve().parent
    if context.applicationId in _SHIPPED or not root.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="larkmill-")) / "larkmill.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir`` (any path Spark can read), for work by the row ``spread``."""
    ship(spark)
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread_rows(found) if spread else found


def spread_rows(df: DataFrame) -> DataFrame:
    """A table no larger than one partition of a scan may lie in a single row group, which one task reads while all
    other cores wait. Its rows are dealt to all cores before work that takes long for each; a larger table is left."""
    spark = df.sparkSession
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    most = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(spark.sparkContext.defaultParallelism) if size <= most else df


def removed_at_exit(spark: SparkSession, path: str) -> str:
    """Makes the folder ``path``, which goes when the application ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Removes a file or folder with all in it, if it is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``. Where none is named, a temporary one serves a session
    in one process; a cluster must name one."""
    ship(spark)
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = removed_at_exit(spark, tempfile.mkdtemp(prefix="larkmill-checkpoint-"))
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, removed when the application ends."""
    return removed_at_exit(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")


def bound_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Lowers the session's Arrow batches to ``rows`` records and ``size`` bytes, if they are larger, for work on whole
    texts. Spark reads both when a query starts."""
    ship(spark)
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        said = spark.conf.get(name).lower().removesuffix("b")
        now = int(said) if said.isdigit() else 0  # a size with a larger unit
        if not 0 < now <= most:
            spark.conf.set(name, str(most))


def small_or_not(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df`` of narrow rows, marked for broadcast if a count finds no more than ``rows``; for tables already cut."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back, so that later plans start there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
