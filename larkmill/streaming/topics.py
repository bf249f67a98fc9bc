"""Keyed topics in a folder: a stream writer with commits, and readers of what is committed, as a Python data source.

Every task of a micro-batch writes a file of its own; the batch's commit names its files in one small file, under the
writer's name and the batch's number. Files without a commit are no messages, and a batch that is committed already is
dropped when it comes again, so a failed task or a restart neither repeats nor loses a message. Messages of one key lie
in one partition of the topic, in order. A reader's offset is the last batch of each writer; each committed file is a
partition of the read. Folders may be in any store that Arrow can open.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage,
)

from larkmill.session import ship

MESSAGE = "partition int, key string, value string"
READ = f"writer string, batch long, {MESSAGE}, position long"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


class Topic:
    """A topic's folder: ``messages`` holds files, ``commits`` what counts."""

    def __init__(self, path: str):
        self.files, self.path = _opened(path)

    def commit_name(self, writer: str, batch: int) -> str:
        return f"{self.path}/commits/{writer}/{batch:020d}.json"

    def exists(self, path: str) -> bool:
        return self.files.get_file_info(path).type != fs.FileType.NotFound

    def remove(self, names: list[str]) -> None:
        for name in names:
            if self.exists(f"{self.path}/messages/{name}"):
                self.files.delete_file(f"{self.path}/messages/{name}")

    def commit(self, writer: str, batch: int, names: list[str]) -> bool:
        """Whether the batch wasn't committed before."""
        if self.exists(self.commit_name(writer, batch)):
            self.remove(names)
            return False
        self.files.create_dir(f"{self.path}/commits/{writer}", recursive=True)
        beside = f"{self.path}/commits/{writer}/.{uuid.uuid4().hex}"
        with self.files.open_output_stream(beside) as out:
            out.write(json.dumps(names).encode())
        self.files.move(beside, self.commit_name(writer, batch))
        return True

    def latest(self) -> dict[str, int]:
        """The last committed batch of each writer."""
        if not self.exists(f"{self.path}/commits"):
            return {}
        found: dict[str, int] = {}
        for info in self.files.get_file_info(fs.FileSelector(f"{self.path}/commits", recursive=True)):
            if info.path.endswith(".json"):
                writer, name = info.path.rsplit("/", 2)[1:]
                found[writer] = max(found.get(writer, -1), int(name.removesuffix(".json")))
        return found

    def committed(self, after: dict[str, int], to: dict[str, int]) -> list[tuple[str, int, str]]:
        """(writer, batch, file) of the batches behind ``after`` up to ``to``. Batches without rows have no file."""
        out = []
        for writer, last in sorted(to.items()):
            for batch in range(after.get(writer, -1) + 1, last + 1):
                if self.exists(self.commit_name(writer, batch)):
                    with self.files.open_input_stream(self.commit_name(writer, batch)) as file:
                        out += [(writer, batch, name) for name in json.loads(file.read())]
        return out


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class TopicWriter(DataSourceStreamArrowWriter):
    """A task puts its rows of one micro-batch, which the files for each trigger bound, in order before it writes them, as
    Spark sorts no streams."""

    def __init__(self, options: dict):
        self.path, self.writer = options["path"], options["writer"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        topic, name = Topic(self.path), f"{uuid.uuid4().hex}.parquet"
        batches = [batch for batch in iterator if len(batch)]
        if not batches:
            return Written([])
        topic.files.create_dir(f"{topic.path}/messages", recursive=True)
        whole = pa.Table.from_batches(batches)
        order = [c for c in whole.column_names if c.startswith("_order")]
        ranked = whole.sort_by([(c, "ascending") for c in ("partition", *order)]).drop_columns(order)
        pq.write_table(ranked, f"{topic.path}/messages/{name}", filesystem=topic.files)
        return Written([name])

    def _names(self, messages: list[Written | None]) -> list[str]:
        return [name for m in messages if m is not None for name in m.names]

    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        Topic(self.path).commit(self.writer, batchId, self._names(messages))

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        Topic(self.path).remove(self._names(messages))


class MessageFile(InputPartition):
    def __init__(self, writer: str, batch: int, name: str):
        self.writer, self.batch, self.name = writer, batch, name


def _messages(path: str, part: MessageFile) -> Iterator[pa.RecordBatch]:
    topic, at = Topic(path), 0
    with topic.files.open_input_file(f"{topic.path}/messages/{part.name}") as file:
        for batch in pq.ParquetFile(file).iter_batches(10_000):
            n = len(batch)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part.writer] * n, pa.string()), pa.array([part.batch] * n, pa.int64()), *[batch.column(c) for c in ("partition", "key", "value")], pa.array(range(at, at + n), pa.int64())],
                ["writer", "batch", "partition", "key", "value", "position"],
            )
            at += n


class TopicStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return Topic(self.path).latest()

    def partitions(self, start: dict, end: dict) -> list[MessageFile]:
        return [MessageFile(*x) for x in Topic(self.path).committed(start, end)]

    def read(self, partition: MessageFile) -> Iterator[pa.RecordBatch]:
        return _messages(self.path, partition)


class TopicReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[MessageFile]:
        topic = Topic(self.path)
        return [MessageFile(*x) for x in topic.committed({}, topic.latest())]

    def read(self, partition: MessageFile) -> Iterator[pa.RecordBatch]:
        return _messages(self.path, partition) if partition is not None else iter(())


class TopicSource(DataSource):
    """Options: path (the topic's folder) and, to write, writer (a name that outlives restarts)."""

    @classmethod
    def name(cls) -> str:
        return "topic"

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> TopicReader:
        return TopicReader(self.options)

    def streamReader(self, schema) -> TopicStreamReader:  # noqa: N802
        return TopicStreamReader(self.options)

    def streamWriter(self, schema, overwrite: bool) -> TopicWriter:  # noqa: N802
        return TopicWriter(self.options)


def _registered(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(TopicSource)


def keyed(df: DataFrame, key: Column, value: Column, order: list[str], partitions: int = 4) -> DataFrame:
    """Messages of ``df``: those of one key in one partition, in order."""
    named = df.withColumns({"_key": key.cast("string"), "_value": value})
    placed = named.withColumn("_partition", F.pmod(F.xxhash64("_key"), F.lit(partitions)).cast("int"))
    by = [F.col(c).alias(f"_order{i}") for i, c in enumerate(order)]
    dealt = placed.repartition(partitions, "_partition")
    return dealt.select(F.col("_partition").alias("partition"), F.col("_key").alias("key"), F.col("_value").alias("value"), *by)


def publish(messages: DataFrame, path: str, writer: str, checkpoint: str) -> None:
    """Publishes a stream of messages, all there is now."""
    _registered(messages.sparkSession)
    out = messages.writeStream.format("topic").option("path", path).option("writer", writer).option("checkpointLocation", checkpoint)
    out.trigger(availableNow=True).start().awaitTermination()


def publish_or_bury(events: DataFrame, valid: Column, key: Column, order: list[str], path: str, checkpoint: str, partitions: int = 4) -> None:
    """Publishes valid events as JSON to ``path``/live, the others, keyed alike, to ``path``/dead, whole and with their
    key, so that they can be published again when they are mended. A null verdict is a bad one."""
    ok = F.coalesce(valid, F.lit(False))
    whole = F.to_json(F.struct(*[F.col(c) for c in events.columns]))
    for name, which in (("live", ok), ("dead", ~ok)):
        publish(keyed(events.where(which), key, whole, order, partitions), f"{path}/{name}", "publisher", f"{checkpoint}/{name}")


def subscribe(spark: SparkSession, path: str) -> DataFrame:
    """The messages of a topic as a stream."""
    _registered(spark)
    return spark.readStream.format("topic").option("path", path).load()


def read_topic(spark: SparkSession, path: str) -> DataFrame:
    """All committed messages of a topic."""
    _registered(spark)
    return spark.read.format("topic").option("path", path).load()
