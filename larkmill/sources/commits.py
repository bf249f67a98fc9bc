"""A table's commits: numbered files in the shared folder that say what the table consists of."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from larkmill.session import remove


class CommitConflict(RuntimeError):
    """Another writer has committed since the state was read."""


class CommitLog:
    """The states of a table below ``path``, a JSON file each, by number.

    Data files are written first, under names of their own; the commit that names them is written beside the log and
    renamed to its number, which fails if that number is there. So readers see all of a commit or nothing, of two
    writers one has to read again, and a session that dies leaves the last good state, which the next one reads.
    The last ``keep`` states stay.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 20):
        self.spark, self.path, self.keep = spark, path, keep
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._folder = hadoop.Path(f"{path}/_log")
        conf = spark._jsc.hadoopConfiguration()
        self._files = self._folder.getFileSystem(conf)
        self._context = hadoop.FileContext.getFileContext(self._folder.toUri(), conf)

    def _place(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_log/{name}")

    def numbers(self) -> list[int]:
        """The numbers of the states that are kept, in order."""
        if not self._files.exists(self._folder):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._folder)]
        return sorted(int(x.removesuffix(".json")) for x in names if x.endswith(".json"))

    def read(self, number: int) -> dict:
        stream = self._files.open(self._place(f"{number:020d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict]:
        """The number of the newest state and the state; 0 and nothing before the first commit."""
        found = self.numbers()
        return (found[-1], self.read(found[-1])) if found else (0, {})

    def commit(self, after: int, state: dict) -> int:
        """Writes the state that follows number ``after``; CommitConflict if there is one already."""
        number, beside = after + 1, self._place(f".{uuid.uuid4().hex}.tmp")
        out = self._files.create(beside, True)
        out.write(json.dumps(state, sort_keys=True).encode())
        out.close()
        jvm = self.spark._jvm
        never = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        never[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            self._context.rename(beside, self._place(f"{number:020d}.json"), never)
        except Exception as error:
            self._files.delete(beside, False)
            if number in self.numbers():
                raise CommitConflict(f"{self.path} has a commit {number} already") from error
            raise
        for old in self.numbers()[: -self.keep]:
            remove(self.spark, f"{self.path}/_log/{old:020d}.json")
        return number

    def update(self, change: Callable[[dict], dict | None], tries: int = 20) -> tuple[int, dict]:
        """Commits ``change(state)``, from the newest state again where another writer comes first. None changes nothing.
        Only for changes that hold whatever the other writer did, such as adding a file."""
        for _ in range(tries):
            number, state = self.latest()
            new = change(state)
            if new is None:
                return number, state
            try:
                return self.commit(number, new), new
            except CommitConflict:
                continue
        raise CommitConflict(f"no commit to {self.path} in {tries} tries")
