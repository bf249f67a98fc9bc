"""A Python data source of paged JSON: every page is a partition. Pages come from files of any store that Arrow can
open, so no network is needed."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class PagedReader(DataSourceReader):
    """Options: path (a pattern with {page}), pages (how many at most), key (where the list is), skip_missing."""

    def __init__(self, options: dict):
        self.pattern = options["path"]
        self.pages = int(options.get("pages", 1))
        self.key = options.get("key", "results")
        self.skip_missing = options.get("skip_missing", "true") == "true"

    def partitions(self) -> list[Page]:
        return [Page(n) for n in range(self.pages)]

    def read(self, partition: Page) -> Iterator[tuple]:
        try:
            where = self.pattern.format(page=partition.number)
            files, path = fs.FileSystem.from_uri(where) if ":" in where else (fs.LocalFileSystem(), where)
            with files.open_input_stream(path) as file:
                body = json.loads(file.read())
        except FileNotFoundError:
            if self.skip_missing:  # past the last page
                return
            raise
        rows = body.get(self.key, []) if isinstance(body, dict) else body
        for position, row in enumerate(rows):
            yield partition.number, position, json.dumps(row, sort_keys=True)


class PagedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "page int, position int, value string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


def read_paged(spark, path: str, pages: int, key: str = "results"):
    spark.dataSource.register(PagedJson)
    return spark.read.format("paged_json").options(path=path, pages=pages, key=key).load()
