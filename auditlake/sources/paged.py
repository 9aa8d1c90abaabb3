"""A paged listing as a Python data source: pages are read until one is short."""

from __future__ import annotations

import importlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class PagedListing(DataSource):
    """``spark.read.format("paged").option("fetch", "module:function").option("lists", "a,b").load()``.

    The function (list, page, size) gives a page's rows as tuples (path, status, patch); each list is one partition. ``size``: rows a page.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "list string, path string, status string, patch string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.fetch, self.size = options["fetch"], int(options.get("size", "100"))
        self.lists = [x for x in options.get("lists", "").split(",") if x]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(x) for x in self.lists]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        module, _, function = self.fetch.partition(":")
        fetch = getattr(importlib.import_module(module), function)
        page = 1
        while True:
            rows = fetch(partition.value, page, self.size)
            for r in rows:
                yield (partition.value, *r)
            if len(rows) < self.size:
                return
            page += 1
