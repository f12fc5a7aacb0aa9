"""A paged API as a Spark data source.

The user gives ``fetch(context) -> (rows, has_more)``. Each slice (for example one day, or one account) is a
task that pages on its own; a lost executor costs one slice, which is fetched again.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Slice(InputPartition):
    def __init__(self, name: str):
        self.name = name


def paged_source(name: str, schema: str, fetch, columns: list[str]) -> type[DataSource]:
    """A data source class whose rows come from ``fetch``.

    Options: ``slices`` (JSON list of names), ``since`` (passed on), ``seconds`` (time budget per slice).
    ``fetch`` gets ``{"slice", "since", "page"}`` and may keep its own position in that dict.
    """

    class PagedReader(DataSourceReader):
        def __init__(self, options):
            self.slices = json.loads(options.get("slices", '["all"]'))
            self.since = options.get("since")
            self.seconds = float(options.get("seconds", "inf"))

        def partitions(self):
            return [Slice(s) for s in self.slices]

        def read(self, partition):
            context = {"slice": partition.name, "since": self.since, "page": 0}
            started = time.monotonic()
            while True:
                rows, has_more = fetch(context)
                for row in rows:
                    yield tuple(row.get(c) for c in columns)
                if not has_more:
                    return
                if time.monotonic() - started > self.seconds:
                    raise TimeoutError(f"slice {partition.name} did not finish in {self.seconds} s")
                context["page"] += 1

    class PagedSource(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return PagedReader(self.options)

    return PagedSource


class SourceRegistry:
    """Sources by name. Hidden ones can be read but are not listed."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._hidden: dict[str, bool] = {}

    def register(self, source: type[DataSource], hidden: bool = False) -> None:
        self.spark.dataSource.register(source)
        self._hidden[source.name()] = hidden

    def names(self) -> list[str]:
        return sorted(n for n, hidden in self._hidden.items() if not hidden)

    def read(self, name: str, **options):
        if name not in self._hidden:
            raise KeyError(f"unknown source: {name}")
        return self.spark.read.format(name).options(**options).load()
