"""Catalogues behind a search function, as a Spark data source: ``spark.read.format("radar_catalog")``.

A backend is a function in an importable module, (query dict) -> iterable of product names or dicts. Queries are split by
time, so that each task asks for one interval; remote services stay outside, behind the function.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Interval(InputPartition):
    def __init__(self, start: float, end: float):
        super().__init__((start, end))


class CatalogReader(DataSourceReader):
    def __init__(self, options: dict[str, str], fields: list[str]):
        self.backend, self.query, self.fields = options["backend"], json.loads(options.get("query", "{}")), fields
        self.parts = max(1, int(options.get("parts", "1")))

    def partitions(self) -> list[Interval]:
        start, end = self.query.get("start"), self.query.get("end")
        if start is None or end is None:
            return [Interval(start, end)]
        step = (end - start) / self.parts
        return [Interval(start + k * step, end if k == self.parts - 1 else start + (k + 1) * step) for k in range(self.parts)]

    def read(self, partition: Interval) -> Iterator[tuple]:
        module, _, name = self.backend.rpartition(":")
        start, end = partition.value
        for found in getattr(importlib.import_module(module), name)({**self.query, "start": start, "end": end}):
            one = found if isinstance(found, dict) else {"name": found}
            yield tuple(one.get(k) for k in self.fields)


class CatalogSource(DataSource):
    """Options: ``backend`` as module:function, ``query`` as JSON with start and end in seconds, ``parts``."""

    @classmethod
    def name(cls) -> str:
        return "radar_catalog"

    def schema(self) -> str:
        return "name string"

    def reader(self, schema) -> CatalogReader:
        return CatalogReader(dict(self.options), schema.fieldNames())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CatalogSource)
