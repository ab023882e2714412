"""A Spark data source for candles behind a paged interface: each instrument is a partition, read page by page on an executor.

The pages come from a function (instrument, since, limit) -> list of rows [ms, open, high, low, close, volume], named by an
option as module:function, so that a connector is a function that executors can import. Incomplete and out-of-range rows go.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "instrument string, epoch_ms long, open double, high double, low double, close double, volume double"
#: Pages of a partition, at most: a source that never ends is an error.
MAX_PAGES = 100_000


class _Series(InputPartition):
    def __init__(self, instrument: str):
        self.instrument = instrument


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.fetch = options["fetch"]
        self.instruments = [x for x in options["instruments"].split(",") if x]
        self.start, self.end, self.limit = int(options["start"]), int(options["end"]), int(options.get("limit", "500"))

    def partitions(self):
        return [_Series(x) for x in self.instruments]

    def read(self, partition: _Series) -> Iterator[tuple]:
        module, _, name = self.fetch.partition(":")
        fetch = getattr(importlib.import_module(module), name)
        since = self.start
        for _ in range(MAX_PAGES):
            page = fetch(partition.instrument, since, self.limit)
            rows = [r for r in page if since <= r[0] <= self.end and None not in r[1:5]]
            for r in rows:
                yield (partition.instrument, int(r[0]), *map(float, r[1:5]), None if r[5] is None else float(r[5]))
            if not page or page[-1][0] < since or page[-1][0] >= self.end:
                return
            since = page[-1][0] + 1
        raise RuntimeError(f"{partition.instrument}: more than {MAX_PAGES} pages")


class PagedCandles(DataSource):
    """spark.dataSource.register(PagedCandles); spark.read.format("paged_candles").options(fetch=..., instruments="A,B", start=ms, end=ms)."""

    @classmethod
    def name(cls) -> str:
        return "paged_candles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))
