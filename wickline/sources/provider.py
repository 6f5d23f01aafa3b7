"""A batch data source over an injected fetcher, one input partition per symbol, with bounded retries."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "symbol string, ts date, open double, high double, low double, close double, adj_close double, volume double"


def provider_source(fetch: Callable[[str, str, str], list[tuple]], retries: int = 3, pause: float = 0.0) -> type[DataSource]:
    """A ``DataSource`` class named ``candle_provider``; options ``symbols``, ``start``, ``end`` (exclusive)."""

    class Part(InputPartition):
        def __init__(self, symbol: str):
            super().__init__(symbol)

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.options = dict(options)

        def partitions(self):
            names = dict.fromkeys(s.strip().upper() for s in self.options["symbols"].replace(",", " ").split())
            return [Part(s) for s in names]

        def read(self, partition) -> Iterator[tuple]:
            for attempt in range(1, retries + 1):
                try:
                    rows = fetch(partition.value, self.options["start"], self.options["end"])
                    break
                except Exception:
                    if attempt == retries:
                        raise
                    time.sleep(pause)
            for r in rows:
                yield (partition.value, *r)

    class Provider(DataSource):
        @classmethod
        def name(cls) -> str:
            return "candle_provider"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options)

    return Provider
