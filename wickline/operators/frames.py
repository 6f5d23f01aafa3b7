"""What operators on ordered series share: the order of a symbol's rows, and scans that carry state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql.types import StructType, _parse_datatype_string
from pyspark.sql.pandas.types import to_arrow_schema


def by_time():
    """Rows of a symbol in time order."""
    return Window.partitionBy("symbol").orderBy("ts")


def fold(df: DataFrame, columns: list[str], made: str, start: Callable[[], object], step: Callable, key: str = "symbol", order: str = "ts") -> DataFrame:
    """Rows of each ``key`` in ``order`` with the columns ``made``, from a state that depends on the rows before.

    ``step(state, *values)`` gets the ``columns`` of a row and returns the next state and the made values (None: no row).
    A partition's keys are sorted by Spark (which spills) and read batch by batch, so that a series of any
    length takes linear time and the memory of one batch.
    """
    dealt = df.select(key, order, *columns).repartition(key).sortWithinPartitions(key, order)
    fields = _parse_datatype_string(made)
    schema = StructType([dealt.schema[key], dealt.schema[order], *fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, state = True, None, None
        for b in batches:
            out = []
            for k, t, *values in zip(*(c.to_pylist() for c in b.columns)):
                if first or k != last:
                    first, last, state = False, k, start()
                state, row = step(state, *values)
                if row is not None:
                    out.append((k, t, *row))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)], schema=arrow)

    return dealt.mapInArrow(run, schema)
