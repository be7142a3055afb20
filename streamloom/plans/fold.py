"""Ordered folds: a state per key, stepped over the key's rows in order.

Rows are brought together by key and sorted, and a worker passes over them as a
stream, so that a key's rows are never held as a group: a stream of any length
needs the memory of one batch and one state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


def fold(df: DataFrame, key: str, order: list[str], start: Callable[[], Any], step: Callable[[Any, dict], tuple[Any, dict | None]], schema: str) -> DataFrame:
    """``step(state, row)`` gives the next state and an output row, or None for no row."""
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, begun = None, None, False
        at = names.index(key)
        for batch in batches:
            made: list[dict] = []
            # columns to lists at once; a row is then a dictionary of its own for the step alone
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or values[at] != last:
                    last, state, begun = values[at], start(), True
                state, out = step(state, dict(zip(names, values, strict=True)))
                if out is not None:
                    made.append(out)
            yield pa.RecordBatch.from_arrays([pa.array([m[f.name] for m in made], f.type) for f in arrow], schema=arrow)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
