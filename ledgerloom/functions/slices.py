"""Arrow functions over a few rows at a time.

Spark hands a task thousands of rows at once. They are compact as Arrow data and many times as large as Python objects, so
only a slice of them is turned into objects, and memory follows the rows of a slice, not those of a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

SLICE_ROWS = 128


def slices(rows: pa.Array | pa.RecordBatch, size: int = SLICE_ROWS) -> Iterator[pa.Array | pa.RecordBatch]:
    """The rows in order, ``size`` at a time, without a copy."""
    for at in range(0, len(rows), size):
        yield rows.slice(at, size)


def mapped(fn: Callable, returns: DataType, made: pa.DataType, size: int = SLICE_ROWS):
    """A column function that maps each value by ``fn``, of Spark's type ``returns`` and Arrow's ``made``; nulls stay null."""

    def run(values: pa.Array) -> pa.Array:
        parts = [pa.array([None if v is None else fn(v) for v in part.to_pylist()], made) for part in slices(values, size)]
        return pa.concat_arrays(parts) if parts else pa.array([], made)

    return F.arrow_udf(run, returns)
