"""Row functions in Python, run over Arrow batches a few megabytes at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Arrow bytes of rows that are Python objects at once.
AT_ONCE = 1 << 21


def pieces(array: pa.Array, most: int = AT_ONCE) -> Iterator[pa.Array]:
    """The array in slices of at most so many bytes, or of one row."""
    if len(array) > 1 and array.nbytes > most:
        half = len(array) // 2
        yield from pieces(array.slice(0, half), most)
        yield from pieces(array.slice(half), most)
    else:
        yield array


def each(value: Column, make: Callable, kind: DataType) -> Column:
    """make(value) of every row; null where it is null. What a task holds as Python objects doesn't grow with its batches,
    and a slice's results leave before the next slice is read."""
    arrow = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in pieces(batch):
                yield pa.array([None if x is None else make(x) for x in part.to_pylist()], arrow)

    return run(value)
