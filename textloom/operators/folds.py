"""Folds over the rows of a key in order, for rules whose next step hangs on all steps before."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that are given to Spark at once.
BATCH = 5_000


class Transition:
    """What one row does to a key's state. A state is plain data (numbers, text, lists, dicts with text as keys), so that
    a stream can keep it as JSON. `rows` is the DDL of what a step gives, without the key."""

    rows: str

    def start(self) -> Any:
        raise NotImplementedError

    def step(self, state: Any, row: dict) -> tuple[Any, list[tuple]]:
        raise NotImplementedError

    def joined(self, rows: list[dict]) -> list[dict]:
        """Rows of a key that come together, as fewer rows with the same outcome where the rule allows it."""
        return rows

    def over(self, state: Any) -> bool:
        """Whether no row comes after those that led to this state, so that it need not be kept."""
        return False

    def end(self, state: Any) -> list[tuple]:
        """What is still to be given when the key's rows are over."""
        return []


def schema_of(df: DataFrame, keys: list[str], rows: str) -> StructType:
    return StructType([df.schema[k] for k in keys] + StructType.fromDDL(rows).fields)


def in_order(df: DataFrame, keys: list[str], order: list[str], transition: Transition) -> DataFrame:
    """The transition over each key's rows. A task streams through sorted rows and holds one state; keys are dealt out by
    hash, so a key's rows are one task's work, but never in memory together."""
    schema = schema_of(df, keys, transition.rows)
    arrow, names = to_arrow_schema(schema), schema.names

    def events(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, dict]]:
        for batch in batches:
            for row in batch.to_pylist():
                yield tuple(row[k] for k in keys), row

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for key, rows in groupby(events(batches), lambda x: x[0]):
            state = transition.start()
            for _, row in rows:
                state, found = transition.step(state, row)
                for x in found:
                    yield dict(zip(names, (*key, *x), strict=True))
            for x in transition.end(state):
                yield dict(zip(names, (*key, *x), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for row in folded(batches):
            held.append(row)
            if len(held) == BATCH:
                yield pa.RecordBatch.from_pylist(held, arrow)
                held = []
        yield pa.RecordBatch.from_pylist(held, arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
