"""The same folds over streams: a key's state is kept between batches and ends by an event-time timer."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from textloom.operators.folds import Transition, schema_of


class Folded(StatefulProcessor):
    """The states of a group's keys as one JSON value, and one timer, as each call to the store takes its time: `keep_s`
    seconds of event time after a key's last row, what is still to be given is given and the key's state goes."""

    def __init__(self, transition: Transition, keys: list[str], names: list[str], order: list[str], ts: str, keep_s: float):
        self.transition, self.keys, self.names, self.order, self.ts, self.keep_ms = transition, keys, names, order, ts, int(keep_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "json string")

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.names, dtype=object)

    def _held(self) -> tuple[dict[tuple, tuple], int | None]:
        """State and time of the last row of each key, and when the timer is due."""
        if not self.state.exists():
            return {}, None
        entries, timer = json.loads(self.state.get()[0])
        return {tuple(k): (s, last) for k, s, last in entries}, timer

    def _hold(self, held: dict[tuple, tuple], timer: int | None) -> None:
        """Keep the states; `timer` is the one that is set."""
        due = min((last for _, last in held.values()), default=None)
        due = None if due is None else due + self.keep_ms
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is not None and timer != due:
            self.handle.registerTimer(due)
        if due is not None:
            self.state.update((json.dumps(([(k, *x) for k, x in held.items()], due)),))
        elif timer is not None:
            self.state.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, timer = self._held()
        found = []
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        times = batch[self.ts].astype("datetime64[ms]").astype("int64").to_list()
        plain = [c.astype(object).where(c.notna(), None).to_list() for c in (batch[n] for n in batch.columns)]
        of: dict[tuple, list[dict]] = {}
        lasts: dict[tuple, int] = {}
        for values, at in zip(zip(*plain, strict=True), times, strict=True):
            row = {c: x.tolist() if isinstance(x, (np.ndarray, np.generic)) else x for c, x in zip(batch.columns, values, strict=True)}
            k = tuple(row[c] for c in self.keys)
            of.setdefault(k, []).append(row)
            lasts[k] = max(lasts.get(k, 0), at)
        for k, own in of.items():
            state = held[k][0] if k in held else self.transition.start()
            for row in self.transition.joined(own):
                state, new = self.transition.step(state, row)
                found += [(*k, *x) for x in new]
            held[k] = state, lasts[k]
            if self.transition.over(state):
                found += [(*k, *x) for x in self.transition.end(state)]
                del held[k]
        self._hold(held, timer)
        yield self._frame(found)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, _ = self._held()
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        ended = [k for k, (_, last) in held.items() if last + self.keep_ms <= now]
        found = [(*k, *x) for k in ended for x in self.transition.end(held.pop(k)[0])]
        if held:
            self._hold(held, None)
        else:
            self.state.clear()
        yield self._frame(found)

    def close(self) -> None:
        pass


def in_order(
    df: DataFrame, keys: list[str], order: list[str], transition: Transition, ts: str = "ts", late: str = "10 minutes", keep_s: float = 1800, group: str | None = None
) -> DataFrame:
    """The transition over each key's rows of a stream with event time `ts`. Rows of a key must not come later than the
    watermark and, from one batch to the next, in order; within a batch they are sorted. Keys are numbers or text.

    A `group`, in SQL, says which keys are kept together (all rows of a key in one group): the store is asked once a group, and a
    group's rows of one batch are in memory together, so groups are to grow in number, not in size. Without it each key
    is by itself."""
    schema = schema_of(df, keys, transition.rows)
    keyed = df.withWatermark(ts, late).withColumn("__group", F.xxhash64(*keys) if group is None else F.expr(group)).groupBy("__group")
    return keyed.transformWithStateInPandas(Folded(transition, keys, schema.names, order, ts, keep_s), schema, "Append", "EventTime")
