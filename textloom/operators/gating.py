"""State that runs through the events of a key, carried over pieces of time, so that a key with many events is many tasks'
work: each piece is summed up by itself, the sums are gone through in order, and each piece is then finished by itself."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .folds import Transition, in_order

#: Seconds of a piece.
PIECE_S = 3600.0


def carried(rows: DataFrame, key: str, at: str, order: list[str], value: Column, name: str, piece_s: float = PIECE_S) -> DataFrame:
    """The rows with the last value (not null) of the key up to and with each row, in order of `order`, which begins with
    `at` (seconds). Null where none came yet."""
    cut = rows.withColumn("__v", value).withColumn("__piece", F.floor(F.col(at) / piece_s))
    last = F.max_by("__v", F.when(F.col("__v").isNotNull(), F.struct(*order)))
    pieces = cut.groupBy(key, "__piece").agg(last.alias("__last"))
    before = W.partitionBy(key).orderBy("__piece").rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.select(F.col(key).alias("__key"), F.col("__piece").alias("__p"), F.last("__last", ignorenulls=True).over(before).alias("__entering"))
    own = W.partitionBy(key, "__piece").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = cut.withColumn("__own", F.last("__v", ignorenulls=True).over(own))
    met = inside.join(pieces, inside[key].eqNullSafe(pieces["__key"]) & (inside["__piece"] == pieces["__p"]))
    return met.withColumn(name, F.coalesce("__own", "__entering")).drop("__v", "__piece", "__own", "__key", "__p", "__entering")


def active_turns(events: DataFrame, key: str = "session", at: str = "at", order: tuple[str, ...] = ("at", "seq"), piece_s: float = PIECE_S) -> DataFrame:
    """Events (kind, turn) with `active`, the key's active turn, and `kept`. A `start` sets the active turn to its own, an
    `end` of the active turn or without a turn clears it. Other events go if they name a turn that is not the active one; without an
    active turn, or without naming one, they stay."""
    is_end = F.col("kind") == "end"
    opens = carried(events, key, at, list(order), F.when(F.col("kind") == "start", F.col("turn")), "__open", piece_s)
    # An end counts if it names the turn that is open; the place of the last start or counting end says which it is.
    ends = is_end & (F.col("turn").isNull() | (F.col("turn") == F.col("__open")))
    mark = F.when(F.col("kind") == "start", F.struct(F.col("turn").alias("t"))).when(ends, F.struct(F.lit(None).cast(events.schema["turn"].dataType).alias("t")))
    marked = carried(opens, key, at, list(order), mark, "__mark", piece_s)
    active = F.col("__mark.t")
    stale = ~F.col("kind").isin("start", "end") & F.col("turn").isNotNull() & active.isNotNull() & (F.col("turn") != active)
    return marked.withColumn("active", active).withColumn("kept", ~F.coalesce(stale, F.lit(False))).drop("__open", "__mark")


class _Piece:
    """The gate over one piece of events in order: times, and whether each is a try or opens the gate anew."""

    def __init__(self, at: np.ndarray, tries: np.ndarray, opens: np.ndarray, cooldown_s: float):
        self.cooldown_s = cooldown_s
        self.tries = np.flatnonzero(tries)
        self.t = at[self.tries]
        self.opened = np.flatnonzero(opens)
        n = len(self.tries)
        # After a try passes, the next one that does: beyond the next opening, and cooldown_s later at least.
        reopened = np.searchsorted(self.opened, self.tries)
        after = np.append(self.opened, len(at))[reopened]
        self.next = np.maximum(np.searchsorted(self.tries, after), np.searchsorted(self.t, self.t + cooldown_s))
        self.last = np.arange(n)
        for k in range(n - 1, -1, -1):
            if self.next[k] < n:
                self.last[k] = self.last[self.next[k]]
        # Whether the gate is shut at the end, by the last try that passed.
        self.shut = reopened >= len(self.opened)

    def first(self, last: float | None, shut: bool) -> int:
        """The first try that passes."""
        k = 0 if last is None else int(np.searchsorted(self.t, last + self.cooldown_s))
        if shut:
            k = max(k, int(np.searchsorted(self.tries, self.opened[0])) if len(self.opened) else len(self.tries))
        return k

    def table(self, start: float) -> list[tuple]:
        """(shut, until, last, shut afterwards): entering shut or not, with the last pass so long ago that a try at `until`
        may pass, the last pass and the gate are these at the end. By until; equal outcomes are one row."""
        rows = []
        for shut in (False, True):
            begin = self.first(None, shut)
            own: list[tuple] = []
            for k in range(begin, len(self.tries)):
                row = (shut, float(self.t[k]), float(self.t[self.last[k]]), bool(self.shut[self.last[k]]))
                if own and own[-1][2:] == row[2:]:
                    own[-1] = row
                else:
                    own.append(row)
                if self.t[k] >= start + self.cooldown_s:
                    break  # no pass before the piece holds back a later try
            rows += own
        return rows

    def passed(self, last: float | None, shut: bool) -> np.ndarray:
        """Places of the events that pass."""
        out, k = [], self.first(last, shut)
        while k < len(self.tries):
            out.append(self.tries[k])
            k = int(self.next[k])
        return np.asarray(out, np.int64)


class _Entering(Transition):
    """Pieces of a key in order (piece, opens: whether an opening is in it, and the columns of its table) to the state that
    each is entered with."""

    rows = "piece bigint, last double, shut boolean"

    def __init__(self, cooldown_s: float):
        self.cooldown_s = cooldown_s

    def start(self) -> list:
        return [None, False]

    def step(self, state: list, row: dict) -> tuple[list, list[tuple]]:
        last, shut = state
        rows = [(u, a, s) for w, u, a, s in zip(row["entered_shut"], row["until"], row["ends_last"], row["ends_shut"], strict=True) if w == shut]
        k = bisect_left([u for u, _, _ in rows], last + self.cooldown_s) if last is not None else 0
        after = list(rows[k][1:]) if k < len(rows) else [last, shut and not row["opens"]]
        return after, [(row["piece"], last, shut)]


def gated(events: DataFrame, key: str, at: str, order: list[str], tries: Column, opens: Column, cooldown_s: float, piece_s: float = PIECE_S) -> DataFrame:
    """The events with `passed`: a try passes if none has since the gate was last opened, and the key's last pass, whenever
    it was, is cooldown_s seconds ago or more. A try that doesn't pass changes nothing. `at` is seconds; order begins with it.

    What a piece does to any state that it is entered with is a small table: only its tries within the first cooldown_s
    seconds may be held back from before, and their chains of passes soon meet. The tables of a key are gone through in order;
    then each piece is finished from the state it is entered with."""
    names = events.columns
    cut = events.withColumn("__try", F.coalesce(tries, F.lit(False))).withColumn("__open", F.coalesce(opens, F.lit(False)))
    cut = cut.withColumn("__piece", F.floor(F.col(at) / piece_s))
    place = lambda table: table.sort_by([(c, "ascending") for c in order])
    flags = lambda table, c: table[c].to_numpy(zero_copy_only=False).astype(bool)

    def piece_of(table: pa.Table) -> _Piece:
        return _Piece(table[at].to_numpy().astype(float), flags(table, "__try"), flags(table, "__open"), cooldown_s)

    def summed(table: pa.Table) -> pa.Table:
        table = place(table)
        piece = piece_of(table)
        number = table["__piece"][0].as_py()
        columns = list(zip(*piece.table(number * piece_s), strict=True)) or [(), (), (), ()]
        out = {key: table[key][:1], "piece": pa.array([number], pa.int64()), "opens": [len(piece.opened) > 0]}
        types = (pa.bool_(), pa.float64(), pa.float64(), pa.bool_())
        return pa.table(out | {c: pa.array([list(x)], pa.list_(t)) for c, x, t in zip(("entered_shut", "until", "ends_last", "ends_shut"), columns, types, strict=True)})

    def finished(table: pa.Table, state: pa.Table) -> pa.Table:
        table = place(table)
        passed = np.zeros(table.num_rows, bool)
        passed[piece_of(table).passed(state["last"][0].as_py(), state["shut"][0].as_py())] = True
        return table.select(names).append_column("passed", pa.array(passed))

    kind = events.schema[key].dataType.simpleString()
    tables = cut.groupBy(key, "__piece").applyInArrow(
        summed, f"`{key}` {kind}, piece bigint, opens boolean, entered_shut array<boolean>, until array<double>, ends_last array<double>, ends_shut array<boolean>"
    )
    entering = in_order(tables, [key], ["piece"], _Entering(cooldown_s))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema) + ", passed boolean"
    return cut.groupBy(key, "__piece").cogroup(entering.groupBy(key, F.col("piece").alias("__piece"))).applyInArrow(finished, schema)
