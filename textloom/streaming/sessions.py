"""Streaming: tokens assembled into utterances, duplicate suppression, idle sessions. Watermarks bound the state; they
are this library's own addition."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ENDS = ("<end>", "<fin>")


def idle_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Events per user and session; a session ends when nothing came for the gap."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(
        "user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n"
    )


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def distinct_within(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first event of every key, as long as the watermark keeps it in mind."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def suppressed(queries: DataFrame, gap_s: float = 1.5) -> DataFrame:
    """session, signature and at (seconds) of the queries that come gap_s or more after the session's last accepted one
    of the same signature; a refused query moves no clock."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        accepted = []
        for t in sorted(t for b in batches for t in b["at"]):
            if last is None or t - last >= gap_s:
                accepted.append(t)
                last = t
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({"session": [key[0]] * len(accepted), "signature": [key[1]] * len(accepted), "at": accepted})

    return queries.groupBy("session", "signature").applyInPandasWithState(
        step, "session string, signature string, at double", "last double", "append", GroupStateTimeout.NoTimeout
    )


def assembled(tokens: DataFrame) -> DataFrame:
    """session and text of every utterance: final tokens in order, ended by a sentinel; partial tokens don't count."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending = list(state.get[0]) if state.exists else []
        done = []
        for row in pd.concat(list(batches)).sort_values("seq").itertuples():
            if row.text in ENDS:
                if pending:
                    done.append("".join(pending).strip())
                pending = []
            elif row.is_final:
                pending.append(row.text)
        state.update((pending,))
        yield pd.DataFrame({"session": [key[0]] * len(done), "text": done})

    return tokens.groupBy("session").applyInPandasWithState(
        step, "session string, text string", "pending array<string>", "append", GroupStateTimeout.NoTimeout
    )
