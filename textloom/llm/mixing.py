"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic). A target is the marginal's own share to the power `temperature`,
normalised (below 1 it lifts small groups). Raking scales the cells' expected tokens to each target marginal in turn,
round after round; no cell can give more tokens than it has, so after each round a cell is cut to them and the next
round rakes the others again. It is done for each of FRACTIONS of all tokens, and the largest fraction counts whose
marginals all meet their targets within TOLERANCE; where none does, the largest that comes about as near as any. Documents are then
drawn, each with its cell's expected tokens over its tokens as the probability.

Cells are few against documents, but a web corpus may have many sources: up to LOCAL_CELLS of them are raked on the
driver (some ten MB), more of them as a table, by partially aggregated sums and joins on one marginal, with the same
results.

Defined results: null source, language or topic are values of their own; a null or empty text has no tokens and
its document the probability of its cell, or 1 where the whole cell has none; repeated rows are drawn alike, as the
draw hangs on the id alone; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, words
from .hashing import without

MARGINALS = ("source", "lang", "topic")
TEMPERATURE = 0.9
ROUNDS = 100
TOLERANCE = 1e-6
#: Parts of all tokens that may stay, the largest that meets the targets counts.
FRACTIONS = tuple(k / 20 for k in range(20, 0, -1))
LOCAL_CELLS = 100_000
#: The table of many cells is looked at after so many rounds, and left when no deviation has moved more than this since.
LOOK, STILL = 10, 1e-9


def form_of(text: Column) -> Column:
    """A topic for corpora that name none: the text's form."""
    return (
        F.when(F.contains(text, F.lit(" | ")), "table")
        .when(F.contains(text, F.lit("Licen")), "license")
        .when(F.contains(text, F.lit("@")) | F.contains(text, F.lit("+1 (")), "contact")
        .otherwise("prose")
    )


def uniform(key: Column) -> Column:
    """A number in [0, 1) that hangs on the key alone: 52 bits of its MD5."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def cells_of(rows: DataFrame) -> DataFrame:
    """Tokens of each cell; names are marked and nulls become an empty one, so that cells join on equality."""
    return rows.groupBy(*MARGINALS).agg(F.sum("n_tokens").cast("double").alias("tokens"))


def raked(tokens: np.ndarray, groups: list[np.ndarray], temperature: float, rounds: int = ROUNDS) -> tuple[np.ndarray, float, float]:
    """Expected tokens of each cell, the fraction of all tokens they make, and the largest relative deviation of a
    marginal from its target. groups: for each marginal the number of each cell's value."""
    total, targets, found = tokens.sum(), [], []
    for g in groups:
        p = np.bincount(g, tokens) ** temperature
        targets.append(p / p.sum())
    for fraction in FRACTIONS:
        share = tokens * fraction
        for _ in range(rounds):
            for g, t in zip(groups, targets, strict=True):
                share = share * (t * (total * fraction) / np.bincount(g, share))[g]
            share = np.minimum(share, tokens)
        away = max(np.abs(np.bincount(g, share) / (t * (total * fraction)) - 1).max() for g, t in zip(groups, targets, strict=True))
        found.append((share, fraction, float(away)))
        if away <= TOLERANCE:
            break
    return next(x for x in found if x[2] <= bound([x[2] for x in found]))


def bound(deviations: list[float]) -> float:
    """A fraction counts up to this deviation: within TOLERANCE or, if none is, about the least there is."""
    return max(TOLERANCE, 1.01 * min(deviations))


def _rake_here(cells: DataFrame, temperature: float, rounds: int) -> DataFrame:
    rows = cells.orderBy(*MARGINALS).toArrow()
    tokens = rows["tokens"].to_numpy()
    groups = [np.unique(rows[m].to_numpy(), return_inverse=True)[1] for m in MARGINALS]
    share, fraction, away = raked(tokens, groups, temperature, rounds)
    n = len(tokens)
    out = rows.append_column("share", pa.array(share)).append_column("fraction", pa.array(np.full(n, fraction))).append_column("deviation", pa.array(np.full(n, away)))
    return cells.sparkSession.createDataFrame(out.select([*MARGINALS, "tokens", "share", "fraction", "deviation"]))


def _rake_there(cells: DataFrame, temperature: float, rounds: int) -> DataFrame:
    """The same as a table: all fractions at once, a row for each cell and fraction."""
    total = cells.agg(F.sum("tokens")).first()[0]
    now = cells
    for m in MARGINALS:
        t = cells.groupBy(m).agg(F.pow(F.sum("tokens"), F.lit(temperature)).alias("p"))
        t = keep(t)
        z = t.agg(F.sum("p")).first()[0]
        now = now.join(t.select(m, (F.col("p") / z * total).alias(f"t_{m}")), m)
    now = now.withColumn("fraction", F.explode(F.array(*[F.lit(f) for f in FRACTIONS]))).withColumn("share", F.col("tokens") * F.col("fraction"))
    columns = now.columns
    now = keep(now)

    def with_sums(rows: DataFrame, m: str) -> DataFrame:
        return rows.join(rows.groupBy(m, "fraction").agg(F.sum("share").alias("z")), [m, "fraction"])

    def away(rows: DataFrame) -> DataFrame:
        for m in MARGINALS:
            rows = with_sums(rows, m).withColumn(f"d_{m}", F.abs(F.col("z") / (F.col(f"t_{m}") * F.col("fraction")) - 1)).drop("z")
        return rows.groupBy("fraction").agg(F.max(F.greatest(*[f"d_{m}" for m in MARGINALS])).alias("d"))

    before: dict[float, float] = {}
    for k in range(rounds):
        for m in MARGINALS:
            now = with_sums(now, m).withColumn("share", F.col("share") * (F.col(f"t_{m}") * F.col("fraction") / F.col("z"))).select(*columns)
        now = keep(now.withColumn("share", F.least("share", "tokens")))
        if k + 1 == rounds or (k + 1) % LOOK == 0:
            found = {r["fraction"]: r["d"] for r in away(now).collect()}
            if all(abs(d - before.get(f, 2.0)) <= STILL for f, d in found.items()):
                break
            before = found
    met = next(f for f in FRACTIONS if found[f] <= bound(list(found.values())))
    return now.filter(F.col("fraction") == met).select(*MARGINALS, "tokens", "share", "fraction").withColumn("deviation", F.lit(float(found[met])))


def rake(cells: DataFrame, temperature: float = TEMPERATURE, rounds: int = ROUNDS) -> DataFrame:
    """The cells with `share` (expected tokens of the draw), the `fraction` of all tokens that they make, and the
    largest relative `deviation` of a marginal from its target."""
    cells = keep(cells.filter("tokens > 0"))
    n = cells.count()
    if not n:
        return cells.select(*MARGINALS, "tokens", *[F.lit(None).cast("double").alias(c) for c in ("share", "fraction", "deviation")])
    return (_rake_here if n <= LOCAL_CELLS else _rake_there)(cells, temperature, rounds)


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
    topic: Column | str | None = None, temperature: float = TEMPERATURE, rounds: int = ROUNDS,
) -> DataFrame:
    """doc_id, n_tokens, the cell, probability and kept, for every document. topic: a column of docs; the text's form,
    if none is given."""
    # A mark in front keeps null apart from every name.
    named = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    text = F.coalesce(docs[text_col], F.lit(""))
    topic = form_of(text) if topic is None else docs[topic] if isinstance(topic, str) else topic
    rows = keep(
        docs.select(
            docs[id_col].alias("doc_id"), F.size(words(text)).cast("bigint").alias("n_tokens"), named(docs[source_col]).alias("source"),
            named(docs[lang_col]).alias("lang"), named(topic).alias("topic"),
        )
    )
    weights = rake(cells_of(rows), temperature, rounds).select(*MARGINALS, (F.col("share") / F.col("tokens")).alias("p"))
    drawn = rows.join(weights, list(MARGINALS), "left").withColumn("probability", F.coalesce("p", F.lit(1.0)))
    return drawn.select(
        "doc_id", "n_tokens", *[F.when(F.col(m) != "", F.expr(f"substring({m}, 2)")).alias(m) for m in MARGINALS], "probability",
        (uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) < F.col("probability")).alias("kept"),
    )


def marginals(drawn: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """marginal, value, and the shares of the tokens: own (of all), target, expected (of the draw) and drawn."""
    parts = None
    for m in MARGINALS:
        sums = drawn.groupBy(F.col(m).alias("value")).agg(
            F.sum("n_tokens").alias("own"), F.pow(F.sum("n_tokens"), F.lit(temperature)).alias("target"),
            F.sum(F.col("n_tokens") * F.col("probability")).alias("expected"), F.sum(F.when(F.col("kept"), F.col("n_tokens")).otherwise(0)).alias("drawn"),
        )
        z = sums.agg(*[F.sum(c).alias(f"z_{c}") for c in ("own", "target", "expected", "drawn")])
        part = sums.join(F.broadcast(z)).select(F.lit(m).alias("marginal"), "value", *[(F.col(c) / F.col(f"z_{c}")).alias(c) for c in ("own", "target", "expected", "drawn")])
        parts = part if parts is None else parts.union(part)
    return parts


def sample(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that mix draws, with all their columns."""
    gone = keep(mix(docs, id_col, **options).filter("not kept").select(F.col("doc_id").alias("id")).distinct())
    return without(docs, id_col, gone)
