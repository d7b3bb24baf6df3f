"""Choosing among answers that arrive while time runs out."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class Budgets(NamedTuple):
    """Seconds: for the first result, for a generated one, and for the external service."""

    first: float = 0.25
    most: float = 12.0
    external: float = 8.0


SOURCES = ("faq", "cache", "local", "generated", "external")


def first_arrivals(questions: DataFrame, arrivals: DataFrame, most: float) -> DataFrame:
    """For each question (id, session, at) and source the first arrival (source, session, at, answered, confidence) within
    `most` seconds after it, as maps by source. An arrival belongs to every question that it comes in time for.

    Time is cut into stretches of `most` seconds, so that a busy session is many keys. A stretch's rows are gone through once,
    from the last to the first, with the arrival of each source that was met last; those of the stretch after it are its
    firsts. No question meets an arrival by a join, so the work grows with the rows, however close they come."""
    stretch = F.floor(F.col("at") / most)
    kept = "struct<came:double,silent:boolean,confidence:string>"
    arrived = F.struct(F.col("at").cast("double").alias("came"), (~F.col("answered")).alias("silent"), F.col("confidence").cast("string").alias("confidence")).cast(kept)
    a = arrivals.filter(F.col("source").isin(*SOURCES)).select("session", "at", stretch.alias("s"), "source", arrived.alias("x"))
    firsts = a.groupBy("session", "s", "source").agg(F.min("x").alias("x")).select("session", F.col("x.came").alias("at"), (F.col("s") - 1).alias("s"), "source", "x")
    none = F.lit(None)
    q = questions.select("session", "at", stretch.alias("s"), none.cast("string").alias("source"), none.cast(kept).alias("x"), "id", F.lit(True).alias("asks"))
    more = lambda rows: rows.withColumn("id", none.cast(questions.schema["id"].dataType)).withColumn("asks", F.lit(False))
    rows = q.union(more(a)).union(more(firsts)).filter("session is not null and s is not null")
    # From the last to the first; of one time the best arrival comes last, and questions after it.
    back = W.partitionBy("session", "s").orderBy(F.desc("at"), "asks", F.desc("x")).rowsBetween(W.unboundedPreceding, W.currentRow)
    met = rows.select("id", "asks", F.col("at").alias("asked"), *[F.last(F.when(F.col("source") == s, F.col("x")), ignorenulls=True).over(back).alias(s) for s in SOURCES]).filter("asks")
    after = lambda s: F.col(s)["came"] - F.col("asked")
    took = {s: F.when(after(s) <= most, F.struct(after(s).alias("after"), F.col(s)["silent"].alias("silent"), F.col(s)["confidence"].alias("confidence"))) for s in SOURCES}
    best = met.groupBy("id").agg(*[F.min(x).alias(s) for s, x in took.items()])
    entries = F.filter(F.array(*[F.struct(F.lit(s).alias("source"), F.col(s).alias("first")) for s in SOURCES]), lambda x: x["first"].isNotNull())
    return best.select("id", F.map_from_entries(entries).alias("first"))


def answer_race(questions: DataFrame, arrivals: DataFrame, budgets: Budgets = Budgets()) -> DataFrame:
    """id, winner, after (seconds; of a fallback, when it is given) and confidence for each question (id, session, at, internal).

    A question for the internal tool waits for the external service alone. Others: in the first budget the known questions, the
    cache and the generated answer race, and the first to come with an answer wins; the race is over early when only
    the generated one is still out. Then the local answer has until the last budget, then the generated one. Without a winner the
    fallback is given, when the last of those waited for has come or time is up."""
    got = first_arrivals(questions, arrivals, max(budgets.most, budgets.external))
    rows = questions.join(got, "id", "left")
    after = {s: F.col("first")[s]["after"] for s in SOURCES}
    answers = {s: after[s].isNotNull() & ~F.col("first")[s]["silent"] for s in SOURCES}
    in_time = lambda s, most: F.coalesce(after[s] <= most, F.lit(False))
    never = F.lit(float("inf"))
    end = lambda s: F.coalesce(after[s], never)
    # The first stage is over at the first answer, when both others have come without one, or when its time is up.
    quiet = F.greatest(end("faq"), end("cache"))
    runs = [F.when(answers[s] & in_time(s, budgets.first), F.struct(after[s].alias("t"), F.lit(s).alias("s"))) for s in ("faq", "cache")]
    early = F.when(answers["generated"] & in_time("generated", budgets.first) & (after["generated"] < quiet), F.struct(after["generated"].alias("t"), F.lit("generated").alias("s")))
    first = F.array_min(F.array_compact(F.array(*runs, early)))
    stage_end = F.least(quiet, F.lit(budgets.first))
    rows = rows.withColumn("__first", first).withColumn("__stage_end", stage_end)
    found = lambda s, t: F.struct(F.lit(s).alias("winner"), t.alias("after"))
    waits = {s: F.greatest(F.col("__stage_end"), after[s]) for s in ("local", "generated")}
    local = answers["local"] & in_time("local", budgets.most)
    generated = answers["generated"] & in_time("generated", budgets.most)
    local_done = F.least(F.greatest(F.col("__stage_end"), end("local")), F.lit(budgets.most))
    given_up = F.least(F.greatest(local_done, end("generated")), F.lit(budgets.most))
    public = (
        F.when(F.col("__first").isNotNull(), F.struct(F.col("__first.s").alias("winner"), F.col("__first.t").alias("after")))
        .when(local, found("local", waits["local"]))
        .when(generated, found("generated", F.greatest(local_done, after["generated"])))
        .otherwise(found("fallback", given_up))
    )
    external = F.when(answers["external"] & in_time("external", budgets.external), found("external", after["external"])).otherwise(
        found("fallback", F.least(end("external"), F.lit(budgets.external)))
    )
    chosen = F.when(F.coalesce("internal", F.lit(False)), external).otherwise(public)
    rows = rows.withColumn("__won", chosen)
    return rows.select("id", "__won.winner", "__won.after", F.col("first")[F.col("__won.winner")]["confidence"].alias("confidence"))
