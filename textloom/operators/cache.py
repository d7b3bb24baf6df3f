"""A cache of answers, found again by similar questions: keyed state that expires and evicts, and a join as of a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import text as T

from .folds import Transition
from .ranks import first_of_each

TTL_S = 1800.0
MOST = 256
WIN = 0.9


class AnswerCache(Transition):
    """Questions (id, at in seconds, language, tokens: distinct words) against one cache, in order of time.

    A question first drops entries older than ttl_s. The most similar entry, of equals the one not used for longest,
    becomes the last used whatever its score; it wins with `win` or more and the same language. Else the question's own
    answer is put in, and beyond `most` entries the one not used for longest goes. Entries don't grow younger by use.

    It gives id, hit (the winning entry's id), score (of the best entry, 0 without one) and n_entries (afterwards). A state is
    the entries from the one not used for longest on."""

    rows = "id bigint, hit bigint, score double, n_entries int"

    def __init__(self, ttl_s: float = TTL_S, most: int = MOST, win: float = WIN):
        self.ttl_s, self.most, self.win = ttl_s, most, win

    def start(self) -> list:
        return []

    def step(self, entries: list, row: dict) -> tuple[list, list[tuple]]:
        tokens = set(row["tokens"] or [])
        entries = [e for e in entries if row["at"] - e["at"] <= self.ttl_s]
        best, score = None, 0.0
        for k, e in enumerate(entries):
            common = sum(x in tokens for x in e["tokens"])
            s = common / (len(tokens) + len(e["tokens"]) - common) if common else float(not tokens and not e["tokens"])
            if s > score:
                best, score = k, s
        hit = None
        if best is not None:
            entries.append(found := entries.pop(best))
            if score >= self.win and found["language"] == row["language"]:
                hit = found["id"]
        if hit is None:
            entries.append({"id": row["id"], "at": row["at"], "language": row["language"], "tokens": sorted(tokens)})
            entries = entries[-self.most :]
        return entries, [(row["id"], hit, score, len(entries))]


def _keyed(rows: DataFrame, name: str) -> DataFrame:
    key = F.array_join(F.array_sort("tokens"), " ")
    return rows.select(F.col("id").alias(name), F.col("at").alias(f"at_{name}"), "language", F.array_sort("tokens").alias("t"), key.alias("key"))


def alive_matches(questions: DataFrame, entries: DataFrame, ttl_s: float = TTL_S, win: float = WIN) -> DataFrame:
    """id, hit, score: for each question (id, at, language, tokens) the most similar entry (the same columns) of its
    language that is alive at its time: put in before it, at most ttl_s seconds ago. Of equals the oldest, then the smallest id.

    Sets are compared once each, however many questions have them, and two sets meet under their rarest words alone.
    Questions without words match entries without words. Ids are not null."""
    q, e = _keyed(questions, "id"), _keyed(entries, "hit")
    qs, es = q.select("key", "t").distinct(), e.select("key", "t").distinct()
    counts = es.select(F.explode("t").alias("w")).groupBy("w").agg(F.count("*").alias("c"))

    def rare(sets: DataFrame, name: str) -> DataFrame:
        n = F.size("t")
        words = sets.select(F.col("key").alias(name), n.alias(f"n_{name}"), F.explode("t").alias("w")).join(counts, "w", "left")
        rank = F.row_number().over(W.partitionBy(name).orderBy(F.coalesce("c", F.lit(0)), "w"))
        most = F.col(f"n_{name}") - F.ceil(F.col(f"n_{name}") * win - 1e-9) + 1
        return words.withColumn("r", rank).filter(F.col("r") <= most).select(name, f"n_{name}", "w")

    near = rare(qs, "a").join(rare(es, "b"), "w").filter(F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * win - 1e-9).select("a", "b").distinct()
    score = T.jaccard(F.split("a", " "), F.split("b", " "))
    near = near.withColumn("score", score).filter(F.col("score") >= win - 1e-9)
    empty = qs.filter("key = ''").select(F.col("key").alias("a"), F.lit("").alias("b"), F.lit(1.0).alias("score"))
    stretch = lambda at, k=0: F.floor(F.col(at) / ttl_s) - k
    # The oldest entry alive is the first one from ttl_s before the question on: the next one in time within a stretch of
    # ttl_s, or else the first of the stretch after it. A set that many questions share is cut into its stretches.
    cut = lambda at: F.floor(F.col(at) / ttl_s)
    e = e.select(F.col("key").alias("b"), "language", F.col("at_hit").alias("at"), "hit").withColumn("s", cut("at"))
    wanted = q.withColumnRenamed("key", "a").join(near.union(empty), "a").select("b", "language", (F.col("at_id") - ttl_s).alias("at"), "id", "at_id", "score").withColumn("s", cut("at"))
    rows = wanted.select("b", "language", "s", "at", "id", "at_id", "score", F.lit(None).cast("bigint").alias("hit")).unionByName(e, allowMissingColumns=True)
    later = W.partitionBy("b", "language", "s").orderBy(F.desc("at"), F.desc_nulls_last("hit")).rowsBetween(W.unboundedPreceding, W.currentRow)
    entry = F.struct("at", "hit")
    after = rows.withColumn("next", F.last(F.when(F.col("hit").isNotNull(), entry), ignorenulls=True).over(later)).filter("id is not null")
    firsts = e.groupBy("b", "language", (F.col("s") - 1).alias("s")).agg(F.min(entry).alias("first"))
    found = after.join(firsts, ["b", "language", "s"], "left").withColumn("e", F.coalesce("next", "first")).filter("e.at < at_id")
    found = found.select("id", "e.hit", "score", F.col("e.at").alias("at"))
    return first_of_each(found, ["id"], [-F.col("score"), F.col("at"), F.col("hit")]).select("id", "hit", "score")
