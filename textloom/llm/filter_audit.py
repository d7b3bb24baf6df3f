"""Filter interaction audit: every order of five filters replayed over every document.

Each document is measured once: five flags (does it fail filter A, B, ...), its part (the source) and its labels. The
flags meet a broadcast table of the 120 orders, each order is exploded into its five steps, and a step's filter removes
the document where it is the first in the order that the document fails. The counts are conditional sums, combined
before the shuffle, so a part of any size sends at most 600 rows from each task.

Defined results: a null text is an empty one; a null source is the empty string, one part with it; a null doc_id is
neither smaller nor larger than any other, so its row never fails E and makes no other fail, and it has no labels; rows with the same id and
text don't fail E for each other; a document with several label rows counts as good, or toxic, where one of them says
so; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, words

FILTERS = "ABCDE"
MIN_WORDS = 200


def flags(text: Column) -> dict[str, Column]:
    """Whether a text (not null) fails A to D: few words, repetitive, many capitals, symbols. `w` holds its words."""
    n = F.size("w")
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    return {
        "A": n < MIN_WORDS,
        "B": F.lit(100) * F.size(F.array_distinct("w")) < F.lit(50) * n,
        "C": F.lit(100).cast("bigint") * capitals > F.lit(2).cast("bigint") * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """doc_id, part and `fails`, the set of failed filters as bits (A is 1, B 2, ...), for each row of docs."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), text.alias("t"), words(text).alias("w"))
    bits = sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(flags(F.col("t")).values())), F.lit(0))
    rows = keep(rows.select("doc_id", "part", bits.cast("int").alias("fails"), F.unhex(F.sha2("t", 256)).alias("digest")))
    # Kept, so that the join reads both sides from shuffles of its own: Spark can then split a text that very many rows have.
    firsts = keep(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("doc_id").alias("n")).filter(F.col("n") > 1).drop("n"))
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return rows.join(firsts, "digest", "left").select(
        "doc_id", "part", (F.col("fails") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)).alias("fails")
    )


def _orders(docs: DataFrame) -> DataFrame:
    """The 120 orders with their steps, an array of (step, filter, bit)."""
    rows = [("".join(p), [(k + 1, x, 1 << FILTERS.index(x)) for k, x in enumerate(p)]) for p in permutations(FILTERS)]
    schema = "filter_order string, steps array<struct<step:int,filter:string,bit:int>>"
    return docs.sparkSession.createDataFrame(rows, schema)


def filter_audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
) -> DataFrame:
    """part, filter_order, step, filter, and the counts kept, removed, redundant, unique_fails, good_lost, toxic_lost and
    shapley (what the filter removes in this part, summed over all orders)."""
    by_doc = labels.select(labels["doc_id"].alias("__id"), (labels["quality"] == 1).alias("q"), (labels["toxic"] == 1).alias("x"))
    by_doc = by_doc.groupBy("__id").agg(F.max("q").alias("good"), F.max("x").alias("toxic"))
    rows = measured(docs, id_col, text_col, part_col)
    rows = rows.join(by_doc, rows["doc_id"] == by_doc["__id"], "left").select(
        "part", "fails", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    )
    # The first step whose filter fails: 6 where none does.
    first = lambda s: F.least(*[F.when(F.get(s, k)["bit"].bitwiseAND(F.col("fails")) != 0, k + 1).otherwise(6) for k in range(5)])
    replay = rows.crossJoin(F.broadcast(_orders(docs))).withColumn("first", first(F.col("steps")))
    replay = replay.select("part", "fails", "good", "toxic", "filter_order", "first", F.inline("steps"))
    here, fails = F.col("first") == F.col("step"), F.col("bit").bitwiseAND(F.col("fails")) != 0
    count = lambda x, name: F.sum(F.when(x, 1).otherwise(0).cast("bigint")).alias(name)
    counts = replay.groupBy("part", "filter_order", "step", "filter").agg(
        count(F.col("first") > F.col("step"), "kept"),
        count(here, "removed"),
        count(fails & (F.col("first") < F.col("step")), "redundant"),
        count(F.col("fails") == F.col("bit"), "unique_fails"),
        count(here & F.col("good"), "good_lost"),
        count(here & F.col("toxic"), "toxic_lost"),
    )
    counts = keep(counts)
    shares = counts.groupBy(F.col("part").alias("__part"), F.col("filter").alias("__filter")).agg(F.sum("removed").alias("shapley"))
    return counts.join(shares, (F.col("part") == F.col("__part")) & (F.col("filter") == F.col("__filter"))).drop("__part", "__filter")
