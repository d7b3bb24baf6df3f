"""Best match by shared words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import text as T

from .ranks import first_of_each


def _sets(rows: DataFrame, id_col: str, text: Column) -> DataFrame:
    return rows.select(F.col(id_col), T.token_set(text).alias("t")).filter(F.size("t") > 0).withColumn("key", F.array_join("t", " "))


def best_similar(queries: DataFrame, items: DataFrame, least: float = 0.9) -> DataFrame:
    """query_id, item_id, score: for each query (query_id, text) the item (item_id, text) whose words overlap it most,
    by Jaccard and then item_id, where that is `least` or more.

    Equal word sets are compared once. Two sets that are similar share one of their rarest words, so only these are
    joined on: a word that every text has makes no pairs."""
    q, f = _sets(queries, "query_id", F.col("text")), _sets(items, "item_id", F.col("text"))
    qs, fs = q.select("key", "t").distinct(), f.groupBy("key", "t").agg(F.min("item_id").alias("item_id"))
    counts = fs.select(F.explode("t").alias("w")).groupBy("w").agg(F.count("*").alias("c"))

    def rare(sets: DataFrame, key: str) -> DataFrame:
        words = sets.select(F.col("key").alias(key), F.size("t").alias(f"n_{key}"), F.explode("t").alias("w")).join(counts, "w", "left")
        rank = F.row_number().over(W.partitionBy(key).orderBy(F.coalesce("c", F.lit(0)), "w"))
        return words.withColumn("r", rank).filter(F.col("r") <= F.col(f"n_{key}") - F.ceil(F.col(f"n_{key}") * least - 1e-9) + 1).select(key, f"n_{key}", "w")

    pairs = rare(qs, "a").join(rare(fs, "b"), "w").filter(F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * least - 1e-9).select("a", "b").distinct()
    near = pairs.join(fs.select(F.col("key").alias("b"), "item_id"), "b")
    scored = near.withColumn("score", T.jaccard(F.split("a", " "), F.split("b", " "))).filter(F.col("score") >= least - 1e-9)
    best = first_of_each(scored.select("a", "item_id", "score"), ["a"], [-F.col("score"), F.col("item_id")])
    return q.select("query_id", F.col("key").alias("a")).join(best, "a").select("query_id", "item_id", "score")
