"""From text to vectors and to scores of pairs, without a model: hashed word counts, and lexical scores by rare words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.sources import shared

DIM = 256
#: Saturation of a word's count and weight of a text's length in a pair's score.
K1, B = 1.2, 0.75
#: Rows of words or ids that are broadcast.
SENT = 500_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def _slot(word: Column, dim: int) -> tuple[Column, Column]:
    """A word's dimension and sign, by its MD5 (the number of its first eight hexadecimal digits modulo dim, and whether the
    ninth is even), so that vectors made elsewhere agree. Digits that are no part of the remainder are not looked at."""
    digest = F.md5(word.cast("binary"))
    digit = lambda at: (F.instr(F.lit("0123456789abcdef"), F.substring(digest, at, 1)) - 1).cast("bigint")
    n = next((n for n in range(1, 8) if 16**n % dim == 0), 8)
    number = reduce(lambda x, y: x + y, [digit(8 - k) * 16**k for k in range(n)])
    return (number % dim).cast("int"), F.when(digit(9) % 2 == 0, 1).otherwise(-1)


def hashed_vectors(rows: DataFrame, id_col: str, text_col: str, dim: int = DIM) -> DataFrame:
    """id and vector (unit length, array<double> of dim) of the texts that have words. Counts are added up by text and
    dimension before the shuffle, so a text of any length sends at most dim numbers."""
    each = rows.select(F.col(id_col).alias("id"), F.explode(words(F.col(text_col))).alias("w"))
    slot, sign = _slot(F.col("w"), dim)
    sums = each.select("id", slot.alias("slot"), sign.cast("bigint").alias("sign")).groupBy("id", "slot").agg(F.sum("sign").alias("x")).filter("x <> 0")
    entries = F.sort_array(F.collect_list(F.struct(F.col("slot"), F.col("x").cast("double").alias("x"))))
    sparse = sums.groupBy("id").agg(entries.alias("e"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"))
    return sparse.select("id", _dense(F.col("e"), F.col("length"), dim).alias("vector"))


def _dense(entries: Column, length: Column, dim: int) -> Column:
    """The vector of the entries (slot, x), in order of their slots, over its length: each is put behind the zeros between it
    and the one before, so that a vector costs its own size and no search for each slot."""
    slots = F.concat(F.array(F.lit(-1)), entries["slot"])
    gap = lambda n: F.array_repeat(F.lit(0.0), n)
    parts = F.zip_with(entries, F.slice(slots, F.lit(1), F.size(entries)), lambda e, last: F.array_append(gap(e["slot"] - last - 1), e["x"] / length))
    return F.concat(F.flatten(parts), gap(dim - 1 - F.element_at(slots, -1)))


def _counts(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, w and tf: how often a text holds a word."""
    return rows.select(F.col(id_col).alias("id"), F.explode(words(F.col(text_col))).alias("w")).groupBy("id", "w").agg(F.count("*").alias("tf"))


def _sent(rows: DataFrame) -> DataFrame:
    """The rows, to be broadcast if they are few."""
    return F.broadcast(rows) if rows.limit(SENT + 1).count() <= SENT else rows


def pair_scores(pairs: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, id and lexical score of pairs (query_id, id) of texts (id, text each): for each different word of the query
    that the text holds its rarity among all texts, times its saturated count there. Pairs without a common word have none.

    Only texts that are in a pair are taken apart with their counts, and of all texts only the queries' words are counted; the
    number of texts and of their words is taken on the way, under the word ''. Pairs are read several times: keep them."""
    asked = shared.kept(queries.select(F.col("id").alias("query_id"), F.explode(F.array_distinct(words(F.col("text")))).alias("w")), "asked")
    wanted = asked.select("w").union(queries.sparkSession.range(1).select(F.lit(""))).distinct()
    each = docs.select(words(F.col("text")).alias("all")).select(F.size("all").alias("size"), F.explode(F.concat(F.array(F.lit("")), F.array_distinct("all"))).alias("w"))
    counted = shared.kept(each.join(_sent(wanted), "w", "left_semi").groupBy("w").agg(F.count("*").alias("df"), F.sum("size").alias("size")), "counted")
    total = counted.filter("w = ''").select(F.col("df").alias("n"), (F.col("size") / F.col("df")).alias("mean"))
    held = counted.filter("w <> ''").select("w", "df")
    paired = docs.join(_sent(pairs.select("id").distinct()), "id", "left_semi")
    tf = _counts(paired, "id", "text").withColumn("size", F.sum("tf").over(W.partitionBy("id")))
    met = pairs.select("query_id", "id").distinct().join(asked, "query_id").join(tf, ["id", "w"]).join(held, "w").crossJoin(F.broadcast(total))
    rarity = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    return met.groupBy("query_id", "id").agg(F.sum(rarity * weight).alias("lexical"))


def reranked(hits: DataFrame, queries: DataFrame, docs: DataFrame, top: int = 5, middle: float = 10.0) -> DataFrame:
    """query_id, id, score (0 to 1) and rank of the best hits (query_id, id, rank) of each query by their texts' lexical
    score, squashed around `middle`; of equals, and where no words are shared, the search's own order holds. The search is run
    once and its hits kept in the shared folder."""
    hits = shared.kept(hits.select("query_id", "id", "rank"), "hits")
    scored = hits.join(pair_scores(hits, queries, docs), ["query_id", "id"], "left")
    score = F.round(F.coalesce(1 / (1 + F.exp(-(F.col("lexical") - middle) / middle)), F.lit(0.0)), 6)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    best = scored.withColumn("score", score).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top)
    return best.select("query_id", "id", "score", F.col("r").cast("bigint").alias("rank"))
