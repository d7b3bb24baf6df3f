"""Payloads of unknown shape, as VARIANT, into one form: answer, chunks, citations, confidence.

What is wanted may lie under any of several keys, one within another to any depth, and the first that has it wins. So a
payload is gone down level by level, along the keys that may lead on; every step adds its rank to the path's, and of the
texts at the ends the one with the least path (step by step) is taken. Each level is an explode without a shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.payload import TEXT_KEYS, confidence_ladder
from textloom.sources import shared

#: Keys that lead on, in order.
NESTED = ("result", "data", "message")
CHUNK_KEYS = ("chunks", "contexts", "context", "documents", "docs", "results", "sources")
CHUNK_NESTED = ("result", "data")
CHUNK_TEXTS = ("text", "content", "context", "page_content", "body")
CHUNK_SOURCES = ("source_file", "source", "documentName", "document", "title", "url")
CITATION_KEYS = ("citations", "citation", "sources", "source", "references")
CITATION_NAMES = ("title", "source", "source_file", "document", "url", "name")
CHUNK_CITED = ("source_file", "documentName", "domain", "chunk_id")
SCORE_KEYS = ("score", "confidence_score", "confidenceScore", "similarity", "rerank_score")
CHUNK_SCORES = ("rerank_score", "similarity", "ann_score")
SERVICE = "external_rag"
MOST_CITATIONS = 4
#: Levels of a descent that are one plan.
STRIDE = 4


def member(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "variant")


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID or a kind of number; null for no value."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def is_number(v: Column) -> Column:
    return kind(v).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT")


def filled(v: Column) -> Column:
    """Whether a value counts: not null, false, zero or empty."""
    return v.isNotNull() & ~F.coalesce(F.to_json(v), F.lit("null")).rlike(r'^(null|false|""|\[\]|\{\}|-?0(\.0*)?)$')


def trimmed_text(v: Column) -> Column:
    return F.btrim(v.cast("string"), F.lit(" \t\n\x0b\x0c\r"))


def first_filled(v: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.when(filled(member(v, k)), member(v, k)) for k in keys])


#: A step from one kind of place to another: (rank, kind of place after it, value).
def _text_steps(v: Column) -> list[tuple[int, str, Column]]:
    return [(k, "text", member(v, key)) for k, key in enumerate(TEXT_KEYS)]


def _answer_steps(v: Column) -> list[tuple[int, str, Column]]:
    n = len(TEXT_KEYS)
    chosen = member(v, "choices[0]")
    chosen = F.when(kind(chosen) == "OBJECT", F.coalesce(F.when(filled(member(chosen, "message")), member(chosen, "message")), chosen))
    return [*_text_steps(v), *[(n + k, "answer", member(v, key)) for k, key in enumerate(NESTED)], (n + len(NESTED), "answer", chosen)]


def _chunk_steps(v: Column) -> list[tuple[int, str, Column]]:
    n = len(CHUNK_KEYS)
    return [*[(k, "list", member(v, key)) for k, key in enumerate(CHUNK_KEYS)], *[(n + k, "chunks", member(v, key)) for k, key in enumerate(CHUNK_NESTED)]]


STEPS = {"text": _text_steps, "answer": _answer_steps, "chunks": _chunk_steps}


def descended(rows: DataFrame, place: str, key: str = "id") -> DataFrame:
    """key, place, rank (array) and v of every value that the steps lead to from rows (key, v), the rows' own included."""
    spark = rows.sparkSession
    here = rows.select(key, F.lit(place).alias("place"), F.array().cast("array<int>").alias("rank"), "v")
    levels = [here]
    while True:
        steps = {p: F.array(*[F.struct(F.lit(r).alias("r"), F.lit(q).alias("place"), x.alias("v")) for r, q, x in make(F.col("v"))]) for p, make in STEPS.items()}
        step = reduce(lambda c, p: c.when(F.col("place") == p, steps[p]), [p for p in steps if p != "text"], F.when(F.col("place") == "text", steps["text"]))
        below = here.filter(kind(F.col("v")) == "OBJECT").select(key, "rank", F.explode(step).alias("s"))
        here = below.filter("s.v IS NOT NULL").select(key, "s.place", F.concat("rank", F.array("s.r")).alias("rank"), "s.v")
        if len(levels) % STRIDE == 0:
            # Written now and then: deeper levels start from here, and are only looked for if there is something.
            written = shared.folder(spark, "level")
            here.write.parquet(written)
            here = spark.read.schema(here.schema).parquet(written)
            if here.isEmpty():
                return reduce(DataFrame.union, levels)
        levels.append(here)


def _leaf(v: Column, place: Column) -> Column:
    number = (place == "text") & is_number(v)
    return F.when(kind(v) == "STRING", trimmed_text(v)).when(number, v.cast("string"))


def first_text(rows: DataFrame, place: str, key: str = "id") -> DataFrame:
    """key and the text that the steps lead to first, for the rows (key, v) that have one."""
    ends = descended(rows, place, key).withColumn("t", _leaf(F.col("v"), F.col("place"))).filter("t <> ''")
    return ends.groupBy(key).agg(F.min_by("t", "rank").alias("text"))


def chunks_of(payloads: DataFrame) -> DataFrame:
    """id, n, text, source, cited (what names it as a citation) and score of the chunks of payloads (id, v), in order from 0."""
    lists = descended(payloads, "chunks").filter("place = 'list'")
    v = F.col("v")
    items = F.when(kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>")).when(kind(v).isin("STRING", "OBJECT"), F.array(v))
    items = lists.select("id", "rank", F.posexplode(items).alias("n", "v"))
    v = F.col("v")
    said = F.coalesce(first_filled(v, CHUNK_TEXTS))
    items = items.withColumn("key", F.struct("id", "rank", "n"))
    found = first_text(items.filter(kind(v) == "OBJECT").select("key", said.alias("v")).filter("v IS NOT NULL"), "text", "key")
    plain = kind(v) == "STRING"
    text = F.when(plain, trimmed_text(v)).otherwise(F.coalesce("text", F.lit("")))
    stays = F.when(plain, text != "").otherwise((text != "") | filled(first_filled(v, ("text", "content", "context"))))
    name = lambda x: F.when(kind(x) == "STRING", x.cast("string")).otherwise(F.to_json(x))
    source = F.when(plain, F.lit(SERVICE)).otherwise(name(first_filled(v, CHUNK_SOURCES)))
    cited = F.when(plain, F.lit(SERVICE)).otherwise(F.btrim(F.coalesce(source, name(first_filled(v, CHUNK_CITED)), F.lit(SERVICE))))
    # The first of the score's keys that is there at all counts, a number or not.
    score = F.coalesce(*[F.when(member(v, k).isNotNull(), F.coalesce(F.try_variant_get(v, f"$.{k}", "double"), F.lit(float("nan")))) for k in CHUNK_SCORES], F.lit(0.0))
    rows = items.join(found, "key", "left").filter((plain | (kind(v) == "OBJECT")) & stays)
    rows = rows.select("id", "rank", "n", text.alias("text"), source.alias("source"), cited.alias("cited"), F.when(plain, F.lit(0.0)).otherwise(score).alias("score"))
    first = rows.groupBy("id").agg(F.min("rank").alias("first"))
    return rows.join(first, "id").filter("rank = first").drop("rank", "first")


def citations_of(payloads: DataFrame) -> DataFrame:
    """id, n and name of what payloads (id, v) cite themselves, empty names and repeats included."""
    v = F.col("v")
    raw = F.when(kind(v) == "OBJECT", first_filled(v, CITATION_KEYS))
    rows = payloads.select("id", raw.alias("v")).filter("v IS NOT NULL")
    rows = rows.select("id", F.posexplode(F.when(kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))).alias("n", "v"))
    rows = rows.select(F.struct("id", "n").alias("key"), F.when(kind(v) == "OBJECT", first_filled(v, CITATION_NAMES)).otherwise(v).alias("v")).filter("v IS NOT NULL")
    return first_text(rows, "text", "key").select("key.id", "key.n", F.col("text").alias("name"))


def _firsts(rows: DataFrame, name: str, most: int) -> DataFrame:
    """id and the distinct names in order of first sight, at most so many."""
    seen = rows.filter(F.col(name) != "").groupBy("id", F.col(name).alias("name")).agg(F.min("n").alias("n"))
    return seen.groupBy("id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("n", "name"))), lambda x: x["name"]), 1, most).alias("names"))


def normalised(payloads: DataFrame, high: float = 0.25, partial: float = 0.10) -> DataFrame:
    """id, answer, chunks (array of text, source), citations (at most four), confidence, score and is_contract (has details)
    of payloads (id, v: VARIANT); what can't be found is empty."""
    v = F.col("v")
    chunks = chunks_of(payloads)
    listed = chunks.groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", "text", "source"))), lambda x: F.struct(x["text"].alias("text"), x["source"].alias("source"))).alias("chunks"),
        F.max(F.when(~F.isnan("score"), F.col("score"))).alias("best"),
    )
    own, theirs = _firsts(citations_of(payloads), "name", MOST_CITATIONS), _firsts(chunks, "cited", MOST_CITATIONS)
    rows = payloads.join(first_text(payloads, "answer").withColumnRenamed("text", "answer"), "id", "left").join(listed, "id", "left")
    rows = rows.join(own.withColumnRenamed("names", "own"), "id", "left").join(theirs.withColumnRenamed("names", "theirs"), "id", "left")
    numeric = F.coalesce(*[F.try_variant_get(v, f"$.{k}", "double") for k in SCORE_KEYS], "best", F.lit(0.0))
    numeric = F.when(kind(v) == "OBJECT", numeric).otherwise(F.coalesce("best", F.lit(0.0)))
    given = member(v, "confidence")
    label = F.when(kind(given) == "STRING", F.lower(trimmed_text(given))).when(is_number(given), given.cast("string"))
    number = F.when(~label.isin("high", "partial", "not_found"), label.try_cast("double"))
    has_answer = F.coalesce(F.col("answer"), F.lit("")) != ""
    rows = rows.withColumn("numeric", numeric).withColumn("label", label).withColumn("number", number)
    positive = F.when(F.col("numeric") > 0, F.col("numeric"))
    confidence = confidence_ladder(F.col("label"), positive, high, partial, has_answer)
    score = F.coalesce("number", F.when(F.col("label").isin("high", "partial", "not_found"), F.col("numeric")), positive, F.when(has_answer, 0.92), F.lit(0.0))
    return rows.select(
        "id", F.coalesce("answer", F.lit("")).alias("answer"),
        F.coalesce("chunks", F.array().cast("array<struct<text:string,source:string>>")).alias("chunks"),
        F.coalesce("own", "theirs", F.array().cast("array<string>")).alias("citations"),
        confidence.alias("confidence"), score.alias("score"),
        F.coalesce((kind(v) == "OBJECT") & member(v, "details").isNotNull(), F.lit(False)).alias("is_contract"),
    )
