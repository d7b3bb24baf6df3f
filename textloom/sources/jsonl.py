"""Lines of JSON from files, the bad ones apart from the good."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.nodes import rendered
from textloom.functions.text import trimmed

BAD = "_bad"


def scanned(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The records (path, and the schema's columns) and the rejected lines (path, line) of all files at a path. A line that
    is blank is neither; one that is no JSON object of the schema is rejected whole, and the others of its file stay."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line")).filter(F.trim("line") != "")
    parsed = lines.withColumn("r", F.from_json("line", f"{schema}, {BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}))
    is_object = F.col("line").rlike(r"^\s*\{")
    bad = ~is_object | F.col("r").isNull() | F.col(f"r.{BAD}").isNotNull()
    return parsed.filter(~bad).select("path", "r.*").drop(BAD), parsed.filter(bad).select("path", "line")


PAGE = "url string, title string, section string, scraped_at string, content string, faq_pairs string"


def _pairs(pairs: Column) -> Column:
    each = F.from_json(pairs, "array<struct<question:string,answer:string>>")
    asked = F.filter(each, lambda x: (trimmed(x["question"]) != "") & (trimmed(x["answer"]) != ""))
    return F.array_join(F.flatten(F.transform(asked, lambda x: F.array(F.concat(F.lit("Q: "), trimmed(x["question"])), F.concat(F.lit("A: "), trimmed(x["answer"]))))), "\n")


def page_records(spark: SparkSession, path: str, site: str) -> tuple[DataFrame, DataFrame]:
    """Page records of structured files, and their rejected lines: the content's nodes as lines, then questions and answers."""
    rows, bad = scanned(spark, path, PAGE)
    text = lambda c: F.coalesce(trimmed(F.col(c)), F.lit(""))
    asked = F.nullif(_pairs(F.col("faq_pairs")), F.lit(""))
    body = F.concat(rendered(F.col("content")), F.coalesce(F.concat(F.lit("\n"), asked), F.lit("")))
    return rows.select("path", F.lit(site).alias("site"), F.lit("structured_jsonl").alias("source_type"), *[text(c).alias(c) for c in ("url", "title", "section", "scraped_at")], body.alias("body")), bad
