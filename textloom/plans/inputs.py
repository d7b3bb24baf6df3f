"""Inputs that several queries share, for Spark and as DuckDB SQL: the tables, and fixed rows that make rare rules fire."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES = (
    "Home", "- Contacts", "Read more", "Learn more about fees", "SHARE this page", "cookie settings", "1234", "12345", "-----", "====", "___===---",
    "[IMAGE: logo]", "[ image: a.png ]", "<form action=x>", "<p>text</p>", "ATTACHMENTS: a.pdf", "DOWNLOADED_FILES: b",
    "(data) | (data)", "A (data) | (data) | B", "one two (data)", "alpha beta gamma delta epsilon zeta eta theta (data)",
    "download Download DOWNLOAD", "Intro ......... 3", "PART 1: INTRODUCTION ......... 3", "Chapter 2 Fees and Charges 17", "Schedule 4 Penalties 120",
    "PART 1 GENERAL", "1.2 Scope of Rules", "1.2 scope", "GENERAL PROVISIONS", "ABC", "[H2] Fees and fees", "## Legal Entities legal entities",
    "and", "With", "- and", "ok", "a1", "No.", "* Total fees are listed here.", "- short bullet", "SITE: main", "HEADINGS: x", "see http://a/http:/b",
    "Apply   Now", "Legal Entities legal entities", "question question", "abcabc", "a b A B", "   ", "", "Общие положения", "ОБЩИЕ ПОЛОЖЕНИЯ",
    "1. Общие положения", "It is.  It is. It was! it was. End", "What is the FEE, please?!", "25 [twenty five] and 3,5 [three and a half]", "file name (v2).txt",
    "[[spoken]]Hello there.[[/spoken]][[details]]# A\n- b[[/details]]", "Really?? Yes ,no!Fine (laughs) [music] 42% <b>x</b>", "Stop!Now", "...",
)
CHUNKS = (
    "1. 2. 3.4\n5", "PART 1: 3\nSchedule 2. 7", "1.\n2.\n3\ntext of it", "two words", "three whole words", "", "A long enough chunk " * 20, "1\n2\n\n3",
)
URLS = (
    "", "ftp://x/y", "https://h/https:/z", "http://Ex.com//a//b/?ref=x&page=2#top", "https://Ex.com", "https://www.Site.org/?s=", "no scheme",
    "https://a.b/?id=1&x=2&p=3", "HTTP://UP.example/Path/",
)
FILES = ("Guide to fees (2026).md", "web_content.md", "Правила — общие.md", "no-extension", "a very long file name that goes on and on for ever.md")


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def values(rows: tuple[str, ...]) -> str:
    """SQL rows (n, x), numbered from 0."""
    return "(VALUES " + ", ".join(f"({k}, {quoted(x)})" for k, x in enumerate(rows)) + ") v(n, x)"


def fixed(spark: SparkSession, rows: tuple[str, ...]) -> DataFrame:
    """Rows (n, x), numbered from 0."""
    return spark.createDataFrame(list(enumerate(rows)), "n bigint, x string")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos and line: the lines of all documents, and the fixed ones under negative ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    own = fixed(spark, LINES).select((-F.col("n") - 1).alias("doc_id"), F.lit(0).alias("pos"), F.col("x").alias("line"))
    return docs.union(own).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "line")


LINES_SQL = f"""
lines AS (
  SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
  UNION ALL SELECT -n - 1, 0, x FROM {values(LINES)}
)"""
