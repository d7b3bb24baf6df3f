"""Queries of chunkers, sections and number words; with DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import numbers
from textloom.operators import chunkers, chunks

from .inputs import LINES_SQL, lines, quoted, table, values

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
NUMBERS = ("0", "5", "10", "15", "20", "21", "99", "100", "101", "105", "110", "111", "999", "1000", "1001", "2000", "2024", "12012", "21000", "100000", "1000000", "2000002", "5123456", "999999999", "1000000000", "-5")

for _lang in ("en", "ru", "kk", "zh"):
    def _spell(spark, sf_dir, lang=_lang):
        own = spark.createDataFrame([(int(x),) for x in NUMBERS if lang != "zh" or not x.startswith("-")], "x bigint")
        rows = table(spark, sf_dir, "documents").select(F.col("n_chars").alias("x")).union(own).distinct()
        return rows.selectExpr("x", f"{numbers.spelled(lang, 'x')} AS words")

    QUERIES[f"spell_{_lang}"] = _spell
    _own = values(tuple(x for x in NUMBERS if _lang != "zh" or not x.startswith("-")))
    ORACLES[f"spell_{_lang}"] = f"SELECT x, {numbers.spelled(_lang, 'x', numbers.DUCKDB)} AS words FROM (SELECT n_chars AS x FROM documents UNION SELECT x::BIGINT FROM {_own})"

QUERIES["split_paragraphs"] = lambda spark, sf_dir: chunks.chunks(table(spark, sf_dir, "documents"), "faq")
QUERIES["chunk_single"] = lambda spark, sf_dir: chunks.chunks(table(spark, sf_dir, "documents"), "single").withColumn("chunk_index", F.col("chunk_index").cast("bigint"))
ORACLES["chunk_single"] = "SELECT doc_id AS id, 0::BIGINT AS chunk_index, text, greatest(1, length(text) // 4) AS token_estimate FROM documents WHERE trim(text) <> ''"


def _islands(spark, sf_dir):
    """Runs of table lines and of prose in the documents' lines, every seventh of which is made a table's row."""
    rows = lines(spark, sf_dir).withColumn("line", F.when(F.col("pos") % 7 == 3, F.concat(F.lit("| "), "line", F.lit(" |"))).otherwise(F.col("line")))
    return chunkers.table_runs(rows, ["doc_id"]).groupBy("doc_id", "is_table", "run").agg(F.min("pos").alias("first"), F.count("*").alias("n")).drop("run")


QUERIES["report_islands"] = _islands
ORACLES["report_islands"] = f"""WITH {LINES_SQL}, t AS (SELECT doc_id, pos, pos % 7 = 3 OR starts_with(line, '|') AS is_table FROM lines),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - row_number() OVER (PARTITION BY doc_id, is_table ORDER BY pos) AS run FROM t)
  SELECT doc_id, is_table, min(pos) AS first, count(*) AS n FROM r GROUP BY doc_id, is_table, run"""
QUERIES["repair_line_wraps"] = lambda spark, sf_dir: table(spark, sf_dir, "documents").select(
    "doc_id", F.array_join(chunks.repaired(F.split("text", "\n", -1)), "\n").alias("text")
)

#: Texts with numbers, their language, and what is said.
NUMBERED = (
    ("en", "CO2 costs 25%", "COtwo costs twenty five percent"),
    ("en", "At 9:05, 3.5% or 3,5% of 1,234,567", "At nine five, three point five percent or three point five percent of one million two hundred thirty four thousand five hundred sixty seven"),
    ("en", "-2.5 and +7, 5-7", "minus two point five and seven, five-seven"),
    ("en", "1.234.567,89", "one point two three four five six seven eight nine"),
    ("en", "007 and 12345678901234567890", "seven and one two three four five six seven eight nine zero one two three four five six seven eight nine zero"),
    ("en", "  two   blanks 2\tx ", "two blanks two x"),
    ("en", "", ""),
    ("en", "none  here", "none here"),
    ("ru", "В 14:30 скидка 2.5% и 21", "В четырнадцать тридцать минут скидка два запятая пять процентов и двадцать один"),
    ("kk", "14:05 10%", "он төрт минут бес он нөл пайыз"),
    ("zh", "共 25% 与 -5，3.14 在 8:30", "共 百分之 二十五 与 -五，三 点 一 四 在 八 点 三十"),
)


def _spoken_numbers(spark, sf_dir):
    """Fixed texts, and for every document and language a sentence with its length, a share and a time."""
    own = spark.createDataFrame([(-k - 1, lang, x) for k, (lang, x, _) in enumerate(NUMBERED)], "id bigint, lang string, x string")
    made = "concat('has ', n_chars, ' signs, ', doc_id % 100, '% at ', doc_id % 24, ':', lpad(doc_id % 60, 2, '0'))"
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id AS id", "explode(array('en', 'ru', 'kk', 'zh')) AS lang", f"{made} AS x")
    said = " ".join(f"WHEN '{lang}' THEN {numbers.spoken(lang, 'x')}" for lang in ("en", "ru", "kk", "zh"))
    return own.union(docs).selectExpr("id", "lang", f"CASE lang {said} END AS value")


def _told(lang: str) -> str:
    chars, share, hour, minute = (numbers.spelled(lang, x, numbers.DUCKDB) for x in ("n_chars", "(doc_id % 100)", "(doc_id % 24)", "(doc_id % 60)"))
    before, after = numbers.PERCENT[lang]
    between, last = numbers.TIME[lang]
    return f"SELECT doc_id, '{lang}', concat('has ', {chars}, ' signs, {before}', {share}, '{after} at ', {hour}, '{between}', {minute}, '{last}') FROM documents"


QUERIES["spoken_numbers"] = _spoken_numbers
ORACLES["spoken_numbers"] = (
    "SELECT * FROM (VALUES " + ", ".join(f"({-k - 1}::BIGINT, {quoted(lang)}, {quoted(said)})" for k, (lang, _, said) in enumerate(NUMBERED)) + ") v(id, lang, value) UNION ALL "
    + " UNION ALL ".join(_told(lang) for lang in ("en", "ru", "kk", "zh"))
)
