"""Text for a voice: sentences of a length that can be said, numbers in words, nothing said twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import numbers
from .spoken import CYRILLIC, sanitized
from .text import let, no_repeated_sentences, trimmed

#: Marks that part clauses, by language, and what makes a clause long enough for a sentence.
CLAUSE_MARKS, HAN_CLAUSE_MARKS = ",;:", "，；、"
LONG_WORDS, LONG_CHARS, LONG_HAN = 8, 90, 28


def _clauses(text: Column) -> Column:
    """The text cut after every clause mark."""
    return F.split(text, rf"(?<=[{CLAUSE_MARKS}{HAN_CLAUSE_MARKS}])", -1)


def _joined_clauses(text: Column, add, ends_at: str, is_long, stop: str, glue: str, shown) -> Column:
    """Clauses gathered into sentences: add(held, clause) goes on with what is held; where a mark of ends_at closes enough, a
    sentence ends there."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"))
    marks = f"[ {ends_at}]+$"

    def step(a: Column, x: Column) -> Column:
        mark = F.when(x.rlike(f"[{CLAUSE_MARKS}{HAN_CLAUSE_MARKS}]$"), F.right(x, F.lit(1))).otherwise("")
        held = add(a["held"], trimmed(F.left(x, F.length(x) - F.length(mark))))
        ends = mark.rlike(f"[{ends_at}]") & is_long(held)
        sentence = F.concat(a["out"], F.array(F.concat(F.regexp_replace(held, marks, ""), F.lit(stop))))
        on = trimmed(F.concat(F.rtrim(held), mark)) if glue else F.concat(held, mark)
        return F.struct(F.when(ends, sentence).otherwise(a["out"]).alias("out"), F.when(ends, "").otherwise(F.when(mark == "", held).otherwise(on)).alias("held"))

    pieces = _clauses(text)
    whole = let(F.aggregate(pieces, start, step), lambda a: F.concat(a["out"], F.array(trimmed(a["held"]))))
    kept = F.transform(F.filter(whole, lambda x: trimmed(x) != ""), shown)
    return F.when(F.size(pieces) > 1, trimmed(F.array_join(kept, glue))).otherwise(text)


def sentenceized(text: Column, language: Column) -> Column:
    """What can be spoken, with long clauses as sentences of their own: eight words or 90 characters up to a comma, colon or
    semicolon; in Chinese 28 characters up to a mark of its own."""
    words = f"[A-Za-z{CYRILLIC}]+"
    with_blank = lambda held, x: F.when((held != "") & (x != ""), trimmed(F.concat_ws(" ", held, x))).when(x != "", x).otherwise(held)
    is_long = lambda x: (F.regexp_count(x, F.lit(words)) >= LONG_WORDS) | (F.length(x) >= LONG_CHARS)
    capital = lambda x: F.concat(F.upper(F.left(trimmed(x), F.lit(1))), F.substring(trimmed(x), 2, 1 << 30))
    by_word = lambda t: _joined_clauses(t, with_blank, CLAUSE_MARKS, is_long, ".", " ", capital)
    by_sign = lambda t: _joined_clauses(t, F.concat, HAN_CLAUSE_MARKS, lambda x: F.length(x) >= LONG_HAN, "。", "", lambda x: x)
    return let(sanitized(F.coalesce(text, F.lit(""))), lambda t: F.when(language == "zh", by_sign(t)).otherwise(by_word(t)))


def prepared(rows: DataFrame, text: str, language: str, name: str) -> DataFrame:
    """The rows with `name`: the text for a voice. It is cleaned, its numbers are said in words of the language (other
    languages: English), long clauses become sentences, and sentences that are said twice in a row are said once."""
    lang = F.when(F.col(language).isin("ru", "kk", "zh"), F.col(language)).otherwise("en")
    said = " ".join(f"WHEN '{x}' THEN {numbers.spoken(x, '__x')}" for x in ("en", "ru", "kk", "zh"))
    rows = rows.withColumn("__lang", lang).withColumn("__x", sanitized(F.col(text), keep_digits=True)).withColumn("__x", F.expr(f"CASE __lang {said} END"))
    rows = rows.withColumn("__x", sanitized(sentenceized(F.col("__x"), F.col("__lang"))))
    return rows.withColumn(name, sanitized(no_repeated_sentences(F.col("__x")))).drop("__lang", "__x")


def spaced_like(prepared: Column, text: Column) -> Column:
    """The prepared text of a chunk, with a blank where the chunk had white space on either side."""
    before = F.when(text.rlike(r"^\s") & ~prepared.startswith(" "), " ").otherwise("")
    after = F.when(text.rlike(r"\s$") & ~prepared.endswith(" "), " ").otherwise("")
    return F.when(prepared != "", F.concat(before, prepared, after)).otherwise(prepared)
