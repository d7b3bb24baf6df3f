"""Confidence, enumerations and semi-structured payloads, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trimmed

LABELS = {"high": 0.92, "partial": 0.67, "low": 0.31, "not_found": 0.31}
DEFAULT = 0.86
ANSWER_KINDS = ("answer", "clarify", "fallback", "smalltalk")
TEXT_KEYS = ("answer", "spoken", "response", "text", "content", "summary")



def coerce_confidence(x: Column) -> Column:
    """Labels by their value, numbers clamped to 0..1 (over 1 in text: a percentage), else the default."""
    t = F.lower(trimmed(x))
    n = t.try_cast("double")
    label = F.lit(None).cast("double")
    for k, v in LABELS.items():
        label = F.when(t == k, v).otherwise(label)
    return F.coalesce(label, F.when(n.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(n > 1, n / 100).otherwise(n)))), F.lit(DEFAULT))


def confidence_ladder(label: Column, score: Column, high: float, partial: float, has_answer: Column) -> Column:
    """A label as it is, else one by the score's thresholds, else by whether there is an answer."""
    by = lambda s: F.when(s >= high, "high").when(s >= partial, "partial").otherwise("not_found")
    t = F.lower(trimmed(label))
    n = t.try_cast("double")
    return (
        F.when(t.isin("high", "partial", "not_found"), t).when(n.isNotNull(), by(n)).when(score.isNotNull(), by(score))
        .when(has_answer, "high").otherwise("not_found")
    )


def enum_guard(x: Column, allowed: tuple[str, ...] = ANSWER_KINDS) -> Column:
    t = F.lower(trimmed(x))
    return F.when(t.isin(*allowed), t).otherwise(allowed[0])


def wrapped_json(x: Column) -> Column:
    """From the first opening brace to the last closing one."""
    return F.regexp_extract(x, r"(?s)(\{.*\})", 1)


def first_text(json: Column, keys: tuple[str, ...] = TEXT_KEYS) -> Column:
    return F.coalesce(*[F.nullif(trimmed(F.get_json_object(json, f"$.{k}")), F.lit("")) for k in keys])


def tag(text: Column, name: str) -> Column:
    """What stands between [[name]] and [[/name]]."""
    return trimmed(F.regexp_extract(text, rf"(?is)\[\[{name}\]\](.*?)\[\[/{name}\]\]", 1))


def wrap_tags(spoken: Column, details: Column) -> Column:
    d = F.when(trimmed(details) != "", trimmed(details)).otherwise(trimmed(spoken))
    return F.concat(F.lit("[[spoken]]"), trimmed(spoken), F.lit("[[/spoken]][[details]]"), d, F.lit("[[/details]]"))


def normalize_number(x: Column) -> Column:
    """`1,234` is a thousand and `1,5` one and a half."""
    thousands = x.rlike(r"^[+-]?\d{1,3}(,\d{3})+(\.\d+)?$")
    return F.when(thousands, F.replace(x, F.lit(","), F.lit(""))).otherwise(F.replace(x, F.lit(","), F.lit(".")))


def log_line(event: Column, fields: dict[str, Column]) -> Column:
    """event=… k=v, line breaks escaped, nulls left out."""
    pairs = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), F.regexp_replace(v.cast("string"), "\n", r"\\n"))) for k, v in fields.items()]
    return F.concat_ws(" ", F.concat(F.lit("event="), event), *pairs)


def log_fields(line: Column) -> Column:
    return F.str_to_map(line, F.lit(" "), F.lit("="))


def word_cap(text: Column, n: int) -> Column:
    """The first n words."""
    return F.array_join(F.slice(F.split(trimmed(text), r"\s+"), 1, n), " ")
