"""Content nodes of a page (JSON) as lines, and JSON objects inside other text."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import line_key, squeezed, trimmed, useful_word_count

NODE = "struct<type:string,tag:string,text:string,items:array<string>,url:string,question:string,answer:string,data:array<array<string>>>"
#: Cells and attachment names that say nothing.
EMPTY_CELLS, EMPTY_NAMES = ("download", "data", "(data)", "form available"), ("download", "pdf", "image")


def _leaf(v: Column) -> Column:
    """A string as it is, an object by its text."""
    return F.when(v.startswith("{"), F.coalesce(F.get_json_object(v, "$.text"), F.lit(""))).otherwise(F.coalesce(v, F.lit("")))


def _joined(values: Column) -> Column:
    return F.array_join(F.filter(F.transform(values, _leaf), lambda x: x != ""), " ")


def node_text(v: Column) -> Column:
    """Text of a node's part: a string, an object's text or else its items, or a list of those."""
    items = F.when(v.startswith("{"), F.get_json_object(v, "$.items"))
    inner = F.coalesce(items, F.when(v.startswith('[{') | v.startswith('["'), v))
    own = F.when(v.startswith("{"), F.get_json_object(v, "$.text"))
    return F.coalesce(own, F.when(inner.isNotNull(), _joined(F.from_json(inner, "array<string>"))), _leaf(v))


def _row(cells: Column) -> Column:
    """A table row, null where it says too little."""
    kept = F.filter(F.transform(cells, lambda c: squeezed(node_text(c))), lambda c: (c != "") & ~line_key(c).isin(*EMPTY_CELLS))
    return F.element_at(F.transform(F.array(kept), lambda k: F.when((F.size(k) >= 2) | (useful_word_count(F.array_join(k, " ")) >= 4), F.array_join(k, " | "))), 1)


def _lines(node: Column) -> Column:
    none = F.array().cast("array<string>")
    text = trimmed(F.coalesce(node["text"], F.when(node["items"].isNotNull(), F.array_join(F.filter(F.transform(node["items"], node_text), lambda x: x != ""), " ")), F.lit("")))
    tag = F.lower(F.coalesce(node["tag"], F.lit("h2")))
    level = F.when(tag.rlike("^h[1-6]$"), F.substring(tag, 2, 1)).otherwise("2")
    one = lambda said, line: F.when(said, F.array(line)).otherwise(none)
    bullets = F.transform(F.filter(F.transform(F.coalesce(node["items"], none), lambda i: trimmed(node_text(i))), lambda x: x != ""), lambda x: F.concat(F.lit("- "), x))
    rows = F.array_compact(F.transform(F.coalesce(node["data"], F.array().cast("array<array<string>>")), _row))
    asked, said = trimmed(F.coalesce(node["question"], F.lit(""))), trimmed(F.coalesce(node["answer"], F.lit("")))
    kind = node["type"]
    return (
        F.when(kind == "header", one(text != "", F.concat(F.lit("[H"), level, F.lit("] "), text))).when(kind == "text", one(text != "", text)).when(kind == "list", bullets)
        .when(kind == "file_attachment", one((text != "") & ~line_key(text).isin(*EMPTY_NAMES), F.concat(F.lit("[PDF: "), text, F.lit(" | "), trimmed(F.coalesce(node["url"], F.lit(""))), F.lit("]"))))
        .when(kind == "table", rows)
        .when(kind == "faq", F.when((asked != "") & (said != ""), F.array(F.concat(F.lit("Q: "), asked), F.concat(F.lit("A: "), said))).otherwise(none)).otherwise(none)
    )


def rendered(nodes: Column) -> Column:
    """A JSON list of nodes as lines. Text is found in lists within a node down to the second level."""
    each = F.transform(F.from_json(nodes, "array<string>"), lambda n: F.from_json(n, NODE))
    return F.coalesce(F.array_join(F.flatten(F.transform(each, _lines)), "\n"), F.lit(""))


def balanced_json(text: Column) -> Column:
    """The first JSON object that stands anywhere in a text, null if there is none."""

    def first(t: str | None) -> str | None:
        decoder = json.JSONDecoder()
        at = -1 if t is None else t.find("{")
        while at >= 0:
            try:
                return t[at : decoder.raw_decode(t, at)[1]]
            except (ValueError, RecursionError):
                at = t.find("{", at + 1)
        return None

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(first)

    return F.when(text.contains("{"), run(text))
