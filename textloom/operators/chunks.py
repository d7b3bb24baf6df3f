"""Chunkers: one document to many rows. Section and table cuts are windows; packing to a budget is a fold over a
document's parts and runs in an Arrow function."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import text as X
from textloom.functions.rows import each

SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
BUDGETS = {"faq": 400, "table_faq": 400, "policy": 600, "report": 800, "guidebook": 600, "web": 500, "single": 1200}
OVERLAP = 80


def estimate(text: str) -> int:
    return max(1, len(text) // 4)


def _parts(text: str, budget: int) -> list[str]:
    """Paragraphs; lines if there is one paragraph over the budget; sentences if there is one line."""
    cuts = [lambda t: re.split(r"\n{2,}", t), str.splitlines, SENTENCE_END.split]
    parts: list[str] = []
    for cut in cuts:
        parts = [s for p in cut(text) if (s := p.strip())]
        if len(parts) != 1 or estimate(text) <= budget:
            break
    return parts


def _tail(parts: list[str], budget: int) -> str:
    """The last sentences of a chunk, as many as the budget holds."""
    tail = ""
    for s in reversed(SENTENCE_END.split("\n\n".join(parts))):
        if estimate(tail + s) > budget:
            break
        tail = f"{s} {tail}"
    return tail.strip()


def packed(text: str, budget: int, overlap: int = OVERLAP) -> Iterator[str]:
    """Chunks of whole parts up to the budget, each begun with the end of the one before; a part over the budget is cut
    every four characters per token."""
    lead, held = "", []
    whole = lambda parts: f"{lead}\n\n{'\n\n'.join(parts)}".strip()
    for part in _parts(text, budget):
        if estimate(part) > budget:
            if held:
                yield whole(held)
                lead, held = "", []
            yield from (part[i : i + 4 * budget] for i in range(0, len(part), 4 * budget))
        elif estimate(whole([*held, part])) <= budget:
            held.append(part)
        else:
            if held:
                yield whole(held)
                lead = _tail(held, overlap)
            held = [part]
    if held:
        yield whole(held)


def split_paragraphs(text: Column, budget: int) -> Column:
    """Array of the chunks of a text, itself if there is none."""

    return each(text, lambda t: [c for c in packed(t, budget) if c] or [t], T.ArrayType(T.StringType()))


def chunks(docs: DataFrame, strategy: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, chunk_index, text and token_estimate by the strategy's budget; `single` keeps the document whole."""
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("t"))
    cut = F.array("t") if strategy == "single" else split_paragraphs(F.col("t"), BUDGETS[strategy])
    out = rows.select("id", F.posexplode(cut).alias("chunk_index", "text"))
    return out.filter(F.trim("text") != "").withColumn("token_estimate", X.token_estimate(F.col("text")))


SAID_END = ".!?:;。！？)"
STARTS = re.compile(r"^(?:[-*]\s+|\d+[.)]\s+)")
GOES_ON = re.compile(r"^[a-zа-яәғқңөұүһі,;)]")
WORD_MARK = re.compile(rf"[^{X.LETTERS}]")
NUMBERED = re.compile(rf"^(?:(?i:PART|Schedule|Chapter)\s+\d+|\d+(?:\.\d+)*\.?\s+[{X.CAPITALS}])")


def _is_heading(line: str) -> bool:
    """As functions.text.is_heading, for one line."""
    t = re.sub(r"\s+", " ", re.sub(r"^#{1,6}\s+", "", re.sub(r"^\[H[1-6]\]\s*", "", line.strip()))).strip(" -")
    w = t.split()
    half = len(w) // 2
    if len(w) >= 2 and len(w) % 2 == 0 and [x.lower() for x in w[:half]] == [x.lower() for x in w[half:]]:
        t = " ".join(w[:half])
    letters = WORD_MARK.sub("", t)
    return bool(t) and len(t) <= 140 and (bool(NUMBERED.match(t)) or (len(letters) >= 4 and letters.upper() == letters))


def _joint(last: str, line: str) -> str | None:
    """What joins a line to the one before: nothing, a blank, or None where it stands by itself."""
    if any(x.startswith(("|", "[H")) for x in (last, line)):
        return None
    if line[0] in ",.;:!?)":
        return ""
    if last[-1] in SAID_END or STARTS.match(line) or _is_heading(last) or _is_heading(line):
        return None
    return " " if GOES_ON.match(line) or (len(last) < 95 and len(line) < 95) else None


def _repair(lines) -> list[str]:
    out: list[str] = []
    held: list[str] = []  # pieces of the last line
    length = 0
    for line in (x.strip() for x in lines):
        last = "".join(held) if length < 4000 else held[0] + held[-1]  # of a very long line both ends tell
        joint = _joint(last, line) if held and line else None
        if joint is not None:
            held.append(joint + line)
            length += len(joint) + len(line)
            continue
        if held:
            out.append("".join(held))
        if not line and out and out[-1] != "":
            out.append("")
        held, length = ([line], len(line)) if line else ([], 0)
    if held:
        out.append("".join(held))
    while out and not out[-1]:
        out.pop()
    return out


def repaired(lines: Column) -> Column:
    """Wrapped lines joined again: a fold, as a line is compared with what the one before has become. Blank lines stay
    single, and none at the end."""

    return each(lines, _repair, T.ArrayType(T.StringType()))


MARKER = re.compile(r"(?:\d+(?:\.\d+)+\.?|\([a-z]\))", re.IGNORECASE)


def merged_markers(lines: Column) -> Column:
    """A line that is a section's number alone, joined to the next one (unless that is blank or a table)."""

    def merge(lines) -> list[str]:
        out, waiting = [], None
        for line in lines:
            if waiting is not None:
                text = line.strip()
                if text and not text.startswith("|"):
                    out.append(f"{waiting.strip().rstrip('.')} {text}")
                    waiting = None
                    continue
                out.append(waiting)
                waiting = None
            if MARKER.fullmatch(line.strip()):
                waiting = line
            else:
                out.append(line)
        return out if waiting is None else [*out, waiting]

    return each(lines, merge, T.ArrayType(T.StringType()))
