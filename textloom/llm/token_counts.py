"""Token counts of sections by offset-mapped attribution.

A whole document is encoded once. The tokens' byte lengths give their offsets, which are merged with the ordered
section boundaries; a token that crosses a boundary goes where the rule says:

- `most` (default): to the section that holds most of its bytes, the earlier one of equals;
- `start`: to the section where it begins;
- `split`: to all sections it touches, each by its share of the bytes.

Defined results: a null or empty text has no tokens and one empty section; sections partition the text, so the
counts of a document's sections add up to its own; a text of any length is encoded whole, long runs of white space
included; repeated rows are counted each by itself, and so are rows with a null id, which stays null; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed value: how the public vocabulary cuts a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The pattern looks back over a run of white space once per character, each on the stack: longer runs are taken out first.
LONG_RUN = 10_000
#: Fixed value: what the pattern takes for white space.
SPACE = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
RULES = ("most", "start", "split")
SCHEMA = (
    "doc_id bigint, section int, char_start bigint, char_end bigint, n_tokens double, n_crossing bigint, doc_tokens bigint"
)


@functools.cache
def encoder(path: str):
    """The encoding of a rank file, and the byte length of each token; once per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


LONG = re.compile(f"{SPACE}{{{LONG_RUN},}}")


def encoded(enc, text: str) -> list[int]:
    """The ids of a whole text. The pattern makes one piece of a run of white space, less its last character where other
    text follows, and begins anew after it; so a long run may be encoded by itself, as that one piece."""
    ids, at = [], 0
    for run in LONG.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        ids += enc.encode_ordinary(text[at : run.start()])
        ids += enc._encode_single_piece(text[run.start() : end])
        at = end
    return ids + enc.encode_ordinary(text[at:])


def line_sections(text: str) -> list[str]:
    """Sections are lines, each with the line feed that ends it."""
    lines = text.split("\n")
    return [x + "\n" for x in lines[:-1]] + [x for x in lines[-1:] if x]


def attribute(lengths: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and tokens of it that cross into a later one.

    lengths: bytes of the tokens in order; bounds: byte ends of the sections in order, the last the text's end."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    first, last = np.searchsorted(bounds, starts, "right"), np.searchsorted(bounds, ends, "left")
    n = len(bounds)
    crossing = np.bincount(first[first < last], minlength=n)
    if rule == "start":
        return np.bincount(first, minlength=n).astype(float), crossing
    counts = np.bincount(first[first == last], minlength=n).astype(float)
    begins = np.concatenate(([0], bounds[:-1]))
    for k in np.flatnonzero(first < last):
        touched = np.arange(first[k], last[k] + 1)
        held = np.minimum(bounds[touched], ends[k]) - np.maximum(begins[touched], starts[k])
        if rule == "split":
            counts[touched] += held / lengths[k]
        else:
            counts[touched[np.argmax(held)]] += 1
    return counts, crossing


def _rows(doc_id: int, text: str, enc, token_bytes: np.ndarray, rule: str) -> Iterator[tuple]:
    ids = np.asarray(encoded(enc, text), np.int64)
    parts = line_sections(text) or [""]
    byte_ends = np.cumsum([len(x.encode()) for x in parts])
    counts, crossing = attribute(token_bytes[ids], byte_ends, rule)
    at = 0
    for k, part in enumerate(parts):
        yield doc_id, k, at, at + len(part), float(counts[k]), int(crossing[k]), len(ids)
        at += len(part)


def token_counts(docs: DataFrame, ranks_path: str, rule: str = "most", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per section: doc_id, section, its code points [char_start, char_end), n_tokens, n_crossing (tokens
    that begin in it and end in a later one) and doc_tokens. One pass, no shuffle; a task holds one batch."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())

    def count(batches):
        enc, token_bytes = encoder(ranks_path)
        for batch in batches:
            rows = [
                row
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for row in _rows(doc_id, text or "", enc, token_bytes, rule)
            ]
            columns = zip(*rows, strict=True) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(count, SCHEMA)
