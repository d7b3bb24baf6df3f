"""Substring dedup by de Bruijn compaction.

Edges are word k-mers (K = 20 words), nodes the 19-mers between them. Every k-mer has an anchor, the smallest hash among
its inner 10-mers; equal k-mers have equal anchors, so k-mers whose anchor comes once in all documents can't repeat and
need no further look. For the nodes of the others Spark gathers the words before and after them over all documents (a
document's end counts as a word of its own): a node with two different ones on a side branches. Documents are cut at
branching nodes, and what lies between is a nonbranching path. All occurrences of a k-mer share their path whole, since
each inner node has one way in and one way out everywhere, so paths meet as one row each and never overlap in part.

The first occurrence of each path, by its source coordinates, is found by a partially aggregated minimum and joined
back to the others. Paths that meet are verified at their coordinates: their key comes from 64-bit hashes of their
words, and the check beside it from other 32-bit hashes of each of their words. Every occurrence but the first is a
repeated span. A task settles repeats among its own documents before anything is shuffled, so a passage that a third of
all documents hold reaches the shuffle once per task and buffer.

Branching nodes are sent as a filter of fixed size. A node that it takes for branching cuts the same path at the same
place in every document, which changes no result.

Defined results: a null text has no words (n_removed 0, the digest of the empty text), nor has one of white space;
texts under K words lose nothing; rows that share an id count as one document, of which no row is earlier than
another, and lose the words of all spans found for that id; rows with a null id lose nothing and take nothing from
others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, words, written
from .hashing import BASE, bit_filter, lists, mixed, passes, slot_of, windows

K, INNER = 20, 10
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: k-mers that a task holds at once.
BUFFER = 1_500_000
#: Bits of the filters of anchors and of branching nodes: 16 MB each, whatever the data.
ANCHOR_BITS = 1 << 27
#: Stands for the word before a document's first and after its last.
END = np.uint64(0)


def anchors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every k-mer the place of its anchor, and for every place the inner hash."""
    inner = windows(hashes, INNER)
    span = K - INNER + 1
    if len(inner) < span:
        return np.zeros(0, np.int64), inner
    return np.lib.stride_tricks.sliding_window_view(inner, span).argmin(1) + np.arange(len(inner) - span + 1), inner


def _repeated_anchors(hashed: DataFrame) -> np.ndarray:
    """Filter of the anchors that come twice or more."""

    def counted(batches):
        held: list[np.ndarray] = []
        n = 0

        def flush():
            u, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_pydict({"a": u.view(np.int64), "c": np.minimum(c, 2)})

        for batch in batches:
            for x in lists(batch, 1):
                at, inner = anchors(x)
                held.append(inner[np.unique(at)])
                n += len(held[-1])
                if n >= BUFFER:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    found = hashed.mapInArrow(counted, "a bigint, c bigint").groupBy("a").agg(F.sum("c").alias("c")).filter("c > 1")
    return bit_filter(found.select(F.pmod("a", F.lit(ANCHOR_BITS)).alias("slot")), ANCHOR_BITS)


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(ANCHOR_BITS - 1)).astype(np.int64)


def _candidates(x: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether the anchor of each k-mer repeats."""
    at, inner = anchors(x)
    return passes(bits, _slots(inner[at])) if len(at) else np.zeros(0, bool)


def incident_nodes(x: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nodes at the ends of the candidate k-mers: hash, word before, word after."""
    touched = np.zeros(len(hot) + 1, bool)
    touched[:-1] |= hot
    touched[1:] |= hot
    j = np.flatnonzero(touched)
    before, after = np.concatenate(([END], x)), np.concatenate((x, [END]))
    return windows(x, K - 1)[j], before[j], after[j + K - 1]


def _branching(hashed: DataFrame, bits: np.ndarray) -> np.ndarray:
    """Filter of the nodes with more than one word before or after them. A task sends each of its nodes once, without
    the words where it branches among the task's own documents."""
    sent = hashed.sparkSession.sparkContext.broadcast(bits)

    def nodes(batches):
        held: list[tuple] = []
        n = 0

        def flush():
            node, before, after = (np.concatenate([h[i] for h in held]) for i in range(3))
            order = np.argsort(node)
            node, before, after = node[order], before[order], after[order]
            first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
            alike = np.ones(len(first), bool)
            for side in (before, after):
                alike &= np.minimum.reduceat(side, first) == np.maximum.reduceat(side, first)
            sides = [pa.array(side[first].view(np.int64), mask=~alike) for side in (before, after)]
            return pa.RecordBatch.from_arrays([pa.array(node[first].view(np.int64)), *sides], ["node", "before", "after"])

        for batch in batches:
            for x in lists(batch, 1):
                hot = _candidates(x, sent.value)
                if hot.any():
                    held.append(incident_nodes(x, hot))
                    n += len(held[-1][0])
                if n >= BUFFER:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    found = hashed.mapInArrow(nodes, "node bigint, before bigint, after bigint").groupBy("node").agg(
        *[f(c).alias(f"{c}_{f.__name__}") for c in ("before", "after") for f in (F.min, F.max)], F.count("before").alias("known"), F.count("*").alias("n")
    )
    found = found.filter("known < n or before_min <> before_max or after_min <> after_max")
    return bit_filter(found.select(F.pmod("node", F.lit(ANCHOR_BITS)).alias("slot")), ANCHOR_BITS)


def paths_of(x: np.ndarray, words32: np.ndarray, hot: np.ndarray, branching: np.ndarray) -> tuple[np.ndarray, ...]:
    """Nonbranching paths of a document's candidate k-mers: key, check, place and length."""
    nodes = windows(x, K - 1)
    cut = passes(branching, _slots(nodes))
    before = np.concatenate(([False], hot[:-1]))
    after = np.append(hot[1:], False)
    start = np.flatnonzero(hot & (~before | cut[:-1]))
    end = np.flatnonzero(hot & (~after | cut[1:])) + 1
    length = end - start
    h = windows(x, K)
    key = mixed(h[start] ^ mixed(h[end - 1] + length.astype(np.uint64)))
    return key, _check(words32, start, end + K - 1), start, length


def _check(words32: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of all words of the runs [start, end)."""
    values = mixed(words32.astype(np.int64).view(np.uint64), 5)
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    powers, inverses = np.full(len(values) + 1, BASE, np.uint64), np.full(len(values) + 1, inverse, np.uint64)
    powers[0] = inverses[0] = 1
    powers, inverses = np.cumprod(powers), np.cumprod(inverses)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * powers[:-1])))
    return mixed((sums[end] - sums[start]) * inverses[start])


PATH = "key bigint, check bigint, doc_id bigint, at int, n int"


def _paths(hashed: DataFrame, bits: np.ndarray, branching: np.ndarray) -> DataFrame:
    """The task's first occurrence of each path, and (key null) the later ones, which are settled."""
    sent = hashed.sparkSession.sparkContext.broadcast((bits, branching))

    def rows(batches):
        held: list[tuple] = []
        n = 0

        def flush():
            ids = np.concatenate([np.full(len(p[0]), d, np.int64) for d, p in held])
            key, check, at, length = (np.concatenate([p[i] for _, p in held]) for i in range(4))
            order = np.lexsort((at, ids, check, key))
            key, check, at, length, ids = (a[order] for a in (key, check, at, length, ids))
            new = np.ones(len(order), bool)
            new[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
            first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            later = (ids > ids[first]) | (at > at[first])
            shown = new | later
            some = lambda a: pa.array(a.view(np.int64)[shown], mask=later[shown])
            return pa.RecordBatch.from_arrays(
                [some(key), some(check), pa.array(ids[shown]), pa.array(at[shown], pa.int32()), pa.array(length[shown], pa.int32())],
                ["key", "check", "doc_id", "at", "n"],
            )

        for batch in batches:
            for doc_id, x, words32 in zip(batch.column(0).to_pylist(), lists(batch, 1), short_lists(batch, 2), strict=True):
                hot = _candidates(x, sent.value[0])
                if hot.any():
                    held.append((doc_id, paths_of(x, words32, hot, sent.value[1])))
                    n += len(held[-1][1][0])
                if n >= BUFFER // 4:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    return hashed.mapInArrow(rows, PATH)


def short_lists(batch, column: int):
    """The arrays of a list column of 32-bit numbers."""
    col = batch.column(column)
    flat, ends = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
    for a, b in zip(ends, ends[1:], strict=False):
        yield flat[a:b]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans, an array of (at, n): runs of n k-mers from word `at` on that all start earlier elsewhere."""
    some = docs.filter(docs[id_col].isNotNull()).select(docs[id_col].alias("doc_id"), words(docs[text_col]).alias("w"))
    hashed = some.select("doc_id", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    bits = _repeated_anchors(hashed)
    branching = _branching(hashed, bits)
    both = some.select("doc_id", F.transform("w", lambda x: F.xxhash64(x)).alias("h"), F.transform("w", lambda x: F.hash(x)).alias("c"))
    with written(_paths(both, bits, branching)) as paths:
        open_ = paths.filter("key is not null")
        firsts = open_.groupBy("key", "check").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("m")).filter("m > 1")
        late = open_.join(firsts.select("key", "check", "first"), ["key", "check"]).filter("struct(doc_id, at) > first")
        spans = paths.filter("key is null").select("doc_id", "at", "n").union(late.select("doc_id", "at", "n"))
        return keep(spans.groupBy("doc_id").agg(F.collect_list(F.struct("at", "n")).alias("spans")))


def covered(spans: np.ndarray, n_words: int) -> np.ndarray:
    """Which words the runs (at, n) of k-mers cover."""
    edges = np.zeros(n_words + 1, np.int64)
    at, end = spans[:, 0], np.minimum(spans[:, 0] + spans[:, 1] + K - 1, n_words)
    ok = at < end
    np.add.at(edges, at[ok], 1)
    np.add.at(edges, end[ok], -1)
    return np.cumsum(edges)[:n_words] > 0


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text: the words left, joined by one blank.

    Only texts that may hold a span take part in the join; a filter of fixed size over the ids tells which."""
    spans = repeated_spans(docs, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(bit_filter(spans.select(slot_of(F.col("doc_id")).alias("slot"))))
    plain = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string"

    def finished(doc_id, words, gone):
        kept = " ".join(words)
        return doc_id, len(words) + gone, gone, hashlib.sha256(kept.encode()).hexdigest(), kept if with_text else None

    def batch_of(rows, names, types):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    names = [x.split()[0] for x in plain.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def parted(batches):
        for batch in batches:
            hit = passes(sent.value, batch.column(2).to_numpy())
            rows = [
                (doc_id, None, None, None, None, text) if h and doc_id is not None else (*finished(doc_id, WORD.findall(text), 0), None)
                for doc_id, text, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), hit, strict=True)
            ]
            if rows:
                yield batch_of(rows, [*names, "text"], [*types, pa.string()])

    def cut(batches):
        for batch in batches:
            rows = []
            for *ready, text, spans in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if text is None:
                    rows.append(tuple(ready))
                    continue
                words, gone = WORD.findall(text), 0
                if spans:
                    drop = covered(np.array([(s["at"], s["n"]) for s in spans], np.int64), len(words))
                    words, gone = [w for w, d in zip(words, drop, strict=True) if not d], int(drop.sum())
                rows.append(finished(ready[0], words, gone))
            if rows:
                yield batch_of(rows, names, types)

    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    first = rows.withColumn("slot", slot_of(F.col("doc_id"))).mapInArrow(parted, plain + ", text string")
    joined = first.join(spans.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"), "left").drop("_id")
    out = joined.mapInArrow(cut, plain)
    return out if with_text else out.drop("kept_text")
