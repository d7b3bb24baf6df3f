"""Merkle manifest of a dataset, with a proof for every document.

A leaf is the SHA-256 of a document's fields. The leaves of a part (the source), by id, are hashed in runs of 16 until one
node, the part's root, remains; the parts' roots, in order of the parts, lead to the root of all in the same way.

Spark numbers the leaves of each part (by range, with no task seeing a whole part) and deals them out in aligned blocks of
256, two levels of the tree. A block's root comes from a treehash: one unfinished run a level. The roots of blocks are the
leaves of the next tier, until each part has one, and the same leads from the parts to the root. On the way back every
block is walked leaf by leaf: for each level it holds the run that the present leaf's path goes through, and a treehash
that takes in one leaf of the next run at every step and so has that run ready when the walk gets there. What it holds
is one run and one treehash a level, whatever the tree's size. The path above a block's root is the same for all its leaves; it
is made once, a tier at a time, and appended to each.

Defined results: null fields are written as `-`, so null and empty text differ; a null id comes first in its part; rows with
equal ids are ordered by their leaves, and repeated rows are leaves of their own; a null source is a part of its own,
before all others; rows with a null id are not tampered with; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import keep
from .hashing import lower_ascii

#: Nodes of a run, and levels and leaves of a block.
ARITY = 16
LEVELS = 2
BLOCK = ARITY**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Own place in the run and the run's other nodes, from the leaf's level to the root's.
PATH = "ats array<int>, sibs array<string>"


def digest(text: str) -> str:
    return sha256(text.encode("ascii")).hexdigest()


def height(n: int) -> int:
    """Levels of a tree of n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


class Treehash:
    """Nodes of one level from leaves that come one at a time; below that level it holds one unfinished run a level."""

    def __init__(self, level: int):
        self.stack: list[list[str]] = [[] for _ in range(level + 1)]

    def _put(self, node: str, level: int) -> None:
        self.stack[level].append(node)
        if len(self.stack[level]) == ARITY and level + 1 < len(self.stack):
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.stack[level] = self.stack[level], []
        self._put(digest("".join(run)), level + 1)

    def push(self, leaf: str) -> None:
        self._put(leaf, 0)

    def finish(self) -> list[str]:
        """The nodes of the level, at most a run of them; the last of each level below may be of a shorter run."""
        for level in range(len(self.stack) - 1):
            if self.stack[level]:
                self._close(level)
        nodes, self.stack[-1] = self.stack[-1], []
        return nodes


def nodes_of(leaves: list[str], level: int) -> list[str]:
    tree = Treehash(level)
    for leaf in leaves:
        tree.push(leaf)
    return tree.finish()


def walk(leaves: list[str], levels: int) -> Iterator[tuple[list[int], list[str]]]:
    """For each leaf in turn the path to the root of a tree of so many levels: its place in the run of each level, and
    the other nodes of the run, joined."""
    spans = [ARITY ** (level + 1) for level in range(levels)]
    runs = [nodes_of(leaves[:span], level) for level, span in enumerate(spans)]
    ahead = [Treehash(level) for level in range(levels)]
    for i in range(len(leaves)):
        ats = [i // (span // ARITY) % ARITY for span in spans]
        yield ats, ["".join(run[:at] + run[at + 1 :]) for run, at in zip(runs, ats, strict=True)]
        for level, span in enumerate(spans):
            then = i + span  # the leaf of the next run that stands where i stands in this one
            if then < len(leaves):
                ahead[level].push(leaves[then])
            if (i + 1) % span == 0:
                runs[level] = ahead[level].finish()


def folded(node: str, ats: list[int], sibs: list[str]) -> str:
    """The root that a node and a path lead to."""
    size = len(sha256().hexdigest())
    for at, sib in zip(ats, sibs, strict=True):
        node = digest(sib[: at * size] + node + sib[at * size :])
    return node


def _levels(block: int, n: int) -> int:
    """Levels of a block of n nodes: all but a lone block go up the whole way."""
    return LEVELS if block else height(n)


def _ordered(table: pa.Table) -> tuple[pa.Table, int, int]:
    """The rows of a block by place, the block's number and its levels."""
    table = table.sort_by("pos")
    block = table["pos"][0].as_py() // BLOCK
    return table, block, _levels(block, table.num_rows)


def _hexes(table: pa.Table, name: str) -> list[str | None]:
    return [x and x.hex() for x in table[name].to_pylist()]


def _roots(nodes: DataFrame) -> DataFrame:
    """part, pos and node of the next tier: the root of each block of nodes (part, pos, node)."""

    def root(table: pa.Table) -> pa.Table:
        table, block, levels = _ordered(table)
        top = nodes_of(_hexes(table, "node"), levels)[0]
        return pa.table({"part": table["part"][:1], "pos": pa.array([block], pa.int64()), "node": pa.array([bytes.fromhex(top)], pa.binary())})

    return _blocks(nodes.select("part", "pos", "node")).applyInArrow(root, "part string, pos bigint, node binary")


def _blocks(nodes: DataFrame):
    return nodes.groupBy("part", F.floor(F.col("pos") / BLOCK).alias("block"))


def _tiers(nodes: DataFrame) -> list[DataFrame]:
    """The nodes, their blocks' roots, and so on until each part has one node."""
    tiers = [nodes]
    while True:
        tiers.append(keep(_roots(tiers[-1])))
        if not tiers[-1].filter("pos > 0").limit(1).count():
            return tiers


def _under(nodes: DataFrame, above: DataFrame, rows, schema: str) -> DataFrame:
    """rows(table, table of the one path above) for each block of nodes and its root's row in `above`."""
    return _blocks(nodes).cogroup(above.groupBy("part", F.col("pos").alias("block"))).applyInArrow(rows, schema)


def _paths(tiers: list[DataFrame], tops: DataFrame) -> DataFrame:
    """part, pos, path and `more` of the lowest of tiers (part, pos, node), from those of the highest (pos is 0)."""

    def down(table: pa.Table, above: pa.Table) -> pa.Table:
        table, _, levels = _ordered(table)
        ats, sibs = (above[c][0].as_py() for c in ("ats", "sibs"))
        own = [(a + ats, s + sibs) for a, s in walk(_hexes(table, "node"), levels)]
        return table.select(["part", "pos"]).append_column("ats", pa.array([a for a, _ in own], pa.list_(pa.int32()))).append_column(
            "sibs", pa.array([s for _, s in own], pa.list_(pa.string()))
        )

    for tier in reversed(tiers):
        tops = keep(_under(tier, tops, down, f"part string, pos bigint, {PATH}"))
    return tops


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """The rows with `pos`, their place in their part from 0 on. They are dealt out by range; a task sees the rows of one
    slice, and one count for each part and slice besides. Equal rows, which a range can't part, are told apart by number."""
    order = (*order, "__tie")
    dealt = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange("part", *order)
    dealt = keep(dealt.withColumn("__slice", F.spark_partition_id()))
    counts = dealt.groupBy("part", "__slice").agg(F.count("*").alias("__n"))
    before = W.partitionBy("part").orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("part", "__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(W.partitionBy("part", "__slice").orderBy(*order))
    placed = dealt.withColumn("__own", own).join(counts, ["part", "__slice"])
    return placed.withColumn("pos", F.col("__before") + F.col("__own") - 1).drop("__tie", "__slice", "__own", "__before")


def leaf(values: list[Column]) -> Column:
    """SHA-256 of fields, each `-` if null, else its bytes in UTF-8, a colon and its text."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in values]), 256)


def leaves(docs: DataFrame, altered: Column | None = None, where: Column | None = None) -> DataFrame:
    """doc_id, part (a key in order of the sources: null first), leaf, and `forged`: the leaf with the text altered, where
    the condition holds, else null."""
    fields = {c: docs[c].cast("string") for c in FIELDS}
    changed = fields | {"text": altered}
    forged = F.lit(None).cast("string") if altered is None else F.when(where, leaf([changed[c] for c in FIELDS]))
    return docs.select(
        docs["doc_id"].alias("doc_id"), F.coalesce(F.concat(F.lit("="), fields["source"]), F.lit("")).alias("part"),
        F.unhex(leaf(list(fields.values()))).alias("node"), F.unhex(forged).alias("forged"),
    )


ROWS = "doc_id bigint, part string, pos bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame, altered: Column | None = None, where: Column | None = None, paths: bool = False) -> DataFrame:
    """ROWS for documents (doc_id, source, lang, n_chars, text), and with `paths` also PATH, the whole proof.

    altered and where: another text for the documents of a condition. The proofs are those of the documents as they
    are; folded_root is what a proof leads to from the leaf of the altered document."""
    # Leaves are kept: dealing them out by range looks at them twice, and texts are to be read once.
    own = keep(_numbered(keep(leaves(docs, altered, where)), "doc_id", "node"))
    tiers = _tiers(own.select("part", "pos", "node"))
    parts = tiers[-1].select(F.lit("").alias("part"), F.col("part").alias("of"), "node")
    parts = keep(_numbered(parts, "of"))
    whole = _tiers(parts.select("part", "pos", "node"))
    none = {"ats": F.array().cast("array<int>"), "sibs": F.array().cast("array<string>")}
    shared = _paths(whole[:-1], whole[-1].select("part", "pos", *[x.alias(c) for c, x in none.items()]))
    roots = whole[-1].select(F.hex("node").alias("root"))
    shared = shared.join(parts.select("pos", "of", "node"), "pos").crossJoin(F.broadcast(roots))
    shared = keep(shared.select(F.col("of").alias("part"), "ats", "sibs", F.lower(F.hex("node")).alias("subroot"), F.lower("root").alias("root")))
    upper = _paths(tiers[1:-1], shared.select("part", F.lit(0).cast("bigint").alias("pos"), "ats", "sibs"))
    upper = upper.join(shared.select("part", "subroot", "root"), "part")

    def documents(table: pa.Table, above: pa.Table) -> pa.Table:
        table, _, levels = _ordered(table)
        ats, sibs, subroot, root = (above[c][0].as_py() for c in ("ats", "sibs", "subroot", "root"))
        upper_sibs, n = "".join(sibs), table.num_rows
        nodes, out = _hexes(table, "node"), {"proof_sha256": [], "folded_root": [], "ats": [], "sibs": []}
        for forged, node, (a, s) in zip(_hexes(table, "forged"), nodes, walk(nodes, levels), strict=True):
            out["proof_sha256"].append(digest("".join(s) + upper_sibs))
            out["folded_root"].append(folded(forged or node, a + ats, s + sibs))
            if paths:
                out["ats"].append(a + ats)
                out["sibs"].append(s + sibs)
        columns = {"doc_id": table["doc_id"], "part": table["part"], "pos": table["pos"], "leaf": nodes, "subroot": [subroot] * n, "root": [root] * n}
        columns |= {c: out[c] for c in ("proof_sha256", "folded_root")} | {"verified": [x == root for x in out["folded_root"]]}
        return pa.table(columns | ({"ats": pa.array(out["ats"], pa.list_(pa.int32())), "sibs": out["sibs"]} if paths else {}))

    return _under(own, upper, documents, f"{ROWS}, {PATH}" if paths else ROWS)


def lower_text(docs: DataFrame) -> Column:
    """The text with A-Z in lower case: what the query's tampering does."""
    return lower_ascii(docs["text"].cast("string"))


def tampered(docs: DataFrame) -> Column:
    """Whether 5 divides the unsigned crc32 of the decimal doc_id."""
    return F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 5 == 0, F.lit(False))
