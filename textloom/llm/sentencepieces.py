"""SentencePiece encoding and decoding by a max-plus parallel scan.

The piece sequence of a text is the one path through the lattice of pieces on which every two neighbours are
compatible, that is, on which merging their joint text gives just these two. Compatible steps weigh minus one (so
values count pieces), all others minus infinity. A giant document is cut into chunks at any place. A boundary state
is a piece that covers the last character before the boundary; a chunk yields the max-plus matrix from the states at
its left end to those at its right end, from its own characters and a margin. Matrices combine associatively; the
scan over a document's matrices fixes the state at every boundary, and each chunk is then traced back by itself.

A piece never reaches over a word's start (a blank after something else), so a chunk's inner words don't hang on
the states: they are encoded once per distinct word by the public library and kept in a bounded table. Only the
words at the boundaries go through the lattice; a chunk without a word's start goes through it whole.

A chunk without a word's start (long runs of blanks or dashes) costs one walk, whatever its boundary states: each step is
tested once and carries the values from all of them.

Defined results: a null or empty text has no pieces; U+2581 in a text counts as a blank, as in the library, and is
decoded as one; characters that the model lacks become their bytes; repeated rows and rows without an id are encoded,
decoded and digested each by itself, whatever their length; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import functools
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep

BLANK = "▁"
#: Code points of a chunk; a longer document is giant.
CHUNK = 8192
#: Characters looked at beyond a chunk on either side; longer than twice the longest piece.
MARGIN = 64
#: Chunks whose matrices are scanned in one go; those of a longer document are combined in blocks of so many first.
BLOCK = 1024
CACHED_WORDS = 200_000
Span = tuple[int, int]
Matrix = dict[Span, dict[Span, int]]
START: Span = (-1, 0)


class Model:
    """The pieces of a model file, and the relations that the lattice needs."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        p = self.library
        ids = range(p.vocab_size())
        special = [p.is_control(i) or p.is_unknown(i) or p.is_byte(i) for i in ids]
        self.ids = {p.id_to_piece(i): i for i in ids if not special[i]}
        self.scores = {p.id_to_piece(i): p.get_score(i) for i in ids if not special[i]}
        self.longest = max(map(len, self.ids))
        if MARGIN < 2 * self.longest:
            raise ValueError(f"MARGIN must be at least twice the longest piece, which has {self.longest} characters")
        self.bytes = {int(p.id_to_piece(i)[3:5], 16): i for i in ids if p.is_byte(i)}
        self.unknown = p.unk_id()
        self.texts = [b"" if s and not p.is_byte(i) else bytes([int(p.id_to_piece(i)[3:5], 16)]) if s else p.id_to_piece(i).replace(BLANK, " ").encode() for i, s in zip(ids, special, strict=True)]
        # Ids of words as packed numbers; when the table is full it becomes the older one, and what is asked for again moves back.
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.odd: set[str] = set()  # words that decoding doesn't give back
        self.compatible = functools.lru_cache(50_000)(self.compatible)
        self.whole = functools.lru_cache(30_000)(self.whole)

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text: of the neighbours whose joint text is a piece the best-scored merge first, the
        leftmost of equals."""
        parts = list(text)
        while True:
            found = [(-self.scores[x], i) for i, x in enumerate(map("".join, zip(parts, parts[1:], strict=False))) if x in self.scores]
            if not found:
                return parts
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def whole(self, piece: str) -> bool:
        return self.merged(piece) == [piece]

    def compatible(self, a: str, b: str) -> bool:
        return self.merged(a + b) == [a, b]

    def ends(self, text: str, i: int, most: int) -> Iterator[int]:
        """Ends of the pieces that begin at i, up to most."""
        for j in range(i + 1, min(i + self.longest, most) + 1):
            if j == i + 1 or (text[i:j] in self.ids and self.whole(text[i:j])):
                yield j

    def piece_ids(self, piece: str) -> list[int]:
        if piece in self.ids:
            return [self.ids[piece]]
        return [self.bytes[b] for b in piece.encode()] if self.bytes else [self.unknown]

    def know(self, lists: Iterable[list[str]]) -> None:
        """Have the ids of all words of these lists at hand. The library is asked once for all that are new, as a call costs
        it more than many words."""
        words = set().union(*lists)
        new = words - self.words.keys()
        if not new:
            return
        if len(self.words) + len(new) > CACHED_WORDS:
            self.older, self.words, new = self.words, {}, words
            self.odd = {w for w in self.odd if w in self.older}
        missing = []
        for w in new:
            if (ids := self.older.get(w)) is None:
                missing.append(w)
            else:
                self.words[w] = ids
        plain = [w[1:].replace(BLANK, " ") for w in missing]
        for w, x, ids in zip(missing, plain, self.library.encode(plain, num_threads=1), strict=True):
            ids = ids if len(w) > 1 else [self.ids[BLANK]]
            self.words[w] = packed(ids)
            if self.decode(ids) != " " + x:
                self.odd.add(w)

    def word_ids(self, words: list[str]) -> bytes:
        """Ids of whole words that are known, each with its leading blanks (marked), as packed 32-bit numbers."""
        return b"".join(map(self.words.__getitem__, words))

    def encode_words(self, words: list[str]) -> list[int]:
        self.know([words])
        return np.frombuffer(self.word_ids(words), np.int32).tolist()

    def gives_back(self, words: list[str], ids: bytes, text: str) -> bool:
        """Whether decoding gives the text of these words back. Where it does for each word, it does for all."""
        if not self.odd or self.odd.isdisjoint(words):
            return True
        return self.decode(np.frombuffer(ids, np.int32).tolist()) == text

    def decode(self, ids: Iterable[int]) -> str:
        """Text of the ids, with the blank that encoding puts in front of a document."""
        return b"".join(map(self.texts.__getitem__, ids)).decode(errors="replace")


@functools.cache
def model(path: str) -> Model:
    return Model(path)


def packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


def marked(text: str) -> str:
    return BLANK + text.replace(" ", BLANK) if text else ""


def split_words(text: str) -> list[str]:
    """A marked text that begins at a word's start, cut into words with their leading blanks."""
    parts = text.split(BLANK)[1:]
    if "" not in parts:
        return [BLANK + x for x in parts]
    out, blanks = [], ""
    for x in parts:
        blanks += BLANK
        if x:
            out.append(blanks + x)
            blanks = ""
    return [*out, blanks] if blanks else out


def is_word_start(text: str, i: int) -> bool:
    return text[i] == BLANK and (i == 0 or text[i - 1] != BLANK)


def next_word_start(text: str, i: int, stop: int) -> int | None:
    while (i := text.find(BLANK, i, stop)) >= 0:
        if is_word_start(text, i):
            return i
        i += 1
    return None


def last_word_start(text: str, start: int, i: int) -> int | None:
    while (i := text.rfind(BLANK, start, i)) >= 0:
        if is_word_start(text, i):
            return i
    return None


def paths(m: Model, text: str, first: Span, stop: int) -> tuple[dict[Span, tuple[int, Span | None]], int]:
    """Lattice from one state on: best value and predecessor of every state that begins before stop, and the text's
    length as its limit. A state that begins at a word's start or at the text's start follows any other."""
    best: dict[Span, tuple[int, Span | None]] = {first: (0, None)}
    at: dict[int, list[Span]] = {first[1]: [first]}
    for j in range(first[1], stop):
        free = j == 0 or is_word_start(text, j)
        for s in at.pop(j, ()):
            for e in m.ends(text, j, len(text)):
                value = best[s][0] - 1
                if (free or s[0] < 0 or m.compatible(text[s[0] : j], text[j:e])) and value > best.get((j, e), (value - 1, None))[0]:
                    if (j, e) not in best:
                        at.setdefault(e, []).append((j, e))
                    best[(j, e)] = (value, s)
    return best, len(text)


def boundary_states(m: Model, text: str, b: int) -> list[Span]:
    """Pieces that cover the last character before b; reachable ones alone where a word's start is near."""
    if b == 0:
        return [START]
    if b >= len(text):
        b = len(text)
    if (h := last_word_start(text, max(0, b - MARGIN + 1), b)) is not None:
        best, _ = paths(m, text, (-1, h), b)
        return sorted(s for s in best if s[0] >= h and s[0] < b <= s[1])
    return [(i, j) for i in range(max(0, b - m.longest), b) for j in m.ends(text, i, len(text)) if j >= b]


def spread(m: Model, text: str, firsts: list[Span], stop: int) -> dict[Span, np.ndarray]:
    """The same lattice from several states at once, for a text without a word's start before stop: for every state the
    best value from each of the first ones (minus infinity: none). Each step is tested once for all of them."""
    best = {s: np.where(np.arange(len(firsts)) == k, 0.0, -np.inf) for k, s in enumerate(firsts)}
    at: dict[int, list[Span]] = {}
    for s in firsts:
        at.setdefault(s[1], []).append(s)
    for j in range(min(at, default=stop), stop):
        for s in at.pop(j, ()):
            value = best[s] - 1
            for e in m.ends(text, j, len(text)):
                if j == 0 or s[0] < 0 or m.compatible(text[s[0] : j], text[j:e]):
                    if (j, e) in best:
                        np.maximum(best[(j, e)], value, out=best[(j, e)])
                    else:
                        best[(j, e)] = value.copy()
                        at.setdefault(e, []).append((j, e))
    return best


def transfer(m: Model, text: str, lo: int, hi: int, last: bool) -> Matrix:
    """Max-plus matrix of the chunk [lo, hi) of a text that holds the chunk and its margins (lo = 0 only for the
    document's first). The last chunk has the states that end with the text."""
    outs = [s for s in boundary_states(m, text, hi) if not last or s[1] == hi]
    firsts = boundary_states(m, text, lo)
    h1 = next_word_start(text, max(lo, 1), hi)
    if h1 is None:
        found = spread(m, text, firsts, hi)
        rows = {s: {x: int(found[x][k]) for x in outs if x in found and np.isfinite(found[x][k])} for k, s in enumerate(firsts)}
        return {s: row for s, row in rows.items() if row}
    best, _ = paths(m, text, (-1, last_word_start(text, h1, hi)), hi)
    right = {s: best[s][0] for s in outs if s in best}
    out: Matrix = {}
    for s in firsts:
        best, _ = paths(m, text, s, h1)
        done = [v for x, (v, _) in best.items() if x[1] == h1]
        if done and right:
            out[s] = {x: max(done) + v for x, v in right.items()}
    return out


def combined(a: Matrix, b: Matrix) -> Matrix:
    """Max-plus product, which is associative."""
    out: Matrix = {}
    for s, row in a.items():
        new: dict[Span, int] = {}
        for mid, v in row.items():
            for x, w in b.get(mid, {}).items():
                new[x] = max(new.get(x, v + w), v + w)
        if new:
            out[s] = new
    return out


def scanned(matrices: list[Matrix], first: Span = START, last: Span | None = None) -> list[Span]:
    """The state at the right end of every chunk: prefix products from the first state, then back from the last one (the
    best, if none is given)."""
    prefixes: list[Matrix] = [{first: matrices[0][first]}]
    for x in matrices[1:]:
        prefixes.append(combined(prefixes[-1], x))
    ends = prefixes[-1][first]
    states = [max(ends, key=lambda s: (ends[s], s)) if last is None else last]
    for before, here in zip(prefixes[-2::-1], matrices[:0:-1], strict=True):
        row = before[first]
        states.append(max((s for s in row if states[-1] in here.get(s, {})), key=lambda s: (row[s] + here[s][states[-1]], s)))
    return states[::-1]


Trace = tuple[list[int], list[str], list[int], int, int]


def trace(m: Model, text: str, before: Span, after: Span) -> Trace:
    """What stands after one state up to and with another: ids before the first word's start, whole words, ids from the
    last word's start on, and where the words begin and end."""
    lo, hi = before[1], after[1]

    def through(first: Span, stop: int, end: Span | None) -> list[int]:
        best, _ = paths(m, text, first, stop)
        if end is None:
            end = max((s for s in best if s[1] == stop), key=lambda s: best[s][0])
        pieces = []
        while end is not None and end != first:
            pieces.append(m.piece_ids(text[end[0] : end[1]]))
            end = best[end][1]
        return [i for p in reversed(pieces) for i in p]

    if after == before:
        return [], [], [], lo, lo
    h1 = next_word_start(text, lo, after[0] + 1)
    if h1 is None:
        return through(before, hi, after), [], [], hi, hi
    hn = last_word_start(text, h1, after[0] + 1)
    head = through(before, h1, None) if h1 > lo else []
    return head, split_words(text[h1:hn]) if hn > h1 else [], through((-1, hn), hi, after), h1, hn


def traced(m: Model, text: str, before: Span, after: Span) -> list[int]:
    """Ids of the pieces after one state up to and with another."""
    head, words, tail, _, _ = trace(m, text, before, after)
    return head + m.encode_words(words) + tail


def _chunked(text: str, size: int) -> Iterator[tuple[int, int, str, int]]:
    """number, offset of the piece of text, that piece (with margins), and the chunk's own end, of every chunk."""
    whole = marked(text)
    for k, lo in enumerate(range(0, len(whole), size)):
        hi = min(lo + size, len(whole))
        at = max(0, lo - MARGIN)
        yield k, at, whole[at : hi + MARGIN], hi


def _giants(docs: DataFrame, size: int) -> DataFrame:
    """The chunks of giant documents, with margins, packed. Each row of docs has a key, made once and kept: ids may be
    null or repeated."""

    def rows(batches):
        for batch in batches:
            for row, doc_id, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for part in _some(_chunked(text, size), 64):
                    k, at, piece, hi = zip(*part, strict=True)
                    n = -(-(len(text) + 1) // size)
                    packed = [zlib.compress(x.encode(), 1) for x in piece]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row] * len(k), pa.int64()), pa.array([doc_id] * len(k), pa.int64()), pa.array(k, pa.int32()), pa.array([n] * len(k), pa.int32()), pa.array(at, pa.int64()), pa.array(hi, pa.int64()), pa.array(packed, pa.binary())],
                        ["row", "doc_id", "chunk", "n_chunks", "at", "hi", "piece"],
                    )

    keyed = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return keep(keyed.mapInArrow(rows, "row bigint, doc_id bigint, chunk int, n_chunks int, at bigint, hi bigint, piece binary"))


def _some(items: Iterator, n: int) -> Iterator[list]:
    held: list = []
    for x in items:
        held.append(x)
        if len(held) == n:
            yield held
            held = []
    if held:
        yield held


def _flat(t: Matrix) -> list[int]:
    return [x for s, row in t.items() for e, v in row.items() for x in (*s, *e, v)]


def _matrix(flat) -> Matrix:
    t: Matrix = {}
    for a, b, c, d, v in np.asarray(flat, np.int64).reshape(-1, 5).tolist():
        t.setdefault((a, b), {})[(c, d)] = v
    return t


STATES = "b0 bigint, b1 bigint, a0 bigint, a1 bigint"


def _states(chunks: DataFrame, path: str, size: int, block: int) -> DataFrame:
    """row, chunk, and the states before and after it (start and end of a piece), for every chunk."""

    def matrices(batches):
        m = model(path)
        for batch in batches:
            out = []
            for k, n, at, hi, piece in zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True):
                t = transfer(m, zlib.decompress(piece).decode(), k * size - at, hi - at, k == n - 1)
                shift = lambda s, at=at: s if s == START else (s[0] + at, s[1] + at)
                out.append(_flat({shift(s): {shift(e): v for e, v in row.items()} for s, row in t.items()}))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.list_(pa.int64()))], ["row", "chunk", "n_chunks", "matrix"])

    def states(pdf, key, first=START, last=None):
        after = scanned([_matrix(x) for x in pdf["matrix"]], first, last)
        before = [first, *after[:-1]]
        return pdf[["row", key]].assign(
            b0=[s[0] for s in before], b1=[s[1] for s in before], a0=[s[0] for s in after], a1=[s[1] for s in after]
        )

    def whole(pdf):
        return states(pdf.sort_values("chunk"), "chunk")

    def product(pdf):
        found = [_matrix(x) for x in pdf.sort_values("chunk")["matrix"]]
        return pdf[["row", "block"]].head(1).assign(matrix=[_flat(functools.reduce(combined, found))])

    def ends(pdf):
        return states(pdf.sort_values("block"), "block")

    def inner(pdf):
        b0, b1, a0, a1 = (int(pdf[c].iloc[0]) for c in ("b0", "b1", "a0", "a1"))
        return states(pdf.sort_values("chunk"), "chunk", (b0, b1), (a0, a1))

    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Dealt out by chunk, so that a giant's matrices are made in many tasks.
    dealt = chunks.select("row", "chunk", "n_chunks", "at", "hi", "piece").repartition(n, "row", "chunk")
    rows = dealt.mapInArrow(matrices, "row bigint, chunk int, n_chunks int, matrix array<bigint>")
    rows = keep(rows)
    short = rows.filter(F.col("n_chunks") <= block).repartition(n, "row").groupBy("row").applyInPandas(whole, f"row bigint, chunk int, {STATES}")
    blocks = rows.filter(F.col("n_chunks") > block).withColumn("block", F.expr(f"chunk div {block}"))
    products = blocks.groupBy("row", "block").applyInPandas(product, "row bigint, block bigint, matrix array<bigint>")
    at = products.groupBy("row").applyInPandas(ends, f"row bigint, block bigint, {STATES}")
    return short.union(blocks.join(at, ["row", "block"]).groupBy("row", "block").applyInPandas(inner, f"row bigint, chunk int, {STATES}"))


ENCODED = "doc_id bigint, chunk int, n_chars bigint, ids array<int>, exact boolean, row bigint, digest bigint"
DIGEST_BASE = 0x9E3779B97F4A7C15
WRAP = (1 << 64) - 1


@functools.cache
def _powers(n: int) -> np.ndarray:
    """Falling powers of the base, n of them (a power of two)."""
    powers = np.full(n, DIGEST_BASE, np.uint64)
    powers[:1] = 1
    return np.cumprod(powers)[::-1]


def digest_of(ids) -> int:
    """Polynomial over the ids modulo 2^64, as a signed number."""
    x = np.asarray(ids)
    powers = _powers(1 << len(x).bit_length())
    return int(((x.astype(np.uint64) + np.uint64(1)) * powers[len(powers) - len(x) :]).sum(dtype=np.uint64).view(np.int64)) if len(x) else 0


def _encoded(doc_ids, chunks, sizes, ids: list[bytes], exact, rows=None) -> pa.RecordBatch:
    ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
    flat = np.frombuffer(b"".join(ids), np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
    digests = [digest_of(flat[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
    return pa.RecordBatch.from_arrays(
        [pa.array(doc_ids, pa.int64()), pa.array(chunks, pa.int32()), pa.array(sizes, pa.int64()), lists, pa.array(exact, pa.bool_()), pa.array(rows or [None] * len(ids), pa.int64()), pa.array(digests, pa.int64())],
        ["doc_id", "chunk", "n_chars", "ids", "exact", "row", "digest"],
    )


def encode(
    docs: DataFrame, path: str, size: int = CHUNK, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK
) -> DataFrame:
    """doc_id, chunk, n_chars (with the blank in front), ids, exact (decoding gives the text back), row, and digest (of the
    ids): a row for each document, or for each chunk of a giant one; a document's ids are those of its chunks in order.
    The chunks of one giant share `row`, which is null for other documents."""
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    giant = F.length("text") >= size

    def plain(batches):
        m = model(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [marked(t) for t in part.column(1).to_pylist()]
                words = [split_words(t) for t in texts]
                m.know(words)
                ids = [m.word_ids(w) for w in words]
                exact = [m.gives_back(w, i, t.replace(BLANK, " ") if m.odd else "") for w, i, t in zip(words, ids, texts, strict=True)]
                yield _encoded(part.column(0), [0] * len(texts), map(len, texts), ids, exact)

    def traces(batches):
        m = model(path)
        for batch in batches:
            names = batch.schema.names
            rows = [dict(zip(names, x, strict=True)) for x in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
            for part in _some(iter(rows), 100):
                found = []
                for r in part:
                    local = lambda a, b, at=r["at"]: START if (a, b) == START else (a - at, b - at)
                    before, after, piece = local(r["b0"], r["b1"]), local(r["a0"], r["a1"]), zlib.decompress(r["piece"]).decode()
                    found.append((piece.replace(BLANK, " "), before[1], after[1], *trace(m, piece, before, after)))
                m.know([words for _, _, _, _, words, _, _, _ in found])
                ids, exact = [], []
                for text, lo, hi, head, words, tail, h1, hn in found:
                    inner = m.word_ids(words)
                    ids.append(packed(head) + inner + packed(tail))
                    exact.append(m.decode(head) == text[lo:h1] and m.decode(tail) == text[hn:hi] and m.gives_back(words, inner, text[h1:hn]))
                sizes = [hi - lo for _, lo, hi, *_ in found]
                yield _encoded([r["doc_id"] for r in part], [r["chunk"] for r in part], sizes, ids, exact, [r["row"] for r in part])

    chunks = _giants(rows.filter(giant), size)
    states = keep(_states(chunks, path, size, block))
    placed = chunks.join(states, ["row", "chunk"])
    # Constant nullness of `row`: the plan of _split() then runs one side of the union for each part.
    short = rows.filter(~giant).mapInArrow(plain, ENCODED).withColumn("row", F.lit(None).cast("bigint"))
    return short.union(placed.mapInArrow(traces, ENCODED).withColumn("row", F.coalesce("row", F.lit(-1).cast("bigint"))))


def _split(encoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that are a whole document, and the chunks of giants."""
    return encoded.filter("row is null"), encoded.filter("row is not null")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text, per document: each row is decoded by itself, a giant's rows are joined in order, and the blank in
    front goes."""

    def texts(batches):
        m = model(path)
        for batch in batches:
            found = [m.decode(i) for i in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), batch.column(3)], ["doc_id", "chunk", "text", "row"])

    short, chunks = (x.select("doc_id", "chunk", "ids", "row").mapInArrow(texts, "doc_id bigint, chunk int, text string, row bigint") for x in _split(encoded))
    parts = F.array_sort(F.collect_list(F.struct("chunk", "text")))
    whole = F.array_join(F.transform(parts, lambda x: x["text"]), "")
    giants = chunks.groupBy("row").agg(F.first("doc_id").alias("doc_id"), whole.alias("t")).select("doc_id", "t")
    return short.select("doc_id", F.col("text").alias("t")).union(giants).select("doc_id", F.substring("t", 2, F.length("t")).alias("text"))


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_pieces, ids_digest (a polynomial over the ids modulo 2^64, in hex) and exact, per document. Digests of
    chunks combine in order, so ids never leave their task."""

    def joined(parts) -> str:
        total = 0
        for _, n, d in sorted((p["chunk"], p["n"], p["d"]) for p in parts):
            total = (total * pow(DIGEST_BASE, n, 1 << 64) + d) & WRAP
        return f"{total:016x}"

    @F.pandas_udf("string")
    def join_all(s):
        return s.map(joined)

    slim = encoded.select("doc_id", "chunk", F.size("ids").cast("bigint").alias("n"), F.col("digest").alias("d"), "exact", "row")
    short, chunks = _split(slim)
    giants = chunks.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.sum("n").alias("n_pieces"), F.collect_list(F.struct("chunk", "n", "d")).alias("parts"), F.bool_and("exact").alias("exact")
    )
    return short.select("doc_id", F.col("n").alias("n_pieces"), F.lpad(F.lower(F.hex("d")), 16, "0").alias("ids_digest"), "exact").union(
        giants.select("doc_id", "n_pieces", join_all("parts").alias("ids_digest"), "exact")
    )
