"""Secret scans (native DataFrame functions only).

Base kinds come from patterns. Besides, two character Markov models (random strings, ordinary identifiers) score
every long token, less the base spans in it; where the log-likelihood ratio favours a random string, the token, or
each remaining part of it that does, is a span of kind `random`. The models are trained on labelled samples, at most MAX_SAMPLES of them, by counting
character pairs, and their ratio goes into the expression as whole numbers (thousandths of a nat).

Defined results: a null text is an empty one (no spans); repeated rows are scanned each by itself; an empty table
gives an empty result; other columns of the input are ignored. Positions are code points, end exclusive.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN_HEAD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ASSIGN_VALUE = r"[A-Za-z0-9+/_.=-]+"
KINDS = ("assign", "access", "hex", "random")
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
MAX_SAMPLES = 4096
#: A token is random where the ratio is at least this, in thousandths of a nat for each pair of characters.
THRESHOLD = 400
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
Sample = tuple[str, int]

#: Common parts of identifiers and paths.
PARTS = (
    "account action address array async base batch buffer build button cache callback change channel check class client "
    "close cluster code collection column command component config connection constructor container content context "
    "control count create current data database date default delete description device directory document domain "
    "download element email enable encoding entry error event exception execute export expression factory field file "
    "filter final format function generate group handler header height helper history host identifier image implementation "
    "import index information initial input instance integer interface internal item language layout length library link "
    "list listener load local location logger manager mapping message metadata method minimum model module monitor name "
    "network node notification number object operation option order output package page parameter parent parser password "
    "path pattern payment policy position process product profile project property protocol provider query queue random "
    "record reference register remote render report request resource response result return route sample schedule schema "
    "scope search section security select sequence server service session setting source standard start state statement "
    "status storage stream string structure style subject summary support symbol system table target task template test "
    "text thread time title token total transaction transform translation transport type update upload user utility "
    "validation value variable vector version view visible width window worker wrapper write"
).split()


def labelled_samples(seed: int = 7, each: int = 1500) -> list[Sample]:
    """Built-in labelled samples: 1 for random strings (hex, base 62, base 64), 0 for identifiers and paths."""
    rng = random.Random(seed)
    alphabets = ("0123456789abcdef", "0123456789ABCDEF", ALPHABET[:62], ALPHABET[:62] + "+/")
    out: list[Sample] = [("".join(rng.choices(rng.choice(alphabets), k=rng.randint(20, 64))), 1) for _ in range(each)]
    for _ in range(each):
        parts = rng.choices(PARTS, k=rng.randint(3, 6))
        style = rng.randrange(5)
        if style == 0:
            name = parts[0] + "".join(p.title() for p in parts[1:])
        else:
            name = ("_", "-", "/", "")[style - 1].join(parts)
        out.append((name.upper() if style == 1 and rng.random() < 0.3 else name + str(rng.randrange(100)) * (rng.random() < 0.2), 0))
    return out


def train(samples: Iterable[Sample]) -> dict[str, int]:
    """Ratio of the two models' transition probabilities for every pair of characters, add-half smoothed."""
    pairs, firsts = (Counter(), Counter()), (Counter(), Counter())
    for k, (text, label) in enumerate(samples):
        if k >= MAX_SAMPLES:
            raise ValueError(f"more than {MAX_SAMPLES} labelled samples")
        kept = [c for c in text if c in ALPHABET]
        for x, y in zip(kept, kept[1:], strict=False):
            pairs[label][x + y] += 1
            firsts[label][x] += 1
    share = lambda label, x, y: (pairs[label][x + y] + 0.5) / (firsts[label][x] + 0.5 * len(ALPHABET))
    return {x + y: round(1000 * math.log(share(1, x, y) / share(0, x, y))) for x in ALPHABET for y in ALPHABET}


def _pieces(text: Column, pattern: str, replacement: str) -> Column:
    """The text cut before every match; each cut piece but the first begins with a match, ended by mark 2 (and
    with mark 3 before its last group). The marks' own characters in the text become mark 4, of the same length."""
    clean = F.translate(text, "\x01\x02\x03", "\x04\x04\x04")
    return F.split(F.regexp_replace(clean, F.lit(pattern), F.lit(replacement)), "\x01", -1)


#: Items that one inner fold goes over, and characters of a block of text.
CHUNK = 256
TEXT_BLOCK = 1024


def _let(value: Column, body) -> Column:
    """Evaluate an expression once per row and use it by name."""
    return F.get(F.transform(F.array(value), body), 0)


def _folded(items: Column, start: Column, step, out: str) -> Column:
    """Fold over an array that gathers an array: step(state, item) gives the next state and the item's rows, an array of
    type out. Struct of the last state and of all rows. Rows are gathered by chunks of items, as appending to one long
    array copies it each time."""
    none = F.array().cast(out)
    # The items are made once, and cut where a chunk begins.
    cut = lambda a: F.transform(F.sequence(F.lit(0), F.size(a) - 1, F.lit(1)), lambda i: F.when(i % CHUNK == 0, F.slice(a, i + 1, CHUNK)))
    chunks = F.filter(_let(items, lambda a: F.when(F.size(a) > 0, cut(a)).otherwise(F.array())), lambda c: c.isNotNull())

    def inner(a: Column, x: Column) -> Column:
        return _let(step(a["state"], x), lambda r: F.struct(r["state"].alias("state"), F.concat(a["rows"], r["rows"]).alias("rows")))

    def outer(a: Column, c: Column) -> Column:
        done = F.aggregate(c, F.struct(a["state"].alias("state"), none.alias("rows")), inner)
        return _let(done, lambda r: F.struct(r["state"].alias("state"), F.concat(a["rows"], F.array(r["rows"])).alias("rows")))

    first = F.struct(start.alias("state"), F.array().cast(f"array<{out}>").alias("rows"))
    return _let(F.aggregate(chunks, first, outer), lambda r: F.struct(r["state"].alias("state"), F.flatten(r["rows"]).alias("rows")))


def _spans(pieces: Column, kind: str, wanted, texts: bool = False) -> Column:
    """Spans (start, kind, end and, if asked for, text) of the pieces whose match is wanted, found by adding up lengths."""
    bare = lambda x: F.translate(x, "\x02\x03", "")
    out = f"array<struct<s:int,k:int,e:int{',t:string' if texts else ''}>>"
    rank = KINDS.index(kind)

    def step(at: Column, x: Column) -> Column:
        match = F.substring_index(x, "\x02", 1)
        span = F.struct(at.alias("s"), F.lit(rank).alias("k"), (at + F.length(bare(match))).alias("e"), *[bare(match).alias("t")] * texts)
        return F.struct((at + F.length(bare(x))).alias("state"), F.when(wanted(match), F.array(span)).otherwise(F.array().cast(out)).alias("rows"))

    rest = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
    found = _folded(rest, F.length(F.get(pieces, 0)), step, out)["rows"]
    return F.when(F.size(pieces) > 1, found).otherwise(F.array().cast(out))


def _parts(tokens: Column, base: Column) -> Column:
    """What the base spans leave of the tokens (s, e, t), as (s, e, codes): both lists are merged by start and gone through
    once, with the end of what is covered, the open token and the place up to which it is dealt with."""
    out = "array<struct<s:int,e:int,c:array<int>>>"
    event = lambda x, kind, codes: F.struct(x["s"].alias("s"), F.lit(kind).alias("kind"), x["e"].alias("e"), codes.alias("c"))
    none, far = F.array().cast("array<int>"), F.lit((1 << 31) - 1)
    codes = lambda t: F.transform(F.array_remove(F.split(t, "", -1), ""), lambda c: F.instr(F.lit(ALPHABET), c))
    events = F.concat(
        F.transform(base, lambda x: event(x, 0, none)), F.transform(tokens, lambda x: event(x, 1, codes(x["t"]))),
        F.array(F.struct(far.alias("s"), F.lit(1).alias("kind"), far.alias("e"), none.alias("c"))),
    )
    start = F.struct(F.lit(0).alias("cover"), F.lit(0).alias("s"), F.lit(0).alias("at"), F.lit(0).alias("e"), none.alias("c"))

    def step(a: Column, x: Column) -> Column:
        # A base span ends the open part where it begins, a token the one before it where that ends.
        to = F.least(a["e"], x["s"])
        part = F.struct(a["at"].alias("s"), to.alias("e"), F.slice(a["c"], a["at"] - a["s"] + 1, F.greatest(to - a["at"], F.lit(0))).alias("c"))
        rows = F.when(to > a["at"], F.array(part)).otherwise(F.array().cast(out))
        cover = F.greatest(a["cover"], x["e"])
        after_base = F.struct(cover.alias("cover"), a["s"].alias("s"), F.greatest(a["at"], x["e"]).alias("at"), a["e"].alias("e"), a["c"].alias("c"))
        after_token = F.struct(a["cover"].alias("cover"), x["s"].alias("s"), F.greatest(a["cover"], x["s"]).alias("at"), x["e"].alias("e"), x["c"].alias("c"))
        return F.struct(F.when(x["kind"] == 0, after_base).otherwise(after_token).alias("state"), rows.alias("rows"))

    found = _folded(F.array_sort(events, lambda x, y: F.when(x["s"] != y["s"], x["s"] - y["s"]).otherwise(x["kind"] - y["kind"])), start, step, out)["rows"]
    return F.when(F.size(tokens) > 0, found).otherwise(F.array().cast(out))


def _looks_random(codes: Column, table: dict[str, int]) -> Column:
    """Whether the ratios over the pairs of characters (places in ALPHABET, from 1) come to THRESHOLD a pair or more."""
    n = len(ALPHABET)
    values = F.split(F.lit(",".join(str(table[x + y]) for x in ALPHABET for y in ALPHABET)), ",").cast("array<int>")
    count = F.size(codes) - 1
    ratios = F.zip_with(
        F.slice(codes, 1, count), F.slice(codes, 2, count), lambda a, b: F.element_at(values, (a - 1) * n + b)
    )
    total = F.aggregate(ratios, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return total >= THRESHOLD * count


def base_pieces(text: Column) -> dict[str, Column]:
    return {
        "assign": _pieces(text, f"({ASSIGN_HEAD})({ASSIGN_VALUE})", "\x01$1\x03$2\x02"),
        "access": _pieces(text, "(AKIA[A-Z0-9]{12,})", "\x01$1\x02"),
        "hex": _pieces(text, "([0-9a-f]{32,})", "\x01$1\x02"),
        "random": _pieces(text, f"({TOKEN})", "\x01$1\x02"),
    }


def secret_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: Iterable[Sample] | None = None
) -> DataFrame:
    """row (the input's row), doc_id, text (null: empty) and spans, an array of (s, k, e) by start, then kind (an
    index of KINDS)."""
    table = train(samples if samples is not None else labelled_samples())
    text = F.coalesce(docs[text_col], F.lit(""))
    cut = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("doc_id"), text.alias("text"), *[x.alias(f"_{k}") for k, x in base_pieces(text).items()]
    )
    value = lambda m: F.substring_index(m, "\x03", -1)
    found = cut.select(
        "row",
        "doc_id",
        "text",
        "_random",
        F.concat(
            _spans(F.col("_assign"), "assign", lambda m: F.length(value(m)) >= 8),
            _spans(F.col("_access"), "access", lambda m: F.lit(True)),
            _spans(F.col("_hex"), "hex", lambda m: F.lit(True)),
        ).alias("base"),
    )
    found = found.select(
        "row", "doc_id", "text", F.array_sort("base").alias("base"), _spans(F.col("_random"), "random", lambda m: F.lit(True), texts=True).alias("tokens")
    )
    wanted = F.filter(_parts(F.col("tokens"), F.col("base")), lambda x: (x["e"] > x["s"] + 1) & _looks_random(x["c"], table))
    more = F.transform(wanted, lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index("random")).alias("k"), x["e"].alias("e")))
    return found.select("row", "doc_id", "text", F.array_sort(F.concat("base", more)).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ","
    )


def digest(scanned: DataFrame) -> DataFrame:
    """One row per document: counts, the digest of the base spans, and all spans."""
    n = lambda kind: F.size(F.filter("spans", lambda x: x["k"] == KINDS.index(kind))).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["k"] != KINDS.index("random"))
    return scanned.select(
        "doc_id", *[n(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


def redacted(mask: str = "[SECRET]") -> Column:
    """The text of a scanned row with every span, or run of overlapping spans, replaced by the mask. The stretches between
    are taken from blocks of the text, so that none is looked for from the text's start."""
    out = "array<struct<a:int,z:int>>"

    def step(at: Column, x: Column) -> Column:
        gap = F.struct(at.alias("a"), x["s"].alias("z"))
        rows = F.when(x["s"] >= at, F.array(gap)).otherwise(F.array().cast(out))
        return F.struct(F.greatest(at, x["e"]).alias("state"), rows.alias("rows"))

    ends = F.concat("spans", F.array(F.struct(F.length("text").alias("s"), F.lit(0).alias("k"), F.length("text").alias("e"))))
    blocks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0))

    def stretch(b: Column, g: Column) -> Column:
        first = F.floor(g["a"] / TEXT_BLOCK).cast("int")
        n = F.floor((g["z"] - 1) / TEXT_BLOCK).cast("int") - first + 1
        held = F.array_join(F.slice(b, first + 1, F.greatest(n, F.lit(0))), "")
        return F.when(g["z"] > g["a"], F.substring(held, g["a"] - first * TEXT_BLOCK + 1, g["z"] - g["a"])).otherwise("")

    gaps = _folded(ends, F.lit(0), step, out)["rows"]
    clean = _let(blocks, lambda b: F.array_join(F.transform(gaps, lambda g: stretch(b, g)), mask))
    return F.when(F.size("spans") == 0, F.col("row.text")).otherwise(clean)


def redact(docs: DataFrame, mask: str = "[SECRET]", samples: Iterable[Sample] | None = None) -> DataFrame:
    """The rows of docs (with a column text), secrets masked; n_chars, where there is one, follows the text."""
    clean = secret_scan(docs, samples=samples).select("row", redacted(mask).alias("clean"))
    own = {"text": F.col("clean"), "n_chars": F.length("clean").cast("bigint")}
    return clean.select(*[own.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
