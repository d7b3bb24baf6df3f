"""Toxicity by class-conditional Kneser-Ney models.

Both classes, toxic and ordinary, have an interpolated model of a word after the word before it:

- the absolutely discounted count of the pair (a pair seen once is discounted whole, others by DISCOUNT);
- what is left goes to the word's continuation share in the class: how many different words it follows there, again
  discounted;
- what is left there goes to the share of the word's head (its first HEAD characters) in the class, within the head by
  the shared counts; and what the head leaves, to the shared counts alone: in how many documents of the whole corpus,
  labelled or not, each word occurs. Both classes back off to the same counts.

A document is compared by the difference of the two log-likelihoods, normalised by length: over the whole text and over
its most toxic stretches of fixed lengths, each with the pairs and by continuation shares alone. A logistic curve, fitted to labelled rows that the models have not seen,
turns the normalised differences into a score.

All counts are exact. The class models are fitted on at most LABELLED rows, which bounds what executors are sent: pairs
seen twice, words and heads of those rows. The shared counts cover all documents and grow with them; of them, the words
that a class has seen are joined in. For a word that neither class has seen the shared share cancels.

Labels: of the rows that may be learned from, half the folds fit the models (at most LABELLED rows) and one the
curve (at most CALIBRATION rows). Labels, language, source and id are never inputs of a score.

Defined results: a null or empty text has no words and scores as a neutral one; a null label is none; of repeated
ids in the labels the largest counts; repeated documents are scored each by itself, and one text of each id is learned
from; a row with a null id is scored and not held out; without labels of both classes every score is the share of toxic labels (0 without any); empty tables give empty results; other columns
are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep
from .hashing import lists, mixed

HEAD = 5
DISCOUNT = 0.75
STRETCHES = (1, 5, 25)
LABELLED, CALIBRATION = 20_000, 50_000
HELD_OUT, CURVE = 2, 3
#: Documents of an Arrow batch that are scored at once.
SLICE = 500
#: What separates words: white space and punctuation.
BETWEEN = r"[\s.,;:!?\"'()\[\]{}|*#$%&<>=+/\\]+"


class Table(NamedTuple):
    """Rows of values by sorted keys; the last row is for keys that are not there."""

    keys: np.ndarray
    values: np.ndarray

    def of(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.broadcast_to(self.values[-1], (len(keys), self.values.shape[1]))
        u, back = np.unique(keys, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, u), len(self.keys) - 1)
        return self.values[np.where(self.keys[at] == u, at, len(self.keys))[back]]


def table(keys: np.ndarray, values: np.ndarray, absent: tuple) -> Table:
    order = np.argsort(keys)
    return Table(keys[order], np.vstack([values[order].reshape(len(order), len(absent)), absent]).astype(np.float32))


class Models(NamedTuple):
    """For both classes, toxic first: pairs: discounted shares; contexts: what they leave; words: discounted
    continuation shares and the shared share; heads: what words leave times the head's share over the shared one."""

    pairs: Table
    contexts: Table
    words: Table
    heads: Table


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4))


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, and the lower-case words without the punctuation between: 32 bits of the head's hash, then of the word's."""
    rows = docs.select(docs[id_col].alias("doc_id"), F.array_remove(F.split(F.lower(F.coalesce(docs[text_col], F.lit(""))), BETWEEN), "").alias("w"))
    low = F.lit(0xFFFFFFFF).cast("bigint")
    word = lambda x: F.shiftleft(F.xxhash64(F.substring(x, 1, HEAD)), 32).bitwiseOR(F.xxhash64(x).bitwiseAND(low))
    return rows.select("doc_id", F.transform("w", word).alias("words"))


def labelled(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """One row per labelled document that may be learned from: doc_id, toxic, fold."""
    rows = labels.select(labels[id_col].alias("doc_id"), labels[label_col].cast("int").alias("toxic")).filter("toxic is not null and doc_id is not null")
    return rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("fold", fold(F.col("doc_id"))).filter(F.col("fold") != HELD_OUT)


def _bounded(rows: DataFrame, most: int) -> DataFrame:
    """At most so many rows, the first by a hash of the id."""
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def pair_counts(docs: DataFrame, training: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """v, w (word before, word), toxic and ordinary: how often the pair comes in either class. The first word of a text
    follows 0."""
    # At most LABELLED rows of an id and a label; of rows with one id a single text is taken.
    some = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).join(F.broadcast(training.select("doc_id")), "doc_id")
    some = some.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = _hashed(some, "doc_id", "text").join(F.broadcast(training), "doc_id").filter(F.size("words") > 0)
    before = F.concat(F.array(F.lit(0).cast("bigint")), F.slice("words", 1, F.size("words") - 1))
    pairs = rows.select("toxic", F.explode(F.arrays_zip(before.alias("v"), F.col("words").alias("w"))).alias("p"))
    one = F.col("toxic") == 1
    return pairs.groupBy("p.v", "p.w").agg(F.count_if(one).alias("toxic"), F.count_if(~one).alias("ordinary"))


def shared_counts(hashed: DataFrame) -> DataFrame:
    """w and df, the number of documents that hold the word, over all documents."""
    return hashed.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.count("*").alias("df"))


def head_of(word: Column) -> Column:
    return F.shiftrightunsigned(word, 32)


CLASSES = ("toxic", "ordinary")


def fitted(pairs: DataFrame, shared: DataFrame) -> Models:
    """The models' tables, from pair_counts and shared_counts."""
    # Words and heads that a class has seen, with their different words before them.
    seen = pairs.groupBy("w").agg(*[F.count_if(F.col(c) > 0).alias(c) for c in CLASSES])
    words = seen.join(shared, "w", "left").select("w", *CLASSES, F.coalesce("df", F.lit(1)).alias("df")).toArrow()
    total = float(shared.agg(F.sum("df")).first()[0] or 1)
    head = head_of(F.col("w")).alias("h")
    heads = seen.groupBy(head).agg(*[F.sum(c).alias(c) for c in CLASSES]).join(shared.groupBy(head).agg(F.sum("df").alias("df")), "h", "left")
    heads = heads.select("h", *CLASSES, F.coalesce("df", F.lit(1)).alias("df")).toArrow()
    less = lambda c: F.when(F.col(c) > 1, F.col(c) - DISCOUNT).otherwise(F.lit(0.0))
    contexts = pairs.groupBy("v").agg(*[F.sum(c).alias(f"n_{c}") for c in CLASSES], *[F.sum(less(c)).alias(c) for c in CLASSES])
    left = keep(contexts.select("v", *[f"n_{c}" for c in CLASSES], *CLASSES).filter("toxic > 0 or ordinary > 0"))
    often = pairs.filter("toxic > 1 or ordinary > 1").join(left.select("v", *[f"n_{c}" for c in CLASSES]), "v")
    share = lambda c: F.when(F.col(f"n_{c}") > 0, less(c) / F.col(f"n_{c}")).otherwise(F.lit(0.0)).alias(c)
    often = often.select("v", "w", *map(share, CLASSES)).toArrow()
    left = left.select("v", *[F.when(F.col(f"n_{c}") > 0, 1 - F.col(c) / F.col(f"n_{c}")).otherwise(F.lit(1.0)).alias(c) for c in CLASSES]).toArrow()
    column = lambda t, c: t[c].to_numpy().astype(np.float64)
    key = lambda t, c: t[c].to_numpy().view(np.uint64)
    word_shares, head_ratios, absent = [], [], []
    for c in CLASSES:
        n, m = column(words, c), column(heads, c)
        all_pairs = max(n.sum(), 1.0)
        discounted, head_discounted = np.maximum(n - DISCOUNT, 0) / all_pairs, np.maximum(m - DISCOUNT, 0) / all_pairs
        rest, head_rest = 1 - discounted.sum(), 1 - head_discounted.sum()
        word_shares.append(discounted)
        head_ratios.append(rest * (head_discounted / (column(heads, "df") / total) + head_rest))
        absent.append(rest * head_rest)
    return Models(
        table(pair_key(key(often, "v"), key(often, "w")), np.column_stack([column(often, c) for c in CLASSES]), (0.0, 0.0)),
        table(key(left, "v"), np.column_stack([column(left, c) for c in CLASSES]), (1.0, 1.0)),
        table(key(words, "w"), np.column_stack([*word_shares, column(words, "df") / total]), (0.0, 0.0, 1.0)),
        table(key(heads, "h"), np.column_stack(head_ratios), tuple(absent)),
    )


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mixed(mixed(v, 1) + w)


def differences(v: np.ndarray, w: np.ndarray, m: Models) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of each word as toxic, less as ordinary: after the word before it, and by its continuation share
    alone, which copies of a text don't raise."""
    pairs, left, words, heads = (t.astype(np.float64) for t in (m.pairs.of(pair_key(v, w)), m.contexts.of(v), m.words.of(w), m.heads.of(w >> np.uint64(32))))
    share = words[:, :2] + heads * words[:, 2:]
    p = pairs + left * share
    return np.log(p[:, 0]) - np.log(p[:, 1]), np.log(share[:, 0]) - np.log(share[:, 1])


def normalised(d: np.ndarray) -> list[float]:
    """The mean over the text, and the largest mean over its stretches of each length (or the text, if shorter)."""
    if not len(d):
        return [0.0] * (1 + len(STRETCHES))
    sums = np.concatenate(([0.0], np.cumsum(d)))
    out = [sums[-1] / len(d)]
    for n in STRETCHES:
        k = min(n, len(d))
        out.append(float((sums[k:] - sums[:-k]).max()) / k)
    return out


FEATURES = [f"{kind}_{x}" for kind in ("pair", "word") for x in ("whole", *(f"stretch_{n}" for n in STRETCHES))]


def _features(hashed: DataFrame, models: Models) -> DataFrame:
    sent = hashed.sparkSession.sparkContext.broadcast(models)

    def rows(batches):
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            w = np.concatenate([*lists(batch, 1), np.zeros(0, np.uint64)])
            ends = np.cumsum([0, *map(len, lists(batch, 1))])
            v = np.concatenate((np.zeros(1, np.uint64), w[:-1]))[: len(w)]
            v[ends[:-1][np.diff(ends) > 0]] = 0
            by_pair, by_word = differences(v, w, sent.value)
            found = [normalised(by_pair[a:b]) + normalised(by_word[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
            columns = np.array(found, float).reshape(-1, len(FEATURES)).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in columns)], ["doc_id", *FEATURES])

    return hashed.mapInArrow(rows, "doc_id bigint, " + ", ".join(f"{f} double" for f in FEATURES))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 60) -> np.ndarray:
    """Weights and, last, the constant, by Newton steps on standardised columns; a step that does not lower the loss is
    halved."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.column_stack(((x - mean) / scale, np.ones(len(x))))
    pull = np.append(np.full(x.shape[1], ridge), 1e-6)

    def loss(b):
        z = a @ b
        return (np.logaddexp(0, z) - y * z).sum() + (pull * b * b).sum() / 2

    b, now = np.zeros(a.shape[1]), np.inf
    for _ in range(steps):
        now, p = loss(b), 1 / (1 + np.exp(-np.clip(a @ b, -500, 500)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p) + 1e-12)[:, None]) + np.diag(pull), a.T @ (p - y) + pull * b)
        while loss(b - step) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        b = b - step
        if np.abs(step).max() < 1e-8:
            break
    w = b[:-1] / scale
    return np.append(w, b[-1] - (w * mean).sum())


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted and the normalised differences, for every document."""
    hashed = _hashed(docs, id_col, text_col)
    learn = keep(labelled(labels))
    training = keep(_bounded(learn.filter(F.col("fold") != CURVE), LABELLED).select("doc_id", "toxic"))
    pairs = keep(pair_counts(docs, training, id_col, text_col))
    features = keep(_features(hashed, fitted(pairs, keep(shared_counts(hashed)))))
    curve = _bounded(learn.filter(F.col("fold") == CURVE), CALIBRATION).join(features, "doc_id")
    curve = curve.groupBy("doc_id").agg(F.min(F.struct("toxic", *FEATURES)).alias("x")).select("x.*").toArrow()
    y = curve["toxic"].to_numpy().astype(float)
    if 0 < y.sum() < len(y):
        b = logistic(np.column_stack([curve[f].to_numpy() for f in FEATURES]), y)
        z = F.lit(float(b[-1]))
        for f, x in zip(FEATURES, b, strict=False):
            z = z + F.lit(float(x)) * F.col(f)
        score = 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), z))))
    else:
        score = F.lit(float(y.mean()) if len(y) else 0.0)
    return features.select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), score.alias("score"), *FEATURES
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
