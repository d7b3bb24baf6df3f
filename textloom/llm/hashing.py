"""Hashes of word sequences, and a filter of fixed size over keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words

#: Odd factor of the polynomial hash, and constants of the finishing mix.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Bits of the filter: 4 MB, whatever the data.
FILTER_BITS = 1 << 25


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words of a text, in order."""
    return F.transform(words(text), lambda x: F.xxhash64(x))


def lower_ascii(word: Column) -> Column:
    """A-Z in lower case; other letters stay. Words of ASCII alone, which are most, take the fast way."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, upper, upper.lower()))


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    x = x + np.uint64(seed * int(BASE) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column of strings, text after text, and the bounds between texts; null is empty."""
    column = column.fill_null("") if column.null_count else column
    _, ends, flat = column.buffers()
    if not len(column) or flat is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(ends, np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(flat, np.uint8)[ends[0] : ends[-1]], ends.astype(np.int64) - ends[0]


#: What the values of bytes add to a word's hash, A-Z like a-z, and which are white space.
VALUES = mixed(np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(np.uint64), 4)
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
#: Bytes that are hashed at once (more than LONG_WORD), and the factor's powers and their inverses for them.
PIECE = 1 << 18
POWERS, INVERSES = (np.multiply.accumulate(np.full(PIECE, x, np.uint64)) for x in (BASE, np.uint64(pow(int(BASE), -1, 1 << 64))))
#: Words of more bytes are hashed one by one: a polynomial modulo 2 ** 64 tells long words of a regular build badly apart.
LONG_WORD = 64


def lower_word_hashes(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words, A-Z in lower case, of the texts that lie in `flat` between the bounds `ends`, and the
    bounds between the texts' words. White space and A-Z are never part of a longer character of UTF-8."""
    space, hashes, firsts, at = SPACE[flat], [], [], 0
    edge = space.copy()  # bytes that end a piece of words: white space, and a text's last byte
    edge[ends[ends > 0] - 1] = True
    while at < len(flat):
        stop = min(at + PIECE, len(flat))
        if stop < len(flat) and not edge[stop - 1]:
            back = edge[at:stop][::-1].argmax()
            if not edge[stop - 1 - back]:  # a word longer than a piece
                stop += int(edge[stop:].argmax())
                stop += not space[stop]
                hashes.append(np.array([_long_word(flat[at:stop])], np.uint64))
                firsts.append(np.array([at]))
                at = stop
                continue
            stop -= int(back)
        word = ~space[at:stop]
        first = word & np.concatenate(([True], edge[at : stop - 1]))
        last = word & np.concatenate((space[at + 1 : stop], [True])) | word & edge[at:stop]
        first, last = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(VALUES[flat[at:stop]] * POWERS[: stop - at])))
        h = mixed((sums[last] - sums[first]) * INVERSES[first])
        for i in np.flatnonzero(last - first > LONG_WORD):
            h[i] = _long_word(flat[at + first[i] : at + last[i]])
        hashes.append(h)
        firsts.append(first + at)
        at = stop
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(firsts), ends)


def _long_word(word: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(word.tobytes().lower())


def windows(values: np.ndarray, k: int, base: np.uint64 = BASE) -> np.ndarray:
    """Hash of every k consecutive values, as many as there are."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * base + values[i : n + i]
    return mixed(out)


def lists(batch, column: int) -> Iterator[np.ndarray]:
    """The arrays of a list column of 64-bit numbers, as views; null is empty."""
    col = batch.column(column)
    flat, ends = col.values.to_numpy(zero_copy_only=False).view(np.uint64), col.offsets.to_numpy()
    for a, b in zip(ends, ends[1:], strict=False):
        yield flat[a:b]


def bit_filter(slots: DataFrame, n_bits: int = FILTER_BITS) -> np.ndarray:
    """Bit array of n_bits bits, one set for each row's `slot` (0 to n_bits - 1): a key whose bit is not set is surely
    absent. Spark combines the words; at most n_bits / 64 of them come to the driver."""
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("slot") % 64).cast("int"))
    rows = slots.groupBy(F.shiftright("slot", 6).cast("int").alias("w")).agg(F.bit_or(one).alias("bits")).toArrow()
    bits = np.zeros(n_bits // 64, np.uint64)
    bits[rows["w"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return bits


def passes(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Whether the bits of these slots are set."""
    return (bits[slots >> 6] >> (slots & 63).astype(np.uint64)) & np.uint64(1) == 1


def slot_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))


def without(docs: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """The rows of docs whose id is not in `gone` (column id). Rows that a filter of fixed size clears go past the join,
    so only the texts that may have to go are shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(bit_filter(gone.select(slot_of(F.col("id")).alias("slot"))))

    def where(wanted: bool):
        def rows(batches):
            for batch in batches:
                hit = passes(sent.value, batch.column(batch.num_columns - 1).to_numpy()) == wanted
                yield batch.slice(0).filter(pa.array(hit)).select(batch.schema.names[:-1])

        return rows

    slotted = docs.withColumn("__slot", slot_of(docs[id_col]))
    doubtful = slotted.mapInArrow(where(True), docs.schema)
    return slotted.mapInArrow(where(False), docs.schema).union(
        doubtful.join(gone.select(F.col("id").alias("__gone")), F.col(id_col) == F.col("__gone"), "left_anti")
    )
