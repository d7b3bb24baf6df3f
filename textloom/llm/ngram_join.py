"""N-gram Jaccard join by token-combination prefixes.

A document is its set of word shingles (64-bit hashes), put in one global order: shingles outside a bounded table
of frequent ones first, then those of the table by count. Two sets that link share at least two shingles of their
prefixes, which hold n - ceil(t n) + 2 shingles. Of the prefixes' shingles, those that at most RARE documents hold
are indexed singly. Of the others, a document indexes every combination of two, or, where it has more than
MAX_FREQUENT of them, each singly; the second kind only pairs documents of which one has that many. So every
linking pair meets under some key. Verification compares whole sets.

Equal sets are one class from the start. Within a key the members first meet one hub only; links found merge
components, and what is left meets across components alone, so a group of near copies never makes all its pairs.
Under keys of frequent shingles a pair is only made where the sets' parity sketches allow a link: the bits in which
the sketches differ are at most as many as the shingles in which the sets differ, so no link is lost.

Defined results: a null or empty text has an empty set, links with nothing and is its own component; repeated rows
are one class; rows that share an id count as one document, whose set is that of the row with the smallest digests
(an empty one last); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import keep, release, written
from .components import components
from .hashing import bit_filter, lower_word_hashes, mixed, passes, slot_of, texts, windows, without

RARE = 8
MAX_FREQUENT = 16
#: The frequent table: shingles that come LOCAL times or more among BUFFER of a task, the TABLE most frequent.
LOCAL, BUFFER, TABLE = 4, 2_000_000, 1 << 18
HUB_ROUNDS = 2
#: Keys of so many members go from their first hub straight to the pairs that are left.
SMALL_KEY = 16
#: Bits of the filter of shared shingles: 16 MB, whatever the data.
SHINGLE_BITS = 1 << 27
#: Number of a row whose id doesn't tell it from others.
ROW = "__textloom_row"
#: Bytes and rows of an Arrow batch's texts that are worked on at once; a longer text is by itself.
SLICE, ROWS = 1 << 20, 1000
#: Words of 64 bits of a set's parity sketch, and keys that a member knows of those before a key.
SKETCH, BEFORE = 8, 4


def shingle_sets(flat: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of each text, text after text, and the bounds between the texts; fewer than k words
    make one."""
    words, at = lower_word_hashes(flat, ends)
    counts, made = np.diff(at), windows(words, k)
    owners = np.repeat(np.arange(len(counts)), counts)
    made = made[owners[: len(made)] == owners[len(owners) - len(made) :]]
    sizes = np.maximum(counts - k + 1, 0)
    if len(short := np.flatnonzero((counts > 0) & (counts < k))):
        alone = np.concatenate([windows(words[at[i] : at[i + 1]], counts[i]) + np.uint64(counts[i]) for i in short])
        made = np.insert(made, np.cumsum(sizes)[short], alone)
        sizes[short] = 1
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    for a, b in zip(bounds, bounds[1:], strict=False):
        made[a:b].sort()
    owners = np.repeat(np.arange(len(sizes)), sizes)
    new = np.ones(len(made), bool)
    new[1:] = (made[1:] != made[:-1]) | (owners[1:] != owners[:-1])
    return made[new], np.concatenate(([0], np.cumsum(np.bincount(owners[new], minlength=len(sizes)))))


def _sliced(batch: pa.RecordBatch, column: int, k: int):
    """Runs of rows with their shingles and the bounds between the rows' sets."""
    flat, ends = texts(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = min(max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, "right")) - 1), at + ROWS)
        yield batch.slice(at, to - at), *shingle_sets(flat[ends[at] : ends[to]], ends[at : to + 1] - ends[at], k)
        at = to


def frequent_shingles(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted frequent shingles and their counts. It only steers the order, so results don't hang on it."""

    def counted(batches):
        held: list[np.ndarray] = []
        n = 0

        def flush():
            u, c = np.unique(np.concatenate(held), return_counts=True)
            often = c >= LOCAL
            return pa.RecordBatch.from_pydict({"s": u[often].view(np.int64), "c": c[often]})

        for batch in batches:
            for _, shingles, _ in _sliced(batch, 1, k):
                held.append(shingles)
                n += len(shingles)
                if n >= BUFFER:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    rows = (
        docs.mapInArrow(counted, "s bigint, c bigint").groupBy("s").agg(F.sum("c").alias("c"))
        .orderBy(F.desc("c"), "s").limit(TABLE).toArrow()
    )
    s = rows["s"].to_numpy().view(np.uint64)
    at = np.argsort(s)
    return s[at], rows["c"].to_numpy()[at]


def prefix_length(n: np.ndarray, threshold: int, shared: np.ndarray | int = 2) -> np.ndarray:
    """Shingles of which two linking sets share at least so many."""
    return np.minimum(n, n - -(-threshold * n // 100) + shared)


def shared_least(n):
    """How many shingles two linking sets share at least in their long prefixes; for the smaller set's n."""
    return 2 + n // 20


def digests(shingles: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A digest of each set between neighbouring bounds."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(shingles, seed))))
    return np.diff(sums[ends]).view(np.int64)


def sketches(shingles: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Parity sketches of sets: bit i tells whether an odd number of a set's shingles hash to i."""
    n, bits = len(ends) - 1, 64 * SKETCH
    slots = (mixed(shingles, 3) & np.uint64(bits - 1)).astype(np.int64) + bits * np.repeat(np.arange(n), np.diff(ends))
    odd = np.bincount(slots, minlength=n * bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64).reshape(n, SKETCH)


def sketch_of(shingles: np.ndarray) -> np.ndarray:
    return sketches(shingles, np.array([0, len(shingles)]))[0]


def list_array(flat: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    """The parts of `flat` between neighbouring bounds."""
    return pa.ListArray.from_arrays(ends.astype(np.int32), flat.view(np.int64))


def in_order(shingles: np.ndarray, ends: np.ndarray, table: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sorted shingles of each set in the global order."""
    if not len(table) or not len(shingles):
        return shingles
    at = np.minimum(np.searchsorted(table, shingles), len(table) - 1)
    weight = np.where(table[at] == shingles, np.minimum(counts[at], (1 << 32) - 1), 0)
    return shingles[np.argsort((np.repeat(np.arange(len(ends) - 1), np.diff(ends)) << 32) + weight, kind="stable")]


def _parts(shingles: np.ndarray, ends: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.ListArray:
    """Of each set the shingles from its `start` to its `stop`."""
    place = np.arange(len(shingles)) - np.repeat(ends[:-1], np.diff(ends))
    inside = (place >= np.repeat(start, np.diff(ends))) & (place < np.repeat(stop, np.diff(ends)))
    return list_array(shingles[inside], np.concatenate(([0], np.cumsum(stop - start))))


def _sets(docs: DataFrame, k: int, threshold: int) -> DataFrame:
    """doc_id, n, two digests of the set, its sketch, its prefix, and what makes the prefix long enough to share 2 + n / 20."""
    table, counts = frequent_shingles(docs, k)
    sent = docs.sparkSession.sparkContext.broadcast((table, counts))

    def rows(batches):
        table, counts = sent.value
        for batch in batches:
            for part, s, ends in _sliced(batch, 1, k):
                n = np.diff(ends)
                own = [pa.array(x, pa.int64()) for x in (n, digests(s, ends, 1), digests(s, ends, 2))]
                sketch = list_array(sketches(s, ends).ravel(), np.arange(len(n) + 1) * SKETCH)
                s, at, to = in_order(s, ends, table, counts), prefix_length(n, threshold), prefix_length(n, threshold, shared_least(n))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *own, sketch, _parts(s, ends, np.zeros_like(at), at), _parts(s, ends, at, to)],
                    ["doc_id", "n", "d1", "d2", "sketch", "prefix", "more"],
                )

    return docs.mapInArrow(rows, "doc_id bigint, n bigint, d1 bigint, d2 bigint, sketch array<bigint>, prefix array<bigint>, more array<bigint>")


def _shared_prefixes(rows: DataFrame) -> DataFrame:
    """The rows with their prefixes less the shingles that no other document's prefix holds (a filter of fixed size
    tells, so a few of those stay; the exact counts follow)."""
    counts = rows.select(F.explode(F.concat("prefix", "more")).alias("s")).groupBy("s").agg(F.count("*").alias("f")).filter("f > 1")
    sent = rows.sparkSession.sparkContext.broadcast(bit_filter(counts.select(F.pmod("s", F.lit(SHINGLE_BITS)).alias("slot")), SHINGLE_BITS))

    def held(column: pa.ListArray) -> pa.ListArray:
        flat, ends = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
        stays = passes(sent.value, (flat & np.uint64(SHINGLE_BITS - 1)).astype(np.int64))
        return list_array(flat[stays], np.concatenate(([0], np.cumsum(stays)))[ends])

    def shared(batches):
        for batch in batches:
            for name in ("prefix", "more"):
                at = batch.schema.names.index(name)
                batch = batch.set_column(at, name, held(batch.column(at)))
            yield batch

    return rows.mapInArrow(shared, rows.schema)


def _keys(classes: DataFrame) -> DataFrame:
    """key, kind, long, id, n and m (members): what each class is indexed under; keys that one class has alone are left
    out."""
    postings = keep(classes.select("id", "n", F.explode("prefix").alias("s")))
    counts = postings.groupBy("s").agg(F.count("*").alias("f")).filter("f > 1")
    shared = keep(postings.join(counts, "s"))
    rare = shared.filter(F.col("f") <= RARE).select(F.col("s").alias("key"), F.lit(0).alias("kind"), F.lit(False).alias("long"), "id", "n")
    lists_ = shared.filter(F.col("f") > RARE).groupBy("id", "n").agg(F.array_sort(F.collect_list("s")).alias("l"))
    lists_ = lists_.withColumn("long", F.size("l") > MAX_FREQUENT)
    pairs = F.flatten(F.transform("l", lambda a, i: F.transform(F.slice(F.col("l"), i + 2, F.size("l")), lambda b: F.xxhash64(a, b))))
    combined = lists_.filter("not long").select(F.explode(pairs).alias("key"), F.lit(1).alias("kind"), "long", "id", "n")
    single = lists_.select(F.explode("l").alias("key"), F.lit(2).alias("kind"), "long", "id", "n")
    every = rare.union(combined).union(single)
    members = every.groupBy("key", "kind").agg(F.count("*").alias("m"), F.bool_or("long").alias("any_long"))
    members = members.filter("m > 1 and (kind < 2 or any_long)").select("key", "kind", "m")
    return keep(every.join(members, ["key", "kind"]))


def _close(a: Column, b: Column, threshold: int) -> Column:
    """Sizes that allow a link."""
    return 100 * F.least(a, b) >= threshold * F.greatest(a, b)


def _plausible(pairs: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose sketches allow a link and that share as much of their long prefixes as a link must."""
    x, y = (classes.select(F.col("id").alias(i), F.col("n").alias(f"n{i}"), F.concat("prefix", "more").alias(f"p{i}"), *_sketch_words(i)) for i in "ab")
    enough = F.size(F.array_intersect("pa", "pb")) >= shared_least_sql(F.least("na", "nb"))
    return pairs.join(x, "a").join(y, "b").filter(F.expr(_differ_least(threshold))).filter(enough).select("a", "b")


def _sketch_words(side: str = "") -> list[Column]:
    return [F.get("sketch", i).alias(f"s{i}{side}") for i in range(SKETCH)]


def shared_least_sql(n: Column) -> Column:
    return 2 + F.floor(n / 20)


def _whole_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """id and all its shingles, for the given ids (id, and the digest d1 of its set) of docs (doc_id, text). A filter of
    fixed size spares the others both the hashing and the shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(bit_filter(ids.select(slot_of(F.col("id")).alias("slot"))))

    def rows(batches):
        for batch in batches:
            wanted = batch.filter(pa.array(passes(sent.value, batch.column(2).to_numpy())))
            for part, s, ends in _sliced(wanted, 1, k):
                digest = pa.array(digests(s, ends, 1), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), digest, list_array(s, ends)], ["doc_id", "digest", "shingles"])

    slotted = docs.select("doc_id", "text", slot_of(F.col("doc_id")).alias("slot"))
    found = slotted.mapInArrow(rows, "doc_id bigint, digest bigint, shingles array<bigint>")
    return found.join(ids, (found["doc_id"] == ids["id"]) & (found["digest"] == ids["d1"])).select("id", "shingles").dropDuplicates(["id"])


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    x = sets.select(F.col("id").alias("a"), F.col("shingles").alias("xs"))
    y = sets.select(F.col("id").alias("b"), F.col("shingles").alias("ys"))
    both = F.size(F.array_intersect("xs", "ys"))
    return pairs.join(x, "a").join(y, "b").filter(100 * both >= threshold * (F.size("xs") + F.size("ys") - both)).select("a", "b")


def _hub_pairs(rows: DataFrame, seed: int, threshold: int) -> DataFrame:
    """Each member of a key with the key's hub: a `long` member if there is one, else the first by a hash that is
    the same under all keys in round 0 and of its own under each key later on."""
    order = F.xxhash64("id") if seed == 0 else F.xxhash64("id", "key", F.lit(seed))
    hub = rows.groupBy("key", "kind").agg(
        F.min(F.struct((~F.col("long")).alias("short"), order.alias("o"), F.col("id").alias("id"), F.col("n").alias("n"), F.col("c").alias("c"))).alias("hub")
    )
    met = rows.join(hub, ["key", "kind"]).filter((F.col("c") != F.col("hub.c")) & _close(F.col("n"), F.col("hub.n"), threshold))
    return met.select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct()


def _differ_least(threshold: int) -> str:
    """SQL: whether the sketches of a and b differ in no more bits than linking sets differ in shingles."""
    bits = " + ".join(f"bit_count(s{i}a ^ s{i}b)" for i in range(SKETCH))
    return f"({bits}) * {100 + threshold} <= (na + nb) * {100 - threshold}"


def _across(rows: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """All pairs of a key's members that belong to different components and may link by their sizes and sketches.
    Keys of rare shingles have few members and go without sketches. Under the others a member carries its keys just
    before this one: a pair that has one of them in common meets there and is left out here; the pair's first key
    always stays."""
    sketches = classes.select("id", *_sketch_words())
    before = W.partitionBy("id", "kind").orderBy("key")
    lags = [F.lag("key", i + 1).over(before).alias(f"k{i}") for i in range(BEFORE)]
    met_before = " or ".join(f"k{i}a = k{j}b" for i in range(BEFORE) for j in range(BEFORE))

    def met(members: DataFrame, more: str) -> DataFrame:
        x, y = (
            members.select("key", "kind", *[F.col(c).alias(f"{c}{side}") for c in members.columns if c not in ("key", "kind", "m")]) for side in "ab"
        )
        close = (F.col("ida") < F.col("idb")) & (F.col("ca") != F.col("cb")) & _close(F.col("na"), F.col("nb"), threshold)
        return x.join(y, ["key", "kind"]).filter(close & F.expr(more)).select(F.col("ida").alias("a"), F.col("idb").alias("b"))

    rare = met(rows.filter("kind = 0"), "true")
    often = rows.filter("kind > 0").select("*", *lags).join(sketches, "id")
    often = met(often, f"(kind < 2 or longa or longb) and not coalesce({met_before}, false) and {_differ_least(threshold)}")
    return rare.union(often).distinct()


def _relabelled(rows: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    l = labels.select(F.col("id").alias("_id"), F.col("component_id").alias("_c"))
    return rows.join(l, rows[column] == l["_id"], "left").withColumn(column, F.coalesce("_c", column)).drop("_id", "_c")


def _open_keys(rows: DataFrame) -> DataFrame:
    """Rows of keys that hold two components or more."""
    mixed_keys = rows.groupBy("key", "kind").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("key", "kind")
    return rows.join(mixed_keys, ["key", "kind"])


def _near_roots(links: DataFrame) -> DataFrame:
    """id and component_id: an id that each linked one reaches, by few steps to the first hub in the hubs' order. Equal
    ones are surely connected; connected ones may differ, which costs later rounds some pairs and changes no result."""
    both = links.select("a", "b").union(links.select("b", "a"))
    ranked = lambda c: F.struct(F.xxhash64(c).alias("o"), F.col(c).alias("id"))
    roots = keep(both.groupBy("a").agg(F.min(ranked("b")).alias("m")).select(F.col("a").alias("id"), F.least(ranked("a"), "m")["id"].alias("component_id")))
    for _ in range(2):
        roots = _relabelled(roots, "component_id", roots)
    return keep(roots)


def class_components(keys: DataFrame, classes: DataFrame, docs: DataFrame, k: int, threshold: int) -> DataFrame:
    """id and component_id of every class that links with another.

    Every key's members meet its hub. Keys that still hold several components follow: large ones meet further hubs
    first, and at last all members of different components meet, less the pairs that have met before. A key that is
    left with one component is done, so each step goes through what the one before has left open."""
    links = tested = None
    rows = keys.withColumn("c", F.col("id"))
    for step in range(HUB_ROUNDS + 1):
        last = step == HUB_ROUNDS
        some = rows if last or step == 0 else rows.filter(F.col("m") > SMALL_KEY)
        if step and some.isEmpty():
            continue
        met = _across(some, classes, threshold) if last else _hub_pairs(some, step, threshold)
        met = keep(met if tested is None else met.join(tested, ["a", "b"], "left_anti"))
        tested = met if tested is None else tested.union(met)
        pairs = keep(_plausible(met, classes, threshold))
        if pairs.isEmpty():
            continue
        ids = keep(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct().join(classes.select("id", "d1"), "id"))
        new = keep(_verified(pairs, _whole_sets(docs, ids, k), threshold))
        release(docs.sparkSession)
        links = new if links is None else links.union(new)
        if not last:
            rows = keep(_open_keys(_relabelled(rows.withColumn("c", F.col("id")), "c", _near_roots(links))))
    return keys.select("id", F.col("id").alias("component_id")).limit(0) if links is None else keep(components(links))


def _several_sets(rows: DataFrame) -> DataFrame:
    """doc_id and the set that counts (`one`: n, d1, d2), for ids whose rows differ in their sets."""
    order = F.struct((F.col("n") == 0).alias("empty"), "d1", "d2", "n")
    several = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.min(order).alias("one"), F.max(order).alias("other"))
    return keep(several.filter("one <> other").select("doc_id", "one"))


def ngram_join(docs: DataFrame, k: int = 5, threshold: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, class_id (smallest id with an equal set) and component_id, one row per document.

    threshold: percent of the union that the intersection holds at least."""
    docs = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    same = ["n", "d1", "d2"]
    with written(_sets(docs, k, threshold)) as rows:
        slim = keep(_shared_prefixes(rows))
    some, own = slim.filter("n > 0"), slim.select("doc_id", *same)
    if not (several := _several_sets(slim)).isEmpty():
        some = some.join(several, "doc_id", "left").filter("one is null or struct(n, d1, d2) = struct(one.n, one.d1, one.d2)").drop("one")
        own = own.join(several, "doc_id", "left").select("doc_id", *[F.coalesce(F.col("one")[c], F.col(c)).alias(c) for c in same])
    of = some.groupBy(*same).agg(F.min("doc_id").alias("id"))
    classes = some.groupBy(*same).agg(F.min("doc_id").alias("id"), *[F.first(c).alias(c) for c in ("sketch", "prefix", "more")])
    classes = keep(classes.select("id", "n", "d1", "sketch", "prefix", "more"))
    keys = _keys(classes)
    release(docs.sparkSession)
    labels = class_components(keys, classes, docs, k, threshold)
    release(docs.sparkSession)
    joined = own.join(of.withColumnRenamed("id", "class_id"), same, "left")
    joined = joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"))
    return _relabelled(joined.withColumn("component_id", F.col("class_id")), "component_id", labels)


def _tell_rows_apart(ids: DataFrame) -> bool:
    """Whether no id (column id) is null or repeated."""
    return ids.groupBy("id").agg(F.count("*").alias("n")).filter("id IS NULL OR n > 1").isEmpty()


def one_of_each(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that represent their component, with all their columns: the smallest id of each. Where ids are null or
    repeated, rows are numbered, and the first row of each component stays."""
    if not _tell_rows_apart(docs.select(docs[id_col].alias("id"))):
        numbered = keep(docs.withColumn(ROW, F.monotonically_increasing_id()))
        return _representatives(numbered, ROW, **options).drop(ROW)
    return _representatives(docs, id_col, **options)


def _representatives(docs: DataFrame, id_col: str, **options) -> DataFrame:
    gone = keep(ngram_join(docs, id_col=id_col, **options).filter("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct())
    return without(docs, id_col, gone)
