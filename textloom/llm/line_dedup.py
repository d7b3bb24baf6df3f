"""Line dedup over levelled sorted runs (native DataFrame functions only).

A line's key is the line stripped of white space at both ends, with A-Z in lower case. Documents come in batches, the
largest ids first. A run is a table of key hashes, bucketed and sorted by them, with the number of documents that hold
the key and the key's holder. A new batch is merged with the runs: keys that no run has (the anti join) get their largest
document of the batch as holder, the others only add to the count; the batch's keys become a run of level 0. FANOUT runs
of a level are compacted into one of the next. As all runs have the same buckets and order, neither the merge with the
runs nor the compaction shuffles or sorts them. In the end, keys in enough documents lose all lines but the holder's.

Keys are told apart by 128 bits of hashes. A batch is a range of ids, so a scan reads only the row groups that it needs
where files follow the ids.

Defined results: a null or empty text is one empty line; a row is a document, so of rows that share the largest id all
keep the line, and each counts; a null id is smaller than all others, and a key that only rows with null ids hold loses
nothing; lines with the same key in one document count once and stay or go together; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import OTHER_SPACE, delete, keep, release, shared_folder
from .hashing import lower_ascii

#: Batches of one table, and runs of a level that are compacted into one.
BATCHES = 4
FANOUT = 2
#: So many repeated keys (32 bytes each) are broadcast at most; more are joined by a shuffle.
FEW_KEYS = 500_000
KEY = ["h", "g"]


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return lower_ascii(F.btrim(line, F.lit(" " + OTHER_SPACE)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashed(keys: DataFrame, least: int) -> DataFrame:
    """The rows whose `key` has at least so many code points, with its hashes h and g in place of it."""
    long = keys.filter(F.length("key") >= least)
    return long.withColumn("h", F.xxhash64("key")).withColumn("g", F.xxhash64(F.lit(1), "key")).drop("key")


@contextmanager
def _sorted_scans(spark: SparkSession) -> Iterator[None]:
    """Let scans of bucketed tables of one file a bucket tell Spark their order."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class LineRuns:
    """Runs of (h, g, n, holder) by level, as bucketed sorted tables in the shared folder. close() deletes them."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        out = rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("compression", "zstd")
        out.option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def fresh(self, batch: DataFrame) -> DataFrame:
        """The batch's rows with `fresh`: whether no run has their key. The left-only rows of the merge with each run."""
        marked = batch.withColumn("fresh", F.lit(True))
        for k, name in enumerate(self.runs()):
            run = self.spark.table(name).select(*KEY, F.lit(True).alias(f"__in{k}"))
            marked = marked.join(run, KEY, "left").withColumn("fresh", F.col("fresh") & F.col(f"__in{k}").isNull()).drop(f"__in{k}")
        return marked

    def add(self, batch: DataFrame) -> None:
        """Add a batch of (h, g, n, holder), one row a key: its own keys with their holder, others with their count."""
        with _sorted_scans(self.spark):
            own = self.fresh(batch).select(*KEY, "n", F.when(F.col("fresh"), F.col("holder")).alias("holder"))
            name = self._write(own)
        self.levels = self.levels or [[]]
        self.levels[0].append(name)
        for k, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                self._compact(k)

    def _compact(self, k: int) -> None:
        old, self.levels[k] = self.levels[k], []
        if k + 1 == len(self.levels):
            self.levels.append([])
        self.levels[k + 1].append(self._one(old, 1))

    def _one(self, names: list[str], left: int) -> str | list[str]:
        """Runs, older ones first, merged two by two, the newest first, until so many are left."""
        while len(names) > max(left, 1):
            *names, older, newer = names
            with _sorted_scans(self.spark):
                names.append(self._write(self._merged(older, newer)))
            self._drop([older, newer])
        return names[0] if left == 1 else names

    def _merged(self, older: str, newer: str) -> DataFrame:
        """Two runs merged by key: counts add up, and a key's holder is the one that either names."""
        new = self.spark.table(newer).select(*KEY, F.col("n").alias("__n"), F.col("holder").alias("__holder"))
        n = F.coalesce("n", F.lit(0)) + F.coalesce("__n", F.lit(0))
        return self.spark.table(older).join(new, KEY, "full").select(*KEY, n.alias("n"), F.coalesce("holder", "__holder").alias("holder"))

    def total(self) -> DataFrame | None:
        """All runs merged, the last two as they are read; the oldest are on the highest level."""
        names = self._one([name for level in reversed(self.levels) for name in level], 2)
        self.levels = [names]
        return self._merged(*names) if len(names) == 2 else self.spark.table(names[0]) if names else None

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete(self.spark, f"{self.folder}/{name}")
        release(self.spark)

    def close(self) -> None:
        self._drop(self.runs())
        delete(self.spark, self.folder)


def _ranges(docs: DataFrame, batches: int) -> list[Column]:
    """Conditions that cut the rows by id into at most so many batches of about equal size, the largest ids first."""
    shares = [k / batches for k in range(1, batches)]
    cuts = docs.select(F.percentile_approx("doc_id", shares)).first()[0] if shares else None
    cuts = sorted(set(cuts or []))
    doc = F.col("doc_id")
    out, above = [], None
    for cut in reversed(cuts):
        out.append(doc >= cut if above is None else (doc >= cut) & (doc < above))
        above = cut
    return [*out, doc.isNull() if above is None else doc.isNull() | (doc < above)] if cuts else [F.lit(True)]


def batch_keys(docs: DataFrame, least: int) -> DataFrame:
    """h, g, n (documents that hold the key) and holder (the largest doc_id) of documents (doc_id, text)."""
    keys = F.array_distinct(F.transform(lines_of(F.col("text")), line_key))
    rows = _hashed(docs.select("doc_id", F.explode(keys).alias("key")), least)
    return rows.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("doc_id").alias("holder"))


def repeated_keys(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """h, g and holder of the keys that at least so many documents (doc_id, text) hold, kept in the shared folder."""
    runs = LineRuns(docs.sparkSession, fanout)
    try:
        for where in _ranges(docs, batches):
            runs.add(batch_keys(docs.filter(where), min_chars))
        with _sorted_scans(runs.spark):
            return keep(runs.total().filter(F.col("holder").isNotNull() & (F.col("n") >= min_docs)).select(*KEY, "holder"))
    finally:
        runs.close()


def line_dedup(
    docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES,
    fanout: int = FANOUT,
) -> DataFrame:
    """doc_id, text (the lines that stay, joined), n_lines (before) and n_dropped, one row per row of docs.

    A document with lines to drop is met with their positions; which lines it loses hangs on its id and its text alone."""
    docs = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    gone = repeated_keys(docs, min_chars, min_docs, batches, fanout)
    gone = F.broadcast(gone) if gone.count() <= FEW_KEYS else gone
    docs = docs.withColumn("__t", F.xxhash64("text"))
    rows = docs.select("doc_id", "__t", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    rows = _hashed(rows.select("doc_id", "__t", "pos", line_key(F.col("line")).alias("key")), min_chars)
    lost = rows.join(gone, KEY).filter(~F.col("doc_id").eqNullSafe(F.col("holder")))
    lost = lost.groupBy(F.col("doc_id").alias("__d"), F.col("__t").alias("__u")).agg(F.collect_set("pos").alias("lost"))
    met = docs.join(lost, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__t") == F.col("__u")), "left")
    n = F.size("lines").cast("bigint")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("lost"))
    left = F.array_join(F.transform(stay, lambda p: F.get(F.col("lines"), p)), "\n")
    return met.withColumn("lines", lines_of(F.col("text"))).select(
        "doc_id",
        F.when(F.col("lost").isNull(), F.col("text")).otherwise(left).alias("text"),
        n.alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )
