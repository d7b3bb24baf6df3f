"""Web pages: reading and writing block files, cleaning bodies line by line, and one record for each page."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.rows import pieces

from .chunks import repaired
from .ranks import global_row_number

SEPARATOR = "=" * 80
#: Header keys of a block.
META = ("SITE", "LANGUAGE", "SOURCE_TYPE", "URL", "TITLE", "SECTION", "BREADCRUMB", "HEADINGS", "CRAWLED_AT", "SCRAPED_AT", "CONTENT_HASH")
RECORD = ("site", "language", "source_type", "url", "title", "section", "scraped_at", "content_hash", "body")
RULE = re.compile(r"={20,}")
LEAST_WORDS = 20
#: Odd characters made plain, none of them ASCII.
PLAIN = str.maketrans("�\xa0•●▪", ". ---")
#: Records that a written file holds, and that are read at once.
RECORDS = 1000


def normalized(text: Column) -> Column:
    """Compatibility forms, ligatures, odd blanks and bullets made plain; blanks and blank lines squeezed. Only texts
    with characters beyond ASCII pass through Python."""

    plain = lambda a: pc.all(pc.string_is_ascii(a)).as_py() is not False

    @F.arrow_udf("string")
    def compatible(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in [batch] if plain(batch) else pieces(batch):
                yield part if plain(part) else pa.array([t and unicodedata.normalize("NFKC", t).translate(PLAIN) for t in part.to_pylist()], part.type)

    t = compatible(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(t, r"(?md)^\s*o\s+", "- ")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]{2,}|\t", " "), " \n ?|\n ", "\n")
    return T.trimmed(F.regexp_replace(t, "\n{4,}", "\n\n\n"))


def _records(text: str) -> Iterator[tuple]:
    """A file's records: between rules stand a header and, after another rule or a blank line, the body. A SITE_GROUP
    header names the site of those that follow."""
    parts: list[list[str]] = [[]]
    for line in text.splitlines():
        if RULE.fullmatch(line.strip()):
            parts.append([])
        else:
            parts[-1].append(line)
    site, k = "", 1
    while k < len(parts):
        part, k = parts[k], k + 1
        n = next((i for i, x in enumerate(part) if not x.strip()), len(part))
        head, rest = part[:n], part[n + 1 :]
        if not head:
            continue
        if head[0].strip().startswith(("SITE_GROUP:", "SITE GROUP:")):
            site = head[0].split(":", 1)[1].strip()
            continue
        if not rest and k < len(parts):  # the rule below the header
            rest, k = parts[k], k + 1
        meta, skipping = {}, False
        for x in map(str.strip, head):
            skipping = x in ("ATTACHMENTS:", "DOWNLOADED_FILES:") or (skipping and x.startswith("- "))
            key, colon, value = x.partition(":")
            if not skipping and colon and key in META:
                meta[key] = value.strip()
        if meta.get("URL"):
            yield (
                meta.get("SITE", site), meta.get("LANGUAGE", ""), meta.get("SOURCE_TYPE", ""), meta["URL"], meta.get("TITLE", meta["URL"]), meta.get("SECTION", ""),
                meta.get("SCRAPED_AT") or meta.get("CRAWLED_AT", ""), meta.get("CONTENT_HASH", ""), "\n".join(rest).strip(),
            )


def block_records(files: DataFrame) -> DataFrame:
    """path, pos and the record's columns, for files (path, text) in block form; a task holds a batch of files (Arrow's limit
    of bytes) and RECORDS records of one of them."""
    schema = "path string, pos bigint, " + ", ".join(f"{c} string" for c in RECORD)

    kinds = pa.schema([("path", pa.string()), ("pos", pa.int64()), *((c, pa.string()) for c in RECORD)])

    def rows(batches):
        for path, text in ((p.as_py(), t.as_py()) for b in batches for p, t in zip(b.column(0), b.column(1), strict=True)):
            found = enumerate(_records(text or ""))
            while some := [dict(zip(kinds.names, (path, k, *r), strict=True)) for k, r in islice(found, RECORDS)]:
                yield pa.RecordBatch.from_pylist(some, kinds)

    return files.select("path", "text").mapInArrow(rows, schema)


def cleaned_lines(pages: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """id, pos and line of each body: no noise, every line once, nothing before the first heading, and no navigation
    after it."""
    body = F.regexp_replace(normalized(F.col(body_col)), r"\s+(\[H[1-6]\])", "\n$1")
    lines = pages.select(F.col(id_col).alias("id"), F.posexplode(F.split(body, "\n", -1)).alias("pos", "line"))
    line = T.strip_placeholder_cells(T.trimmed(F.col("line")))
    lines = lines.select("id", "pos", line.alias("line")).filter(~T.is_noise_line(F.col("line")))
    lines = lines.withColumn("line", T.squeezed(F.regexp_replace("line", r"^\s*[-*]\s+", "- ")))
    mark = F.regexp_extract("line", r"^(\[H[1-6]\])\s+.+$", 1)
    lines = lines.withColumn("mark", mark).withColumn("heading", F.when(F.col("mark") != "", T.clean_heading_line(F.col("line"))))
    lines = lines.filter("heading is null or heading <> ''").filter(F.col("heading").isNull() | ~T.is_noise_line(F.col("heading")))
    lines = lines.withColumn("line", F.when(F.col("heading").isNotNull(), F.concat_ws(" ", "mark", "heading")).otherwise(F.col("line")))
    lines = lines.withColumn("key", T.line_key(F.col("line")))
    once = F.when(F.length("key") > 3, F.col("key")).otherwise(F.concat(F.lit("#"), F.col("pos")))
    lines = lines.groupBy("id", once.alias("k")).agg(F.min(F.struct("pos", "line", "key")).alias("x")).select("id", "x.*")
    whole = W.partitionBy("id")
    top = F.col("line").rlike(r"^\[H[1-3]\]")
    lines = lines.withColumn("first", F.min(F.when(top, F.col("pos"))).over(whole)).filter("first is null or pos >= first")
    lines = lines.withColumn("head", F.max(F.when(F.col("pos") == F.col("first"), T.line_key(T.clean_heading_line(F.col("line"))))).over(whole))
    content = (F.col("pos") > F.col("first")) & ~T.is_nav_prefix(F.col("line"), F.col("head"))
    lines = lines.withColumn("begins", F.min(F.when(content, F.col("pos"))).over(whole))
    return lines.filter("first is null or pos = first or pos >= begins").select("id", F.col("pos").cast("bigint").alias("pos"), "line")


def clean_bodies(pages: DataFrame, id_col: str = "id", body_col: str = "body") -> DataFrame:
    """id and body, cleaned: wrapped lines joined again, orphans and contents lines out."""
    lines = cleaned_lines(pages, id_col, body_col)
    every = lines.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]).alias("l"))
    kept = F.filter(repaired(F.col("l")), lambda x: ~T.is_orphan_fragment(x) & ~T.is_noise_line(x) & ~T.is_contents_line(x))
    found = every.select("id", T.trimmed(F.array_join(kept, "\n")).alias("body"))
    return pages.select(F.col(id_col).alias("id")).distinct().join(found, "id", "left").select("id", F.coalesce("body", F.lit("")).alias("body"))


def dedupe_records(records: DataFrame) -> DataFrame:
    """The record kept for each page. records: pos and RECORD's columns, with clean bodies.

    Records of one key (content hash, else address) are folded in order: a record takes the place of the one held if
    its words and bonuses exceed the words alone of the one held. Then the record with most words stays for each
    address, the first of equals. What is gathered for a key is three numbers a record; bodies join afterwards."""
    r = records.withColumn("url", T.canonical_url(F.col("url"))).filter(~T.is_bad_url(F.col("url")))
    r = r.withColumn("words", T.useful_word_count(F.col("body"))).filter(F.col("words") >= LEAST_WORDS)
    bonus = (
        F.when(F.col("source_type") == "structured_jsonl", 1000).otherwise(0) + F.when(F.col("url").startswith("https://"), 20).otherwise(0)
        + F.when((F.col("title") != "") & (F.col("title") != F.col("url")), 10).otherwise(0)
    )
    slim = r.select("pos", "url", "words", (F.col("words") + bonus).alias("score"), F.coalesce(F.nullif("content_hash", F.lit("")), "url").alias("key"))
    steps = F.array_sort(F.collect_list(F.struct("pos", "words", "score")))
    start = F.struct(F.lit(-1).cast("bigint").alias("pos"), F.lit(-1).cast("bigint").alias("words"))
    held = F.aggregate(
        steps, start, lambda a, x: F.when((a["pos"] < 0) | (x["score"] > a["words"]), F.struct(x["pos"].cast("bigint").alias("pos"), x["words"].cast("bigint").alias("words"))).otherwise(a)
    )
    # A page's place is that of its key's first record.
    best = slim.groupBy("key").agg(held.alias("held"), F.min("pos").alias("place")).select("held.*", "place").join(slim.select("pos", "url"), "pos")
    best = best.groupBy("url").agg(F.min(F.struct((-F.col("words")).alias("w"), "place", "pos")).alias("b")).select(F.col("b.pos").alias("pos"))
    return r.drop("words").join(best, "pos")


def formatted(records: DataFrame, with_site_group: bool = False) -> DataFrame:
    """n and block of each record in order of site, language, section and address: its header between rules, and its
    body; a SITE_GROUP header where the site changes."""
    label = T.site_label(F.col("site"), F.col("url"))
    header = F.concat_ws(
        "\n", F.lit(SEPARATOR), F.concat(F.lit("URL: "), "url"), F.concat(F.lit("TITLE: "), "title"),
        F.concat(F.lit("SECTION: "), F.coalesce(F.nullif("section", F.lit("")), F.nullif("site", F.lit("")), F.lit("General"))),
        F.when(F.col("language") != "", F.concat(F.lit("LANGUAGE: "), "language")), F.concat(F.lit("SITE: "), label), F.concat(F.lit("SCRAPED_AT: "), "scraped_at"), F.lit(SEPARATOR),
    )
    rows = records.withColumn("order", F.struct("site", "language", "section", "url"))
    numbered = global_row_number(rows, "order")
    # The row before, by its number: no window over all rows.
    labels = numbered.select((F.col("n") + 1).alias("n"), label.alias("before"))
    marked = numbered.join(labels, "n", "left")
    group = F.when(F.lit(with_site_group) & (F.col("before").isNull() | (F.col("before") != label)), F.concat_ws("\n", F.lit(SEPARATOR), F.concat(F.lit("SITE_GROUP: "), label), F.lit(SEPARATOR), F.lit("")))
    return marked.select("n", F.concat_ws("\n", group, header, F.lit(""), T.trimmed(F.col("body")), F.lit("")).alias("block"))


def write_blocks(records: DataFrame, path: str, with_site_group: bool = False) -> None:
    """The records as text files in block form, RECORDS to a file at most, as a file is read whole. Files hold the records in
    order; their names do too, while a task writes fewer than 1,000 files."""
    formatted(records, with_site_group).orderBy("n").select("block").write.mode("overwrite").option("maxRecordsPerFile", RECORDS).text(path)


def read_files(spark, path: str, glob: str = "*.txt") -> DataFrame:
    """path and text of every file below a folder that fits the glob, each whole."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
