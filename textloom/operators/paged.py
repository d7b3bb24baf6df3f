"""Documents that come as pages: finding the pages, cleaning each, and taking out what is repeated on their edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from textloom.functions import text as T
from textloom.functions.rows import each
from textloom.sources.shared import kept

from .chunks import merged_markers, repaired
from .pages import normalized

BREAKS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
#: Words that a page needs before a lone number ends it, and that a cleaned page needs to stay.
ENOUGH_WORDS, LEAST_WORDS = 20, 15
#: Lines of a page's upper and lower edge.
EDGE = 4


def _cuts(marks: Column) -> Column:
    """Of the marks of a document in order (n, opens, words before it) the n of those that begin a page: all that open one,
    and lone numbers with more than ENOUGH_WORDS since the last cut."""

    def chosen(rows) -> list[int]:
        out, base = [], 0
        for r in rows:
            if r["opens"] or r["words"] - base > ENOUGH_WORDS:
                out.append(r["n"])
                base = r["words"]
        return out

    return each(marks, chosen, ArrayType(IntegerType()))


def page_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, page (from 1), n and line of every line on a page. A line `[H2] Page 3` begins a page; a line of one to three
    digits ends one that has enough words, and is left out anyway."""
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(normalized(F.col(text_col)), BREAKS, -1)).alias("n", "line"))
    lines = lines.select("id", "n", T.trimmed(F.col("line")).alias("line"))
    opens, number = F.col("line").rlike(r"(?i)^\[H2\]\s+Page\s+\d+"), F.col("line").rlike(r"^\d{1,3}$")
    lines = lines.withColumn("opens", opens).withColumn("mark", opens | number)
    lines = kept(lines.withColumn("own", F.when(F.col("mark"), 0).otherwise(T.useful_word_count(F.col("line")))), "lines")
    before = W.partitionBy("id").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    counts = lines.select("id", "n", "opens", "mark", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("words"))
    marks = counts.filter("mark").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "opens", "words"))).alias("m"))
    cuts = marks.select("id", F.explode(_cuts(F.col("m"))).alias("n"), F.lit(None).cast("string").alias("line"), F.lit(1).alias("cut"))
    # A cut is a row beside its mark, whose equal place counts it; lines and cuts meet by document alone.
    every = lines.filter(~F.col("mark")).select("id", "n", "line", F.lit(0).alias("cut")).union(cuts)
    parted = every.withColumn("part", F.sum("cut").over(W.partitionBy("id").orderBy("n"))).filter("cut = 0")
    return parted.select("id", F.dense_rank().over(W.partitionBy("id").orderBy("part")).alias("page"), "n", "line")


def _cleaned(lines: DataFrame) -> DataFrame:
    """id, page and l: the lines of each page that stays, cleaned, as an array."""
    page = W.partitionBy("id", "page")
    contents = F.min(F.when(F.col("line").rlike(r"(?i)\bTable of Contents\b"), F.col("n"))).over(page)
    lines = lines.withColumn("until", contents).filter("until IS NULL OR n < until")
    lines = lines.filter(~T.is_noise_line(F.col("line")) & ~T.is_contents_line(F.col("line")))
    line = F.regexp_replace("line", r"^#{1,6}\s+", "")
    parted = F.regexp_replace(F.regexp_replace(line, r"(?i)\bEnd-\s+if-?\s*Service\b", "End-of-Service"), r"(?i)\bEnd-\s+of-\s+Service\b", "End-of-Service")
    parted = F.regexp_replace(parted, r"\b([A-Za-z])-\s+([a-z]{2,})\b", "$1$2")
    line = F.when(F.col("line").rlike(r"-\s"), parted).otherwise(line)
    lines = lines.withColumn("line", T.trimmed(F.regexp_replace(line, r"\s{2,}", " "))).filter("line <> ''")
    every = lines.groupBy("id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]).alias("l"))
    each = every.select("id", "page", F.posexplode(merged_markers(F.col("l"))).alias("k", "line"))
    marks = {
        "heading": T.is_heading(F.col("line")), "ended": F.col("line").rlike("[.!?;:]$"), "lists": T.is_contents_line(F.col("line")) | F.col("line").rlike(r"^\d{1,3}$"),
        "names": F.col("line").rlike(r"(?i)\b(CONTENT|Table of Contents)\b"), "numbered": F.col("line").rlike(r"^\d+\.\s+"),
    }
    each = each.select("id", "page", "k", "line", T.useful_word_count(F.col("line")).alias("words"), *[x.alias(c) for c, x in marks.items()])
    count = lambda c: F.count_if(F.col(c)).over(page)
    n = F.count("*").over(page)
    each = each.select(
        "id", "page", "k", "line", "heading", n.alias("lines"), F.sum("words").over(page).alias("words"), *[count(c).alias(f"n_{c}") for c in marks],
        F.min(F.when(F.col("numbered"), F.col("k"))).over(page).alias("first"),
    )
    table = (F.col("n_names") > 0) & (F.col("n_lists") + 3 >= F.col("lines") * 0.25)
    only_headings = (F.col("lines") >= 4) & (F.col("n_heading") / F.col("lines") > 0.8) & (F.col("n_ended") <= 1)
    each = each.filter(~table & ~only_headings & (F.col("words") >= LEAST_WORDS))
    # What stands before the first numbered line goes, but a heading right above it.
    above = (F.col("k") == F.col("first") - 1) & F.col("heading") & ~F.col("line").rlike(r"\d+\s*$")
    each = each.filter((F.coalesce("first", F.lit(0)) <= 1) | (F.col("k") >= F.col("first")) | above)
    every = each.groupBy("id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]).alias("l"))
    return every.select("id", "page", repaired(F.col("l")).alias("l"))


def without_repeated(pages: DataFrame) -> DataFrame:
    """id, page, k and line of pages (id, page, l: lines), without the lines that repeat on the edges of a document's pages: on
    three or more of the first and last four lines, and on a quarter of the pages at least. They go wherever they stand."""
    lines = pages.select("id", "page", F.size("l").alias("m"), F.posexplode("l").alias("k", "line")).withColumn("key", T.line_key(F.col("line")))
    on_edge = (F.col("k") < EDGE).cast("int") + (F.col("k") >= F.col("m") - EDGE).cast("int")
    often = lines.filter((on_edge > 0) & F.length("key").between(5, 90)).groupBy("id", "key").agg(F.sum(on_edge).alias("c"))
    counts = pages.groupBy("id").agg(F.count("*").alias("pages"))
    repeated = often.join(counts, "id").filter((F.col("c") >= 3) & (F.col("c") >= F.greatest(F.lit(2), F.floor(F.col("pages") / 4))))
    return lines.join(repeated.select("id", "key"), ["id", "key"], "left_anti").select("id", "page", "k", "line")


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and text: the pages that stay, each under `[H2] Page n`, headings marked by their kind. A document of which nothing
    stays keeps its text, trimmed. Pages are cleaned by themselves; only their edge lines meet, by document and line."""
    pages = kept(_cleaned(page_lines(docs, id_col, text_col)), "pages")
    numbered = pages.select("id", "page", F.row_number().over(W.partitionBy("id").orderBy("page")).alias("no"))
    heading = T.clean_heading_line(F.col("line"))
    sub = heading.rlike(r"^\d+(?:\.\d+)*\.?\s+") & ~heading.rlike(r"(?i)^(PART|Schedule|Chapter)\s+\d+")
    shown = F.when(~F.col("line").startswith("|") & T.is_heading(F.col("line")), F.concat(F.when(sub, "## ").otherwise("# "), heading)).otherwise(F.col("line"))
    lines = without_repeated(pages).select("id", "page", "k", shown.alias("line")).join(numbered, ["id", "page"]).select("id", "no", "k", "line")
    heads = numbered.select("id", "no", F.lit(-1).alias("k"), F.concat(F.when(F.col("no") > 1, "\n").otherwise(""), F.lit("[H2] Page "), "no").alias("line"))
    every = lines.union(heads).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("no", "k", "line"))).alias("l"))
    text = T.trimmed(F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    found = every.select("id", text.alias("clean"))
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    clean = F.coalesce(F.nullif(F.col("clean"), F.lit("")), T.trimmed(F.col("t")))
    return own.join(found, "id", "left").select("id", F.concat(clean, F.lit("\n")).alias("text"))
