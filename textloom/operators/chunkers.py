"""Chunkers by kind of document: sections are windows over lines, packing to a budget a fold over a section's parts.

Each gives doc_id, chunk_index, section_title, text, is_table and token_estimate. Chunks are numbered before those
that cleaning empties are dropped, so numbers may have gaps."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as D

from textloom.functions import text as T
from textloom.functions.rows import each

from .chunks import BUDGETS, estimate, packed

#: What begins a section of a policy, a service of a guide and a part of a service.
POLICY_START = r"^(?:PART\s+\d+[.:]\s+|Schedule\s+\d+|\d+(?:\.\d+)+\.?\s+|\d+\.\s+[A-Z])"
SERVICE = r"^#\s+[A-Z][A-Z\s/&–-]{4,}$"
PART_START = r"(?i)^(?:\d+\.\s+.{10,}|Step\s+\d+|Application Process|Required documents?|Note[:\s]|CONTACT|SERVICE\s+TYPE)"
PAGE_RULE = re.compile(r"^(?:##\s*)?={10,}")
PAGE_META = ("SITE:", "LANGUAGE:", "SITE_GROUP:", "SOURCE_TYPE:", "CRAWLED_AT:", "SCRAPED_AT")
PAGE_NOISE = r"(?i)^(?:\[IMAGE:|PDF LINK:|Home\b|Filter\b|SITE:|SITE_GROUP:|LANGUAGE:|SOURCE_TYPE:|SCRAPED_AT:|CRAWLED_AT:|\d+\s*$)"
HEADING = re.compile(r"^\[(H[1-6])\]\s*(.*)")
LEAST, LEAST_POLICY = 20, 80


def parts_of(text: Column, budget: Column | int, always: bool = False) -> Column:
    """Array of the chunks of a text over its budget (or, always, of any); else the text alone."""

    most = F.lit(budget) if isinstance(budget, int) else budget
    over = text.isNotNull() & (F.lit(always) | (T.token_estimate(text) > most))

    def split(row) -> list[str]:
        return [c for c in packed(row["t"], row["n"]) if c] or [row["t"]]

    # Only texts over their budget pass through Python.
    cut = each(F.when(over, F.struct(text.alias("t"), most.alias("n"))), split, D.ArrayType(D.StringType()))
    return F.when(text.isNotNull(), F.coalesce(cut, F.array(text)))


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n", -1)).alias("pos", "line"))


def joined(rows: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """The lines of each group in order, as one `body`."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    return rows.groupBy(*keys).agg(F.array_join(lines, "\n").alias("body"), *more)


def numbered(pieces: DataFrame, order: list[str]) -> DataFrame:
    """Pieces (doc_id, the order's columns, title, text, is_table) as chunks."""
    at = F.row_number().over(W.partitionBy("doc_id").orderBy(*order)) - 1
    out = pieces.select("doc_id", at.cast("bigint").alias("chunk_index"), F.left("title", F.lit(120)).alias("section_title"), T.clean_chunk_text(F.col("text")).alias("text"), "is_table")
    return out.filter("text <> ''").withColumn("token_estimate", T.token_estimate(F.col("text")))


def _first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def faq(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A chunk for each `## N.` question."""
    sections = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), r"(?md)(?=^##\s+\d+[.)])", -1)).alias("section", "s"))
    sections = sections.withColumn("s", T.trimmed(F.col("s"))).filter((F.col("s") != "") & (T.token_estimate(F.col("s")) >= LEAST))
    pieces = sections.select("doc_id", "section", T.clean_heading(_first_line(F.col("s"))).alias("title"), F.posexplode(parts_of(F.col("s"), BUDGETS["faq"])).alias("part", "text"), F.lit(False).alias("is_table"))
    return numbered(pieces, ["section", "part"])


def table_faq(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A chunk for each table row of category, question and answer; an empty category is the one above."""
    rows = lines_of(docs, id_col, text_col).filter(F.col("line").startswith("|") & ~F.col("line").rlike(r"^\|\s*[-:]+"))
    cells = F.transform(F.split(F.regexp_replace(T.trimmed(F.col("line")), r"^\|+|\|+$", ""), r"\|", -1), T.trimmed)
    by = W.partitionBy("doc_id").orderBy("pos")
    rows = rows.withColumn("r", F.row_number().over(by)).filter("r > 1").withColumn("c", cells)
    rows = rows.select("doc_id", "pos", *[F.coalesce(F.get("c", i), F.lit("")).alias(c) for i, c in enumerate(("category", "question", "answer"))])
    rows = rows.filter("question <> '' and answer <> ''").withColumn("category", F.coalesce(F.last(F.nullif("category", F.lit("")), ignorenulls=True).over(by), F.lit("")))
    text = F.concat(F.lit("Category: "), "category", F.lit("\nQuestion: "), "question", F.lit("\nAnswer: "), "answer")
    return numbered(rows.select("doc_id", "pos", F.left("question", F.lit(100)).alias("title"), text.alias("text"), F.lit(False).alias("is_table")), ["pos"])


def policy_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, section, title and body: cut at # headings, PART, Schedule and numbers; contents lines left out."""
    by = W.partitionBy("doc_id").orderBy("pos")
    s = T.trimmed(F.col("line"))
    lines = lines_of(docs, id_col, text_col).filter(~s.rlike(r"\.{4,}\s*\d+\s*$"))
    heading = T.clean_heading(F.col("line"))
    lines = lines.withColumn("s", s).withColumn("is_mark", F.col("line").startswith("#")).withColumn("heading", F.when(F.col("is_mark") & (F.length(heading) > 2), heading))
    opens = ~F.col("is_mark") & F.col("s").rlike(POLICY_START) & (F.regexp_replace("s", POLICY_START, "") != "")
    lines = lines.withColumn("title", F.coalesce("heading", F.when(opens, F.left("s", F.lit(120)))))
    lines = lines.withColumn("section", F.sum(F.col("title").isNotNull().cast("bigint")).over(by))
    titles = F.coalesce(F.max("title"), F.lit("Introduction")).alias("title")
    body = F.transform(F.filter(F.array_sort(F.collect_list(F.struct("pos", "is_mark", "line"))), lambda x: ~x["is_mark"]), lambda x: x["line"])
    found = lines.groupBy("doc_id", "section").agg(titles, T.trimmed(F.array_join(body, "\n")).alias("body"))
    return found.filter("body <> ''")


def policy(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sections, small ones joined to the one before while both stay small; junk left out."""

    def merge(sections) -> list[dict]:
        out: list[dict] = []
        for x in sections:
            both = f"{out[-1]['body']}\n\n{x['body']}".strip() if out else x["body"]
            if out and estimate(both) < LEAST_POLICY:
                out[-1]["body"] = both
            else:
                out.append({"title": x["title"], "body": x["body"]})
        return out

    kind = D.ArrayType(D.StructType().add("title", "string").add("body", "string"))
    sections = policy_sections(docs, id_col, text_col).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section", "title", "body"))).alias("s"))
    rows = sections.select("doc_id", F.posexplode(each(F.transform("s", lambda x: F.struct(x["title"].alias("title"), x["body"].alias("body"))), merge, kind)).alias("section", "x"))
    rows = rows.select("doc_id", "section", "x.title", T.clean_chunk_text(F.col("x.body")).alias("body")).filter("body <> ''").filter(~T.is_junk_chunk(F.col("body")))
    pieces = rows.select("doc_id", "section", "title", F.posexplode(parts_of(F.col("body"), BUDGETS["policy"])).alias("part", "text"), F.lit(False).alias("is_table"))
    return numbered(pieces.filter(~T.is_junk_chunk(F.col("text"))), ["section", "part"])


def table_runs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Lines (keys, pos, line) with is_table (they begin with a bar) and `run`, which tells runs of either kind apart."""
    own = W.partitionBy(*keys).orderBy("pos")
    rows = rows.withColumn("is_table", F.col("line").startswith("|"))
    run = F.row_number().over(own) - F.row_number().over(W.partitionBy(*keys, "is_table").orderBy("pos"))
    return rows.withColumn("run", run)


def _tables_apart(rows: DataFrame, keys: list[str], budget: int, always: bool) -> DataFrame:
    """Pieces of lines (keys, title, pos, line): each run of table lines under its title, each run of prose of more than
    LEAST tokens, packed."""
    runs = joined(table_runs(rows, keys), [*keys, "title", "is_table", "run"], F.min("pos").alias("start"))
    tables = runs.filter("is_table").select(*keys, "start", "title", F.lit(0).alias("part"), F.concat(F.lit("**"), "title", F.lit("**\n\n"), "body").alias("text"), "is_table")
    prose = runs.filter("not is_table").withColumn("body", T.trimmed(F.col("body"))).filter(T.token_estimate(F.col("body")) > LEAST)
    prose = prose.select(*keys, "start", "title", F.posexplode(parts_of(F.col("body"), budget, always)).alias("part", "text"), "is_table")
    return tables.unionByName(prose)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sections at # to ### headings; contents left out; tables and prose apart."""
    sections = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), r"(?md)(?=^#{1,3}\s)", -1)).alias("section", "s"))
    sections = sections.withColumn("s", T.trimmed(F.col("s"))).filter((F.col("s") != "") & (T.token_estimate(F.col("s")) >= LEAST)).withColumn("l", F.split("s", "\n", -1))
    first = F.get("l", 0)
    sections = sections.withColumn("title", F.when(first.startswith("#"), T.clean_heading(first)).otherwise("Section")).withColumn("l", F.slice("l", 2, F.size("l")))
    filled = F.filter("l", lambda x: T.trimmed(x) != "")
    contents = (F.size(filled) >= 3) & (F.size(F.filter(filled, lambda x: x.rlike(r"\.{4,}\s*\d+\s*$"))) / F.size(filled) > 0.4)
    sections = sections.filter(~F.col("title").rlike(r"(?i)table\s+of\s+contents")).filter(~contents)
    rows = sections.select("doc_id", "section", "title", F.posexplode("l").alias("pos", "line"))
    return numbered(_tables_apart(rows, ["doc_id", "section"], BUDGETS["report"], always=False), ["section", "start", "part"])


def guidebook(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Services under # headings in capitals, cut at numbers and key words; a document without services is a policy."""
    has = F.exists(F.split(F.coalesce(text_col, F.lit("")), "\n", -1), lambda x: T.trimmed(x).rlike(SERVICE))
    by = W.partitionBy("doc_id").orderBy("pos")
    lines = lines_of(docs.filter(has), id_col, text_col).withColumn("s", T.trimmed(F.col("line"))).withColumn("service", F.when(F.col("s").rlike(SERVICE), T.clean_heading(F.col("line"))))
    lines = lines.withColumn("n", F.count("service").over(by)).filter("n > 0")
    inner = W.partitionBy("doc_id", "n").orderBy("pos")
    lines = lines.withColumn("name", F.first("service").over(inner)).filter("service is null")
    number = F.col("s").rlike(r"^\d+\.\s+.+")
    opens = F.when(number, F.left("s", F.lit(120))).when(F.col("s").rlike(PART_START) & (F.length("s") > 5), F.left("s", F.lit(80)))
    lines = lines.withColumn("opens", opens).withColumn("m", F.count("opens").over(inner))
    part = W.partitionBy("doc_id", "n", "m")
    lines = lines.withColumn("title", F.concat_ws(" – ", "name", F.coalesce(F.max("opens").over(part), F.lit("Overview"))))
    size = F.sum(F.length("line") + 1).over(part)
    lines = lines.withColumn("size", size).filter(F.col("size") >= 4 * LEAST)
    services = numbered(_tables_apart(lines.select("doc_id", "n", "m", "title", "pos", "line"), ["doc_id", "n", "m"], BUDGETS["guidebook"], always=True), ["n", "m", "start", "part"])
    return services.unionByName(policy(docs.filter(~has), id_col, text_col))


def web_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, url, title, section, heading and the lines of each section of the pages in a text: a page begins at
    `URL:`, a section at a rule or at an [H1] or [H2] other than the heading at hand; deeper headings are lines."""

    def of(text: str):
        page = {"url": "", "title": "", "section": ""}
        heading, lines, inside = "", [], False
        for raw in text.splitlines():
            line = raw.strip()
            rule = bool(PAGE_RULE.match(line))
            m = None if rule else HEADING.match(line)
            new = m is not None and m[1] in ("H1", "H2") and bool(m[2].strip()) and m[2].strip() != heading
            if inside and lines and (rule or new or line.startswith("URL:")):
                yield {**page, "heading": heading or page["title"] or "Page", "lines": lines}
                lines = []
                heading = page["title"] or "Page" if rule else heading
            if rule or line.startswith(PAGE_META):
                continue
            key, _, value = line.partition(":")
            if key == "URL" and line.startswith("URL:"):
                page, heading, lines, inside = {"url": value.strip(), "title": "", "section": ""}, "", [], True
            elif line.startswith("TITLE:"):
                page["title"] = heading = value.strip()
            elif line.startswith("SECTION:"):
                page["section"] = value.strip()
            elif inside and new:
                heading = m[2].strip()
            elif inside and m is not None:
                lines += [m[2].strip()] if m[2].strip() and m[1] not in ("H1", "H2") else []
            elif inside:
                lines.append(raw)
        if inside and lines:
            yield {**page, "heading": heading or page["title"] or "Page", "lines": lines}

    kind = D.StructType()
    for c in ("url", "title", "section", "heading"):
        kind = kind.add(c, "string")
    cut = each(F.coalesce(text_col, F.lit("")), lambda t: list(of(t)), D.ArrayType(kind.add("lines", D.ArrayType(D.StringType()))))
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(cut).alias("n", "x")).select("doc_id", "n", "x.*")


def web(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sections of pages, each under its address, title and section; noise and short lines out."""
    good = lambda x: T.let(T.trimmed(x), lambda s: (s != "") & ~s.rlike(PAGE_NOISE) & ~T.is_low_value_line(s) & (F.length(s) > 20))
    rows = web_sections(docs, id_col, text_col).withColumn("body", T.trimmed(F.array_join(F.filter("lines", good), "\n"))).filter(T.token_estimate(F.col("body")) >= 30)
    context = F.concat(F.lit("URL: "), "url", F.lit("\nTitle: "), "title", F.lit("\nSection: "), "section")
    rows = rows.withColumn("context", context).withColumn("lead", F.concat("context", F.lit("\n\n## "), "heading", F.lit("\n\n")))
    fits = T.token_estimate(F.concat("lead", "body")) <= BUDGETS["web"]
    budget = F.when(fits, F.lit(1 << 30)).otherwise(BUDGETS["web"] - T.token_estimate(F.col("context")) - 20)
    pieces = rows.select("doc_id", "n", "lead", F.left("heading", F.lit(100)).alias("title"), F.posexplode(parts_of(F.col("body"), budget.cast("int"))).alias("part", "p"), F.lit(False).alias("is_table"))
    return numbered(pieces.withColumn("text", F.concat("lead", "p")), ["n", "part"])


def single(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.lit(0).alias("n"), F.lit("").alias("title"), T.trimmed(F.coalesce(text_col, F.lit(""))).alias("text"), F.lit(False).alias("is_table"))
    return numbered(rows.filter("text <> ''"), ["n"])


STRATEGIES = {"faq": faq, "table_faq": table_faq, "policy": policy, "report": report, "guidebook": guidebook, "web": web, "single": single}


def dispatched(docs: DataFrame, routes: list[tuple[str, str, str]], name_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks of the documents whose name a route knows. routes: (name, domain, strategy); they are part of the plan, so
    they stay few. Each chunk gets its id from the domain, the name and its number."""
    out = None
    for strategy in sorted({s for *_, s in routes}):
        own = {n: d for n, d, s in routes if s == strategy}
        some = docs.filter(F.col(name_col).isin(*own))
        names = some.select(F.col(id_col).alias("_id"), F.col(name_col).alias("source_file"))
        domain = F.lit(None).cast("string")
        for n, d in own.items():
            domain = F.when(F.col("source_file") == n, d).otherwise(domain)
        made = STRATEGIES[strategy](some, id_col, text_col).join(names, F.col("doc_id") == F.col("_id")).drop("_id").withColumn("domain", domain).withColumn("strategy", F.lit(strategy))
        out = made if out is None else out.unionByName(made)
    return out.withColumn("chunk_id", T.chunk_id(F.col("domain"), T.source_slug(F.col("source_file")), F.col("chunk_index")))
