"""Quality rules with host-level verdicts (native DataFrame functions only).

Each document is measured by a few rules. Failures are summed by host, each host's failure rate is shrunk
towards the whole by a beta prior fitted to the hosts by the method of moments, and the shrunk rate goes back to
the host's documents, where it is the prior of a document's own verdict.

Defined results: a null text is an empty one (no words, so it fails the base rule); null hosts form one host;
repeated rows are measured and counted each by itself; an empty table gives an empty result; other columns of
the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OTHER_SPACE, keep, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Log-odds that one document's own rules add to (failing) or take from (passing) its host's.
EVIDENCE = 3.0
#: So many hosts (a few MB) are broadcast at most.
FEW_HOSTS = 50_000


def _let(value: Column, body) -> Column:
    """Evaluate an array expression once per row and use it by name."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _paired(a: str, b: str, ahead: int) -> Column:
    """Hash of each item of array a with the item `ahead` places on in array b, as far as both go."""
    left = F.slice(a, 1, F.greatest(F.least(F.size(a), F.size(b) - ahead), F.lit(0)))
    right = F.slice(b, ahead + 1, F.greatest(F.least(F.size(a), F.size(b) - ahead), F.lit(0)))
    return F.zip_with(left, right, lambda x, y: F.xxhash64(x, y))


def _covered(hashes: Column) -> Column:
    """Words inside windows that occur twice or more, from (hash, position) pairs in order of hash: the windows
    equal to a neighbour in that order, by position, cover 5 words each less their overlap with the last one."""
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = _let(
        pairs,
        lambda p: F.transform(
            F.filter(
                p,
                lambda x, k: (F.get(p, k - 1)["h"] == x["h"]).__and__(k > 0) | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False)),
            ),
            lambda x: x["i"],
        ),
    )
    total = F.aggregate(
        F.array_sort(repeated),
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")),
    )["n"]
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(total)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document: the row itself as `row`, and the counts of the rules."""
    text = F.coalesce(docs[text_col], F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^ {OTHER_SPACE}]"))
    d = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        docs[id_col].alias("doc_id"),
        docs[host_col].alias("host"),
        words(text).alias("w"),
        F.regexp_count(text, F.lit("[" + SYMBOLS + "]")).cast("bigint").alias("n_symbols"),
        lines.alias("lines"),
    )
    d = d.withColumn("n_lines", F.size("lines").cast("bigint"))
    d = d.withColumn("n_dup_lines", F.col("n_lines") - F.size(F.array_distinct("lines")))
    # Windows of five words: hashes of one word and the next, of two such pairs, of those and a fifth word.
    d = d.withColumn("n_words", F.size("w").cast("bigint")).withColumn("word_chars", F.length(F.array_join("w", "")).cast("bigint"))
    d = d.withColumn("h2", _paired("w", "w", 1)).withColumn("h4", _paired("h2", "h2", 2))
    return d.select(
        "row", "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines",
        _let(_paired("h4", "w", 4), _covered).alias("n_repeat_words"),
    ).withColumn(
        "base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    )


def rule_failed() -> Column:
    """A document's own rules: the base rule, many symbols (over a tenth of its characters) or many repeated
    lines (over three tenths of its lines)."""
    return (
        F.col("base_failed")
        | (10 * F.col("n_symbols") > F.col("word_chars"))
        | (10 * F.col("n_dup_lines") > 3 * F.col("n_lines"))
    )


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Beta(a, b) from the hosts' rates by moments: the spread of the rates less what counting alone gives.
    One row of sums comes to the driver. Without spread between hosts the prior holds as much as 10,000 documents."""
    s = hosts.select(
        F.count("*").alias("k"), F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"),
        F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")).alias("ff"), F.sum(1.0 / F.col("n_docs")).alias("inv"),
        F.sum(F.col("n_docs") * F.col("n_docs")).alias("nn"),
    ).first()
    if not s["n"]:
        return 1.0, 1.0
    n, k = float(s["n"]), s["k"]
    mean = min(max(float(s["f"]) / n, 1e-6), 1 - 1e-6)
    between = float(s["ff"]) - n * mean * mean - (k - 1) * mean * (1 - mean)
    scale = n - float(s["nn"]) / n
    spread = between / scale if scale > 0 else 0.0
    strength = mean * (1 - mean) / spread - 1 if spread > 0 else math.inf
    strength = min(max(strength, 1.0), 10_000.0)
    return mean * strength, (1 - mean) * strength


def _rates(measured: DataFrame) -> DataFrame:
    """The shrunk rate of every host; a table of few hosts is marked for broadcasting."""
    hosts = keep(measured.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(rule_failed().cast("bigint")).alias("n_failed")))
    a, b = beta_prior(hosts)
    rates = hosts.select(F.col("host").alias("of"), ((F.col("n_failed") + a) / (F.col("n_docs") + a + b)).alias("host_rate"))
    return F.broadcast(rates) if hosts.count() <= FEW_HOSTS else rates


def _judged(measured: DataFrame, rates: DataFrame) -> DataFrame:
    joined = measured.join(rates, measured["host"].eqNullSafe(rates["of"]), "left").drop("of")
    odds = F.log(F.col("host_rate") / (1 - F.col("host_rate"))) + F.when(rule_failed(), EVIDENCE).otherwise(-EVIDENCE)
    return joined.withColumn("kept", ~F.col("base_failed") & (odds < 0))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host, the counts, base_failed, host_rate (shrunk) and kept.

    A document is rejected where it fails the base rule, or where the host's shrunk log-odds of failing and the
    document's own evidence (EVIDENCE, plus or minus) come to zero or more: a failing document of an ordinary
    host goes, one of a spotless host stays, and a document that fails nothing goes only from a host where
    nearly all fail."""
    m = keep(measure(docs, id_col, text_col, host_col).drop("row"))
    return _judged(m, _rates(m))


def _computed(measured: DataFrame) -> DataFrame:
    """The same rows with the counts behind a generator: a filter on them can't be pushed down to the scan, where it
    would measure the texts anew for each of its terms."""
    counts = F.array(F.struct(*[c for c in measured.columns if c not in ("row", "doc_id", "host")]))
    return measured.select("row", "doc_id", "host", F.inline(counts))


def filter_rejected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows that quality_rules keeps, with all their columns. Texts are measured twice, once for the hosts and
    once for the verdict, which costs less than a shuffle of them."""
    m = measure(docs, id_col, text_col, host_col)
    return _judged(_computed(m), _rates(m)).filter("kept").select("row.*")
