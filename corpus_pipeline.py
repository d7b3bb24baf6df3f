"""A corpus through five operators: quality rules, near duplicates, secrets, mixing and encoding.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns the next stage's docs, with the
columns of documents. The last stage returns what the corpus is encoded to, a row per document.

Defined results: a document without text, or with an empty one, fails the quality rules; of documents with equal or nearly
equal texts one stays, whatever their ids, repeated and null ones included; n_chars follows a masked text; null sources and
languages are sources and languages of their own for the rules and the mixture; an empty table gives an empty result; other
columns are passed on, up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import mixing, ngram_join, quality_rules, secret_scans, sentencepieces
from textloom.llm.common import keep, read
from textloom.llm.queries import VOCABULARIES

#: SQL cannot express the last stage (sub-word pieces); the tests hold run() against a brute-force version.
ORACLE_SQL = None


def drop_rejected(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_rejected(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scans.redact(docs)


def draw_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepieces.digests(sentencepieces.encode(docs, f"{VOCABULARIES}/piece_bpe_32k.model"))


STAGES = [
    ("quality rules", drop_rejected),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", mask_secrets),
    ("mixing", draw_mixture),
    ("SentencePiece encoding", encode_texts),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written before the next one reads it."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
