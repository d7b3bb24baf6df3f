"""The queries of this package and, where SQL can express them, the same in DuckDB SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import merkle, mixing, warc
from .common import read
from .embedding_dedup import embedding_dedup
from .filter_audit import filter_audit
from .line_dedup import line_dedup
from .ngram_join import ngram_join
from .quality_rules import quality_rules
from .secret_scans import digest, secret_scan
from .sentencepieces import digests, encode
from .substring_dedup import substring_dedup
from .token_counts import token_counts
from .toxicity import toxicity

#: Folder of the public vocabularies.
VOCABULARIES = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("host_rate", 6).alias("host_rate"),
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), f"{VOCABULARIES}/byte_bpe_50k.tiktoken")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read(spark, sf_dir, "documents"))


def op4_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(read(spark, sf_dir, "documents"), f"{VOCABULARIES}/piece_bpe_32k.model"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).select(
        "doc_id", "held_out", "score", "predicted"
    )


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(read(spark, sf_dir, "embeddings"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(secret_scan(read(spark, sf_dir, "documents")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.mix(read(spark, sf_dir, "documents"))
    return drawn.withColumn("probability", F.round("probability", 6))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, read(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop("filter")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rows = merkle.manifest(docs, merkle.lower_text(docs), merkle.tampered(docs))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_token_counts": op2_token_counts,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_sentencepieces": op4_sentencepieces,
    "op5_toxicity": op5_toxicity,
    "op6_ngram_join": op6_ngram_join,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_secret_scans": op8_secret_scans,
    "op9_mixing": op9_mixing,
    "op10_warc": op10_warc,
    "op11_line_dedup": op11_line_dedup,
    "op12_filter_audit": op12_filter_audit,
    "op13_merkle_manifest": op13_merkle_manifest,
}
