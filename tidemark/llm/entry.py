"""The queries of the training-data operators, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, html_extract, license_scan, media, near_dup, pii, quality, token_count

BPE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
UNIGRAM_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(_table(spark, sf_dir, "documents"), width=2, similarity=(80, 100))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_table(spark, sf_dir, "documents"), token_count.UnigramVocabulary.from_sentencepiece(UNIGRAM_MODEL))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe.encode(_table(spark, sf_dir, "documents"), BPE_RANKS, public_tokenizers.PATTERN, decoded=True)
    return ids.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "matched", "item_words")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))
    base = {k: k for k in pii.PATTERNS}
    count = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("long").alias(f"n_{c}")
    return found.select(
        "doc_id",
        *map(count, base),
        F.sha2(pii.span_text(base), 256).alias("base_sha256"),
        pii.span_text(base | {"term": "terms"}).alias("spans"),
        F.coalesce(F.size(F.filter("terms", lambda x: x["remove"])), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.size(F.filter("terms", lambda x: ~x["remove"])), F.lit(0)).cast("long").alias("n_generalised"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"), license_scan.notices(spark)).drop("text_hash")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select(
        "doc_id",
        "lang",
        F.round(F.exp("__loss"), 4).alias("perplexity"),
        F.round(F.exp("__limit"), 4).alias("threshold"),
        F.col("__accepted").alias("kept"),
    )


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_formatting,
        op2_near_duplicates,
        op3_token_counts,
        op4_byte_bpe,
        op5_decontamination,
        op6_pii,
        op7_license_scan,
        op8_quality,
        op9_html_extraction,
        op10_media_columns,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op1_chat_formatting": chat.ORACLE_SQL,
    "op5_decontamination": decontam.ORACLE_SQL,
    "op7_license_scan": license_scan.oracle_sql(),
}
