"""Queries ``opN_<name>`` of the training-data operators over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, html_extract, language_id, license_scan, line_dedup, media, near_dedup, oracles, packing, suffix_dedup, token_counts
from .common import documents

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = language_id.train(language_id.training_rows(docs))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select(
        "doc.doc_id", language_id.held_out(F.col("doc.doc_id")).alias("held_out"), "lang_pred", "score", "rejected"
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(documents(spark, sf_dir))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), TOKENIZER).withColumnRenamed("id", "doc_id")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup_substrings(documents(spark, sf_dir))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("bigint").alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(documents(spark, sf_dir), TOKENIZER)
    return packing.pack(pieces).withColumnRenamed("id", "doc_id")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    digest = F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    return found.select("doc.doc_id", "n_lines", "n_removed", "n_runs", digest)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.find_contamination(spark, documents(spark, sf_dir).select("doc_id", "text"), benchmark)
    return found.select(
        "doc.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        decontamination.items_digest(found).alias("items_sha256"),
        decontamination.contaminated(found).alias("contaminated"),
    )


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.media_columns(documents(spark, sf_dir))
    tail = F.expr("substring(payload, -32, 32)")
    return stored.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        F.length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        op1_language_id,
        op2_license_scan,
        op3_token_counts,
        op4_near_dedup,
        op5_suffix_dedup,
        op6_best_fit_packing,
        op7_html_extraction,
        op8_line_dedup,
        op9_benchmark_decontamination,
        op10_media_columns,
    ]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
