"""The numbered queries over the shared tables, with their SQL where SQL can say them.

Each gives one row for each row of its table (op1: for each copy drawn), an empty table for an
empty one; other columns are not looked at but for op1, which carries them along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    audit_oracles, byte_bpe, class_lm, dart_minhash, divergence, license_scan, merkle, oracles, pairwise_quality, pq_dedup, quality_rules, secret_scan, source_mix,
    stratified_shards, suffix_dedup,
)
from .shared import ship_package


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as often as drawn, with copy_no and mix_key, in a random order; a null source is one of its own, a null text one character."""
    return source_mix.mix(_documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, posterior and verdict of each document; a null text has no words and fails, equal texts fare alike."""
    return quality_rules.judge(_documents(spark, sf_dir))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and labels of each document; a null text has no words and no labels, first_word and last_word are then null."""
    return license_scan.scan(_documents(spark, sf_dir)).drop("detections")


def op4_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each document; null and blank texts are classes of their own, equal words are one class, null ids come last."""
    return dart_minhash.classes(_documents(spark, sf_dir))


def op5_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for each document; null labels teach nothing, a null text has a score like an empty one."""
    return pairwise_quality.classify(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of each document; a null text holds none, repeated rows have the same ones."""
    return secret_scan.report(_documents(spark, sf_dir))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each document and the digest of the bytes that they decode to; a null text has no ids."""
    import public_tokenizers

    ranks = byte_bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.round_trip(_documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes removed from each document; a null text has none, equal rows are one document, null ids come last."""
    return suffix_dedup.dedup(_documents(spark, sf_dir)).drop("kept")


def op9_pq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of each vector; vectors that are null, zero or not finite, and those without a label, stand alone."""
    ship_package(spark)
    return pq_dedup.classes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of each document; a null text is an end alone, repeated rows are learned as often as they stand there."""
    return class_lm.score(_documents(spark, sf_dir))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of each document; nulls are part of the leaf, a null source is a group, null ids come first."""
    return merkle.manifest(_documents(spark, sf_dir))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sources and the terms that set each apart; null text, lang and source are ''."""
    return divergence.audit(_documents(spark, sf_dir))


def op13_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of each document by the law of equal counts; a null text has no bytes, a null source is one."""
    rows = stratified_shards.shards(_documents(spark, sf_dir))
    law, grown = F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return rows.select(F.col("id").alias("doc_id"), "size", "text_crc32", law, "shard", "slot", grown)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_source_mix": op1_source_mix,
        "op2_quality_rules": op2_quality_rules,
        "op3_license_scan": op3_license_scan,
        "op4_dart_minhash": op4_dart_minhash,
        "op5_pairwise_quality": op5_pairwise_quality,
        "op6_secret_scan": op6_secret_scan,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_pq_dedup": op9_pq_dedup,
        "op10_class_lm": op10_class_lm,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_source_divergence": op12_source_divergence,
        "op13_stratified_shards": op13_stratified_shards,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op9_pq_dedup": oracles.pq_dedup_sql(),
        "op1_source_mix": oracles.source_mix_sql(),
        "op2_quality_rules": oracles.quality_rules_sql(),
        "op3_license_scan": oracles.license_scan_sql(),
        "op4_dart_minhash": oracles.dart_minhash_sql(),
        "op6_secret_scan": oracles.secret_scan_sql(),
        "op11_merkle_manifest": audit_oracles.merkle_sql(),
        "op12_source_divergence": audit_oracles.divergence_sql(),
        "op13_stratified_shards": audit_oracles.shards_sql(),
    }
