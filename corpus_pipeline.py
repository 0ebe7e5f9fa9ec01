"""From raw documents to encoded training data, in five stages.

Each stage is a function of (spark, docs, sf_dir) and works on all that the one before it kept.
Any column may be null and ids may repeat; an empty table gives an empty one at every stage, and
columns with the names that a stage uses inside do no harm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, dart_minhash, quality_rules, secret_scan, source_mix
from tessera.llm.shared import ship_package, to_table as texts_to_table
from tessera.tables import drop_tables, to_table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed quality rules keep, all columns; null and empty texts go, equal texts fare alike."""
    return quality_rules.good_rows(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near copies; null ids come last, blank texts are no copies of each other."""
    ship_package(spark)
    return dart_minhash.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts; n_chars follows the text, null texts stay null."""
    masked = secret_scan.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the sources' target weights ask for, in a random global order; a null source is one of its own."""
    return source_mix.mix(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of the bytes that they decode to.

    A row for each row of ``docs``; a null or empty text has no ids; equal texts have equal ids.
    They are written at once, as texts then go to Python in small batches.
    """
    import public_tokenizers

    ship_package(spark)
    ranks = byte_bpe.read_ranks(spark, public_tokenizers.path(VOCABULARY))
    coded = byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    coded = coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))
    return texts_to_table(coded, "pipeline-encoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", keep_good),
    ("MinHash near-dedup", keep_one_of_near_copies),
    ("secret scans", mask_secrets),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        last, docs = docs, to_table(stage(spark, docs, sf_dir), "pipeline-" + name.lower().replace(" ", "-"))
        drop_tables(last)  # the input itself is none of these tables
    return STAGES[-1][1](spark, docs, sf_dir)


#: Byte-pair merges can't be said in SQL; ``tests/llm/test_pipeline.py`` runs the five stages by brute force.
ORACLE_SQL = None
