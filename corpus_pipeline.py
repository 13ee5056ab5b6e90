"""A corpus pipeline: quality filter, exact and near dedup, mixing to weights, packing.

Every stage takes all rows its predecessor kept, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import exact_dedup, mixing, near_dedup, packing, quality
from cairn.llm.common import Scratch, read_table
from cairn.llm.queries import vocabulary_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the classifier (trained on the labels of these documents) scores below the threshold."""
    return quality.quality_filter(docs, read_table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal up to white space the smallest id stays."""
    return exact_dedup.drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at 0.8 on five-word shingles the smallest id stays."""
    return near_dedup.drop_near_copies(docs, words=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the target weights; a document taken twice is two rows."""
    return mixing.emit_mix(docs, weights=(3, 1, 2), share=1.5, max_copies=2)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens; one row per piece."""
    placed = packing.pack(docs, vocabulary_path())
    return placed.select(
        F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), F.col("sequence").alias("sequence_id"), F.col("place").alias("offset")
    )


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mix", mixing_stage),
    ("pack", packing_stage),
]

#: SQL can't express a learned classifier; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each written as Parquet in the shared folder and read again."""
    docs, scratch, before = read_table(spark, sf_dir, "documents"), Scratch(spark, "pipeline"), ""
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
