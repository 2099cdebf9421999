"""A training corpus from raw documents: quality rules, language, near duplicates, repeated passages, packing.

Rows without a text or with an empty one go at the quality rules. Rows without a doc_id are judged by the first two stages like
any other and left alone by the next two; rows that repeat a doc_id are kept or dropped together by these. Other columns are
carried along up to the packing, whatever their names. Of equal documents the one with the least doc_id stays. An empty table
gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import language, near_dedup, packing, quality_rules, substring_dedup
from assayer.llm.common import crc_mod, read, small_batches, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base rules or the host verdicts reject."""
    small_batches(spark)
    return quality_rules.keep(docs)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a language; the model learns from the rows that the language query may learn from."""
    small_batches(spark)
    return language.keep_known(docs, crc_mod(F.col("doc_id"), 4) != 2)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates on five-word shingles."""
    small_batches(spark)
    return near_dedup.keep_one(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document holds."""
    small_batches(spark)
    return substring_dedup.cut_duplicates(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in training sequences."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality),
    ("language ID", languages),
    ("near duplicates", near_duplicates),
    ("substring dedup", passages),
    ("packing", pack),
]

#: Learned and iterative stages: SQL cannot express them; tests hold each stage against a plain version, and run() against the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
