"""A training corpus from ``documents``: quality rules, line dedup, one document of each group
of near copies, masked secrets, packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from adpace.llm.common import table
from adpace.llm.jaccard_join import keep_one
from adpace.llm.line_dedup import dedup_lines
from adpace.llm.packing import pack
from adpace.llm.quality_rules import keep_good
from adpace.llm.secret_scans import mask_secrets
from adpace.scratch import work_dir, written

#: Near copies: shingles of so many words, and so many percent of them in common.
NEAR_WORDS = 5
NEAR_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no rule and that the forest does not reject."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that many documents share."""
    return dedup_lines(docs).select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_one(docs, NEAR_WORDS, NEAR_PERCENT)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with secrets masked."""
    return mask_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies: bucket, batch and slot."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("secret_scans", secret_scans),
    ("packing", packing),
]

#: The forest and the bucket search have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each on the Parquet files of the one before."""
    docs = table(spark, sf_dir, "documents")
    root = work_dir(spark, "corpus-pipeline")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"{root}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
