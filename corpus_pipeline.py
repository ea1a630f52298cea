"""The pipeline from raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the
next stage's docs. All but the last return docs' columns.

Every stage takes nulls in any column, empty and very long texts, repeated rows, ties, tables without rows, and other columns of any
name, which ride along. What each makes of them is stated at the operator that it calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftline.llm import decontaminate, mixing, quality, secrets, simhash
from driftline.llm.common import Scratch


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.keep_good(docs)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their targets; a row for each repetition of a document."""
    return mixing.mixed(docs)


STAGES = [("quality rules", keep_good), ("simhash near-dedup", keep_one), ("benchmark decontamination", clean), ("secret scans", redact), ("source mixing", mix)]

#: SQL has neither the 64-bit hash of the fingerprints nor the structural checks of secrets.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        following = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return following
        before, docs = docs, scratch.keep(following)
        if k:
            scratch.drop(before)  # no later stage reads it
