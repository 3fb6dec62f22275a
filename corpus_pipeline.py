"""A cleaning pipeline over the documents table; each stage is one operator and reads what the stage before wrote.

Packing encodes text with a tokenizer, which SQL cannot state, so ORACLE_SQL is None and the tests hold the
stages against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rivermeld.llm import decontamination, line_dedup, near_duplicates, packing, quality_rules
from rivermeld.llm.shared import table
from rivermeld.session import new_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def rule_cleaning(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their failing lines."""
    return quality_rules.clean(docs)


def line_cleaning(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines and passages that repeat across documents; those left without a line go."""
    return line_dedup.clean(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_duplicates.clean(docs)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated, without the words of benchmark items."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per token piece with its sequence and offset."""
    return packing.packed_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", rule_cleaning),
    ("line_dedup", line_cleaning),
    ("minhash_near_dedup", one_of_near_copies),
    ("benchmark_decontamination", without_test_items),
    ("best_fit_packing", packed),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = new_folder(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
