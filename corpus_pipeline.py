"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination and packing, each over all that the one before kept.

Each stage takes and returns a DataFrame; the caller writes it as Parquet and reads it again. All but the last keep the columns of documents.

A null text has no words, so the first stage drops it; a null or unlisted lang is a stratum of its own there; source is never read. Rows that repeat a doc_id with another
text are documents of their own; rows equal in both are one document delivered twice, of which line dedup leaves each its lines and near-dedup one row. A null doc_id
comes before all others. Empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import decontaminate, line_dedup, packing, quality, simhash
from tidewell.llm.common import cut
from tidewell.llm.registry import table
from tidewell.ship import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(f: Stage) -> Stage:
    """f, whose Python workers have the package."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, docs, sf_dir)

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@stage
def line_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that the corpus has earlier; those that lose all lines go."""
    return line_dedup.remove_lines(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.keep_one(docs)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


@stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_duplicates),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

#: SQL can't express the stages' fingerprints, tokens and risk bounds; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = cut(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
