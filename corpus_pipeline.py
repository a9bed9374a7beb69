"""Corpus pipeline: rules, near copies, personal data, mixing, packing, each stage over all that the last one kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skygauge.llm.jaccard import one_of_each
from skygauge.llm.mixing import mix, sized, training_order
from skygauge.llm.packing import pack
from skygauge.llm.pii import mask
from skygauge.llm.rules import judge
from skygauge.llm.storage import land, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return judge(docs).where("kept").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every span of personal data replaced by its kind; n_chars follows the new text."""
    masked = mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else masked


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every reading of every document that the mix takes, in training order; a partly needed one is read whole or not at all."""
    return training_order(mix(sized(docs))).where("2 * words >= size").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_copies),
    ("pii", personal_data),
    ("mixing", mixing),
    ("best_fit_packing", packing),
]

#: Character classes, a trained span model and a tokenizer's ids: not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = land(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
