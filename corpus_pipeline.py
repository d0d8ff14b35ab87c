"""A cleaning pipeline over ``documents``: toxic texts go, near duplicates go, benchmark texts go, personal data is masked,
and what is left is mixed to the sources' targets.

Each stage works on all that its predecessor kept, written as Parquet and read again. No SQL expresses the stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorespark.llm import decontamination, mixing, pii, simhash, toxicity
from lorespark.llm.common import discard, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the labels' model rejects. Null and empty texts stay; repeated rows go or stay together."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the smallest doc_id (null last). All texts without words are one group; of repeated rows one stays."""
    return simhash.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold a window of a test item. Null and empty texts stay; repeated rows go or stay together."""
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All docs, every span of personal data replaced by its kind. Null texts stay null, empty ones empty; repeated rows are masked alike."""
    return pii.masked(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document. Null and empty texts have size 0 and are not taken; repeated rows count one by one; a
    null source is a source of its own."""
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", "partial")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "zstd")
        if held is not None:
            discard(held)
        held = docs
    return STAGES[-1][1](spark, docs, sf_dir)
