"""From raw documents to a training mix: five stages, each a table that the next one reads.

Every stage works on all rows that the one before it kept. Their decisions take effect: documents that the quality
classifier rejects go, of equal texts and of near-duplicate groups one stays, documents with a passage of the benchmark go,
and the mix leaves out the documents that it takes no time and says of the others how often it takes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barwright.llm import decontaminate, exact_dedup, mixing, near_dedup, quality
from barwright.llm.common import store, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier keeps. Null text counts as empty, null source and lang as values of their own; repeated rows stay or go together."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts. Null and empty texts are one group; of repeated rows one stays."""
    return exact_dedup.keep_one(docs)


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words a shingle, 0.8 or more. Null, empty and blank texts stay."""
    return near_dedup.keep_one(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no window of ten words of a benchmark item occurs. Null and empty texts stay."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with copies and taken. A null source is a source of its own; null and empty texts have no words to take."""
    return mixing.take(docs)


STAGES = [("quality", good), ("exact_dedup", distinct), ("near_dedup", dissimilar), ("decontaminate", unseen), ("mixing", mixed)]
#: The classifier's weights and the mix's draws are not SQL; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each a stored table that the next one reads. Empty tables give no rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
