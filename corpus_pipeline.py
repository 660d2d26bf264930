"""From raw documents to packed training sequences, in stages that are written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seedlane.llm.mixing import mix_sources
from seedlane.llm.packing import pack_documents
from seedlane.llm.quality import drop_low_quality, train_quality
from seedlane.llm.simhash import drop_near_duplicates
from seedlane.llm.toxicity import drop_toxic, train_toxicity
from seedlane.plans.layout import settled, spread


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose nearest labelled examples are toxic."""
    docs, labels = spread(docs), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return drop_toxic(docs, train_toxicity(docs, labels))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier scores below one half."""
    docs, labels = spread(docs), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return drop_low_quality(docs, train_quality(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id."""
    return drop_near_duplicates(spread(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources weigh as the roots of their sizes, in random order."""
    return mix_sources(docs).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 1024 ids."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

# Stages learn classifiers and tokenise, which SQL can't express; tests hold them against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is kept as Parquet in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
