"""Bounded samples of labelled documents, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedlane.llm.common import smallest_hashes
from seedlane.plans.layout import settled


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, text, label)`` of at most ``rows`` labelled ids, different texts only.

    The ids are those with the smallest hashes among the ``usable`` ones, hence the same in every run. An id
    labelled several times counts as 1 if any label is 1. Labels are ``rows`` at most when they are broadcast,
    so the documents are not shuffled.
    """
    known = (
        labels.filter(usable & F.col(label).isNotNull() & F.col(id).isNotNull())
        .groupBy(F.col(id).cast("long").alias("_id")).agg(F.max(label).cast("int").alias("label"))
    )
    chosen = smallest_hashes(known, "_id", rows, known.count())
    kept = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return settled(
        kept.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
        .groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("label").alias("label"))
    )
