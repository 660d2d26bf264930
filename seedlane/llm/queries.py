"""Each operator of this folder applied to its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedlane.llm.collocations import COLLOCATIONS_SQL, collocations
from seedlane.llm.common import fold, table
from seedlane.llm.fingerprints import fingerprint_edits
from seedlane.llm.hard_negatives import NEGATIVES_SQL, hard_negatives
from seedlane.llm.language import predict_language, train_language
from seedlane.llm.lm import score_texts
from seedlane.llm.mixing import MIX_SQL, mix_sources
from seedlane.llm.neighbours import nearest_neighbours
from seedlane.llm.packing import pack_documents
from seedlane.llm.quality import score_quality, train_quality
from seedlane.llm.simhash import near_duplicates
from seedlane.llm.substrings import REMOVED_SQL, remove_repeats
from seedlane.llm.toxicity import score_toxicity, train_toxicity
from seedlane.llm.urls import JUDGE_SQL, RULES, judge_urls


def op1_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf, "documents"))


def op2_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_lm_scores(spark: SparkSession, sf: str) -> DataFrame:
    # Not spread over more tasks than it has splits: each trains a model before they are averaged.
    return score_texts(spark.read.parquet(f"{sf}/documents.parquet"), fold("doc_id", 7) == 2)


def op4_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mix_sources(table(spark, sf, "documents"))


def op5_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    held_out = fold("doc_id", 3) == 1
    filters = train_language(docs.filter(~held_out))
    return predict_language(docs, filters).withColumn("held_out", held_out)


def op6_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs, held_out = table(spark, sf, "documents"), fold("doc_id", 3) == 1
    model = train_quality(docs, table(spark, sf, "labels"), usable=~held_out)
    return score_quality(docs, model).withColumn("held_out", held_out)


def op7_url_rules(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judge_urls(table(spark, sf, "pages"), rules)


def op8_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "documents")).drop("text_hash")


def op9_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs, held_out = table(spark, sf, "documents"), fold("doc_id", 4) == 2
    model = train_toxicity(docs, table(spark, sf, "labels"), usable=~held_out)
    return score_toxicity(docs, model).withColumn("held_out", held_out)


def op10_packing(spark: SparkSession, sf: str) -> DataFrame:
    # Not spread over more tasks than it has splits, as each may leave one sequence that is not full.
    return pack_documents(spark.read.parquet(f"{sf}/documents.parquet"), with_ids=False)


def op11_repeats(spark: SparkSession, sf: str) -> DataFrame:
    found = remove_repeats(table(spark, sf, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op12_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations(table(spark, sf, "documents"))


def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf, "embeddings"), F.col("id") % 100 == 0, label=label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q for q in (op1_fingerprints, op2_neighbours, op3_lm_scores, op4_mixing, op5_language, op6_quality, op7_url_rules, op8_simhash, op9_toxicity, op10_packing, op11_repeats, op12_collocations, op13_hard_negatives)
}

SQL: dict[str, str] = {"op4_mixing": MIX_SQL, "op7_url_rules": JUDGE_SQL, "op11_repeats": REMOVED_SQL, "op12_collocations": COLLOCATIONS_SQL, "op13_hard_negatives": NEGATIVES_SQL}
