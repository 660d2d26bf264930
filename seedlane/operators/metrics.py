"""Balance of the work and counts of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def balance_by(df: DataFrame, key: str | Column, items: Column | None = None) -> DataFrame:
    """One row: how evenly rows (or ``items`` per row) are spread over the values of ``key``.

    ``unbalance_pct`` is how much the fullest group exceeds the mean one.
    """
    weight = F.lit(1) if items is None else items
    groups = df.groupBy(F.col(key) if isinstance(key, str) else key).agg(F.sum(weight).alias("n"))
    mean = F.avg("n")
    return groups.agg(
        F.count("*").alias("parts"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.round(mean, 3).alias("mean_n"),
        F.max("n").alias("max_n"),
        F.round((F.max("n") - mean) / mean * F.lit(100.0), 3).alias("unbalance_pct"),
    )


def partition_balance(df: DataFrame, items: Column | None = None) -> DataFrame:
    """:func:`balance_by` over the Spark partitions of ``df`` (those with rows)."""
    return balance_by(df, F.spark_partition_id(), items)


def search_summary(
    queries: DataFrame, keys: DataFrame, diagonals: DataFrame, threshold: int
) -> DataFrame:
    """One row of counts; seeds, diagonals and candidates come from one pass."""
    return diagonals.agg(
        F.coalesce(F.sum("hits"), F.lit(0)).alias("seed_hits"),
        F.count("*").alias("diagonals"),
        F.count_if(F.col("hits") > threshold).alias("candidates"),
    ).select(
        queries.agg(F.count("*").alias("n")).scalar().alias("queries"),
        keys.agg(F.count("*").alias("n")).scalar().alias("query_keys"),
        "seed_hits", "diagonals", "candidates",
    )


def listed_candidates(lists: DataFrame) -> DataFrame:
    """One row: candidate placements held by candidate lists."""
    return lists.agg(F.coalesce(F.sum(F.size("offsets")), F.lit(0)).alias("candidates"))


def run_stats(spark: SparkSession, **values: str | int | float | None) -> DataFrame:
    """One row of named values about a run, with the session's executor settings."""
    conf = spark.sparkContext.getConf()
    settings = {
        "executors": conf.get("spark.executor.instances", None),
        "cores": conf.get("spark.executor.cores", None),
        "memory": conf.get("spark.executor.memory", None),
    }
    return spark.range(0, 1, 1, 1).select(
        *(F.lit(v).alias(n) for n, v in values.items()),
        *(F.lit(v).cast("string").alias(n) for n, v in settings.items()),
        F.current_timestamp().cast("string").alias("date"),
    )
