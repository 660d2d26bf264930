"""Decisions about data layout: spreading small scans, broadcasting, cutting lineage."""

from __future__ import annotations

import heapq
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Session settings this work runs best with.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Grouping into lists sorts its input once; object hash aggregation falls back to sorting it
    # twice.
    "spark.sql.execution.useObjectHashAggregateExec": "false",
    # Windows and queries of any length go to Python in batches of this many.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    # K-mers that were moved as runs of text are joined where they are.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.session.timeZone": "UTC",
    # A scan of a stored index looks for so many hashes itself instead of for their smallest and largest.
    "spark.sql.parquet.pushdown.inFilterThreshold": "5000",
}

# A side is broadcast only if it is proven to stay below this many bytes.
BROADCAST_BYTES = 256 << 20
ROW_OVERHEAD = 64


def spread(scan: DataFrame, factor: int = 4) -> DataFrame:
    """Repartition a scan that has fewer tasks than the cluster can run at once.

    For scans only (nothing runs to find their partitions). A table of many files keeps its own
    splits, so nothing is shuffled where the data is large.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores * factor)


def shuffle_tasks(spark: SparkSession) -> int:
    """Tasks for work that is much larger than the bytes it reads: as many as set for shuffles."""
    return max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        2 * spark.sparkContext.defaultParallelism,
    )


# Characters of reference text that one task cuts into k-mers, and the most tasks of one step: beyond, at 400 GB,
# tasks grow, as the driver keeps track of each. The lists of so many k-mers are sorted in memory. It is also the most buckets a table of Spark may have.
TASK_CHARS, MOST_TASKS = 4 << 20, 100_000


def text_tasks(spark: SparkSession, chars: int) -> int:
    """Tasks for cutting and grouping so much text; enough for all cores in any case."""
    return max(2 * spark.sparkContext.defaultParallelism, min(MOST_TASKS, -(-chars // TASK_CHARS)))


def rows_fit(rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether ``rows`` rows of about ``row_bytes`` bytes may be broadcast."""
    return rows * (row_bytes + ROW_OVERHEAD) <= limit


class TextSize(NamedTuple):
    """How much text a table holds; also bounds the number of k-mers it can have."""

    rows: int
    chars: int

    def fits(self, limit: int = BROADCAST_BYTES) -> bool:
        """Whether the table with its text may be broadcast."""
        return self.chars + self.rows * ROW_OVERHEAD <= limit


def text_size(df: DataFrame, text: str = "sequence") -> TextSize:
    """Measured in one pass over the text column."""
    chars = F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("chars")
    row = df.agg(F.count("*").alias("rows"), chars).first()
    return TextSize(row["rows"], row["chars"])


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a temporary one only for local runs that set none."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="seedlane-")
        context.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Paths of settled tables, for each open scratch().
_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Within it, tables are settled for its duration only: their files go when it ends.

    What is to last must be written elsewhere inside of it. Without it they stay in the checkpoint folder
    and are the caller's to remove, as a result that is not computed yet may still need them.
    """
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def settled(df: DataFrame) -> DataFrame:
    """The table, computed once and kept as files in the shared folder.

    Later steps then read these instead of repeating the scan of the references, losing an
    executor costs nothing, and Spark knows the real size.
    """
    path = fresh_path(df.sparkSession, "settled")
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Rows that cost more than one in so many of a task's fair share are placed one by one.
FINE = 8


def deal_by_cost(rows: DataFrame, cost: Column, keys: list[str], tasks: int, name: str = "_deal") -> DataFrame:
    """``rows`` with a number in column ``name``; partitioned by its hash into ``tasks``, these cost alike.

    Those that make up more than an eighth of a task's share, fewer than eight times ``tasks`` whatever the number of
    rows, are placed on the driver, each where there is least so far. All others are dealt by the hash of
    their ``keys`` over what room there is left. ``rows`` are read three times.
    """
    spark = rows.sparkSession
    cost = cost.cast("double")
    total = rows.agg(F.coalesce(F.sum(cost), F.lit(0.0)).alias("n")).first()["n"]
    large = rows.filter(cost * F.lit(float(FINE * tasks)) > F.lit(total)).select(*keys, cost.alias("_cost")).collect()
    # A number for each task that Spark's partitioning by hash leads to it.
    numbers = {
        r["task"]: r["id"] for r in spark.range(64 * tasks + 1000)
        .groupBy(F.pmod(F.hash("id"), F.lit(tasks)).alias("task")).agg(F.min("id").alias("id")).collect()}
    loads = [(0.0, n) for n in numbers.values()]
    placed = []
    for row in sorted(large, key=lambda r: -r["_cost"]):
        load, number = heapq.heappop(loads)
        heapq.heappush(loads, (load + row["_cost"], number))
        placed.append((*(row[k] for k in keys), number))
    room = {number: max(total / tasks - load, 0.0) for load, number in loads}
    unit = sum(room.values()) / (16 * tasks)
    slots = [n for n, free in sorted(room.items()) for _ in range(round(free / unit) if unit else 1)] or sorted(room)
    # Tables of some numbers per task.
    table = F.broadcast(spark.createDataFrame(list(enumerate(slots)), f"_slot int, `{name}` long"))
    slot = F.pmod(F.xxhash64(*keys), F.lit(len(slots))).cast("int")
    dealt = rows.withColumn("_slot", slot).join(table, "_slot", "left").drop("_slot")
    if not placed:
        return dealt
    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    single = spark.createDataFrame(placed, f"{schema}, _number long")
    return dealt.join(F.broadcast(single), keys, "left").withColumn(name, F.coalesce("_number", name)).drop("_number")


def in_ranges(df: DataFrame, key: str, name: str) -> DataFrame:
    """Rows with the number of the range of ``key`` they are in, ranges being in order and of like size.

    Rows of one key are in one range. The bounds are Spark's, found by sampling, so numbers only
    belong together within one computation: settle the result before it is used twice.
    """
    tasks = shuffle_tasks(df.sparkSession)
    return df.repartitionByRange(tasks, key).withColumn(name, F.spark_partition_id())


def spread_of(keys: list[str | Column], buckets: int) -> Column:
    """Bucket number of a row by the hash of its keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
