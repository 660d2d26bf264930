"""Stored tables: index, content, alignments and run statistics."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seedlane.functions.digest import text_hashes
from seedlane.functions.packed import CODEC, closer, numbers, opened
from seedlane.operators.kmers import joined_bytes, texts_of, words_of
from seedlane.plans.layout import spread_of

# Number of parts stored content is split into. A search reads only the parts that hold wanted blocks.
PARTS = 64

# Bytes of an index file's row group, the least that a scan can skip without looking into it.
ROW_GROUP = 32 << 20


def load_table(spark: SparkSession, *paths: str) -> DataFrame:
    """A stored table, or several of one kind together."""
    # Each may be stored in parts of its own.
    found = [spark.read.parquet(path) for path in paths]
    return reduce(DataFrame.unionByName, found)


# Columns of a stored index without the type of its offsets, and the largest block whose offsets are short.
INDEX, SHORT = "seq string, refs array<bigint>, blocks array<bigint>, value array<array<{}>>, hash int", 1 << 15

# Lists that a task packs at once, lists of a k-mer in one row of a stored index, and rows given to Spark at once.
TOGETHER, MOST_LISTS, ROWS = 3 << 19, 1 << 13, 1 << 13


def index_schema(group: int) -> str:
    return INDEX.format("smallint" if group <= SHORT else "int")


# Settings while an index is stored. A task has one bucket, and few of hot k-mers: with a file open for each Spark need not
# sort by a bucket number that it computes for every comparison. What was shuffled goes as soon as it is stored.
STORING = {"spark.sql.maxConcurrentOutputFileWriters": "4", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def packed_lists(batch: pa.RecordBatch, group: int, offset: type) -> Iterator[pa.RecordBatch]:
    """Lists in few rows: those of a batch with one ``task``, each column in one compressed piece.

    Offsets become distances from the beginning of their block; a k-mer whose lists follow one another is there once.
    """
    task = batch.column("task").to_numpy()
    rows = batch
    if (task[1:] < task[:-1]).any():
        order = np.argsort(task, kind="stable")
        rows, task = batch.take(pa.array(order)), task[order]
    first = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]])) if len(task) else np.zeros(0, np.int64)
    to = np.concatenate([first, [len(task)]])
    seq, value, refs = rows.column("seq"), rows.column("value"), rows.column("ref_id")
    data, edges = joined_bytes(seq)
    size, words = np.diff(edges).astype(np.int32), words_of(data, edges)
    new = np.ones(len(task), bool)
    if words is not None:
        new[1:] = np.any([w[1:] != w[:-1] for w in words], axis=0) if words else False
        new[first] = True
    count = value.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)
    ends = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
    block = rows.column("block").to_numpy()
    columns = [
        refs.fill_null(0).to_numpy(), refs.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8), block, count,
        rows.column("apart").to_numpy(zero_copy_only=False).astype(np.uint8), new.astype(np.uint8),
    ]
    distance = (value.flatten().to_numpy() - np.repeat(block * group, count)).astype(offset)
    packed = []
    for begin, end in zip(to[:-1].tolist(), to[1:].tolist()):
        kept = np.flatnonzero(new[begin:end]) + begin
        if words is None:
            seqs = CODEC.compress(data[edges[begin]:edges[end]], asbytes=True) if edges[end] > edges[begin] else b""
        else:
            seqs = closer(data.reshape(len(task), -1)[kept])
        packed.append((
            int(task[begin]), end - begin, len(kept), int(size[begin]) if words is not None else -1,
            seqs, b"" if words is not None else closer(size[begin:end]), *(closer(c[begin:end]) for c in columns),
            closer(distance[ends[begin]:ends[end]])))
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(c), kind) for c, kind in zip(zip(*packed) if packed else [()] * len(PACKED_TYPES), PACKED_TYPES)], PACKED_NAMES)


PACKED_NAMES = ["task", "n", "kept", "size", "seqs", "sizes", "refs", "known", "blocks", "counts", "aparts", "news", "offsets"]
PACKED_TYPES = [pa.int32()] * 4 + [pa.binary()] * 9
PACKED = ", ".join(f"{name} {'int' if kind == pa.int32() else 'binary'}" for name, kind in zip(PACKED_NAMES, PACKED_TYPES))


def opened_lists(batch: pa.RecordBatch, offset: type) -> Iterator[pa.RecordBatch]:
    """Back from :func:`packed_lists`."""
    for row in range(len(batch)):
        task, n, kept, size = (batch.column(name)[row].as_py() for name in PACKED_NAMES[:4])

        def column(name: str, kind: type, many: int = n) -> np.ndarray:
            return numbers(batch.column(name)[row].as_buffer(), many, kind)

        counts = np.concatenate([[0], np.cumsum(column("counts", np.int32))]).astype(np.int32)
        if size < 0:
            edges = np.concatenate([[0], np.cumsum(column("sizes", np.int32))])
            data = batch.column("seqs")[row].as_buffer()
            seq = texts_of(np.frombuffer(CODEC.decompress(data, int(edges[-1])), np.uint8) if edges[-1] else np.zeros(0, np.uint8), edges)
        else:
            letters = opened(batch.column("seqs")[row].as_buffer(), kept, size)[np.cumsum(column("news", np.uint8)) - 1]
            seq = texts_of(letters.reshape(-1), np.arange(n + 1) * size)
        yield pa.RecordBatch.from_arrays([
            seq, pa.array(column("refs", np.int64), mask=column("known", np.uint8) == 0), pa.array(column("blocks", np.int64)),
            pa.ListArray.from_arrays(pa.array(counts), pa.array(column("offsets", offset, int(counts[-1])))),
            pa.array(column("aparts", np.uint8).astype(bool)),
        ], ["seq", "ref_id", "block", "value", "apart"])


def lists_for_buckets(
    batches: Iterator[pa.RecordBatch], group: int, buckets: int, hot: dict[str, int]
) -> Iterator[pa.RecordBatch]:
    """Lists ``(seq, ref_id, block, value)`` packed for the tasks that store them, as :func:`write_index` takes them.

    The lists of ``hot`` k-mers, each with its number of splits, are to be kept apart and are dealt over as many tasks.
    """
    width = np.int16 if group <= SHORT else np.int32
    known, splits = pa.array([*hot], pa.string()), np.array([*hot.values(), 1])

    def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        # Its copy is enough.
        held.clear()
        data, edges = joined_bytes(lists.column("seq"))
        words = words_of(data, edges)
        # Where Spark's bucketing has the k-mer, or in one of the tasks that follow.
        place = pc.fill_null(pc.index_in(lists.column("seq"), known), len(hot)).to_numpy()
        ref, block = (lists.column(c).fill_null(0).to_numpy() for c in ("ref_id", "block"))
        mixed = (ref.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + block.view(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(33)
        task = ((text_hashes(data, edges) + mixed.astype(np.int64) % splits[place]) % buckets).astype(np.int32)
        order = np.argsort(task.astype(np.uint16) if buckets <= 1 << 16 else task, kind="stable")
        ends = np.flatnonzero(np.concatenate([[True], np.diff(task[order]) != 0, [True]]))
        # By letters within a task, so that they are compressed closely; texts of several lengths stay as they came.
        for begin, end in zip(ends[:-1].tolist(), ends[1:].tolist()) if words else ():
            some = order[begin:end]
            order[begin:end] = some[np.lexsort([w[some] for w in words[::-1]])]
        taken = lists.take(pa.array(order))
        yield from packed_lists(pa.RecordBatch.from_arrays(
            [*taken.columns, pa.array((place < len(hot))[order]), pa.array(task[order])], [*taken.schema.names, "apart", "task"]), group, width)

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= TOGETHER:
            yield from packed(held)
            n = 0
    if n:
        yield from packed(held)


def rows_of_bucket(batches: Iterator[pa.RecordBatch], offset: type) -> Iterator[pa.RecordBatch]:
    """The rows of a stored index from all that :func:`lists_for_buckets` made for one task, in order of their hash.

    The lists of a k-mer are in one row, or in several if there are very many; those that are apart in a row each, at the end.
    """
    parts = [some for batch in batches for some in opened_lists(batch, offset)]
    if not parts:
        return
    every = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    parts.clear()
    held = set(pc.unique(every.column("apart")).to_pylist())
    for apart in sorted(held):
        lists = every if len(held) == 1 else every.filter(pc.equal(every.column("apart"), apart))
        data, edges = joined_bytes(lists.column("seq"))
        hashes, words = text_hashes(data, edges), words_of(data, edges)
        mixed = np.zeros(len(lists), np.uint64)
        for word in words or ():
            mixed = (mixed ^ word) * np.uint64(0x9E3779B97F4A7C15)
        order = np.argsort((hashes.astype(np.int64) << 32) + (mixed >> np.uint64(32)).astype(np.int64), kind="stable")
        new = np.ones(len(lists), bool)
        if words is not None and not apart:
            new[1:] = np.any([w[order][1:] != w[order][:-1] for w in words], axis=0) if words else False
        at = np.arange(len(lists))
        new |= (at - np.maximum.accumulate(np.where(new, at, 0))) % MOST_LISTS == 0
        first = np.flatnonzero(new)
        lists = lists.take(pa.array(order))
        to = pa.array(np.concatenate([first, [len(lists)]]).astype(np.int32))
        rows = pa.RecordBatch.from_arrays([
            lists.column("seq").take(pa.array(first)), *(pa.ListArray.from_arrays(to, lists.column(c)) for c in ("ref_id", "block", "value")),
            pa.array(hashes[order[first]]), pa.array(np.full(len(first), apart))], ["seq", "refs", "blocks", "value", "hash", "apart"])
        for begin in range(0, len(rows), ROWS):
            yield rows.slice(begin, ROWS)


def write_index(packed: DataFrame, path: str, group: int, buckets: int) -> None:
    """Replace the index at ``path``; stored in ``buckets`` by k-mer, from what :func:`lists_for_buckets` made.

    A bucket is one file in the order of a ``hash`` of the k-mer, which lets a scan that looks for some
    hashes skip row groups and pages. A row has all lists of a k-mer, up to a number of them. The lists of hot k-mers
    are kept apart from the buckets. Offsets are stored as distances from the beginning of
    their block of ``group`` positions. Lists are moved once, those of many blocks for one bucket in one piece.
    """
    spark = packed.sparkSession
    width = np.int16 if group <= SHORT else np.int32
    ordered = packed.repartitionById(buckets, "task").mapInArrow(
        lambda batches: rows_of_bucket(batches, width), f"{index_schema(group)}, apart boolean")
    # Files can only be written in buckets as a table, which is forgotten at once: it is opened by its path.
    name = f"seedlane_{uuid.uuid4().hex}"
    before = {key: spark.conf.get(key) for key in STORING}
    try:
        for key, value in STORING.items():
            spark.conf.set(key, value)
        (
            ordered.write.mode("overwrite").format("parquet").option("path", path).option("parquet.block.size", ROW_GROUP)
            # Sorted hashes as differences, and a closer compression.
            .option("parquet.writer.version", "PARQUET_2_0").option("compression", "zstd")
            .partitionBy("apart").bucketBy(buckets, "seq").saveAsTable(name)
        )
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    spark.sql(f"DROP TABLE {name}")


def load_index(spark: SparkSession, *paths: str, group: int) -> DataFrame:
    """All rows of a stored index, or of several together, as stored."""
    found = [spark.read.schema(f"{index_schema(group)}, apart boolean").parquet(path) for path in paths]
    return reduce(DataFrame.unionByName, found).drop("apart")


def stored_lists(rows: DataFrame, *keep: str) -> DataFrame:
    """The lists of rows as stored, ``value`` having distances from the beginning of the ``block``."""
    one = F.explode(F.arrays_zip("refs", "blocks", "value")).alias("_list")
    return rows.select(*keep, one).select(
        *keep, F.col("_list.refs").alias("ref_id"), F.col("_list.blocks").alias("block"), F.col("_list.value").alias("value"))


def lists_of_rows(batches: Iterator[pa.RecordBatch], group: int) -> Iterator[pa.RecordBatch]:
    """The same of ``(seq, refs, blocks, value)`` rows inside a task, with whole offsets."""
    for batch in batches:
        row = pa.array(np.repeat(np.arange(len(batch)), batch.column("refs").value_lengths().to_numpy(zero_copy_only=False)))
        block, value = batch.column("blocks").flatten(), batch.column("value").flatten()
        count = value.value_lengths().to_numpy(zero_copy_only=False)
        whole = value.flatten().to_numpy().astype(np.int64) + np.repeat(block.to_numpy() * group, count)
        ends = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("seq").take(row), batch.column("refs").flatten(), block, pa.ListArray.from_arrays(ends, pa.array(whole))],
            ["seq", "ref_id", "block", "value"])


def whole_offsets(group: int) -> Column:
    """The offsets of a stored list as positions of their reference."""
    start = F.col("block") * F.lit(group)
    return F.transform("value", lambda x: x + start)


def open_buckets(spark: SparkSession, path: str, group: int, buckets: int) -> DataFrame:
    """The rows of a stored index that are in buckets, as stored, as a table Spark knows the buckets of.

    The table is an entry of the session's catalogue for files that are there already.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/apart=false")
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(place)
    where = system.makeQualified(place).toString()
    name = f"seedlane_{uuid.uuid5(uuid.NAMESPACE_URL, where).hex}"
    quoted = where.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({index_schema(group)}) USING parquet "
        f"CLUSTERED BY (seq) INTO {buckets} BUCKETS LOCATION '{quoted}'")
    return spark.table(name)


def write_content(content: DataFrame, path: str, parts: int = PARTS) -> None:
    """Replace the content at ``path``, stored in parts by the hash of the block.

    Content is added to as a segment; see :func:`seedlane.plans.reference.append_reference`.
    """
    stored = content.withColumn("part", spread_of(["ref_id", "blockid"], parts))
    (
        stored.hint("rebalance", F.col("part"))
        .sortWithinPartitions("part", "ref_id", "offset")
        .write.mode("overwrite").partitionBy("part").parquet(path)
    )


def write_alignments(
    alignments: DataFrame, folder: str, query_name: str, reference_name: str, run_id: str,
    format: str = "parquet",
) -> str:
    """Store alignments under a path that names queries, reference and run; returns the path.

    As many files as there are tasks: merging them would pass the whole result through one.
    """
    path = f"{folder.rstrip('/')}/{query_name}_{reference_name}_{run_id}"
    writer = alignments.write.mode("overwrite")
    if format == "csv":
        writer.csv(path, sep="\t", header=True)
    else:
        writer.format(format).save(path)
    return path


def append_run_stats(stats: DataFrame, path: str) -> None:
    """Append a row of statistics as ``;``-separated text. One path per kind of job."""
    stats.write.mode("append").csv(path, sep=";", header=True)
