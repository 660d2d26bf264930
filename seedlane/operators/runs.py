"""K-mers that move as runs of text.

Among the shorter words inside a k-mer the one of the smallest hash is its minimiser. Neighbouring k-mers mostly
share it, and equal k-mers always have the same. So a run of them can be moved as one piece of text to the
partition of its minimiser, and be cut into k-mers there: what crosses the network is a few times smaller
than the k-mers are, and what belongs together still meets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedlane.functions.text import cut, starts
from seedlane.operators.filters import bitmap_bits, key_bitmap, likely_in
from seedlane.operators.kmers import PIECE, distinct_keys, explode_kmers
from seedlane.plans.layout import rows_fit, settled, shuffle_tasks

# Minimisers with more than one in so many of all runs are dealt over several parts.
HOT_SHARE = 2000
# Characters whose runs are found at once. Arrays over them take about a hundred bytes each, however many texts Spark hands over.
SLICE = 1 << 18
# Share of the texts that is read to find them, and how often one must be seen. For the layout only.
SAMPLE, SEEN = 0.05, 32


def minimiser_size(k: int) -> int:
    """Letters of the inner words of k-mers."""
    return max(1, k // 2)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def runs_of(data: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, kmers, minimiser)`` of all runs in texts that lie one after the other and end at ``ends``."""
    inner = minimiser_size(k)
    if len(data) < k:
        none = np.zeros(0, np.int64)
        return none, none, none
    hashes = np.zeros(len(data) - inner + 1, np.uint64)
    for j in range(inner):
        hashes = hashes * np.uint64(0x100000001B3) + data[j:len(data) - inner + 1 + j]
    hashes = _mixed(hashes)
    n = len(data) - k + 1
    least = hashes[:n].copy()
    for j in range(1, k - inner + 1):
        np.minimum(least, hashes[j:j + n], out=least)
    text = np.searchsorted(ends, np.arange(n), "right")
    valid = np.arange(n) + k <= ends[text]
    begins = valid.copy()
    begins[1:] &= ~valid[:-1] | (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(begins)
    last = np.flatnonzero(valid & np.concatenate([begins[1:] | ~valid[1:], [True]]))
    return start, last - start + 1, least[start].view(np.int64)


def slices(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts, of about ``SLICE`` characters each, for texts that end at ``ends``."""
    first, done = 0, 0
    while first < len(ends):
        last = max(int(np.searchsorted(ends, done + SLICE, "right")), first + 1)
        yield first, last
        first, done = last, int(ends[last - 1])


def batch_runs(batch: pa.RecordBatch, k: int, keep: list[str]) -> Iterator[pa.RecordBatch]:
    """``keep`` columns, ``offset``, ``word`` and ``run`` of the texts ``_b`` that begin at ``_p``, slice by slice."""
    _, ends, data = batch.column("_b").buffers()
    ends = np.frombuffer(ends, np.int32)[batch.column("_b").offset:][:len(batch) + 1].astype(np.int64) if len(batch) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if ends[-1] else np.zeros(0, np.uint8)
    for first, last in slices(ends[1:] - ends[0]):
        part, edges = batch.slice(first, last - first), ends[first:last + 1] - ends[first]
        text = data[ends[first]:ends[last]]
        start, n, word = runs_of(text, edges[1:], k)
        row = np.searchsorted(edges[1:], start, "right")
        size = n + k - 1
        to = np.concatenate([[0], np.cumsum(size)])
        which = np.repeat(start - to[:-1], size) + np.arange(to[-1])
        offset = start - edges[row] + part.column("_p").to_numpy()[row]
        held = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(text[which])])
        rows = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [*[part.column(c).take(rows) for c in keep], pa.array(offset), pa.array(word), held], [*keep, "offset", "word", "run"])


def minimiser_runs(df: DataFrame, k: int, keep: list[str], text: str = "sequence") -> DataFrame:
    """``keep`` columns (numbers), ``offset``, ``word`` and ``run``: the runs of normalised texts.

    ``word`` stands for the minimiser that all k-mers of ``run`` share, ``offset`` is where it begins.
    """
    body = df.select(*keep, F.col(text).cast("binary").alias("_b"))
    pieces = body.select(*keep, "_b", F.explode(starts(F.length("_b"), k, PIECE)).alias("_p")).select(
        *keep, F.col("_p").cast("long").alias("_p"), cut(F.col("_b"), F.col("_p"), PIECE + k - 1).alias("_b"))
    kinds = {c: df.schema[c].dataType.simpleString() for c in keep}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from batch_runs(batch, k, keep)

    schema = ", ".join([*[f"`{c}` {t}" for c, t in kinds.items()], "offset long", "word long", "run binary"])
    return pieces.mapInArrow(run, schema)


def _as_text(runs: DataFrame) -> DataFrame:
    return runs.withColumn("run", F.col("run").cast("string"))


def key_totals_by_runs(references: DataFrame, k: int, tasks: int | None = None) -> DataFrame:
    """``(seq, n)``: how often each k-mer occurs, for ``(ref_id, sequence)`` rows.

    Equal runs are counted before they are moved, in two steps if one minimiser holds very many: what is moved to its
    partition are different runs only. They are cut into k-mers there, and these are summed where they are.
    """
    tasks = tasks or 4 * shuffle_tasks(references.sparkSession)
    runs = minimiser_runs(references, k, ["ref_id"]).groupBy("word", "run").agg(F.count("*").alias("n"))
    placed = _as_text(runs).repartition(tasks, "word")
    return explode_kmers(placed, k, ["word", "n"], text="run").groupBy("word", "seq").agg(F.sum("n").alias("n")).select("seq", "n")


def seed_hits_by_runs(
    queries: DataFrame, references: DataFrame, k: int, tasks: int | None = None, screen: bool = True
) -> DataFrame:
    """``(query_id, ref_id, end_pos)`` as :func:`seedlane.operators.seeds.seed_hits`, for texts on both sides.

    For queries whose k-mers are too many for a broadcast. Runs whose minimiser no query has are turned away
    by a bitmap first, if ``screen``. The others of both sides go to the partition of their minimiser, those of
    a frequent one are dealt over several parts. K-mers are cut there, turned away by a bitmap of all those of the
    queries as well, and joined. Spark joins them in place with
    ``spark.sql.requireAllClusterKeysForCoPartition`` set to false; otherwise it moves the k-mers left.
    """
    spark = references.sparkSession
    tasks = tasks or 4 * shuffle_tasks(spark)
    sized = queries.select("query_id", "sequence", F.length("sequence").cast("long").alias("_n"))
    asked = settled(minimiser_runs(sized, k, ["query_id", "_n"]))
    held = minimiser_runs(references, k, ["ref_id"])
    sample = minimiser_runs(references.sample(SAMPLE, seed=1), k, ["ref_id"])
    if screen:
        words = asked.select("word").distinct()
        bits = bitmap_bits(words.count())
        if bits is not None:
            pages = settled(key_bitmap(words, bits, "word"))
            held, sample = likely_in(held, pages, bits, "word"), likely_in(sample, pages, bits, "word")
    # Frequent minimisers of the references, at most HOT_SHARE; all their reference runs are dealt.
    counts = settled(sample.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= SEEN))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    hot = counts.filter(F.col("n") * F.lit(HOT_SHARE) > total).select(
        "word", F.ceil(F.col("n") * F.lit(HOT_SHARE) / F.lit(max(total, 1))).cast("int").alias("_parts"))
    hot = settled(hot)
    assert rows_fit(HOT_SHARE, 16)
    parts = F.coalesce("_parts", F.lit(1))
    kmers = settled(distinct_keys(explode_kmers(_as_text(asked), k, ["query_id"], text="run"))) if screen else None
    held = held.join(F.broadcast(hot), "word", "left").withColumn(
        "_deal", F.pmod(F.xxhash64("ref_id", "offset"), parts).cast("int")).drop("_parts")
    asked = asked.join(F.broadcast(hot), "word", "left").withColumn(
        "_deal", F.explode(F.sequence(F.lit(0), parts - F.lit(1)))).drop("_parts")
    key = ["word", "_deal"]
    left = explode_kmers(
        _as_text(held).repartition(tasks, *key), k, ["ref_id", *key], text="run", base=F.col("offset"))
    right = explode_kmers(
        _as_text(asked).repartition(tasks, *key), k, ["query_id", "_n", *key], text="run", position="_at", base=F.col("offset"))
    if kmers is not None:
        bits = bitmap_bits(kmers.count())
        left = left if bits is None else likely_in(left, settled(key_bitmap(kmers, bits)), bits)
    joined = left.join(right.hint("merge"), [*key, "seq"])
    return joined.select("query_id", "ref_id", (F.col("offset") + F.col("_n") - F.lit(1) - F.col("_at")).alias("end_pos"))
