"""Cutting sequences into k-mers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedlane.functions.text import UNKNOWN_LETTER, cut, is_uninformative, normalize, starts

# Characters handled per generated array. Long texts are first cut into pieces of this size, so
# that no array grows with the length of a text.
PIECE = 4096

# Bytes of k-mers that are cut or grouped at once inside a task.
SLICE = 1 << 20


def as_references(df: DataFrame, ref_id: str, text: str) -> DataFrame:
    """``(ref_id, sequence)`` with the text normalised."""
    return df.select(
        F.col(ref_id).cast("long").alias("ref_id"), normalize(F.col(text)).alias("sequence")
    )


def as_queries(df: DataFrame, query_id: str, text: str) -> DataFrame:
    """``(query_id, sequence, length)`` with the text normalised."""
    return df.select(
        F.col(query_id).cast("long").alias("query_id"), normalize(F.col(text)).alias("sequence")
    ).withColumn("length", F.length("sequence"))


def explode_kmers(
    df: DataFrame,
    k: int,
    keep: list[str],
    text: str = "sequence",
    position: str = "offset",
    base: Column | None = None,
) -> DataFrame:
    """One row per k-mer of ``text``: ``keep`` columns, ``seq`` and its 0-based ``position``.

    ``text`` must be normalised (one byte per character). ``base`` is the position of the text
    in its sequence, if it is only a part. K-mers of the unknown letter only are dropped.
    """
    first = F.lit(0) if base is None else base
    body = df.select(*keep, first.cast("long").alias("_base"), F.col(text).cast("binary").alias("_b"))
    pieces = body.select(
        *keep, "_base", "_b", F.explode(starts(F.length("_b"), k, PIECE)).alias("_p")
    ).select(
        *keep, (F.col("_base") + F.col("_p")).alias("_base"),
        cut(F.col("_b"), F.col("_p"), PIECE + k - 1).alias("_b"),
    )
    kmers = pieces.select(
        *keep, "_base", "_b", F.explode(starts(F.length("_b"), k, 1)).alias("_i")
    )
    where = F.col("_base") + F.col("_i")
    return kmers.select(
        *keep,
        cut(F.col("_b"), F.col("_i"), k).cast("string").alias("seq"),
        # A position below zero means wrong base positions in the input.
        (where if base is None
         else F.when(where >= 0, where).otherwise(
             F.raise_error(F.lit("negative k-mer position")).cast("long"))).alias(position),
    ).filter(~is_uninformative(F.col("seq"), k))


def joined_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of texts and where each begins, with the end of the last."""
    edges = np.frombuffer(values.buffers()[1], np.int32)[values.offset:][:len(values) + 1].astype(np.int64)
    data = values.buffers()[2]
    return (np.frombuffer(data, np.uint8)[edges[0]:edges[-1]] if edges[-1] else np.zeros(0, np.uint8)), edges - edges[0]


def texts_of(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The opposite of :func:`joined_bytes`."""
    return pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def words_of(data: np.ndarray, edges: np.ndarray) -> list[np.ndarray] | None:
    """Texts of one length as numbers of eight letters each, which sort as the texts do; None if lengths differ."""
    size = np.diff(edges)
    if not len(size) or (size != size[0]).any():
        return None
    padded = np.zeros((len(size), -(-int(size[0]) // 8) * 8), np.uint8)
    padded[:, :size[0]] = data.reshape(len(size), -1)
    return list(np.ascontiguousarray(padded.view(">u8").T).astype(np.uint64))


def slices(sizes: np.ndarray, together: int = SLICE) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows of about ``together`` bytes each."""
    ends, first = np.cumsum(sizes), 0
    while first < len(ends):
        last = max(int(np.searchsorted(ends, (ends[first - 1] if first else 0) + together, "right")), first + 1)
        yield first, last
        first = last


def cut_texts(data: np.ndarray, edges: np.ndarray, base: np.ndarray, k: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """K-mers of texts that lie one after the other, the text each is from and its position.

    As by :func:`explode_kmers`; ``base`` is the position of each text.
    """
    if len(data) < k:
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(data, k)
    # How many letters of the k-mer are others than the unknown one.
    known = np.concatenate([[0], np.cumsum(data != ord(UNKNOWN_LETTER), dtype=np.int32)])
    kept = known[k:] > known[:-k]
    for edge in edges[1:-1].tolist():
        kept[max(edge - k + 1, 0):edge] = False
    at = np.flatnonzero(kept)
    size = np.diff(np.searchsorted(at, edges))
    part = np.repeat(np.arange(len(size)), size)
    offset = at + np.repeat(base - edges[:-1], size)
    if len(offset) and offset.min() < 0:
        raise ValueError("negative k-mer position")
    return texts_of(windows[at].reshape(-1), np.arange(len(at) + 1, dtype=np.int64) * k), part, offset


def _gathered(batches: Iterator[pa.RecordBatch], text: str, chars: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have so many characters."""
    held, size = [], 0
    for batch in batches:
        if len(batch):
            held.append(batch)
            size += int(joined_bytes(batch.column(text))[1][-1])
        if size >= chars:
            yield held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def map_kmers(
    df: DataFrame,
    k: int,
    keep: list[str],
    run: Callable[[pa.RecordBatch], pa.RecordBatch],
    schema: str,
    text: str = "sequence",
    base: Column | None = None,
    together: int = SLICE,
) -> DataFrame:
    """What ``run`` makes of the rows of :func:`explode_kmers`, some at a time, in the tasks that cut them.

    For results that are few next to the k-mers, which never become rows of Spark. ``run`` is given
    the ``keep`` columns, ``seq`` and ``offset`` of the k-mers of about ``together / k`` characters.
    """
    first = F.lit(0) if base is None else base
    body = df.select(*keep, first.cast("long").alias("_base"), F.col(text).cast("binary").alias("_b"))
    pieces = body.select(*keep, "_base", "_b", F.explode(starts(F.length("_b"), k, PIECE)).alias("_p")).select(
        *keep, (F.col("_base") + F.col("_p")).alias("_base"), cut(F.col("_b"), F.col("_p"), PIECE + k - 1).alias("_b"))

    def cut_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, "_b", together // k):
            data, edges = joined_bytes(batch.column("_b"))
            bases = batch.column("_base").to_numpy()
            for begin, end in slices(np.diff(edges) * k, together):
                seq, part, offset = cut_texts(
                    data[edges[begin]:edges[end]], edges[begin:end + 1] - edges[begin], bases[begin:end], k)
                if len(seq):
                    rows = pa.array(part + begin)
                    yield run(pa.RecordBatch.from_arrays(
                        [*(batch.column(c).take(rows) for c in keep), seq, pa.array(offset)], [*keep, "seq", "offset"]))

    return pieces.mapInArrow(cut_slices, schema)


def in_line_kmers(lines: DataFrame, k: int) -> DataFrame:
    """K-mers inside single lines only, none across a line end.

    ``lines`` is ``(ref_id, offset, line, …)``; the result is ``(ref_id, seq, offset)``.
    """
    return explode_kmers(lines, k, ["ref_id"], text="line", base=F.col("offset"))


def query_keys(queries: DataFrame, k: int) -> DataFrame:
    """``(query_id, seq, despl)``: each k-mer with its distance from the end of the query.

    ``despl`` is ``length - 1 - position``, so that reference offset plus ``despl`` is the last
    reference position of the whole query laid on this seed.
    """
    sized = queries.select("query_id", "sequence", F.length("sequence").alias("_n"))
    keys = explode_kmers(sized, k, ["query_id", "_n"], position="_at")
    return keys.select(
        "query_id", "seq", (F.col("_n") - F.lit(1) - F.col("_at")).cast("int").alias("despl")
    )


def distinct_keys(keys: DataFrame) -> DataFrame:
    """The different k-mers of a key table."""
    return keys.select("seq").distinct()
