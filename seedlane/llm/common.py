"""What several operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seedlane.plans.layout import spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table; one with fewer splits than cores is spread over them."""
    return spread(spark.read.parquet(f"{sf}/{name}.parquet"))


def fold(key: str | Column, parts: int) -> Column:
    """``crc32`` of a key as text, modulo ``parts``; a null key counts as empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return (F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % parts).cast("int")


def raw_text(text: str | Column = "text") -> Column:
    """A text as UTF-8 bytes; null counts as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(text.cast("string").cast("binary"), F.lit(b""))


def byte_array(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary Arrow array and its offsets, without copying."""
    if pa.types.is_large_binary(values.type):
        kind = np.int64
    else:
        kind = np.int32
    _, ends, data = values.buffers()
    at = np.frombuffer(ends, kind)[values.offset:values.offset + len(values) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[at[0]:at[-1]], at - at[0]


def as_frame_stream(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def smallest_hashes(df: DataFrame, key: str, rows: int, total: int) -> DataFrame:
    """The at most ``rows`` rows whose ``key`` has the smallest hashes, the same in every run.

    ``total`` is the number of rows. Hashes are cut off well above what is needed first, so that tasks do
    not each sort and send as many rows as are wanted in all.
    """
    unit = 1 << 40
    place = F.pmod(F.xxhash64(key), F.lit(unit))
    # Twice as many are expected below the cut, and no fewer than wanted for all but tiny samples.
    cut = min(unit, int(unit * (2 * rows + 100) / max(1, total)))
    return df.filter(place < cut).orderBy(place, key).limit(rows)


def free_prefix(wanted: str, *tables: DataFrame) -> str:
    """``wanted``, with underscores before it until no column begins so."""
    names = [c.lower() for t in tables for c in t.columns]
    while any(n.startswith(wanted.lower()) for n in names):
        wanted = f"_{wanted}"
    return wanted


def sorted_groups(
    batches: Iterator[pa.RecordBatch], keys: int
) -> Iterator[tuple[tuple[int, ...], list[np.ndarray]]]:
    """Groups of rows that follow each other with equal first ``keys`` columns, all of whole numbers.

    Gives the key and the other columns of one group at a time; only that group is held.
    """
    held: list[list[np.ndarray]] = []
    current: tuple[int, ...] | None = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for key in columns[:keys]:
            change[1:] |= key[1:] != key[:-1]
        starts = [*np.flatnonzero(change), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            found = tuple(int(key[a]) for key in columns[:keys])
            if found != current:
                if current is not None:
                    yield current, [np.concatenate(parts) for parts in held]
                current, held = found, [[] for _ in columns[keys:]]
            for parts, values in zip(held, columns[keys:]):
                parts.append(values[a:b])
    if current is not None:
        yield current, [np.concatenate(parts) for parts in held]


def join_by_class(rows: DataFrame, classes: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Rows with the columns of their class; ``classes`` has a row per key and ``size``, its rows.

    Classes with more than a 2000th of all rows are at most 2000, so they are broadcast; only the rows
    of smaller ones are shuffled. Keys are not null.
    """
    hot = F.col(size) > max(total // 2000, 1000)
    large, small = classes.filter(hot).drop(size), classes.filter(~hot).drop(size)
    return rows.join(F.broadcast(large), key).unionByName(
        rows.join(F.broadcast(large.select(key)), key, "left_anti").join(small, key)
    )
