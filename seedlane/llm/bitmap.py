"""Bitmaps of hashes: which of many values may be in a table, in bounded memory."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits per value, and the least and most bits of a bitmap. A full one lets more through, never less.
PER_VALUE, LEAST, MOST = 16, 1 << 16, 1 << 28
# Fixed by Spark's bitmap functions: bits per row.
PAGE = 32768


def bitmap_of(values: DataFrame, hashed: str, wanted: Column | None = None) -> np.ndarray:
    """The bits of the numbers in column ``hashed`` (random 64-bit ones) of rows that are ``wanted``.

    Spark sets the bits; the driver gets them as pages, ``MOST`` bits at most whatever the number of rows.
    """
    kept = values if wanted is None else values.filter(wanted)
    rows = kept.count()
    size = LEAST
    while size < min(MOST, PER_VALUE * rows):
        size *= 2
    place = F.pmod(F.col(hashed), F.lit(size)) + F.lit(1)
    pages = (
        kept.select(F.bitmap_bucket_number(place).alias("page"), F.bitmap_bit_position(place).alias("bit"))
        .groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))
    )
    bits = np.zeros(size // 8, np.uint8)
    for page in pages.toLocalIterator():
        at = (page["page"] - 1) * PAGE // 8
        bits[at:at + PAGE // 8] = np.frombuffer(page["bits"], np.uint8)[:len(bits) - at]
    return bits


def may_hold(bits: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """For each number whether it may be among those the bitmap was made of; true for all that are."""
    place = hashed.view(np.uint64) & np.uint64(8 * len(bits) - 1)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
