"""Turning away rows that cannot match, before anything is shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bits per key, and the least and most bits of a bitmap: 128 MB of them are broadcast at most.
PER_KEY, LEAST_BITS, MOST_BITS = 64, 1 << 16, 1 << 30
# Positions of a page, which is one row: 512 numbers of 64 bits.
PAGE_BITS = 15


def bitmap_bits(keys: int) -> int | None:
    """Bits for so many keys; None for so many that a bitmap of any allowed size would be full."""
    bits = LEAST_BITS
    while bits < MOST_BITS and bits < keys * PER_KEY:
        bits *= 2
    return bits if keys < bits else None


def key_bitmap(keys: DataFrame, bits: int, key: str = "seq") -> DataFrame:
    """``(_page, _bits)``: a bitmap of the hashes of ``keys``, of at most ``bits / 32768`` rows."""
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    none = keys.sparkSession.range(bits >> 6).select(F.col("id").alias("_word"), F.lit(0).cast("long").alias("_mask"))
    words = keys.select(
        F.shiftright(place, 6).alias("_word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64({key}), 64) as int))").alias("_mask"),
    ).unionByName(none).groupBy("_word").agg(F.bit_or("_mask").alias("_mask"))
    # Every page has all of its 512 numbers, in order.
    pages = words.groupBy(F.shiftright("_word", PAGE_BITS - 6).alias("_page")).agg(
        F.array_sort(F.collect_list(F.struct("_word", "_mask"))).alias("_all"))
    return pages.select("_page", F.transform("_all", lambda w: w["_mask"]).alias("_bits"))


def likely_in(rows: DataFrame, pages: DataFrame, bits: int, key: str = "seq") -> DataFrame:
    """Rows whose ``key`` may be one the bitmap was made of; all that are, and few others.

    The bitmap is broadcast and probed where the rows are read.
    """
    place = F.pmod(F.xxhash64(rows[key]), F.lit(bits))
    found = rows.withColumn("_place", place).join(F.broadcast(pages), F.shiftright("_place", PAGE_BITS) == F.col("_page"))
    bit = F.expr("getbit(_bits[cast(pmod(shiftright(_place, 6), 512) as int)], cast(pmod(_place, 64) as int))")
    return found.filter(bit == 1).drop("_place", "_page", "_bits")
