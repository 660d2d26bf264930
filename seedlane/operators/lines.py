"""Tables of text lines: ``(ref_id, line_no, line)`` with ``line_no`` dense from 0.

A record may have any number of lines, so nothing here sorts a whole record in one task. Work is
cut into spans of ``SPAN`` lines; what a span needs from its neighbours is one row per span.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seedlane.functions.text import HEADER_MARK, block_of, text_lines
from seedlane.plans.layout import in_ranges, settled

SPAN = 10_000


def split_lines(df: DataFrame, ref_id: str, text: str) -> DataFrame:
    """Normalised non-blank lines of multi-line texts."""
    return df.select(
        F.col(ref_id).cast("long").alias("ref_id"),
        F.posexplode(text_lines(F.col(text))).alias("_n", "line"),
    ).select("ref_id", F.col("_n").cast("long").alias("line_no"), "line")


def line_offsets(lines: DataFrame, span: int = SPAN) -> DataFrame:
    """Add ``size`` and ``offset``, the position of the line in the record without line ends."""
    sized = lines.withColumn("size", F.length("line")).withColumn(
        "_span", block_of(F.col("line_no"), span)
    )
    before = Window.partitionBy("ref_id").orderBy("_span").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = (
        sized.groupBy("ref_id", "_span")
        .agg(F.sum("size").alias("_chars"))
        .select("ref_id", "_span", F.coalesce(F.sum("_chars").over(before), F.lit(0)).alias("_base"))
    )
    inside = Window.partitionBy("ref_id", "_span").orderBy("line_no").rowsBetween(
        Window.unboundedPreceding, -1
    )
    return (
        sized.join(carried, ["ref_id", "_span"])
        .withColumn("offset", F.col("_base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .drop("_span", "_base")
    )


def with_next_line(lines: DataFrame, span: int = SPAN) -> DataFrame:
    """Add ``next_line``, null for the last line of a record."""
    spanned = lines.withColumn("_span", block_of(F.col("line_no"), span))
    heads = spanned.filter(F.col("line_no") == F.col("_span") * span).select(
        "ref_id", (F.col("_span") - 1).alias("_span"), F.col("line").alias("_head")
    )
    inside = Window.partitionBy("ref_id", "_span").orderBy("line_no")
    return (
        spanned.join(heads, ["ref_id", "_span"], "left")
        .withColumn("next_line", F.coalesce(F.lead("line").over(inside), F.col("_head")))
        .drop("_span", "_head")
    )


def two_line_join(lines: DataFrame, span: int = SPAN) -> DataFrame:
    """``lines``: each line followed by the whole next line, if there is one."""
    return with_next_line(lines, span).select(
        "ref_id",
        "line_no",
        F.length("line").alias("size"),
        F.concat("line", F.coalesce("next_line", F.lit(""))).alias("lines"),
    )


def overlap_prefix_join(lines: DataFrame, k: int, span: int = SPAN) -> DataFrame:
    """``lines``: each line followed by the first ``k - 1`` characters of the next one."""
    return with_next_line(lines, span).select(
        "ref_id",
        "line_no",
        F.length("line").alias("size"),
        F.concat("line", F.substring(F.coalesce("next_line", F.lit("")), 1, k - 1)).alias("lines"),
    )


def lines_to_queries(lines: DataFrame, headers: bool = False) -> DataFrame:
    """Every line as a query ``(query_id, sequence, length)``, numbered from 1 over all records.

    Records count in the order of ``ref_id``, whatever numbers those are, and lines by ``line_no``.
    With ``headers``, lines that begin with the header mark are left out and not counted.
    The running number is a prefix sum in three steps, so that no task orders all records: over
    spans of lines in a record, over the records of a range of ids, over the ranges. It is joined
    back per span of lines, so that a very long record is spread over many tasks.
    """
    used = lines.withColumn("_part", block_of(F.col("line_no"), SPAN))
    if headers:
        used = used.filter(~F.col("line").startswith(HEADER_MARK))
    counts = used.groupBy("ref_id", "_part").agg(F.count("*").alias("_n"))
    # Kept, as the number of a range is only the same within one computation.
    parts = settled(in_ranges(counts, "ref_id", "_range"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        parts.groupBy("_range")
        .agg(F.sum("_n").alias("_t"))
        .select("_range", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_base"))
    )
    inside = Window.partitionBy("_range").orderBy("ref_id", "_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    bases = parts.join(F.broadcast(totals), "_range").select(
        "ref_id", "_part",
        (F.col("_base") + F.coalesce(F.sum("_n").over(inside), F.lit(0))).alias("_base"),
    )
    place = Window.partitionBy("ref_id", "_part").orderBy("line_no")
    return used.join(bases, ["ref_id", "_part"]).select(
        (F.col("_base") + F.row_number().over(place)).alias("query_id"),
        F.col("line").alias("sequence"),
        F.length("line").alias("length"),
    )
