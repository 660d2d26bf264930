"""The block table of reference texts, and fetching windows of text from it.

Content rows are ``(ref_id, blockid, offset, size, value)``: the text of a reference in blocks of
a fixed number of characters, the last one shorter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedlane.functions.arrays import ordered_text
from seedlane.functions.text import FILL, block_of, cut, starts
from seedlane.plans.layout import deal_by_cost, spread_of

BLOCK = 1000
PLACED = ["query_id", "ref_id", "end_pos", "hits", "_from", "_to", "_lead"]


def build_content(references: DataFrame, block_size: int = BLOCK) -> DataFrame:
    """Blocks of ``(ref_id, sequence)`` rows, cut without a shuffle."""
    body = references.select("ref_id", F.col("sequence").cast("binary").alias("_b"))
    at = F.col("offset")
    return body.select(
        "ref_id", "_b", F.explode(starts(F.length("_b"), 1, block_size)).alias("offset")
    ).select(
        "ref_id",
        block_of(at, block_size).alias("blockid"),
        at.cast("long").alias("offset"),
        F.least(F.lit(block_size), F.length("_b") - at).alias("size"),
        cut(F.col("_b"), at, block_size).cast("string").alias("value"),
    )


def build_content_from_lines(
    lines: DataFrame, block_size: int = BLOCK, overlap: int = 0
) -> DataFrame:
    """Blocks of ``(ref_id, offset, line)`` rows, for records too long for one row.

    Lines are cut at block edges; a block then gathers at most ``block_size`` pieces. Blocks may
    be followed by ``overlap`` characters of the text after them: with ``k - 1`` of them, their
    k-mers are exactly those of the whole record.
    """
    end = F.col("offset") + F.length("line")
    first = F.greatest(block_of(F.col("offset") - F.lit(overlap), block_size), F.lit(0))
    last = block_of(end - F.lit(1), block_size)
    block_end = (F.col("blockid") + F.lit(1)) * F.lit(block_size) + F.lit(overlap)
    pieces = (
        lines.filter(F.length("line") > 0)
        .select(
            "ref_id", "offset", F.col("line").cast("binary").alias("_b"),
            F.explode(F.sequence(first, last)).alias("blockid"),
        )
        .withColumn("_at", F.greatest(F.col("offset"), F.col("blockid") * F.lit(block_size)))
        .select(
            "ref_id", "blockid",
            F.struct(
                F.col("_at").alias("position"),
                cut(
                    F.col("_b"),
                    (F.col("_at") - F.col("offset")).cast("int"),
                    (block_end - F.col("_at")).cast("int"),
                ).cast("string").alias("text"),
            ).alias("_piece"),
        )
    )
    value = ordered_text(F.collect_list("_piece"))
    return pieces.groupBy("ref_id", "blockid").agg(value.alias("value")).select(
        "ref_id", "blockid", (F.col("blockid") * F.lit(block_size)).alias("offset"),
        F.length("value").alias("size"), "value",
    )


def content_by_line(lines: DataFrame, block_size: int = BLOCK) -> DataFrame:
    """Blocks that keep lines whole: the lines starting inside ``block_size`` characters.

    One aggregation yields the text and its start together. Blocks have uneven sizes.
    """
    piece = F.struct(F.col("offset").alias("position"), F.col("line").alias("text"))
    return (
        lines.groupBy("ref_id", block_of(F.col("offset"), block_size).alias("blockid"))
        .agg(F.min("offset").alias("offset"), ordered_text(F.collect_list(piece)).alias("value"))
        .select("ref_id", "blockid", "offset", F.length("value").alias("size"), "value")
    )


def window_bounds(placed: DataFrame, extension: int = 0) -> DataFrame:
    """Add the wanted window ``_from .. _to`` (inclusive) to ``(…, end_pos, hits, length)`` rows.

    The window is the query laid ungapped on its diagonal, with half of ``extension`` more
    characters on either side (the odd one on the right). It starts at 0 at the earliest;
    ``_lead`` tells how many characters were cut off there.
    """
    left, right = extension // 2, extension - extension // 2
    start = F.col("end_pos") - F.col("length") + F.lit(1 - left)
    return placed.select(
        "query_id", "ref_id", "end_pos", "hits",
        F.greatest(start, F.lit(0)).cast("long").alias("_from"),
        (F.col("end_pos") + F.lit(right)).cast("long").alias("_to"),
        (F.greatest(start, F.lit(0)) - start).cast("int").alias("_lead"),
    )


def fetch_windows(
    placed: DataFrame,
    content: DataFrame,
    block_size: int = BLOCK,
    extension: int = 0,
    pad: bool = True,
    broadcast_placed: bool = False,
    parts: int | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Reference text under each candidate.

    ``placed`` is ``(query_id, ref_id, end_pos, hits, length)`` with the length of the query. The
    range of positions becomes a few block numbers, so that this is an equi-join. ``parts`` is
    the number of stored parts of ``content``, if it has a ``part`` column. Pieces are cut
    before they are gathered. ``tasks`` spreads the result for the alignment that follows, so that the products of
    lengths, which that takes time for, are alike; ``placed`` is read several times then.

    Result: ``window`` (filled with blanks past the end of the reference if ``pad``),
    ``ref_start`` and ``ref_end`` of the text really there, ``lead`` and ``missing`` characters
    at the left and right, and ``overhang`` if there are any.
    """
    bounds = window_bounds(placed, extension)
    key = PLACED
    if tasks is not None:
        width = F.col("_to") - F.col("_from") + F.lit(1)
        bounds, key = deal_by_cost(bounds, width * width, ["query_id", "ref_id", "end_pos"], tasks), ["_deal", *PLACED]
    needed = bounds.select(
        *key,
        F.explode(
            F.sequence(block_of(F.col("_from"), block_size), block_of(F.col("_to"), block_size))
        ).alias("blockid"),
    )
    on = ["ref_id", "blockid"]
    if parts is not None:
        needed = needed.withColumn("part", spread_of(on, parts))
        on = ["part", *on]
    text = content.select(*on, "value")
    joined = text.join(F.broadcast(needed) if broadcast_placed else needed.hint("merge"), on)

    block_start = F.col("blockid") * F.lit(block_size)
    at = F.greatest(F.col("_from"), block_start)
    pieces = joined.select(
        *key,
        F.struct(
            at.alias("position"),
            cut(
                F.col("value"), (at - block_start).cast("int"),
                (F.least(F.col("_to") + F.lit(1), block_start + F.lit(block_size)) - at).cast("int"),
            ).alias("text"),
        ).alias("_piece"),
    )
    if tasks is not None:
        pieces = pieces.repartition(tasks, "_deal")
    wanted = (F.col("_to") - F.col("_from") + F.lit(1)).cast("int")
    missing = wanted - F.length("_text")
    return (
        pieces.groupBy(*key)
        .agg(ordered_text(F.collect_list("_piece")).alias("_text"))
        .select(
            "query_id", "ref_id", "end_pos", "hits",
            F.col("_from").alias("ref_start"),
            (F.col("_from") + F.length("_text") - F.lit(1)).alias("ref_end"),
            F.col("_lead").alias("lead"),
            missing.alias("missing"),
            ((F.col("_lead") > 0) | (missing > 0)).alias("overhang"),
            (F.rpad("_text", wanted, F.lit(FILL)) if pad else F.col("_text")).alias("window"),
        )
    )
