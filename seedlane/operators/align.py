"""Aligning queries with the reference windows of their candidates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seedlane.functions.alignment import align_trimmed
from seedlane.functions.text import cut

# An alignment must score above this; characters by which windows are extended
# when ends are searched for; columns of a printed block and its mark for equal characters.
MIN_SCORE = 0.7
EXTENSION = 6
COLUMNS = 40
EQUAL_MARK = "|"

ALIGNMENT_SCHEMA = (
    "query_id long, ref_id long, end_pos long, hits long, ref_start long, ref_end long, "
    "score double, aligned_ref string, aligned_query string"
)


def compared_query(windows: DataFrame, extension: int = 0, pad: bool = True) -> DataFrame:
    """Add ``_query``, the part of ``query`` to align.

    That is all of it, unless windows are clipped at the reference ends (``pad`` off): then the
    parts of the query beyond the ends are left out.
    """
    if pad:
        return windows.withColumn("_query", F.col("query"))
    left, right = extension // 2, extension - extension // 2
    skip = F.greatest(F.col("lead") - F.lit(left), F.lit(0))
    drop = F.greatest(F.col("missing") - F.lit(right), F.lit(0))
    return windows.withColumn("_query", cut(F.col("query"), skip, F.length("query") - skip - drop))


def align_candidates(
    windows: DataFrame, extension: int = 0, pad: bool = True, min_score: float | None = MIN_SCORE
) -> DataFrame:
    """Align windows with their ``query`` and keep scores above ``min_score`` (None keeps all).

    With an ``extension``, by which the windows must have been fetched, the best ends are
    searched for. The rows of ``windows`` should be spread over tasks already.
    """
    left, right = extension // 2, extension - extension // 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            head, tail, found = align_trimmed(
                batch["window"].tolist(), batch["_query"].tolist(), left, right
            )
            last = batch["ref_start"] + batch["window"].str.len() - 1 - pd.Series(
                tail, index=batch.index, dtype="int64"
            )
            out = batch[["query_id", "ref_id", "end_pos", "hits"]].assign(
                ref_start=batch["ref_start"] + pd.Series(head, index=batch.index, dtype="int64"),
                ref_end=last.where(last < batch["ref_end"], batch["ref_end"]),
                score=[r[0] if r else None for r in found],
                aligned_ref=[r[1] if r else None for r in found],
                aligned_query=[r[2] if r else None for r in found],
            )
            yield out[out["score"].notna()]

    pairs = compared_query(windows, extension, pad).select(
        "query_id", "ref_id", "end_pos", "hits", "ref_start", "ref_end", "window", "_query"
    )
    aligned = pairs.mapInPandas(run, ALIGNMENT_SCHEMA)
    return aligned if min_score is None else aligned.filter(F.col("score") > F.lit(min_score))


def ungapped_identity(windows: DataFrame) -> DataFrame:
    """``identity``: share of equal characters of window and query laid on each other.

    For windows fetched without extension. Native, so also a cheap view before aligning.
    """
    window, query = F.col("window").cast("binary"), F.col("query").cast("binary")
    length = F.length("window")
    equal = F.filter(
        F.sequence(F.lit(0), length - F.lit(1)),
        lambda i: cut(window, i, 1) == cut(query, i + F.col("lead"), 1),
    )
    return windows.filter(length > 0).select(
        "query_id", "ref_id", "end_pos", "hits", "ref_start", "ref_end", "overhang",
        (F.size(equal) / length).alias("identity"),
    )


def above_score(scored: DataFrame, column: str = "score", min_score: float = MIN_SCORE) -> DataFrame:
    """Rows with a score strictly above ``min_score``."""
    return scored.filter(F.col(column) > F.lit(min_score))


def best_hit(alignments: DataFrame, score: str = "score") -> DataFrame:
    """The best alignment of every query: score, then hits, then position."""
    best = Window.partitionBy("query_id").orderBy(
        F.desc(score), F.desc("hits"), "ref_id", "end_pos"
    )
    ranked = alignments.withColumn("_rank", F.row_number().over(best))
    return ranked.filter(F.col("_rank") <= 1).drop("_rank")


def alignment_blocks(alignments: DataFrame, columns: int = COLUMNS) -> DataFrame:
    """Alignments in printable blocks of ``columns`` characters with marks at equal ones."""
    a, b = F.col("aligned_ref"), F.col("aligned_query")
    first = F.col("block_no") * F.lit(columns)
    blocks = alignments.select(
        "query_id", "ref_id", "end_pos", "aligned_ref", "aligned_query",
        F.explode(
            F.sequence(F.lit(0), F.floor((F.length(a) - F.lit(1)) / F.lit(columns)).cast("int"))
        ).alias("block_no"),
    ).select(
        "query_id", "ref_id", "end_pos", "block_no",
        cut(a, first, columns).alias("sequence1"), cut(b, first, columns).alias("sequence2"),
    )
    marks = F.zip_with(
        F.split("sequence1", ""), F.split("sequence2", ""),
        lambda x, y: F.when(x == y, F.lit(EQUAL_MARK)).otherwise(F.lit(" ")),
    )
    return blocks.withColumn("marks", F.array_join(marks, ""))
