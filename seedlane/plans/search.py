"""Whole searches: queries against references, as one chain of DataFrame operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedlane.operators.align import MIN_SCORE, align_candidates
from seedlane.operators.content import BLOCK, build_content, fetch_windows
from seedlane.operators.index import postings
from seedlane.operators.kmers import query_keys
from seedlane.operators.seeds import (
    THRESHOLD,
    candidates,
    diagonal_counts,
    join_queries,
    seed_hits,
    seed_hits_in_buckets,
    with_query_text,
)
from seedlane.plans.layout import TextSize, rows_fit, settled, shuffle_tasks, text_size
from seedlane.plans.reference import KEY_SIZE, Reference


@dataclass(frozen=True)
class SearchOptions:
    """Settings of a search.

    ``threshold`` is a number of hits or ``"adaptive"``. ``extension`` is the number of
    characters windows are extended by to search for the best ends (0: off). ``pad`` fills
    windows beyond the end of a reference with blanks, which count against the score; without
    it only the overlapping part is aligned. ``tasks`` is the number of tasks that align.
    ``broadcast`` set to False shuffles what could be broadcast by its size, as with larger data.
    """

    k: int = KEY_SIZE
    threshold: int | str = THRESHOLD
    extension: int = 0
    pad: bool = True
    min_score: float | None = MIN_SCORE
    tasks: int | None = None
    broadcast: bool | None = None

    def may_broadcast(self, fits: bool) -> bool:
        return fits if self.broadcast is None else self.broadcast and fits


def find_candidates(
    queries: DataFrame,
    references: DataFrame,
    options: SearchOptions = SearchOptions(),
    size: TextSize | None = None,
) -> DataFrame:
    """Candidates straight from ``(ref_id, sequence)`` rows, without a stored index.

    While the k-mers of the queries fit a broadcast, the references are read once and only
    hits are shuffled.
    """
    bound = (size or text_size(queries)).chars
    seeds = seed_hits(
        query_keys(queries, options.k), postings(references, options.k),
        broadcast_keys=options.may_broadcast(rows_fit(bound, options.k + 24)),
    )
    return candidates(diagonal_counts(seeds), options.threshold, queries)


def find_candidates_indexed(
    queries: DataFrame,
    reference: Reference,
    options: SearchOptions = SearchOptions(),
    size: TextSize | None = None,
) -> DataFrame:
    """Candidates from a stored index, reading only what holds k-mers of the queries.

    K-mers beyond a broadcast are sent to the buckets of the index, whose lists stay where they are.
    """
    keys, bound = query_keys(queries, reference.k), (size or text_size(queries)).chars
    if options.may_broadcast(rows_fit(bound, reference.k + 24)):
        seeds = seed_hits(keys, reference.entries_for(keys, True), broadcast_keys=True, screen=False)
    else:
        seeds = seed_hits_in_buckets(
            keys, reference.buckets, reference.group, reference.hot,
            lambda frequent: reference.entries_for(frequent, True), bound)
    return candidates(diagonal_counts(seeds), options.threshold, queries)


def place(
    found: DataFrame, queries: DataFrame, size: TextSize, options: SearchOptions = SearchOptions()
) -> DataFrame:
    """Candidates with the length of their query, computed once and kept.

    They are few next to the references, and their number decides how text is fetched for them.
    """
    lengths = queries.select("query_id", F.length("sequence").alias("length"))
    small = options.may_broadcast(rows_fit(size.rows, 16))
    # Read twice when queries are not small.
    return settled(join_queries(found if small else settled(found), lengths, small))


def blocks_needed(placed: DataFrame, block_size: int, extension: int) -> int:
    """Upper bound of the block reads for placed candidates."""
    per_row = F.ceil((F.col("length") + F.lit(extension)) / F.lit(block_size)) + F.lit(1)
    return placed.agg(F.coalesce(F.sum(per_row), F.lit(0)).alias("n")).first()["n"]


def extend(
    placed: DataFrame,
    queries: DataFrame,
    size: TextSize,
    content: DataFrame,
    block_size: int,
    options: SearchOptions = SearchOptions(),
    parts: int | None = None,
    few: bool | None = None,
) -> DataFrame:
    """Placed candidates with their windows and query texts, ready to align.

    ``few`` tells whether the block reads they need may be broadcast; counted if not given.
    """
    if few is None:
        few = options.may_broadcast(rows_fit(blocks_needed(placed, block_size, options.extension), 64))
    windows = fetch_windows(
        placed, content, block_size, options.extension, options.pad,
        broadcast_placed=few, parts=parts,
        tasks=options.tasks or shuffle_tasks(placed.sparkSession),
    )
    small = options.may_broadcast(size.fits())
    return with_query_text(windows if small else settled(windows), queries, small)


def windows_of(
    queries: DataFrame, references: DataFrame, options: SearchOptions = SearchOptions()
) -> DataFrame:
    """Windows of all candidates, straight from ``(ref_id, sequence)`` rows.

    References without a candidate are left out before their text is touched again.
    """
    size = text_size(queries)
    placed = place(find_candidates(queries, references, options, size), queries, size, options)
    few = options.may_broadcast(rows_fit(blocks_needed(placed, BLOCK, options.extension), 64))
    held = placed.select("ref_id").distinct()
    wanted = references.join(F.broadcast(held) if few else held, "ref_id", "left_semi")
    return extend(placed, queries, size, build_content(wanted, BLOCK), BLOCK, options, few=few)


def search(
    queries: DataFrame, references: DataFrame, options: SearchOptions = SearchOptions()
) -> DataFrame:
    """Alignments of ``(query_id, sequence)`` with ``(ref_id, sequence)`` rows."""
    windows = windows_of(queries, references, options)
    return align_candidates(windows, options.extension, options.pad, options.min_score)


def search_reference(
    queries: DataFrame, reference: Reference, options: SearchOptions = SearchOptions()
) -> DataFrame:
    """Alignments of queries with a stored reference."""
    size = text_size(queries)
    found = find_candidates_indexed(queries, reference, options, size)
    windows = extend(
        place(found, queries, size, options), queries, size, reference.content, reference.block_size,
        options, reference.content_parts,
    )
    return align_candidates(windows, options.extension, options.pad, options.min_score)
