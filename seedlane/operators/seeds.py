"""From index hits to candidate placements of queries on references."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedlane.functions.arrays import chunked, shift_all
from seedlane.functions.text import block_of
from seedlane.operators.filters import bitmap_bits, key_bitmap, likely_in
from seedlane.operators.index import entry_counts, hot_keys
from seedlane.operators.kmers import distinct_keys
from seedlane.plans.layout import rows_fit, settled
from seedlane.sources.tables import stored_lists

# Default number of hits a diagonal must exceed, the share of the mean query
# length used by the adaptive threshold, and the size of a piece of a candidate list.
THRESHOLD = 15
ADAPTIVE_SHARE = 0.25
LIST_PIECE = 5

# Positions per list of candidate placements.
LIST_SPAN = 100_000

# A query is hot when it has more than one in so many of all candidates.
HOT_QUERY_SHARE = 1000

# Share of the occurrences that are counted to find hot k-mers, and how often one must be seen. This
# decides the layout only: the join itself has all rows.
SAMPLE, SEEN = 0.05, 32

DIAGONAL = ["query_id", "ref_id", "end_pos"]


def keys_fit(keys: DataFrame, n_keys: int | None = None, k: int | None = None) -> bool:
    """Whether a table of k-mers may be broadcast; counted and measured unless given."""
    if n_keys is None or k is None:
        row = keys.agg(F.count("*").alias("n"), F.coalesce(F.max(F.length("seq")), F.lit(0)).alias("k")).first()
        n_keys, k = row["n"] if n_keys is None else n_keys, row["k"]
    # The k-mer, and up to three numbers.
    return rows_fit(n_keys, k + 24)


def lookup_keys(
    entries: DataFrame, keys: DataFrame, n_keys: int | None = None, broadcast_keys: bool | None = None
) -> DataFrame:
    """The index entries of the given k-mers.

    With few enough keys these travel to the entries; otherwise both are shuffled, the entries of
    frequent k-mers over many parts.
    """
    wanted = distinct_keys(keys)
    if keys_fit(keys, n_keys) if broadcast_keys is None else broadcast_keys:
        return likely_entries(entries, keys).join(F.broadcast(wanted), "seq", "left_semi")
    entries = screened(entries, wanted, n_keys)
    parts = parts_of_kmers(entries, None)
    salted = _dealt(entries, parts, "entry_parts", ["ref_id", "offset"])
    return salted.join(_copied(wanted, parts, "entry_parts").hint("merge"), ["seq", "_entry"], "left_semi").drop("_entry")


def likely_entries(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """Entries whose k-mer has the same hash as one of ``keys``; for keys that may be broadcast.

    Nearly all entries drop out here, and a broadcast join looks up a number far faster than a
    string. The few entries left are joined by the k-mer itself afterwards.
    """
    hashes = keys.select(F.xxhash64("seq").alias("_hash"))
    return entries.join(
        F.broadcast(hashes), F.xxhash64(entries["seq"]) == F.col("_hash"), "left_semi"
    )


def screened(entries: DataFrame, keys: DataFrame, n_keys: int | None = None) -> DataFrame:
    """Entries whose k-mer may be among ``keys``, by a bitmap of bounded size; for keys beyond a broadcast.

    Entries that drop out here are never shuffled, the others are kept as files, as several steps need them. Of
    keys that would fill the largest bitmap none is made.
    """
    bits = bitmap_bits(keys.count() if n_keys is None else n_keys)
    return entries if bits is None else settled(likely_in(entries, settled(key_bitmap(keys, bits)), bits))


def parts_of_kmers(entries: DataFrame, keys: DataFrame | None, hot: DataFrame | None = None) -> DataFrame:
    """``(seq, entry_parts, key_parts)`` of the k-mers that are frequent on either side of a join.

    Both sides of such a k-mer are cut, so that every part of their product is small. At most two times
    ``HOT_SHARE`` k-mers can be frequent, so this may be broadcast. ``hot`` are those of the entries if
    they are known, see :func:`seedlane.operators.index.hot_keys`.
    """
    if hot is None:
        hot = hot_keys(entry_counts(entries.select("seq").sample(SAMPLE, seed=1)), least=SEEN)
    parts = hot.select("seq", F.col("splits").alias("entry_parts"))
    if keys is None:
        return settled(parts)
    asked = hot_keys(entry_counts(keys), least=SEEN).select("seq", F.col("splits").alias("key_parts"))
    return settled(parts.join(asked, "seq", "full"))


def _dealt(rows: DataFrame, parts: DataFrame, count: str, by: list[str]) -> DataFrame:
    """Rows of frequent k-mers dealt over ``count`` parts, in a column named by it."""
    salt = F.pmod(F.xxhash64(*by), F.coalesce(F.col(count), F.lit(1))).cast("int")
    marked = rows.join(F.broadcast(parts.select("seq", count)), "seq", "left")
    return marked.withColumn(f"_{count.split('_')[0]}", salt).drop(count)


def _copied(rows: DataFrame, parts: DataFrame, count: str) -> DataFrame:
    """Rows of frequent k-mers once for each of ``count`` parts of the other side."""
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(count), F.lit(1)) - F.lit(1)))
    marked = rows.join(F.broadcast(parts.select("seq", count)), "seq", "left")
    return marked.withColumn(f"_{count.split('_')[0]}", copies).drop(count)


def _split_join(keys: DataFrame, entries: DataFrame, parts: DataFrame, by: list[str]) -> DataFrame:
    """Join by k-mer, both sides shuffled; those in ``parts`` over the product of their parts."""
    left = _copied(_dealt(entries, parts, "entry_parts", by), parts, "key_parts")
    right = _dealt(_copied(keys, parts, "entry_parts"), parts, "key_parts", ["query_id", "despl"])
    return left.join(right.hint("merge"), ["seq", "_entry", "_key"]).drop("_entry", "_key")


def seed_hits(
    keys: DataFrame,
    entries: DataFrame,
    n_keys: int | None = None,
    broadcast_keys: bool | None = None,
    screen: bool = True,
    hot: DataFrame | None = None,
    k: int | None = None,
) -> DataFrame:
    """``(query_id, ref_id, end_pos)``: one row per k-mer shared by a query and a reference.

    ``n_keys`` is an upper bound of the rows of ``keys`` and ``k`` their length, both measured here if
    not given. Keys that fit are broadcast, so the entries are not shuffled at all and no k-mer can
    be too frequent. Beyond that both sides are shuffled, frequent k-mers over many parts; see
    :func:`parts_of_kmers`. ``screen`` first turns away entries that cannot match, by the hashes of all keys if they
    fit and by a bitmap of them if not; see :func:`likely_entries` and :func:`screened`.
    """
    if keys_fit(keys, n_keys, k) if broadcast_keys is None else broadcast_keys:
        likely = likely_entries(entries, keys) if screen else entries
        joined = likely.join(F.broadcast(keys), "seq")
    else:
        needed = entries.select("seq", "ref_id", "offset")
        if screen:
            needed = screened(needed, keys, n_keys)
        joined = _split_join(keys, needed, parts_of_kmers(needed, keys, hot), ["ref_id", "offset"])
    return joined.select("query_id", "ref_id", (F.col("offset") + F.col("despl")).alias("end_pos"))


def seed_hits_in_buckets(
    keys: DataFrame,
    buckets: Sequence[DataFrame],
    group: int,
    hot: DataFrame,
    entries_of: Callable[[DataFrame], DataFrame],
    n_keys: int | None = None,
) -> DataFrame:
    """:func:`seed_hits` with stored lists that are in ``buckets`` by k-mer, without moving these.

    The k-mers of the queries are sent to the buckets, and lists that a bitmap of them turns away drop out in the scan.
    Those that are frequent on either side, ``hot`` among the lists or found by counting the keys, are
    left out there, since a bucket is one task: ``entries_of`` gives their entries, and both sides are cut as in
    :func:`seed_hits`. ``buckets`` may hold lists of hot k-mers or not.
    """
    asked = hot_keys(entry_counts(keys), least=SEEN)
    apart = settled(hot.select("seq").union(asked.select("seq")).distinct())
    rest = keys.join(F.broadcast(apart), "seq", "left_anti")
    bits = bitmap_bits(keys.count() if n_keys is None else n_keys)
    pages = None if bits is None else settled(key_bitmap(keys, bits))
    end = F.col("_at") + F.col("block") * F.lit(group) + F.col("despl")
    found = [
        stored_lists((rows if pages is None else likely_in(rows, pages, bits)).join(rest.hint("merge"), "seq"), "query_id", "despl")
        .select("query_id", "ref_id", "block", "despl", F.explode("value").alias("_at"))
        .select("query_id", "ref_id", end.alias("end_pos"))
        for rows in buckets
    ]
    if not apart.isEmpty():
        frequent = keys.join(F.broadcast(apart), "seq", "left_semi")
        found.append(seed_hits(frequent, entries_of(apart), broadcast_keys=False, screen=False, hot=hot))
    return reduce(DataFrame.unionByName, found)


def seed_lists(
    keys: DataFrame, index: DataFrame, n_keys: int | None = None, broadcast_keys: bool | None = None
) -> DataFrame:
    """``(query_id, ref_id, block, seq, despl, end_positions)``: hits as lists, not opened."""
    if keys_fit(keys, n_keys) if broadcast_keys is None else broadcast_keys:
        joined = likely_entries(index, keys).join(F.broadcast(keys), "seq")
    else:
        index = screened(index, keys, n_keys)
        joined = _split_join(keys, index, parts_of_kmers(index, keys), ["ref_id", "block"])
    return joined.select(
        "query_id", "ref_id", "block", "seq", "despl",
        shift_all(F.col("value"), F.col("despl")).alias("end_positions"),
    )


def diagonal_counts(seeds: DataFrame) -> DataFrame:
    """``hits`` per diagonal, that is per query, reference and end position.

    Counted before the shuffle first. A diagonal has at most one hit per k-mer of the query.
    """
    return seeds.groupBy(*DIAGONAL).agg(F.count("*").alias("hits"))


def adaptive_threshold(queries: DataFrame) -> DataFrame:
    """One row ``(queries, mean_length, threshold)``; a quarter of the mean query length."""
    mean = F.avg(F.length("sequence"))
    return queries.agg(
        F.count("*").alias("queries"),
        mean.alias("mean_length"),
        F.floor(mean * F.lit(ADAPTIVE_SHARE)).alias("threshold"),
    )


def candidates(
    diagonals: DataFrame, threshold: int | str = THRESHOLD, queries: DataFrame | None = None
) -> DataFrame:
    """Diagonals with more hits than ``threshold``, a number or ``"adaptive"``."""
    if threshold == "adaptive":
        if queries is None:
            raise ValueError("the adaptive threshold needs the queries")
        limit: Column = adaptive_threshold(queries).select("threshold").scalar()
    else:
        limit = F.lit(threshold)
    return diagonals.filter(F.col("hits") > limit)


def top_diagonals(diagonals: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` diagonals with most hits."""
    return diagonals.orderBy(F.desc("hits"), *DIAGONAL).limit(n)


def top_diagonals_per_query(diagonals: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` diagonals with most hits of every query, with their ``rank``.

    Spark limits every query to ``n`` rows before the shuffle as well, so a query with very many
    diagonals is no burden.
    """
    best = Window.partitionBy("query_id").orderBy(F.desc("hits"), "ref_id", "end_pos")
    return diagonals.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)


def candidate_lists(found: DataFrame, span: int = LIST_SPAN) -> DataFrame:
    """``(query_id, ref_id, block, offsets)``: sorted end positions per query.

    A list covers one reference and ``span`` end positions, which bounds its length.
    """
    return (
        found.groupBy("query_id", "ref_id", block_of(F.col("end_pos"), span).alias("block"))
        .agg(F.array_sort(F.collect_list("end_pos")).alias("offsets"))
        .filter(F.size("offsets") > 0)
    )


def candidate_chunks(lists: DataFrame, size: int = LIST_PIECE) -> DataFrame:
    """Lists cut into numbered pieces of at most ``size`` end positions."""
    return lists.select(
        "query_id", "ref_id", "block",
        F.posexplode(chunked(F.col("offsets"), size)).alias("chunk", "offsets"),
    )


def join_queries(found: DataFrame, queries: DataFrame, small: bool) -> DataFrame:
    """Add the columns of ``queries`` to candidates.

    Queries that are not ``small`` enough to be broadcast are shuffled; only those with very many
    candidates, of which there are at most ``HOT_QUERY_SHARE``, in some copies each, so that their
    candidates are spread. ``found`` is read twice then.
    """
    if small:
        return found.join(F.broadcast(queries), "query_id")
    counts = found.groupBy("query_id").agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).scalar()
    hot = F.broadcast(settled(
        counts.filter(F.col("n") * F.lit(HOT_QUERY_SHARE) > total).filter(F.col("n") >= SEEN)
        .select("query_id", F.ceil(F.col("n") * F.lit(HOT_QUERY_SHARE) / total).cast("int").alias("_parts"))
    ))
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    copies = queries.join(hot, "query_id", "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), parts - F.lit(1)))).drop("_parts")
    salt = F.pmod(F.xxhash64("ref_id", "end_pos"), parts).cast("int")
    dealt = found.join(hot, "query_id", "left").withColumn("_salt", salt).drop("_parts")
    return dealt.join(copies.hint("merge"), ["query_id", "_salt"]).drop("_salt")


def with_query_text(found: DataFrame, queries: DataFrame, small: bool = False) -> DataFrame:
    """Candidates with the text of their query."""
    return join_queries(found, queries.select("query_id", F.col("sequence").alias("query")), small)


def unmatched_queries(queries: DataFrame, found: DataFrame) -> DataFrame:
    """Queries without any candidate or alignment."""
    return queries.join(found.select("query_id").distinct(), "query_id", "left_anti")
