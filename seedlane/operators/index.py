"""The inverted index: which k-mer occurs where.

Lists are kept per offset block, never per k-mer alone: a list holds at most one entry per
position of its block, so that the most frequent k-mer spreads over many rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedlane.functions.arrays import array_text
from seedlane.functions.packed import closer, numbers, opened
from seedlane.functions.text import block_of, cut, starts
from seedlane.operators.content import build_content_from_lines
from seedlane.operators.kmers import cut_texts, explode_kmers, joined_bytes, map_kmers, slices, texts_of, words_of
from seedlane.plans.layout import settled, shuffle_tasks, spread_of, text_size, text_tasks

# Positions per offset block, hence the largest possible list.
GROUP = 100_000

# The most bytes of k-mers that the text of one block may make.
MOST_BYTES = 1 << 28

# Characters whose k-mers make up one bucket of totals, and the most buckets; beyond, they grow.
BUCKET_CHARS, MOST_BUCKETS = 1 << 21, 1 << 15

# Bytes of k-mers that a task counts at once for totals.
COUNTED = 44 << 20

LISTS = "seq string, ref_id long, block long, value array<long>"
PACKED_NAMES = ["ref_id", "block", "n", "size", "seqs", "sizes", "steps"]
PACKED_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
PACKED = "ref_id long, block long, n int, size int, seqs binary, sizes binary, steps binary"

# What is made of the lists of a task where they are grouped, batch by batch.
Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

# A k-mer is hot when it holds more than one in so many of all index entries.
HOT_SHARE = 10_000


def postings(
    references: DataFrame, k: int, group: int = GROUP, text: str = "sequence", base: str | None = None, packed: bool = False,
) -> DataFrame:
    """Flat index entries ``(seq, block, ref_id, offset)`` of ``(ref_id, sequence)`` rows.

    ``base`` names the column with the start of the text, if rows are parts of a sequence. ``packed`` entries are those of
    :func:`packed_entries`, made in the tasks that cut them, for :func:`build_index`.
    """
    start = None if base is None else F.col(base)
    if packed:

        def pack(found: pa.RecordBatch) -> pa.RecordBatch:
            block = pa.array(np.floor_divide(found["offset"].to_numpy(), group))
            return next(packed_entries(found.append_column("block", block)))

        return map_kmers(references, k, ["ref_id"], pack, PACKED, text, start)
    kmers = explode_kmers(references, k, ["ref_id"], text=text, base=start)
    return kmers.select("seq", block_of(F.col("offset"), group).alias("block"), "ref_id", "offset")


def _listed(row: np.ndarray, offset: np.ndarray, seq: pa.Array, ref_id: pa.Array, block: pa.Array) -> pa.RecordBatch:
    """Lists of the entries of some blocks; ``row`` says in which of the blocks an entry is."""
    if ((offset[1:] < offset[:-1]) & (row[1:] == row[:-1])).any():
        order = np.lexsort((offset, row))
        row, offset, seq = row[order], offset[order], seq.take(pa.array(order))
    entries = pa.table({"row": pa.array(row), "seq": seq, "value": pa.array(offset)})
    # One thread keeps the order of the offsets.
    lists = entries.group_by(["row", "seq"], use_threads=False).aggregate([("value", "list")]).combine_chunks()
    row = lists["row"].combine_chunks()
    columns = [lists["seq"].combine_chunks(), ref_id.take(row), block.take(row), lists["value_list"].combine_chunks()]
    return pa.RecordBatch.from_arrays(columns, ["seq", "ref_id", "block", "value"])


def lists_of_texts(batch: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
    """Lists of the k-mers of ``(ref_id, block, parts)`` rows, ``parts`` being the ``(at, text)`` of one block."""
    if not len(batch):
        return
    parts = batch.column("parts").flatten()
    count = batch.column("parts").value_lengths().to_numpy(zero_copy_only=False)
    data, edges = joined_bytes(parts.field("text"))
    base, to = parts.field("at").to_numpy(), np.concatenate([[0], np.cumsum(count)])
    for first, last in slices((edges[to[1:]] - edges[to[:-1]]) * k):
        begin, end = to[first], to[last]
        seq, part, offset = cut_texts(data[edges[begin]:edges[end]], edges[begin:end + 1] - edges[begin], base[begin:end], k)
        row = np.repeat(np.arange(first, last), count[first:last])[part]
        yield _listed(row, offset, seq, batch.column("ref_id"), batch.column("block"))


def packed_entries(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Flat entries in few rows: those of a block that follow one another in one row, each column in one compressed piece.

    Entries in no order are put together by block first.
    """
    if not len(batch):
        return

    def changes(ref: np.ndarray, known: np.ndarray, block: np.ndarray) -> np.ndarray:
        return np.concatenate([[True], (ref[1:] != ref[:-1]) | (known[1:] != known[:-1]) | (block[1:] != block[:-1])])

    ref, known = batch.column("ref_id").fill_null(0).to_numpy(), batch.column("ref_id").is_valid().to_numpy(zero_copy_only=False)
    block = batch.column("block").to_numpy()
    new = changes(ref, known, block)
    if 8 * new.sum() > len(batch):
        order = np.lexsort((block, known, ref))
        batch, ref, known, block = batch.take(pa.array(order)), ref[order], known[order], block[order]
        new = changes(ref, known, block)
    to = np.concatenate([np.flatnonzero(new), [len(batch)]]).tolist()
    offset = batch.column("offset").to_numpy()
    step = np.diff(offset, prepend=0)
    data, edges = joined_bytes(batch.column("seq"))
    size = np.diff(edges)
    # K-mers of one length, which overlap where they follow one another, take little more than their text.
    letters = data.reshape(len(batch), -1) if (size == size[0]).all() else None
    rows = []
    for begin, end in zip(to[:-1], to[1:]):
        step[begin] = offset[begin]
        packed = data[edges[begin]:edges[end]] if letters is None else letters[begin:end]
        rows.append((
            int(ref[begin]) if known[begin] else None, int(block[begin]), end - begin,
            int(size[0]) if letters is not None else -1, closer(packed),
            b"" if letters is not None else closer(size[begin:end]), closer(step[begin:end])))
    yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*rows), PACKED_TYPES)], PACKED_NAMES)


def packed_lists(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    """:func:`packed_entries` of lists, for blocks that are so many of theirs."""
    for batch in batches:
        value = batch.column("value")
        row = pa.array(np.repeat(np.arange(len(batch)), value.value_lengths().to_numpy(zero_copy_only=False)))
        wide = pa.array(np.floor_divide(batch.column("block").to_numpy(), blocks)).take(row)
        yield from packed_entries(pa.RecordBatch.from_arrays(
            [batch.column("seq").take(row), batch.column("ref_id").take(row), wide, value.flatten()], ["seq", "ref_id", "block", "offset"]))


def lists_of_packed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Lists of ``(ref_id, block, parts)`` rows, ``parts`` being all that :func:`packed_entries` made of one block."""
    if not len(batch):
        return
    parts = batch.column("parts").flatten()
    count = batch.column("parts").value_lengths().to_numpy(zero_copy_only=False)
    to = np.concatenate([[0], np.cumsum(count)])
    n, width = (parts.field(name).to_numpy().astype(np.int64) for name in ("n", "size"))
    seqs, sizes, steps = (parts.field(name) for name in ("seqs", "sizes", "steps"))
    ends = np.concatenate([[0], np.cumsum(n * np.where(width < 0, 1, width))])
    for first, last in slices(ends[to[1:]] - ends[to[:-1]]):
        begin, end = int(to[first]), int(to[last])
        letters, size, offset = [], [], []
        for part in range(begin, end):
            many, each = int(n[part]), int(width[part])
            size.append(np.full(many, each) if each >= 0 else numbers(sizes[part].as_buffer(), many, np.int64))
            letters.append(opened(seqs[part].as_buffer(), *((many, each) if each >= 0 else (int(size[-1].sum()), 1))).reshape(-1))
            offset.append(np.cumsum(numbers(steps[part].as_buffer(), many, np.int64)))
        row = np.repeat(np.repeat(np.arange(first, last), count[first:last]), n[begin:end])
        seq = texts_of(np.concatenate(letters), np.concatenate([[0], np.cumsum(np.concatenate(size))]))
        yield _listed(row, np.concatenate(offset), seq, batch.column("ref_id"), batch.column("block"))


def build_index(entries: DataFrame, run: Run | None = None, schema: str = LISTS) -> DataFrame:
    """``(seq, ref_id, block, value)`` with the offsets of a k-mer in a block, ascending, or what ``run`` makes of them.

    Of any flat entries, or packed ones. They are moved by reference and block, those of a block in one piece, and grouped by
    Arrow where they arrive. Whole sequences are better grouped by :func:`index_sequences`, which moves text.
    """
    if "seqs" in entries.columns:
        return _lists_of_blocks(entries, run, schema)
    flat = entries.select("seq", F.col("ref_id").cast("long").alias("ref_id"), "block", F.col("offset").cast("long").alias("offset"))
    packed = flat.mapInArrow(lambda batches: (p for b in batches for p in packed_entries(b)), PACKED)
    return _lists_of_blocks(packed, run, schema)


def _lists_of_blocks(packed: DataFrame, run: Run | None, schema: str) -> DataFrame:
    blocks = packed.repartition(4 * shuffle_tasks(packed.sparkSession), "ref_id", "block").groupBy("ref_id", "block").agg(
        F.collect_list(F.struct(*PACKED_NAMES[2:])).alias("parts"))
    return _grouped(blocks, lists_of_packed, run, schema)


def _index_groups(groups: DataFrame, k: int, group: int, run: Run | None, schema: str) -> DataFrame:
    """Index of ``(ref_id, block, at, text)`` rows that are partitioned by reference and block.

    All offsets of a list come from one block then, whose k-mers Arrow groups where they are: what was
    moved is the text, not its many times larger k-mers, and these are never sorted.
    """
    if group * k > MOST_BYTES:
        kmers = explode_kmers(groups, k, ["ref_id", "block"], text="text", base=F.col("at"))
        lists = kmers.groupBy("seq", "ref_id", "block").agg(F.array_sort(F.collect_list("offset")).alias("value"))
        return lists.mapInArrow(run, schema) if run else lists
    part = F.struct(F.col("at").cast("long").alias("at"), F.col("text").cast("binary").alias("text"))
    blocks = groups.groupBy("ref_id", "block").agg(F.collect_list(part).alias("parts"))
    return _grouped(blocks, lambda batch: lists_of_texts(batch, k), run, schema)


def _grouped(blocks: DataFrame, lists: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], run: Run | None, schema: str) -> DataFrame:

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (some for batch in batches for some in lists(batch))

    return blocks.mapInArrow((lambda batches: run(grouped(batches))) if run else grouped, schema)


def index_sequences(
    references: DataFrame, k: int, group: int = GROUP, tasks: int | None = None, run: Run | None = None, schema: str = LISTS,
) -> DataFrame:
    """The index of ``(ref_id, sequence)`` rows, or what ``run`` makes of its lists. Texts are cut at the edges of offset blocks.

    The number of ``tasks`` is set, by the measured text if not given: by the bytes to be moved alone,
    Spark would choose too few, and any fixed number would be too few for more text.
    """
    tasks = tasks or text_tasks(references.sparkSession, text_size(references).chars)
    body = references.select("ref_id", F.col("sequence").cast("binary").alias("_b"))
    groups = body.select(
        "ref_id", "_b", F.explode(starts(F.length("_b"), k, group)).alias("_p")
    ).select(
        "ref_id",
        block_of(F.col("_p"), group).alias("block"),
        F.col("_p").alias("at"),
        cut(F.col("_b"), F.col("_p"), group + k - 1).alias("text"),
    )
    return _index_groups(groups.repartition(tasks, "ref_id", "block"), k, group, run, schema)


def index_content(
    content: DataFrame, k: int, group: int = GROUP, tasks: int | None = None, run: Run | None = None, schema: str = LISTS,
) -> DataFrame:
    """The index of the text in content blocks of any size; ``tasks`` and ``run`` as in :func:`index_sequences`."""
    tasks = tasks or text_tasks(content.sparkSession, text_size(content, "value").chars)
    parts = content.select("ref_id", "offset", F.col("value").alias("line"))
    texts = build_content_from_lines(parts, group, k - 1).select(
        "ref_id", F.col("blockid").alias("block"), (F.col("blockid") * F.lit(group)).alias("at"), F.col("value").alias("text")
    )
    return _index_groups(texts.repartition(tasks, "ref_id", "block"), k, group, run, schema)


def index_lines(
    lines: DataFrame, k: int, group: int = GROUP, tasks: int | None = None, run: Run | None = None, schema: str = LISTS,
) -> DataFrame:
    """The index of k-mers inside single lines of ``(ref_id, offset, line)``; ``tasks`` and ``run`` as above.

    Lines are cut where blocks end and dealt by block, so that lists are grouped where they are here too.
    """
    tasks = tasks or text_tasks(lines.sparkSession, text_size(lines, "line").chars)
    start, at = F.col("offset"), F.col("_at")
    last = block_of(start + F.greatest(F.length("line") - F.lit(k), F.lit(0)), group)
    pieces = (
        lines.filter(F.length("line") >= k)
        .select("ref_id", "offset", F.col("line").cast("binary").alias("_b"),
                F.explode(F.sequence(block_of(start, group), last)).alias("block"))
        .withColumn("_at", F.greatest(start, F.col("block") * F.lit(group)))
        .select(
            "ref_id", "block", at.alias("at"),
            cut(F.col("_b"), (at - start).cast("int"),
                ((F.col("block") + F.lit(1)) * F.lit(group) - at).cast("int") + F.lit(k - 1)).alias("text"),
        )
    )
    return _index_groups(pieces.repartition(tasks, "ref_id", "block"), k, group, run, schema)


def index_entries(index: DataFrame) -> DataFrame:
    """Back from lists to flat entries."""
    return index.select("seq", "block", "ref_id", F.explode("value").alias("offset"))


def merge_lists(index: DataFrame, blocks: int, run: Run | None = None, schema: str = LISTS) -> DataFrame:
    """Concatenate the lists of ``blocks`` neighbouring blocks of a k-mer, or what ``run`` makes of the longer ones.

    A list stays bounded by ``blocks`` times the block size. ``index`` are lists, or what :func:`packed_lists` made of them
    in the tasks that grouped them.
    """
    packed = index if "seqs" in index.columns else index.select("seq", "ref_id", "block", "value").mapInArrow(
        lambda batches: packed_lists(batches, blocks), PACKED)
    return _lists_of_blocks(packed, run, schema)


def index_rows_text(index: DataFrame) -> DataFrame:
    """Index rows with the list written as ``[1,2,3]``."""
    return index.select("seq", "ref_id", "block", array_text(F.col("value")).alias("value"))


def list_texts(lists: pa.RecordBatch) -> pa.Array:
    """The text of :func:`index_rows_text` of lists inside a task."""
    value = lists.column("value")
    ends = pc.cumulative_sum(value.value_lengths())
    texts = pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends]), value.flatten().cast(pa.string()))
    return pc.binary_join_element_wise("[", pc.binary_join(texts, ","), "]", "")


def key_totals(entries: DataFrame) -> DataFrame:
    """``(seq, n)``: how often each k-mer occurs, from flat entries."""
    return entries.groupBy("seq").agg(F.count("*").alias("n"))


def _counted(kmers: pa.RecordBatch, buckets: int) -> pa.RecordBatch:
    """How often each k-mer of a batch occurs, those of one of the ``buckets`` in one row, by their letters."""
    data, edges = joined_bytes(kmers["seq"])
    letters, words = data.reshape(len(kmers), -1), words_of(data, edges)
    mixed = np.zeros(len(kmers), np.uint64)
    for word in words:
        mixed = (mixed ^ word) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    bucket = (mixed % np.uint64(buckets)).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    ends = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    for begin, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
        some = order[begin:end]
        order[begin:end] = some[np.lexsort([w[some] for w in words[::-1]])]
    new = np.ones(len(order), bool)
    new[1:] = np.any([w[order][1:] != w[order][:-1] for w in words], axis=0)
    # Different k-mers begin here, those of a bucket at ``to``.
    first = np.flatnonzero(new)
    n, to, found = np.diff(first, append=len(order)).astype(np.int32), np.searchsorted(first, ends).tolist(), order[first]
    rows = [(int(bucket[at]), end - begin, closer(letters[found[begin:end]]), closer(n[begin:end]))
            for at, begin, end in zip(ends[:-1].tolist(), to[:-1], to[1:])]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), kind) for c, kind in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
        ["bucket", "size", "seqs", "ns"])


def _totals(batch: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
    """``(seq, n)`` of ``(bucket, parts)`` rows, ``parts`` being all that :func:`_counted` made of one bucket."""
    for row in range(len(batch)):
        parts = batch.column("parts").slice(row, 1).flatten()
        sizes = parts.field("size").to_pylist()
        # Offsets of a text are numbers of 32 bits in Arrow.
        if sum(sizes) * k >= 1 << 31:
            raise ValueError("too many k-mers in a bucket")
        letters = np.concatenate([opened(s.as_buffer(), n, k) for s, n in zip(parts.field("seqs"), sizes)])
        counts = np.concatenate([numbers(s.as_buffer(), n, np.int32) for s, n in zip(parts.field("ns"), sizes)])
        seq = texts_of(letters.reshape(-1), np.arange(len(letters) + 1) * k)
        entries = pa.table({"seq": seq, "n": counts.astype(np.int64)})
        found = entries.group_by("seq").aggregate([("n", "sum")]).combine_chunks()
        yield pa.RecordBatch.from_arrays([found["seq"].combine_chunks(), found["n_sum"].combine_chunks()], ["seq", "n"])


def sequence_totals(
    references: DataFrame, k: int, buckets: int | None = None,
    run: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: str = "seq string, n long",
) -> DataFrame:
    """:func:`key_totals` of ``(ref_id, sequence)`` rows, or what ``run`` makes of them, a bucket at a time.

    K-mers are counted in the task that cuts them, some million at once. The different ones of these are moved by hash,
    those of a bucket in one compressed piece, and added up there by Arrow. A frequent k-mer comes once a piece; the number of
    ``buckets`` is measured, if not given, so that one has the k-mers of about two million characters.
    """
    if buckets is None:
        buckets = min(MOST_BUCKETS, max(shuffle_tasks(references.sparkSession), -(-text_size(references).chars // BUCKET_CHARS)))
    counted = map_kmers(references, k, [], lambda kmers: _counted(kmers, buckets), "bucket int, size int, seqs binary, ns binary",
        together=COUNTED)
    moved = counted.repartition(max(shuffle_tasks(references.sparkSession), buckets // 4), "bucket").groupBy("bucket").agg(
        F.collect_list(F.struct("size", "seqs", "ns")).alias("parts"))
    return moved.mapInArrow(
        lambda batches: ((run(t) if run else t) for b in batches for t in _totals(b, k)), schema)


def entry_counts(entries: DataFrame) -> DataFrame:
    """Flat entries as ``(seq, n)`` rows for :func:`hot_keys`, not summed up."""
    return entries.select("seq", F.lit(1).alias("n"))


def list_counts(index: DataFrame) -> DataFrame:
    """Index lists as ``(seq, n)`` rows for :func:`hot_keys`, not summed up."""
    return index.select("seq", F.size("value").alias("n"))


def hot_keys(counts: DataFrame, share: int = HOT_SHARE, least: int = 1) -> DataFrame:
    """``(seq, splits)`` of the k-mers that hold more than one in ``share`` of all entries.

    ``counts`` are ``(seq, n)`` rows, any number per k-mer. At most ``share`` k-mers can be hot,
    which bounds the table whatever the size of the index. ``splits`` is the number of parts
    that bring such a k-mer down to that share. K-mers that occur fewer than ``least`` times are never hot.

    Sums per hash bucket come first, as these are few and shrink before the shuffle. A hot k-mer
    can only be in a bucket that is at least as large, so only those are counted by k-mer.
    """
    bucketed = counts.withColumn("_bucket", spread_of(["seq"], 10 * share))
    # Kept, as it is used three times and the counts may be long to compute.
    sums = settled(bucketed.groupBy("_bucket").agg(F.sum("n").alias("n")))
    all_entries = sums.agg(F.sum("n").alias("n")).scalar()
    # At most ``share`` buckets.
    large = sums.filter(F.col("n") * F.lit(share) > all_entries).filter(F.col("n") >= least).select("_bucket")
    totals = (
        bucketed.join(F.broadcast(large), "_bucket", "left_semi")
        .groupBy("seq").agg(F.sum("n").alias("n"))
    )
    return totals.filter(F.col("n") * F.lit(share) > all_entries).filter(F.col("n") >= least).select(
        "seq", F.ceil(F.col("n") * F.lit(share) / all_entries).cast("int").alias("splits")
    )
