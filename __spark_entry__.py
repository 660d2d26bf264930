"""

``documents`` are the references and ``benchmark`` the queries, all rows and whole texts.
"""

from __future__ import annotations

import re
import sys
import warnings
from collections.abc import Callable, Iterator
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seedlane.functions.arrays import array_text, count_by, values_over
from seedlane.functions.digest import md5_numbers
from seedlane.functions.text import block_of, normalize
from seedlane.operators import align, content, index, kmers, lines, metrics, runs, seeds
from seedlane.plans import search as plans
from seedlane.plans.layout import fresh_path, spread, text_size
from seedlane.plans.reference import append_reference, build_reference, compact_reference, open_reference
from seedlane.sources import files, tables

# The operators for training data are a part of their own, which may be left out or lack a library it needs.
OPTIONAL = ("corpus_pipeline", "seedlane.llm")
try:
    import corpus_pipeline
    import seedlane.llm.queries as llm
except ImportError as missing:
    if missing.name not in OPTIONAL:
        warnings.warn(f"no operators for training data: {missing}")
    corpus_pipeline = llm = None

K, BLOCK, GROUP = 11, 1000, 1000


# ---------------------------------------------------------------- inputs


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(_table(spark, sf, "documents").select("doc_id", "text"))


def _refs(spark: SparkSession, sf: str) -> DataFrame:
    return kmers.as_references(_documents(spark, sf), "doc_id", "text")


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    return kmers.as_queries(_table(spark, sf, "benchmark"), "item_id", "text")


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return lines.split_lines(_documents(spark, sf), "doc_id", "text")


def _postings(spark: SparkSession, sf: str, packed: bool = False) -> DataFrame:
    return index.postings(_refs(spark, sf), K, GROUP, packed=packed)


def _index(spark: SparkSession, sf: str, run: index.Run | None = None, schema: str = index.LISTS) -> DataFrame:
    return index.index_sequences(_refs(spark, sf), K, GROUP, run=run, schema=schema)


def _keys(spark: SparkSession, sf: str) -> DataFrame:
    return kmers.query_keys(_queries(spark, sf), K)


def _seeds(spark: SparkSession, sf: str) -> DataFrame:
    queries = _queries(spark, sf)
    return seeds.seed_hits(
        kmers.query_keys(queries, K), _postings(spark, sf), text_size(queries).chars, k=K
    )


def _diagonals(spark: SparkSession, sf: str) -> DataFrame:
    return seeds.diagonal_counts(_seeds(spark, sf))


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    return seeds.candidates(_diagonals(spark, sf))


def _windows(
    spark: SparkSession, sf: str, threshold: int = seeds.THRESHOLD, extension: int = 0, pad: bool = True,
    broadcast: bool | None = None,
) -> DataFrame:
    options = plans.SearchOptions(K, threshold, extension, pad, broadcast=broadcast)
    return plans.windows_of(_queries(spark, sf), _refs(spark, sf), options)


def _checksum(value: Column) -> Column:
    """Sum over all rows of a number that depends on every character of ``value``."""
    return F.sum(F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("long"))


def _kmer_digest(texts: DataFrame, text: str = "sequence", base: Column | None = None) -> DataFrame:
    """Numbers that depend on every k-mer, taken in the tasks that cut them and summed up by reference."""

    def digested(found: pa.RecordBatch) -> pa.RecordBatch:
        lines = pc.binary_join_element_wise(found["seq"], found["offset"].cast(pa.string()), ":")
        sums = pa.table({
            "ref_id": found["ref_id"], "offset": found["offset"], "number": md5_numbers(*kmers.joined_bytes(lines)),
        }).group_by("ref_id").aggregate([("offset", "count"), ("offset", "min"), ("offset", "max"), ("number", "sum")])
        columns = ["ref_id", "offset_count", "offset_min", "offset_max", "number_sum"]
        return sums.select(columns).combine_chunks().to_batches()[0]

    schema = "ref_id long, offset_count long, offset_min long, offset_max long, number_sum long"
    return kmers.map_kmers(texts, K, ["ref_id"], digested, schema, text, base).groupBy("ref_id").agg(
        F.sum("offset_count").alias("kmers"),
        F.min("offset_min").alias("first_offset"),
        F.max("offset_max").alias("last_offset"),
        F.sum("number_sum").alias("checksum"),
    )


# ---------------------------------------------------------------- queries


def normalized_sequences(spark: SparkSession, sf: str) -> DataFrame:
    return _refs(spark, sf).withColumn("size", F.length("sequence"))


def line_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return lines.line_offsets(_lines(spark, sf)).select("ref_id", "line_no", "offset", "size")


def two_line_join(spark: SparkSession, sf: str) -> DataFrame:
    return lines.two_line_join(_lines(spark, sf))


def overlap_prefix_join(spark: SparkSession, sf: str) -> DataFrame:
    return lines.overlap_prefix_join(_lines(spark, sf), K)


def in_line_kmers(spark: SparkSession, sf: str) -> DataFrame:
    return _kmer_digest(lines.line_offsets(_lines(spark, sf)), "line", F.col("offset"))


def reference_kmers(spark: SparkSession, sf: str) -> DataFrame:
    return _kmer_digest(_refs(spark, sf))


def reference_kmers_by_block(spark: SparkSession, sf: str) -> DataFrame:
    located = lines.line_offsets(_lines(spark, sf))
    texts = content.build_content_from_lines(located, BLOCK, overlap=K - 1)
    return _kmer_digest(texts, "value", F.col("offset"))


DIGEST = "ref_id long, block long, lists long, offsets long, longest int, checksum long"


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers that depend on every list, by reference and block, taken in the tasks that grouped them."""
    for lists in batches:
        if not len(lists):
            continue
        size, lines = lists["value"].value_lengths(), pc.binary_join_element_wise(lists["seq"], index.list_texts(lists), ":")
        sums = pa.table({
            "ref_id": lists["ref_id"], "block": lists["block"], "size": size, "number": md5_numbers(*kmers.joined_bytes(lines)),
        }).group_by(["ref_id", "block"]).aggregate([("size", "count"), ("size", "sum"), ("size", "max"), ("number", "sum")])
        columns = ["ref_id", "block", "size_count", "size_sum", "size_max", "number_sum"]
        yield from sums.select(columns).rename_columns(["ref_id", "block", "lists", "offsets", "longest", "checksum"]).to_batches()


def _index_digest(digested: DataFrame) -> DataFrame:
    return digested.groupBy("ref_id", "block").agg(
        F.sum("lists").alias("lists"), F.sum("offsets").alias("offsets"), F.max("longest").alias("longest"),
        F.sum("checksum").alias("checksum"),
    )


def kmer_index(spark: SparkSession, sf: str) -> DataFrame:
    return _index_digest(_index(spark, sf, _digested, DIGEST))


def kmer_index_of_entries(spark: SparkSession, sf: str) -> DataFrame:
    return _index_digest(index.build_index(_postings(spark, sf, packed=True), _digested, DIGEST))


def kmer_index_of_content(spark: SparkSession, sf: str) -> DataFrame:
    blocks = content.build_content(_refs(spark, sf), 300)
    return _index_digest(index.index_content(blocks, K, GROUP, run=_digested, schema=DIGEST))


def kmer_index_merged(spark: SparkSession, sf: str) -> DataFrame:
    packed = _index(spark, sf, lambda lists: index.packed_lists(lists, 8), index.PACKED)
    return _index_digest(index.merge_lists(packed, 8, _digested, DIGEST)).drop("offsets")


def kmer_totals(spark: SparkSession, sf: str) -> DataFrame:

    def digested(totals: pa.RecordBatch) -> pa.RecordBatch:
        sums = pa.table({"n": totals["n"], "number": md5_numbers(*kmers.joined_bytes(totals["seq"]))})
        sums = sums.group_by("n").aggregate([("number", "count"), ("number", "sum")])
        return sums.select(["n", "number_count", "number_sum"]).combine_chunks().to_batches()[0]

    counted = index.sequence_totals(
        _refs(spark, sf), K, run=digested, schema="n long, number_count long, number_sum long")
    return counted.groupBy("n").agg(F.sum("number_count").alias("keys"), F.sum("number_sum").alias("checksum"))


def kmer_totals_by_runs(spark: SparkSession, sf: str) -> DataFrame:
    return runs.key_totals_by_runs(_refs(spark, sf), K).groupBy("n").agg(
        F.count("*").alias("keys"), _checksum(F.col("seq")).alias("checksum")
    )


def frequent_kmers(spark: SparkSession, sf: str) -> DataFrame:
    return index.hot_keys(index.list_counts(_index(spark, sf)))


def index_export(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "index-export")
    files.export_index_tsv(_index(spark, sf, files.tsv_lines, "value string"), path)

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text in (row for batch in batches for row in batch["value"]):
            for lines, number in files.lines_of_text(text, K + 1):
                sums = pa.table({
                    "ref_id": number.cast(pa.int64()), "number": md5_numbers(*kmers.joined_bytes(lines)),
                }).group_by("ref_id").aggregate([("number", "count"), ("number", "sum")])
                yield from sums.select(["ref_id", "number_count", "number_sum"]).rename_columns(["ref_id", "rows", "checksum"]).to_batches()

    # Files are of bounded size, so each is read at once.
    sums = spark.read.text(path, wholetext=True).mapInArrow(digested, "ref_id long, rows long, checksum long")
    return sums.groupBy("ref_id").agg(F.sum("rows").alias("rows"), F.sum("checksum").alias("checksum"))


def query_kmers(spark: SparkSession, sf: str) -> DataFrame:
    return _keys(spark, sf)


def distinct_query_kmers(spark: SparkSession, sf: str) -> DataFrame:
    return kmers.distinct_keys(_keys(spark, sf))


def key_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return seeds.lookup_keys(_postings(spark, sf), _keys(spark, sf))


def key_lookup_shuffled(spark: SparkSession, sf: str) -> DataFrame:
    return seeds.lookup_keys(_postings(spark, sf), _keys(spark, sf), broadcast_keys=False)


def seed_hits(spark: SparkSession, sf: str) -> DataFrame:
    return _seeds(spark, sf)


def seed_hits_shuffled(spark: SparkSession, sf: str) -> DataFrame:
    return seeds.seed_hits(_keys(spark, sf), _postings(spark, sf), broadcast_keys=False)


def seed_hits_by_runs(spark: SparkSession, sf: str) -> DataFrame:
    return runs.seed_hits_by_runs(_queries(spark, sf), _refs(spark, sf), K)


def seed_lists(spark: SparkSession, sf: str) -> DataFrame:
    lists = seeds.seed_lists(_keys(spark, sf), _index(spark, sf))
    return lists.withColumn("end_positions", array_text(F.col("end_positions")))


def seed_lists_shuffled(spark: SparkSession, sf: str) -> DataFrame:
    lists = seeds.seed_lists(_keys(spark, sf), _index(spark, sf), broadcast_keys=False)
    return lists.withColumn("end_positions", array_text(F.col("end_positions")))


def diagonal_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _diagonals(spark, sf)


def _end_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Hits as lists; a list covers one query and so many end positions of one reference."""
    block = block_of(F.col("end_pos"), GROUP).alias("block")
    return _seeds(spark, sf).groupBy("query_id", "ref_id", block).agg(
        F.collect_list("end_pos").alias("ends")
    )


def counted_end_positions(spark: SparkSession, sf: str) -> DataFrame:
    pairs = F.transform(count_by(F.col("ends")), lambda c: F.concat_ws(":", c["value"], c["n"]))
    return _end_lists(spark, sf).select("query_id", "ref_id", "block", array_text(pairs).alias("counts"))


def frequent_end_positions(spark: SparkSession, sf: str) -> DataFrame:
    lists = _end_lists(spark, sf)
    frequent = lists.withColumn("ends", values_over(F.col("ends"), seeds.THRESHOLD))
    return frequent.filter(F.size("ends") > 0).withColumn("ends", array_text(F.col("ends")))


def candidates_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return _candidates(spark, sf)


def candidates_adaptive(spark: SparkSession, sf: str) -> DataFrame:
    return seeds.candidates(_diagonals(spark, sf), "adaptive", _queries(spark, sf))


def adaptive_threshold(spark: SparkSession, sf: str) -> DataFrame:
    row = seeds.adaptive_threshold(_queries(spark, sf))
    return row.withColumn("mean_length", F.round("mean_length", 6))


def candidate_lists(spark: SparkSession, sf: str) -> DataFrame:
    lists = seeds.candidate_lists(_candidates(spark, sf))
    return lists.withColumn("offsets", array_text(F.col("offsets")))


def candidate_chunks(spark: SparkSession, sf: str) -> DataFrame:
    # All diagonals, so that lists need more than one piece.
    pieces = seeds.candidate_chunks(seeds.candidate_lists(_diagonals(spark, sf)))
    return pieces.withColumn("offsets", array_text(F.col("offsets")))


def listed_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.listed_candidates(seeds.candidate_lists(_candidates(spark, sf)))


def candidates_with_query(spark: SparkSession, sf: str) -> DataFrame:
    queries = _queries(spark, sf)
    return seeds.with_query_text(_candidates(spark, sf), queries, text_size(queries).fits())


def unmatched_queries(spark: SparkSession, sf: str) -> DataFrame:
    return seeds.unmatched_queries(_queries(spark, sf), _candidates(spark, sf))


def top_diagonals(spark: SparkSession, sf: str) -> DataFrame:
    return seeds.top_diagonals(_diagonals(spark, sf), 10)


def top_diagonals_per_query(spark: SparkSession, sf: str) -> DataFrame:
    return seeds.top_diagonals_per_query(_diagonals(spark, sf), 3)


def content_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return content.build_content(_refs(spark, sf), BLOCK)


def content_blocks_from_lines(spark: SparkSession, sf: str) -> DataFrame:
    return content.build_content_from_lines(lines.line_offsets(_lines(spark, sf)), BLOCK)


def content_blocks_by_line(spark: SparkSession, sf: str) -> DataFrame:
    return content.content_by_line(lines.line_offsets(_lines(spark, sf)), BLOCK)


def _window_columns(windows: DataFrame) -> DataFrame:
    return windows.select(
        "query_id", "ref_id", "end_pos", "hits", "ref_start", "ref_end", "overhang", "window"
    )


def fetch_windows(spark: SparkSession, sf: str) -> DataFrame:
    # Any hit makes a window here, so that many hang over an end.
    return _window_columns(_windows(spark, sf, threshold=0))


def fetch_windows_extended(spark: SparkSession, sf: str) -> DataFrame:
    return _window_columns(_windows(spark, sf, threshold=0, extension=align.EXTENSION))


def fetch_windows_shuffled(spark: SparkSession, sf: str) -> DataFrame:
    return _window_columns(_windows(spark, sf, threshold=0, broadcast=False))


def ungapped_identity(spark: SparkSession, sf: str) -> DataFrame:
    found = align.ungapped_identity(_windows(spark, sf, threshold=0))
    return found.withColumn("identity", F.round("identity", 6))


def _rounded(aligned: DataFrame) -> DataFrame:
    return aligned.withColumn("score", F.round("score", 6))


def alignments(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(align.align_candidates(_windows(spark, sf)))


def alignments_shuffled(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(align.align_candidates(_windows(spark, sf, broadcast=False)))


def alignments_all_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(align.align_candidates(_windows(spark, sf, threshold=2), min_score=None))


def alignments_extended(spark: SparkSession, sf: str) -> DataFrame:
    windows = _windows(spark, sf, extension=align.EXTENSION)
    return _rounded(align.align_candidates(windows, align.EXTENSION))


def alignments_extended_all_scores(spark: SparkSession, sf: str) -> DataFrame:
    windows = _windows(spark, sf, threshold=2, extension=align.EXTENSION)
    return _rounded(align.align_candidates(windows, align.EXTENSION, min_score=None))


def alignments_clipped(spark: SparkSession, sf: str) -> DataFrame:
    windows = _windows(spark, sf, threshold=2, pad=False)
    return _rounded(align.align_candidates(windows, pad=False, min_score=None))


def best_hit(spark: SparkSession, sf: str) -> DataFrame:
    found = align.best_hit(align.align_candidates(_windows(spark, sf)))
    return _rounded(found).select("query_id", "ref_id", "end_pos", "hits", "score")


def alignment_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return align.alignment_blocks(align.align_candidates(_windows(spark, sf)))


def _reference_of_documents(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    folder = fresh_path(spark, "references")
    refs = _refs(spark, sf)
    build_reference(refs, folder, "documents", K, BLOCK, GROUP, parts=16)
    return folder, refs


def stored_reference_search(spark: SparkSession, sf: str) -> DataFrame:
    folder, _ = _reference_of_documents(spark, sf)
    stored = open_reference(spark, folder, "documents")
    return _rounded(plans.search_reference(_queries(spark, sf), stored))


def stored_reference_appended(spark: SparkSession, sf: str) -> DataFrame:
    folder, refs = fresh_path(spark, "references"), _refs(spark, sf)
    build_reference(refs.filter(F.col("ref_id") % 2 == 0), folder, "documents", K, BLOCK, GROUP, parts=16)
    stored = append_reference(refs.filter(F.col("ref_id") % 2 != 0), folder, "documents")
    return _rounded(plans.search_reference(_queries(spark, sf), stored))


def stored_reference_compacted(spark: SparkSession, sf: str) -> DataFrame:
    folder, refs = fresh_path(spark, "references"), _refs(spark, sf)
    build_reference(refs.filter(F.col("ref_id") % 3 == 0), folder, "documents", K, BLOCK, GROUP, parts=16)
    for rest in (1, 2):
        append_reference(refs.filter(F.col("ref_id") % 3 == rest), folder, "documents")
    stored = compact_reference(spark, folder, "documents")
    return _rounded(plans.search_reference(_queries(spark, sf), stored))


def named_alignments(spark: SparkSession, sf: str) -> DataFrame:
    folder, docs = fresh_path(spark, "references"), _table(spark, sf, "documents")
    names = docs.select(F.col("doc_id").alias("ref_id"), F.concat_ws("/", "source", "lang", "doc_id").alias("name"))
    stored = build_reference(_refs(spark, sf), folder, "documents", K, BLOCK, GROUP, parts=16, names=names)
    found = _rounded(plans.search_reference(_queries(spark, sf), stored))
    return stored.with_names(found).select("query_id", "ref_id", "ref_name", "end_pos", "score")


def stored_reference_other_index(spark: SparkSession, sf: str) -> DataFrame:
    folder, refs = _reference_of_documents(spark, sf)
    build_reference(refs, folder, "documents_21", 21, BLOCK, GROUP, parts=16, index_only=True)
    both = open_reference(spark, folder, "documents", "documents_21")
    return plans.find_candidates_indexed(_queries(spark, sf), both)


def stored_reference_many_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Beyond a broadcast of keys, over two segments in buckets."""
    folder, refs = fresh_path(spark, "references"), _refs(spark, sf)
    build_reference(refs.filter(F.col("ref_id") % 3 == 0), folder, "documents", K, BLOCK, GROUP, parts=16)
    stored = append_reference(refs.filter(F.col("ref_id") % 3 != 0), folder, "documents")
    return plans.find_candidates_indexed(_queries(spark, sf), stored, plans.SearchOptions(broadcast=False))


def saved_alignments(spark: SparkSession, sf: str) -> DataFrame:
    found = align.align_candidates(_windows(spark, sf))
    path = tables.write_alignments(
        found, fresh_path(spark, "output"), "benchmark", "documents", "run1"
    )
    return _rounded(tables.load_table(spark, path))


def lines_to_queries(spark: SparkSession, sf: str) -> DataFrame:
    return lines.lines_to_queries(_lines(spark, sf))


def file_lines_to_queries(spark: SparkSession, sf: str) -> DataFrame:
    found = lines.lines_to_queries(files.read_sequence_lines(spark, _document_files(spark, sf)))
    # Files are in no given order, so queries are told by their text.
    return found.groupBy("sequence", "length").agg(F.count("*").alias("n"))


def query_file(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "queries")
    files.write_query_tsv(lines.lines_to_queries(_lines(spark, sf)), path)
    return files.read_query_tsv(spark, path)


def _document_files(spark: SparkSession, sf: str) -> str:
    path = fresh_path(spark, "fasta")
    text = F.concat(F.lit(">"), F.col("doc_id"), F.lit("\n"), F.col("text"))
    _documents(spark, sf).select(text.alias("value")).write.text(path)
    return path


def file_lines(spark: SparkSession, sf: str) -> DataFrame:
    found, names = files.read_sequences(spark, _document_files(spark, sf))
    found = found.join(names, "ref_id")
    return found.select(F.col("name").cast("long").alias("doc_id"), "line_no", "offset", "line")


def file_lines_by_content(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the files are gzip; the others are not."""
    refs, path = _documents(spark, sf), fresh_path(spark, "fasta")
    text = F.concat(F.lit(">"), F.col("doc_id"), F.lit("\n"), F.col("text"))
    for rest, how in enumerate(("none", "gzip")):
        refs.filter(F.col("doc_id") % 2 == rest).select(text.alias("value")).write.text(f"{path}/{how}", compression=how)
    found, names = files.read_sequences(spark, [f"{path}/none", f"{path}/gzip"], by_content=True)
    found = found.join(names, "ref_id")
    return found.select(F.col("name").cast("long").alias("doc_id"), "line_no", "offset", "line")


def file_records(spark: SparkSession, sf: str) -> DataFrame:
    found, names = files.read_sequences(spark, _document_files(spark, sf))
    found = files.records(found).join(names.withColumnRenamed("ref_id", "query_id"), "query_id")
    return found.select(F.col("name").cast("long").alias("doc_id"), "sequence", "length")


def search_summary(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.search_summary(
        _queries(spark, sf), _keys(spark, sf), _diagonals(spark, sf), seeds.THRESHOLD
    )


def run_statistics(spark: SparkSession, sf: str) -> DataFrame:
    counts = search_summary(spark, sf).first().asDict()
    path = fresh_path(spark, "stats")
    for _ in range(2):
        tables.append_run_stats(
            metrics.run_stats(spark, procedure="search", key_size=K, **counts), path
        )
    saved = spark.read.csv(path, sep=";", header=True)
    return saved.select(
        "procedure", *(F.col(c).cast("long").alias(c) for c in ("key_size", *counts))
    )


def balance_by_key(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.balance_by(_postings(spark, sf), "ref_id")


def partition_balance(spark: SparkSession, sf: str) -> DataFrame:
    # Partitions chosen by reference number, so that the result can be told from the data.
    found = _postings(spark, sf)
    return metrics.partition_balance(
        found.repartitionById(16, F.pmod("ref_id", F.lit(16)).cast("int"))
    )


def page_candidates(spark: SparkSession, sf: str) -> DataFrame:
    pages = spread(_table(spark, sf, "pages").select("page_id", "html"))
    refs = kmers.as_references(pages, "page_id", "html")
    return plans.find_candidates(_queries(spark, sf), refs, plans.SearchOptions(K, 3))


def conversation_offsets(spark: SparkSession, sf: str) -> DataFrame:
    turns = _table(spark, sf, "conversations").select(
        F.col("conv_id").alias("ref_id"), F.col("turn").alias("line_no"),
        normalize(F.col("text")).alias("line"),
    )
    return lines.line_offsets(turns).select("ref_id", "line_no", "offset", "size")


REGISTERED = [
    normalized_sequences, line_offsets, two_line_join, overlap_prefix_join, in_line_kmers,
    reference_kmers, reference_kmers_by_block, kmer_index, kmer_index_of_entries,
    kmer_index_of_content, kmer_index_merged, kmer_totals, kmer_totals_by_runs, frequent_kmers,
    index_export, query_kmers, distinct_query_kmers, key_lookup, key_lookup_shuffled,
    seed_hits, seed_hits_shuffled, seed_hits_by_runs, seed_lists, seed_lists_shuffled, diagonal_counts, counted_end_positions, frequent_end_positions, candidates_fixed, candidates_adaptive,
    adaptive_threshold, candidate_lists, candidate_chunks, listed_candidates,
    candidates_with_query, unmatched_queries, top_diagonals, top_diagonals_per_query,
    content_blocks, content_blocks_from_lines, content_blocks_by_line, fetch_windows,
    fetch_windows_shuffled, fetch_windows_extended, ungapped_identity, alignments, alignments_shuffled,
    alignments_all_scores, alignments_extended, alignments_extended_all_scores, alignments_clipped, best_hit, alignment_blocks, stored_reference_search,
    stored_reference_appended, stored_reference_compacted, named_alignments, stored_reference_other_index, stored_reference_many_keys, saved_alignments, lines_to_queries, file_lines_to_queries, query_file, file_lines, file_lines_by_content,
    file_records, search_summary, run_statistics, balance_by_key, partition_balance,
    page_candidates, conversation_offsets,
]


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: alignments of all benchmark passages with all documents."""
    return alignments(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One entry per operator; each callable takes (spark, sf_dir)."""
    found = {q.__name__: q for q in REGISTERED}
    if llm:
        found |= llm.QUERIES | {"pipeline": corpus_pipeline.run}
    return found


# ---------------------------------------------------------------- the same in SQL

_SEQ = r"upper(regexp_replace(text, '[^\x00-\x7F]|[\r\n]', '', 'g'))"

# Named pieces of SQL. Each may use those above it.
_PARTS = {
    "refs": f"SELECT doc_id AS ref_id, {_SEQ} AS sequence FROM documents",
    "q": f"SELECT item_id AS query_id, {_SEQ} AS sequence, length({_SEQ})::INTEGER AS length FROM benchmark",
    "split_text": r"""
        SELECT doc_id AS ref_id, [x FOR x IN string_split(
            upper(regexp_replace(text, '[^\x00-\x7F]|\r', '', 'g')), chr(10)) IF x <> ''] AS parts
        FROM documents""",
    "lines": """
        SELECT ref_id, generate_subscripts(parts, 1) - 1 AS line_no, unnest(parts) AS line
        FROM split_text""",
    "located": """
        SELECT ref_id, line_no, line, length(line)::INTEGER AS size,
               (sum(length(line)) OVER (PARTITION BY ref_id ORDER BY line_no) - length(line))::BIGINT AS "offset"
        FROM lines""",
    # Every 128th position with what its k-mers need; slicing a short text is much faster.
    "pieces": """
        SELECT ref_id, p, substr(sequence, p + 1, 128 + 10) AS piece
        FROM (SELECT *, unnest(range(0, length(sequence), 128)) AS p FROM refs)""",
    "rk": """
        SELECT ref_id, p + o AS "offset", substr(piece, o + 1, 11) AS seq
        FROM (SELECT ref_id, p, piece, unnest(range(0, length(piece) - 10)) AS o FROM pieces)
        WHERE substr(piece, o + 1, 11) <> repeat('N', 11)""",
    "lists": """
        SELECT seq, ref_id, "offset" // 1000 AS block, count(*) AS n,
               '[' || string_agg("offset", ',' ORDER BY "offset") || ']' AS value
        FROM rk GROUP BY ALL""",
    "qk": """
        SELECT query_id, substr(sequence, o + 1, 11) AS seq, (length - 1 - o)::INTEGER AS despl
        FROM (SELECT *, unnest(range(0, length - 10)) AS o FROM q)
        WHERE substr(sequence, o + 1, 11) <> repeat('N', 11)""",
    "seeds": """
        SELECT query_id, ref_id, "offset" + despl AS end_pos FROM qk JOIN rk USING (seq)""",
    "diag": """
        SELECT query_id, ref_id, end_pos, count(*) AS hits FROM seeds GROUP BY ALL""",
    "cand": "SELECT * FROM diag WHERE hits > 15",
    "blocks": """
        SELECT ref_id, b AS blockid, b * 1000 AS "offset",
               least(1000, length(sequence) - b * 1000)::INTEGER AS size,
               substr(sequence, b * 1000 + 1, 1000) AS value
        FROM (SELECT *, unnest(range(0, (length(sequence) + 999) // 1000)) AS b FROM refs)""",
}

_ORDER = list(_PARTS)


def _with(*names: str, extra: str = "", recursive: bool = False) -> str:
    """WITH clause of all pieces up to the last one named that the query may need."""
    needs = {
        "lines": ["split_text"], "located": ["split_text", "lines"], "pieces": ["refs"], "rk": ["refs", "pieces"],
        "lists": ["refs", "pieces", "rk"], "qk": ["q"], "seeds": ["refs", "q", "pieces", "rk", "qk"],
        "diag": ["refs", "q", "pieces", "rk", "qk", "seeds"], "blocks": ["refs"],
        "cand": ["refs", "q", "pieces", "rk", "qk", "seeds", "diag"],
    }
    wanted = set(names).union(*(needs.get(n, []) for n in names))
    ctes = ", ".join(f"{n} AS MATERIALIZED ({_PARTS[n]})" for n in _ORDER if n in wanted)
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}{', ' + extra if extra else ''} "


def _sum_md5(text: str) -> str:
    return f"sum(('0x' || substr(md5({text}), 1, 8))::BIGINT)::BIGINT"


def _digest_sql(ctes: str, source: str) -> str:
    return ctes + f"""
        SELECT ref_id, count(*) AS kmers, min("offset") AS first_offset, max("offset") AS last_offset,
               {_sum_md5("seq || ':' || " + '"offset"')} AS checksum
        FROM {source} GROUP BY ref_id"""


def _placed_sql(threshold: int, extension: int = 0) -> str:
    """Windows cut from whole sequences, of all diagonals above ``threshold``."""
    left, right = extension // 2, extension - extension // 2
    return f"""
        spans AS MATERIALIZED (
            SELECT query_id, ref_id, end_pos, hits, q.sequence AS query, refs.sequence AS ref,
                   end_pos - length + 1 - {left} AS lo, end_pos + {right} AS hi
            FROM diag JOIN q USING (query_id) JOIN refs USING (ref_id) WHERE hits > {threshold}),
        win AS MATERIALIZED (
            SELECT query_id, ref_id, end_pos, hits, query, greatest(lo, 0) AS ref_start,
                   least(hi, length(ref) - 1) AS ref_end, greatest(-lo, 0) AS lead,
                   (lo < 0 OR hi > length(ref) - 1) AS overhang,
                   rpad(substr(ref, greatest(lo, 0) + 1, hi - greatest(lo, 0) + 1),
                        (hi - greatest(lo, 0) + 1)::INTEGER, ' ') AS "window"
            FROM spans)"""


def _aligned_sql(pairs: str) -> str:
    """Alignment of ``(id, a, b)`` rows cell by cell: matrix, ways back, path, result."""
    return f"""
        pairs AS MATERIALIZED ({pairs}),
        matrix AS (
            SELECT id, 0 AS i, unnest(range(0, length(b))) AS j, -3 * unnest(range(0, length(b))) AS v
            FROM pairs
            UNION ALL
            SELECT id, i + 1, j, max(t + 3 * j) OVER (PARTITION BY id ORDER BY j) - 3 * j
            FROM (
                SELECT m.id, i, j, CASE WHEN j = 0 THEN -3 * (i + 1) ELSE greatest(
                    v - 3,
                    lag(v) OVER (PARTITION BY m.id ORDER BY j)
                        + CASE WHEN substr(a, (i + 2)::BIGINT, 1) = substr(b, j + 1, 1) THEN 2 ELSE -1 END
                ) END AS t
                FROM matrix m JOIN pairs USING (id) WHERE i + 1 < length(a))),
        cells AS (
            SELECT id, i, j, lag(v) OVER (PARTITION BY id, i ORDER BY j) AS west,
                   lag(v) OVER (PARTITION BY id, j ORDER BY i) AS north,
                   lag(v) OVER (PARTITION BY id, i - j ORDER BY i) AS slant
            FROM matrix),
        ways AS MATERIALIZED (
            SELECT id, i, string_agg(CASE WHEN slant >= west AND slant >= north THEN 'S'
                                          WHEN west >= north THEN 'W' ELSE 'N' END, '' ORDER BY j) AS way
            FROM cells WHERE i > 0 AND j > 0 GROUP BY id, i),
        path AS (
            SELECT id, 0 AS step, length(a) - 1 AS i, length(b) - 1 AS j,
                   substr(a, length(a), 1) AS x, substr(b, length(b), 1) AS y
            FROM pairs
            UNION ALL
            SELECT id, step + 1, i2, j2, CASE WHEN w = 'W' THEN '-' ELSE substr(a, i2 + 1, 1) END,
                   CASE WHEN w = 'N' THEN '-' ELSE substr(b, j2 + 1, 1) END
            FROM (
                SELECT p.id, step, a, b, substr(way, p.j, 1) AS w,
                       p.i - (substr(way, p.j, 1) <> 'W')::BIGINT AS i2,
                       p.j - (substr(way, p.j, 1) <> 'N')::BIGINT AS j2
                FROM path p JOIN pairs USING (id) JOIN ways ON ways.id = p.id AND ways.i = p.i
                WHERE p.i > 0 AND p.j > 0)),
        aligned AS MATERIALIZED (
            SELECT id, count(*) FILTER (x = y) / count(*) AS score,
                   string_agg(x, '' ORDER BY step DESC) AS aligned_ref,
                   string_agg(y, '' ORDER BY step DESC) AS aligned_query
            FROM path GROUP BY id)"""


def _alignments_sql(threshold: int = 15, more: str = "") -> str:
    number = """numbered AS MATERIALIZED (
        SELECT *, row_number() OVER (ORDER BY query_id, ref_id, end_pos) AS id FROM win)"""
    steps = ", ".join([
        _placed_sql(threshold), number, _aligned_sql('SELECT id, "window" AS a, query AS b FROM numbered')
    ])
    return _with("diag", extra=steps + more, recursive=True)


_ALIGNMENT_COLUMNS = """
    SELECT query_id, ref_id, end_pos, hits, ref_start, ref_end, round(score, 6) AS score,
           aligned_ref, aligned_query
    FROM numbered JOIN aligned USING (id)"""


def _clipped_sql(threshold: int) -> str:
    """Only the parts of window and query that lie on each other inside the reference."""
    steps = ", ".join([
        _placed_sql(threshold),
        """numbered AS MATERIALIZED (
            SELECT *, row_number() OVER (ORDER BY query_id, ref_id, end_pos) AS id,
                   substr("window", 1, (ref_end - ref_start + 1)::BIGINT) AS there,
                   substr(query, (lead + 1)::BIGINT, (ref_end - ref_start + 1)::BIGINT) AS part
            FROM win)""",
        _aligned_sql("SELECT id, there AS a, part AS b FROM numbered WHERE there <> '' AND part <> ''"),
    ])
    return _with("diag", extra=steps, recursive=True) + _ALIGNMENT_COLUMNS


def _extended_sql(threshold: int = 15, above: float | None = 0.7) -> str:
    """Windows with three more characters on both sides; the best cuts among 0..3 of each end.

    First the cuts of one end each, with the other uncut, then the two best together.
    """
    both = _aligned_sql("""SELECT 16 * n + 4 * h + t AS id, substr("window", h + 1, length("window") - h - t) AS a, query AS b
                           FROM cuts""")
    for name in ("pairs", "matrix", "cells", "ways", "path", "aligned"):
        both = re.sub(rf"\b{name}\b", f"{name}2", both)
    steps = ", ".join([
        _placed_sql(threshold, 6),
        """numbered AS MATERIALIZED (
            SELECT *, row_number() OVER (ORDER BY query_id, ref_id, end_pos) AS n FROM win)""",
        _aligned_sql("""SELECT 16 * n + 4 * h + t AS id, substr("window", h + 1, length("window") - h - t) AS a, query AS b
                        FROM numbered, range(0, 4) hs(h), range(0, 4) ts(t) WHERE h = 0 OR t = 0"""),
        """scored AS MATERIALIZED (SELECT id // 16 AS n, id % 16 // 4 AS h, id % 4 AS t, score FROM aligned),
        heads AS (SELECT n, arg_min(h, (-score, h)) AS h FROM scored WHERE t = 0 GROUP BY n),
        tails AS (SELECT n, arg_min(t, (-score, t)) AS t FROM scored WHERE h = 0 GROUP BY n),
        cuts AS MATERIALIZED (SELECT * FROM numbered JOIN heads USING (n) JOIN tails USING (n))""",
        both,
    ])
    return _with("diag", extra=steps, recursive=True) + """
        SELECT query_id, ref_id, end_pos, hits, ref_start + h AS ref_start,
               least(ref_start + length("window") - 1 - t, ref_end) AS ref_end,
               round(score, 6) AS score, aligned_ref2 AS aligned_ref, aligned_query2 AS aligned_query
        FROM cuts JOIN (SELECT id, score, aligned_ref AS aligned_ref2, aligned_query AS aligned_query2 FROM aligned2) r
          ON r.id = 16 * n + 4 * h + t""" + ("" if above is None else f" WHERE score > {above}")


def oracle_sql() -> dict[str, str]:
    """SQL for DuckDB with the same results as :func:`queries`, where SQL can express them."""
    found = _search_sql()
    if llm:
        found |= llm.SQL
        if corpus_pipeline.ORACLE_SQL:
            found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found


def _search_sql() -> dict[str, str]:
    seed_columns = "SELECT query_id, ref_id, end_pos FROM seeds"
    candidate_columns = "SELECT query_id, ref_id, end_pos, hits FROM cand"
    numbered_lines = """
        SELECT row_number() OVER (ORDER BY ref_id, line_no) AS query_id, line AS sequence,
               length(line)::INTEGER AS length
        FROM lines"""
    next_line = "lead(line) OVER (PARTITION BY ref_id ORDER BY line_no)"
    block_columns = 'SELECT ref_id, blockid, "offset", size, value FROM blocks'
    window_columns = """SELECT query_id, ref_id, end_pos, hits, ref_start, ref_end, overhang, "window" FROM win"""
    good = _alignments_sql() + _ALIGNMENT_COLUMNS + " WHERE score > 0.7"
    summary = """
        SELECT (SELECT count(*) FROM q) AS queries, (SELECT count(*) FROM qk) AS query_keys,
               sum(hits)::BIGINT AS seed_hits, count(*) AS diagonals,
               count(*) FILTER (hits > 15) AS candidates FROM diag"""
    in_lines = """lk AS MATERIALIZED (
        SELECT ref_id, "offset" + o AS "offset", substr(line, o + 1, 11) AS seq
        FROM (SELECT *, unnest(range(0, length(line) - 10)) AS o FROM located)
        WHERE substr(line, o + 1, 11) <> repeat('N', 11))"""
    index_digest = _with("lists") + f"""
        SELECT ref_id, block, count(*) AS lists, sum(n)::BIGINT AS offsets,
               max(n)::INTEGER AS longest, {_sum_md5("seq || ':' || value")} AS checksum
        FROM lists GROUP BY ref_id, block"""
    totals = _with("rk") + f"""
            SELECT n, count(*) AS keys, {_sum_md5("seq")} AS checksum
            FROM (SELECT seq, count(*) AS n FROM rk GROUP BY seq) GROUP BY n"""
    looked_up = _with("rk", "qk") + """
        SELECT seq, "offset" // 1000 AS block, ref_id, "offset" FROM rk
        WHERE seq IN (SELECT seq FROM qk)"""
    listed = _with("rk", "qk") + """
        SELECT query_id, ref_id, "offset" // 1000 AS block, seq, despl,
               '[' || string_agg("offset" + despl, ',' ORDER BY "offset") || ']' AS end_positions
        FROM rk JOIN qk USING (seq) GROUP BY ALL"""
    page_refs = f"SELECT page_id AS ref_id, {_SEQ.replace('text', 'html')} AS sequence FROM pages"
    twenty_one = {"11": "21", "10": "20"}

    def wider(sql: str) -> str:
        for a, b in twenty_one.items():
            sql = sql.replace(f" {a})", f" {b})")
        return sql

    return {
        "normalized_sequences": _with("refs")
        + "SELECT ref_id, sequence, length(sequence)::INTEGER AS size FROM refs",
        "line_offsets": _with("located") + 'SELECT ref_id, line_no, "offset", size FROM located',
        "two_line_join": _with("lines") + f"""
            SELECT ref_id, line_no, length(line)::INTEGER AS size,
                   line || coalesce({next_line}, '') AS lines FROM lines""",
        "overlap_prefix_join": _with("lines") + f"""
            SELECT ref_id, line_no, length(line)::INTEGER AS size,
                   line || coalesce(substr({next_line}, 1, 10), '') AS lines FROM lines""",
        "in_line_kmers": _digest_sql(_with("located", extra=in_lines), "lk"),
        "reference_kmers": _digest_sql(_with("rk"), "rk"),
        "reference_kmers_by_block": _digest_sql(_with("rk"), "rk"),
        "kmer_index": index_digest,
        "kmer_index_of_entries": index_digest,
        "kmer_index_of_content": index_digest,
        "kmer_index_merged": _with("rk", extra="""wide AS (
                SELECT seq, ref_id, "offset" // 8000 AS block, count(*) AS n,
                       '[' || string_agg("offset", ',' ORDER BY "offset") || ']' AS value
                FROM rk GROUP BY ALL)""") + f"""
            SELECT ref_id, block, count(*) AS lists, max(n)::INTEGER AS longest,
                   {_sum_md5("seq || ':' || value")} AS checksum
            FROM wide GROUP BY ref_id, block""",
        "kmer_totals": totals,
        "kmer_totals_by_runs": totals,
        "frequent_kmers": _with("rk") + """
            SELECT seq, ceil(n * 10000 / (SELECT count(*) FROM rk))::INTEGER AS splits
            FROM (SELECT seq, count(*) AS n FROM rk GROUP BY seq)
            WHERE n * 10000 > (SELECT count(*) FROM rk)""",
        "index_export": _with("lists") + f"""
            SELECT ref_id, count(*) AS "rows",
                   {_sum_md5("concat_ws(chr(9), seq, ref_id, block, value)")} AS checksum
            FROM lists GROUP BY ref_id""",
        "query_kmers": _with("qk") + "SELECT query_id, seq, despl FROM qk",
        "distinct_query_kmers": _with("qk") + "SELECT DISTINCT seq FROM qk",
        "key_lookup": looked_up,
        "key_lookup_shuffled": looked_up,
        "seed_hits": _with("seeds") + seed_columns,
        "seed_hits_by_runs": _with("seeds") + seed_columns,
        "seed_hits_shuffled": _with("seeds") + seed_columns,
        "seed_lists": listed,
        "seed_lists_shuffled": listed,
        "diagonal_counts": _with("diag") + "SELECT query_id, ref_id, end_pos, hits FROM diag",
        "counted_end_positions": _with("diag") + """
            SELECT query_id, ref_id, end_pos // 1000 AS block,
                   '[' || string_agg(end_pos || ':' || hits, ',' ORDER BY end_pos) || ']' AS counts
            FROM diag GROUP BY ALL""",
        "frequent_end_positions": _with("cand") + """
            SELECT query_id, ref_id, end_pos // 1000 AS block,
                   '[' || string_agg(end_pos, ',' ORDER BY end_pos) || ']' AS ends
            FROM cand GROUP BY ALL""",
        "candidates_fixed": _with("cand") + candidate_columns,
        "candidates_adaptive": _with("diag") + """
            SELECT query_id, ref_id, end_pos, hits FROM diag
            WHERE hits > (SELECT floor(0.25 * avg(length)) FROM q)""",
        "adaptive_threshold": _with("q") + """
            SELECT count(*) AS queries, round(avg(length), 6) AS mean_length,
                   floor(0.25 * avg(length))::BIGINT AS threshold FROM q""",
        "candidate_lists": _with("cand") + """
            SELECT query_id, ref_id, end_pos // 100000 AS block,
                   '[' || string_agg(end_pos, ',' ORDER BY end_pos) || ']' AS offsets
            FROM cand GROUP BY ALL""",
        "candidate_chunks": _with("diag") + """
            SELECT query_id, ref_id, block, chunk::INTEGER AS chunk,
                   '[' || string_agg(end_pos, ',' ORDER BY end_pos) || ']' AS offsets
            FROM (SELECT query_id, ref_id, end_pos // 100000 AS block, end_pos, (row_number() OVER (
                      PARTITION BY query_id, ref_id, end_pos // 100000 ORDER BY end_pos) - 1) // 5 AS chunk
                  FROM diag)
            GROUP BY ALL""",
        "listed_candidates": _with("cand") + "SELECT count(*) AS candidates FROM cand",
        "candidates_with_query": _with("cand") + """
            SELECT query_id, ref_id, end_pos, hits, sequence AS query FROM cand JOIN q USING (query_id)""",
        "unmatched_queries": _with("cand") + """
            SELECT query_id, sequence, length FROM q
            WHERE query_id NOT IN (SELECT query_id FROM cand)""",
        "top_diagonals": _with("diag") + """
            SELECT query_id, ref_id, end_pos, hits FROM diag
            ORDER BY hits DESC, query_id, ref_id, end_pos LIMIT 10""",
        "top_diagonals_per_query": _with("diag") + """
            SELECT query_id, ref_id, end_pos, hits, rank::INTEGER AS rank
            FROM (SELECT *, row_number() OVER (
                PARTITION BY query_id ORDER BY hits DESC, ref_id, end_pos) AS rank FROM diag)
            WHERE rank <= 3""",
        "content_blocks": _with("blocks") + block_columns,
        "content_blocks_from_lines": _with("blocks") + block_columns,
        "content_blocks_by_line": _with("located") + """
            SELECT ref_id, "offset" // 1000 AS blockid, min("offset") AS "offset",
                   sum(length(line))::INTEGER AS size, string_agg(line, '' ORDER BY line_no) AS value
            FROM located GROUP BY ref_id, located."offset" // 1000""",
        "fetch_windows": _with("diag", extra=_placed_sql(0)) + window_columns,
        "fetch_windows_shuffled": _with("diag", extra=_placed_sql(0)) + window_columns,
        "fetch_windows_extended": _with("diag", extra=_placed_sql(0, 6)) + window_columns,
        "ungapped_identity": _with("diag", extra=_placed_sql(0)) + """
            SELECT query_id, ref_id, end_pos, hits, ref_start, ref_end, overhang,
                   round(length([i FOR i IN range(1, length("window") + 1)
                       IF substr("window", i, 1) = substr(query, i + lead, 1)]) / length("window"), 6) AS identity
            FROM win""",
        "alignments": good,
        "alignments_shuffled": good,
        "alignments_extended_all_scores": _extended_sql(2, None),
        "alignments_clipped": _clipped_sql(2),
        "alignments_all_scores": _alignments_sql(2) + _ALIGNMENT_COLUMNS,
        "alignments_extended": _extended_sql(),
        "best_hit": _alignments_sql() + """
            SELECT query_id, ref_id, end_pos, hits, round(score, 6) AS score FROM (
                SELECT *, row_number() OVER (
                    PARTITION BY query_id ORDER BY score DESC, hits DESC, ref_id, end_pos) AS place
                FROM numbered JOIN aligned USING (id) WHERE score > 0.7)
            WHERE place = 1""",
        "alignment_blocks": _alignments_sql() + """
            SELECT query_id, ref_id, end_pos, block_no::INTEGER AS block_no, sequence1, sequence2,
                   list_aggregate([CASE WHEN substr(sequence1, i, 1) = substr(sequence2, i, 1) THEN '|' ELSE ' ' END
                       FOR i IN range(1, length(sequence1) + 1)], 'string_agg', '') AS marks
            FROM (SELECT query_id, ref_id, end_pos, n AS block_no,
                         substr(aligned_ref, n * 40 + 1, 40) AS sequence1,
                         substr(aligned_query, n * 40 + 1, 40) AS sequence2
                  FROM (SELECT *, unnest(range(0, (length(aligned_ref) + 39) // 40)) AS n
                        FROM numbered JOIN aligned USING (id) WHERE score > 0.7))""",
        "stored_reference_search": good,
        "stored_reference_appended": good,
        "stored_reference_compacted": good,
        "named_alignments": _alignments_sql() + """
            SELECT query_id, ref_id, concat_ws('/', source, lang, doc_id) AS ref_name, end_pos, round(score, 6) AS score
            FROM numbered JOIN aligned USING (id) JOIN documents ON doc_id = ref_id WHERE score > 0.7""",
        "stored_reference_other_index": wider(_with("cand") + candidate_columns).replace(
            "repeat('N', 20)", "repeat('N', 21)"),
        "stored_reference_many_keys": _with("cand") + candidate_columns,
        "saved_alignments": good,
        "lines_to_queries": _with("lines") + numbered_lines,
        "file_lines_to_queries": _with("lines") + """
            SELECT line AS sequence, length(line)::INTEGER AS length, count(*) AS n FROM lines GROUP BY ALL""",
        "query_file": _with("lines") + numbered_lines,
        "file_lines": _with("located") + """
            SELECT ref_id AS doc_id, line_no, "offset", line FROM located""",
        "file_lines_by_content": _with("located") + """
            SELECT ref_id AS doc_id, line_no, "offset", line FROM located""",
        "file_records": _with("refs") + """
            SELECT ref_id AS doc_id, sequence, length(sequence)::INTEGER AS length FROM refs
            WHERE sequence <> ''""",
        "search_summary": _with("diag") + summary,
        "run_statistics": _with("diag") + f"""
            SELECT 'search' AS procedure, 11::BIGINT AS key_size, s.* FROM ({summary}) s, range(2)""",
        "balance_by_key": _with("rk") + """
            SELECT count(*) AS parts, sum(n)::BIGINT AS total, round(avg(n), 3) AS mean_n, max(n) AS max_n,
                   round((max(n) - avg(n)) / avg(n) * 100.0, 3) AS unbalance_pct
            FROM (SELECT ref_id, count(*) AS n FROM rk GROUP BY ref_id)""",
        "partition_balance": _with("rk") + """
            SELECT count(*) AS parts, sum(n)::BIGINT AS total, round(avg(n), 3) AS mean_n, max(n) AS max_n,
                   round((max(n) - avg(n)) / avg(n) * 100.0, 3) AS unbalance_pct
            FROM (SELECT ref_id % 16, count(*) AS n FROM rk GROUP BY 1)""",
        "page_candidates": _with("diag").replace(_PARTS["refs"], page_refs) + """
            SELECT query_id, ref_id, end_pos, hits FROM diag WHERE hits > 3""",
        "conversation_offsets": f"""
            SELECT conv_id AS ref_id, turn AS line_no, (sum(length({_SEQ})) OVER (
                       PARTITION BY conv_id ORDER BY turn) - length({_SEQ}))::BIGINT AS "offset",
                   length({_SEQ})::INTEGER AS size FROM conversations""",
    }
