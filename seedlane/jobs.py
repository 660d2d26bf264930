"""Jobs for spark-submit: ``build`` a stored reference from files, ``query`` it from files."""

from __future__ import annotations

import argparse
import time
import uuid

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from seedlane.operators.align import EXTENSION, MIN_SCORE, align_candidates
from seedlane.operators.content import BLOCK
from seedlane.operators.index import GROUP
from seedlane.operators.kmers import query_keys
from seedlane.operators.metrics import run_stats
from seedlane.operators.seeds import THRESHOLD
from seedlane.plans.layout import RECOMMENDED, scratch, settled, text_size
from seedlane.plans.reference import KEY_SIZE, append_reference, build_reference, compact_reference, open_reference
from seedlane.plans.search import SearchOptions, extend, find_candidates_indexed, place
from seedlane.sources.files import read_query_tsv, read_sequences, records
from seedlane.sources.tables import PARTS, append_run_stats, write_alignments


def build(spark: SparkSession, args: argparse.Namespace) -> None:
    """Content, index and names of sequence files."""
    start = time.time()
    with scratch(spark):
        sequences, names = read_sequences(spark, args.files, by_content=True)
        read = time.time()
        if args.append:
            append_reference(sequences, args.folder, args.name, renumber=True, names=names)
        else:
            build_reference(
                sequences, args.folder, args.name, args.key_size, args.block_size, args.group_size, args.parts,
                args.index_only, not args.single_lines, names,
            )
    done = time.time()
    if args.stats:
        index = open_reference(spark, args.folder, args.name, args.name).index if not args.index_only else None
        append_run_stats(run_stats(
            spark, procedure="append" if args.append else "build", reference_file=",".join(args.files),
            reference=args.name, key_size=args.key_size, block_size=args.block_size, group_size=args.group_size,
            lists=None if index is None else index.count(),
            partitions=None if index is None else index.rdd.getNumPartitions(),
            total_sec=round(done - start, 3), read_sec=round(read - start, 3), write_sec=round(done - read, 3),
        ), args.stats)


def query(spark: SparkSession, args: argparse.Namespace) -> str:
    """Alignments of the queries in files; returns the path written."""
    start = time.time()
    with scratch(spark):
        query_names = None
        if args.multi:
            queries = settled(read_query_tsv(spark, args.files, by_content=True))
        else:
            lines, query_names = read_sequences(spark, args.files, by_content=True)
            queries = settled(records(lines))
            query_names = query_names.select(F.col("ref_id").alias("query_id"), F.col("name").alias("query_name"))
        reference = open_reference(spark, args.folder, args.name, args.index_name)
        threshold = args.threshold if args.threshold == "adaptive" else int(args.threshold)
        options = SearchOptions(
            reference.k, threshold, EXTENSION if args.extend else 0, not args.clip, args.min_score, args.tasks
        )
        size = text_size(queries)
        read = time.time()
        placed = place(find_candidates_indexed(queries, reference, options, size), queries, size, options)
        matched = time.time()
        windows = extend(
            placed, queries, size, reference.content, reference.block_size, options,
            reference.content_parts,
        )
        found = align_candidates(windows, options.extension, options.pad, options.min_score)
        found = reference.with_names(found)
        if query_names is not None:
            found = found.join(query_names, "query_id", "left")
        # Counted as they are written, whatever the format.
        seen = Observation("alignments")
        path = write_alignments(
            found.observe(seen, F.count(F.lit(1)).alias("n")),
            args.output, args.query_name, args.name, uuid.uuid4().hex, args.format,
        )
        done = time.time()
        if args.stats:
            cores = spark.sparkContext.defaultParallelism
            append_run_stats(run_stats(
                spark, procedure="query", query_file=",".join(args.files), reference=args.name,
                key_size=reference.k, queries=size.rows,
                query_keys=query_keys(queries, reference.k).count(), candidates=placed.count(),
                alignments=seen.get["n"], partitions=reference.index.rdd.getNumPartitions(), total_cores=cores,
                total_sec=round(done - start, 3), read_sec=round(read - start, 3),
                match_sec=round(matched - read, 3), extend_sec=round(done - matched, 3),
                query_sec=round((done - start) / max(size.rows, 1), 6),
                query_core_sec=round((done - start) * cores / max(size.rows, 1), 6),
            ), args.stats)
    return path


def compact(spark: SparkSession, args: argparse.Namespace) -> None:
    """Merge what was added to a reference into one."""
    compact_reference(spark, args.folder, args.name)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="seedlane")
    jobs = top.add_subparsers(dest="job", required=True)

    one = jobs.add_parser("build", help=build.__doc__)
    one.set_defaults(run=build)
    one.add_argument("--key-size", type=int, default=KEY_SIZE)
    one.add_argument("--block-size", type=int, default=BLOCK)
    one.add_argument("--group-size", type=int, default=GROUP)
    one.add_argument("--parts", type=int, default=PARTS)
    one.add_argument("--index-only", action="store_true")
    one.add_argument("--single-lines", action="store_true", help="no k-mers across line ends")

    one.add_argument("--append", action="store_true", help="add to the reference, with its settings")

    two = jobs.add_parser("query", help=query.__doc__)
    two.set_defaults(run=query)
    two.add_argument("--multi", action="store_true", help="the files are tab-separated query sets")
    two.add_argument("--index-name", help="use the index stored under another name")
    two.add_argument("--threshold", default=str(THRESHOLD), help="hits to exceed, or 'adaptive'")
    two.add_argument("--extend", action="store_true", help="search for the best window ends")
    two.add_argument("--tasks", type=int, help="tasks that align")
    two.add_argument("--output", required=True)
    two.add_argument("--query-name", default="queries")
    two.add_argument("--format", default="parquet")

    two.add_argument("--clip", action="store_true", help="align only what lies within the reference")
    two.add_argument("--min-score", type=float, default=MIN_SCORE, help="score to exceed")

    three = jobs.add_parser("compact", help=compact.__doc__)
    three.set_defaults(run=compact)

    for job in (one, two, three):
        job.add_argument("--folder", required=True, help="where references are stored")
        job.add_argument("--name", required=True, help="name of the reference")
    for job in (one, two):
        job.add_argument("--stats", help="append a row of statistics here")
        job.add_argument("files", nargs="+")
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    builder = SparkSession.builder.appName(f"seedlane-{args.job}").config(map=RECOMMENDED)
    args.run(builder.getOrCreate(), args)


if __name__ == "__main__":
    main()
