"""Sequences from and to text files."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seedlane.functions.arrays import ordered_text
from seedlane.functions.text import HEADER_MARK, normalize
from seedlane.operators.index import index_rows_text, list_texts
from seedlane.plans.layout import rows_fit, settled

# Characters of the longest record that may be a query.
MOST_CHARS = 100_000_000

# How closely exported lines are compressed, of what zlib offers: the closest takes far longer than making them.
ZLIB_LEVEL = "FOUR"
# Texts of many lines, each of a slice of k-mers, in one exported file: some 40 MB of them.
FILE_TEXTS = 16

EARLIER = (Window.unboundedPreceding, -1)

# First bytes of compressed data, names by which Spark knows it itself, and the bytes and lines read at once.
COMPRESSED = b"\x1f\x8b"
KNOWN = r"\.(gz|bz2|deflate|lz4|snappy|zst)$"
CHUNK, LINES = 1 << 20, 4096
LINE_END = re.compile(rb"\r\n|\r|\n")
SPLIT = ["_file", "_split"]
COUNTED = (
    "_file string, _split long, line string, _header boolean, _headers long, _lines long, _chars long, "
    "_opened boolean"
)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running counts of the lines of an input split, which come in order.

    ``_headers`` counts headers up to a line; ``_lines`` and ``_chars`` those before the line since the
    latest header, or since the beginning of the split while ``_opened`` is false.
    """
    current, headers, lines, chars, opened = None, 0, 0, 0, False
    for batch in batches:
        files, splits, header, size = (c.to_numpy(zero_copy_only=False) for c in (
            batch.column(0), batch.column(1), batch.column(3), batch.column(4)))
        out = np.zeros((4, batch.num_rows), np.int64)
        ends = np.flatnonzero((files[1:] != files[:-1]) | (splits[1:] != splits[:-1])) + 1
        for a, b in zip([0, *ends], [*ends, batch.num_rows]):
            if a == b:
                continue
            if (files[a], splits[a]) != current:
                current, headers, lines, chars, opened = (files[a], splits[a]), 0, 0, 0, False
            head, own = header[a:b].astype(np.int64), np.where(header[a:b], 0, size[a:b])
            seen = np.cumsum(head)
            before_lines, before_chars = np.cumsum(1 - head) - (1 - head), np.cumsum(own) - own
            # What came before the latest header of this batch; nothing while there is none.
            at = np.maximum.accumulate(np.where(head > 0, np.arange(b - a), -1))
            carried = at < 0
            out[0, a:b] = headers + seen
            out[1, a:b] = before_lines + np.where(carried, lines, -before_lines[at])
            out[2, a:b] = before_chars + np.where(carried, chars, -before_chars[at])
            out[3, a:b] = opened | ~carried
            headers, opened = headers + int(seen[-1]), bool(out[3, b - 1])
            lines = int(out[1, b - 1]) + int(1 - head[-1])
            chars = int(out[2, b - 1]) + int(own[-1])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:4], pa.array(out[0]), pa.array(out[1]), pa.array(out[2]), pa.array(out[3].astype(bool))],
            [c.split(" ")[0] for c in COUNTED.split(", ")])


def _opened(uri: str) -> pa.NativeFile:
    system, place = fs.FileSystem.from_uri(uri)
    return system.open_input_stream(place, compression=None)


def _are_compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The files that begin like compressed data; two bytes of each are read."""
    for batch in batches:
        found = []
        for uri in batch.column(0).to_pylist():
            with _opened(uri) as file:
                if file.read(len(COMPRESSED)) == COMPRESSED:
                    found.append(uri)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["_file"])


def _unpacked(file: pa.NativeFile, uri: str) -> Iterator[bytes]:
    """Chunks of the text of a gzip file, which may consist of several members."""
    machine, begun = zlib.decompressobj(31), False
    while data := file.read(CHUNK):
        while data:
            begun = True
            if text := machine.decompress(data, CHUNK):
                yield text
            data = machine.unconsumed_tail
            if machine.eof:
                # Zeros after a member are padding.
                data = machine.unused_data.lstrip(b"\0")
                machine, begun = zlib.decompressobj(31), False
    if begun:
        raise ValueError(f"compressed data ends early: {uri}")


def _lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of compressed files in order; in memory are a few thousand at a time."""
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            with _opened(uri) as file:
                rest, lines = b"", []

                def ready() -> pa.RecordBatch:
                    text = [line.decode("utf-8", "replace") for line in lines]
                    return pa.RecordBatch.from_arrays(
                        [pa.array([uri] * len(text), pa.string()), pa.array([0] * len(text), pa.int64()),
                         pa.array(text, pa.string())], [*SPLIT, "value"])

                pieces = [b""]
                for chunk in _unpacked(file, uri):
                    # A line may span many chunks, and a chunk may end between the two bytes of a line end.
                    if not LINE_END.search(chunk) and not pieces[-1].endswith(b"\r"):
                        pieces.append(chunk)
                        continue
                    text = b"".join([*pieces, chunk])
                    held = text.endswith(b"\r")
                    *more, rest = LINE_END.split(text[:-1] if held else text)
                    pieces = [rest + b"\r" if held else rest]
                    lines += more
                    if len(lines) >= LINES:
                        yield ready()
                        lines = []
                *more, rest = LINE_END.split(b"".join(pieces))
                lines += [*more, rest] if rest else more
                if lines:
                    yield ready()


def _unnamed(spark: SparkSession, path: str | list[str]) -> list[str]:
    """Files that are compressed though their names do not say so. As every file is opened, tasks do that."""
    names = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("_file"))
    rest = names.filter(~F.col("_file").rlike(KNOWN))
    tasks = 4 * spark.sparkContext.defaultParallelism
    return [r["_file"] for r in rest.repartition(tasks, "_file").mapInArrow(_are_compressed, "_file string").collect()]


def _raw_lines(spark: SparkSession, path: str | list[str], by_content: bool) -> DataFrame:
    """``(_file, _split, value)``: lines of text files, those of an input split in order.

    Compressed data is known by its name, or with ``by_content`` by its first bytes as well; it is one
    split then, as such a file can only be read from its beginning. Otherwise it ends the job.
    """
    unnamed = _unnamed(spark, path) if by_content else []
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.when(
            F.substring(F.col("value").cast("binary"), 1, 2) == F.lit(COMPRESSED),
            F.raise_error(F.concat(F.lit("compressed data without a .gz name: "), F.col("_metadata.file_path"))),
        ).otherwise(F.col("value")).alias("value"),
    )
    if not unnamed:
        return raw
    # Spark leaves these files out before it reads any.
    plain = raw.filter(~F.col("_file").isin(unnamed))
    found = spark.createDataFrame(list(zip(unnamed, range(len(unnamed)))), "_file string, _task int").repartitionById(
        len(unnamed), "_task").select("_file")
    return plain.unionByName(found.mapInArrow(_lines_of, "_file string, _split bigint, value string"))


def _numbered(spark: SparkSession, path: str | list[str], by_content: bool = False) -> DataFrame:
    """Lines of FASTA or plain text files with their record, number and position.

    A file may be one record of any size. Each input split is read once, its lines counted as they
    come and kept; what a split needs of those before it is one row per split, and of a file one
    row per file. Text is not shuffled.
    """
    raw = _raw_lines(spark, path, by_content)
    header = F.col("value").startswith(HEADER_MARK)
    lines = raw.select(
        *SPLIT,
        F.when(header, F.trim(F.substring(F.col("value"), 2, 1 << 30)))
        .otherwise(normalize(F.col("value"))).alias("line"),
        header.alias("_header"),
    ).filter(F.col("_header") | (F.col("line") != ""))
    local = settled(lines.withColumn("_size", F.length("line").cast("long")).mapInArrow(_counted, COUNTED))

    size = F.when(F.col("_header"), 0).otherwise(F.length("line"))
    last = F.max_by(
        F.struct(
            F.col("_opened").alias("opened"), F.col("_headers").alias("h"),
            (F.col("_lines") + (~F.col("_header")).cast("long")).alias("l"), (F.col("_chars") + size).alias("c"),
        ),
        F.struct("_headers", "_lines", ~F.col("_header")),
    )
    splits = local.groupBy(*SPLIT).agg(last.alias("end")).select(*SPLIT, "end.*")
    earlier = Window.partitionBy("_file").orderBy("_split").rowsBetween(*EARLIER)
    upto = Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0)
    # Splits since the latest one with a header; that one's rest counts, and the whole of those after it.
    carried = splits.withColumn("run", F.sum(F.col("opened").cast("int")).over(upto)).withColumns({
        "l": F.sum("l").over(Window.partitionBy("_file", "run").orderBy("_split")),
        "c": F.sum("c").over(Window.partitionBy("_file", "run").orderBy("_split")),
    })
    before = Window.partitionBy("_file").orderBy("_split")
    carried = carried.select(
        *SPLIT, F.coalesce(F.sum("h").over(earlier), zero).alias("_h0"),
        F.coalesce(F.lag("l").over(before), zero).alias("_l0"), F.coalesce(F.lag("c").over(before), zero).alias("_c0"),
    )
    files = splits.groupBy("_file").agg((F.sum("h") + 1).alias("n"))
    file_base = files.select(
        "_file",
        F.coalesce(F.sum("n").over(Window.orderBy("_file").rowsBetween(*EARLIER)), zero).alias("_base"),
    )
    # One row for each input split, of the size of a path. Too many for a broadcast are joined by split, which is
    # never large.
    bases = settled(carried.join(file_base, "_file"))
    held = bases.agg(F.count("*").alias("n"), F.coalesce(F.max(F.length("_file")), F.lit(0)).alias("width")).first()
    inherited = ~F.col("_opened")
    return local.join(F.broadcast(bases) if rows_fit(held["n"], held["width"] + 40) else bases, SPLIT).select(
        (F.col("_base") + F.col("_h0") + F.col("_headers")).alias("ref_id"),
        (F.col("_lines") + F.when(inherited, F.col("_l0")).otherwise(zero)).alias("line_no"),
        (F.col("_chars") + F.when(inherited, F.col("_c0")).otherwise(zero)).alias("offset"),
        "line", "_header",
    )


def read_sequences(
    spark: SparkSession, path: str | list[str], by_content: bool = False
) -> tuple[DataFrame, DataFrame]:
    """:func:`read_sequence_lines` and :func:`read_sequence_names` of the same files, read once."""
    numbered = _numbered(spark, path, by_content)
    return numbered.filter(~F.col("_header")).drop("_header"), numbered.filter("_header").select(
        "ref_id", F.col("line").alias("name"))


def read_sequence_lines(spark: SparkSession, path: str | list[str], by_content: bool = False) -> DataFrame:
    """``(ref_id, line_no, offset, line)`` of FASTA or plain text files, plain or compressed.

    Every header begins a new record; text before the first header of a file is a record too.
    Lines are normalised, blank ones do not count, and ``offset`` ignores line ends and headers.
    ``by_content`` also reads gzip files of any name: the first bytes of every file are looked at for that, through
    Arrow's file systems. Without it such a file ends the job with an error.
    """
    return read_sequences(spark, path, by_content)[0]


def read_sequence_names(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(ref_id, name)`` from the headers of the same files."""
    return read_sequences(spark, path)[1]


def read_query_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(query_id, sequence, length)``: the records of FASTA or text files as queries."""
    return records(read_sequence_lines(spark, path))


def records(lines: DataFrame, most: int = MOST_CHARS) -> DataFrame:
    """Lines put together to ``(query_id, sequence, length)``.

    A record has to fit a row and a task, so one of more than ``most`` characters ends the job with an
    error that names it: such texts are references, which are kept by line or block.
    """
    sizes = lines.groupBy("ref_id").agg(F.sum(F.length("line")).alias("_size"))
    large = F.raise_error(F.concat(F.lit("too long for a query: record "), F.col("ref_id").cast("string")))
    sizes = sizes.filter(F.when(F.col("_size") <= most, F.lit(True)).otherwise(large.cast("boolean")))
    piece = F.struct(F.col("line_no").alias("position"), F.col("line").alias("text"))
    return (
        lines.join(sizes.select("ref_id"), "ref_id", "left_semi")
        .groupBy(F.col("ref_id").alias("query_id"))
        .agg(ordered_text(F.collect_list(piece)).alias("sequence"))
        .withColumn("length", F.length("sequence"))
    )


def read_query_tsv(spark: SparkSession, path: str | list[str], by_content: bool = False) -> DataFrame:
    """``(query_id, sequence, length)`` from lines ``sequence TAB id TAB length``.

    Id and length are taken from the right, as a sequence may hold tabs. The length tells whether
    blanks before the last but one tab belong to the sequence, or only surround the tab. A line that
    is not of this form, or whose length is neither, ends the job with an error that names it. Read
    as plain text, since quotes are ordinary characters of a sequence. ``by_content`` as in
    :func:`read_sequence_lines`.
    """
    fields = r"(?s)^(.*)\t *(-?\d+) *\t *(\d+)\s*$"
    raw = _raw_lines(spark, path, by_content).filter(F.trim("value") != "")
    whole, stated = F.regexp_extract("value", fields, 1), F.regexp_extract("value", fields, 3).try_cast("long")

    def fits(text: Column) -> Column:
        return (F.length(text) == stated) | (F.octet_length(text) == stated) | (F.length(normalize(text)) == stated)

    bad = F.raise_error(F.concat(F.lit("not sequence TAB id TAB length: "), F.col("value"))).cast("string")
    sequence = F.when(fits(whole), whole).when(fits(F.trim(whole)), F.trim(whole)).otherwise(bad)
    return raw.select(
        F.regexp_extract("value", fields, 2).try_cast("long").alias("query_id"), normalize(sequence).alias("sequence"),
    ).withColumn("length", F.length("sequence"))


def write_query_tsv(queries: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write queries as :func:`read_query_tsv` reads them."""
    queries.select(F.concat_ws("\t", "sequence", "query_id", "length").alias("value")).write.mode(
        "overwrite"
    ).text(path, compression=compression)


def write_fasta(records: DataFrame, path: str, width: int = 80) -> None:
    """Write ``(name, sequence)`` rows as FASTA text with lines of ``width`` characters.

    A record is one multi-line value, so its lines stay together in one file.
    """
    rest = F.regexp_replace("sequence", f"(.{{{width}}})(?=.)", "$1\n")
    records.select(
        F.concat(F.lit(HEADER_MARK), F.col("name").cast("string"), F.lit("\n"), rest).alias("value")
    ).write.mode("overwrite").text(path)


def tsv_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of :func:`export_index_tsv` inside the tasks that grouped the lists, those of a batch in one text."""
    for lists in batches:
        if len(lists):
            lines = pc.binary_join_element_wise(
                lists.column("seq"), lists.column("ref_id").cast(pa.string()), lists.column("block").cast(pa.string()),
                list_texts(lists), "\t", null_handling="skip")
            together = pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines)
            yield pa.RecordBatch.from_arrays([pc.binary_join(together, "\n")], ["value"])


def lines_of_text(text: pa.StringScalar, begin: int, together: int = 1 << 17) -> Iterator[tuple[pa.Array, pa.Array]]:
    """The lines of a text that ends with a line end, so many at a time, and the field of each at ``begin``, up to the next tab."""
    data = text.as_buffer()
    letters = np.frombuffer(data, np.uint8)
    ends, tabs = np.flatnonzero(letters == ord("\n")), np.flatnonzero(letters == ord("\t"))
    begins = np.concatenate([[0], ends[:-1] + 1])

    def pieces(first: np.ndarray, last: np.ndarray) -> pa.Array:
        # Every other one lies between two that are wanted.
        edges = pa.py_buffer(np.stack([first, last], 1).reshape(-1).astype(np.int32))
        return pa.StringArray.from_buffers(2 * len(first) - 1, edges, data).take(pa.array(np.arange(0, 2 * len(first), 2)))

    for first in range(0, len(ends), together):
        some = slice(first, first + together)
        field = begins[some] + begin
        yield pieces(begins[some], ends[some]), pieces(field, tabs[np.searchsorted(tabs, field)])


def export_index_tsv(index: DataFrame, path: str, compression: str = "gzip") -> None:
    """Index rows as ``seq TAB ref_id TAB block TAB [offsets]``, in as many files as tasks or more.

    ``index`` are lists, or what :func:`tsv_lines` made of them; then a file has about as many characters as its k-mers
    in ``FILE_TEXTS`` slices. Compressed unless ``compression`` is ``none``: the rows of
    neighbouring k-mers repeat nearly all of each other.
    """
    together = index.columns == ["value"]
    lines = index if together else index_rows_text(index).select(F.concat_ws("\t", "seq", "ref_id", "block", "value").alias("value"))
    written = lines.write.mode("overwrite").option("zlib.compress.level", ZLIB_LEVEL)
    (written.option("maxRecordsPerFile", FILE_TEXTS) if together else written).text(path, compression=compression)
