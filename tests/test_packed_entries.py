"""Entries, totals and exported lines that are made and moved in tasks, in few bytes."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from seedlane.functions.packed import closer, numbers, opened
from seedlane.operators import index, kmers
from seedlane.sources import files


def letters(seed, n, of="ABCDEFGH"):
    return "".join(random.Random(seed).choices(of, k=n))


def refs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "ref_id long, sequence string").coalesce(1)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def flat(seqs, refs, blocks, offsets):
    return pa.RecordBatch.from_arrays(
        [pa.array(seqs, pa.string()), pa.array(refs, pa.int64()), pa.array(blocks, pa.int64()), pa.array(offsets, pa.int64())],
        ["seq", "ref_id", "block", "offset"])


def lists_back(packed):
    parts = {}
    for row in (r for p in packed for r in p.to_pylist()):
        parts.setdefault((row["ref_id"], row["block"]), []).append({n: row[n] for n in index.PACKED_NAMES[2:]})
    kind = pa.struct(list(zip(index.PACKED_NAMES[2:], index.PACKED_TYPES[2:])))
    blocks = pa.RecordBatch.from_pylist(
        [{"ref_id": r, "block": b, "parts": p} for (r, b), p in parts.items()],
        pa.schema([("ref_id", pa.int64()), ("block", pa.int64()), ("parts", pa.list_(kind))]))
    return sorted((tuple(r.values()) for b in index.lists_of_packed(blocks) for r in b.to_pylist()), key=str)


def expected(entries):
    found = {}
    for s, r, b, o in entries:
        found.setdefault((s, r, b), []).append(o)
    return sorted(((*key, sorted(at)) for key, at in found.items()), key=str)


@pytest.mark.parametrize("values", [
    np.arange(5), np.zeros((3, 11), np.uint8), np.array([-1, 1 << 40]), np.zeros(0, np.int32), np.zeros((4, 0), np.uint8)])
def test_closer_and_back(values):
    width = values.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    data = pa.py_buffer(closer(values))
    assert (opened(data, len(values), width) == np.ascontiguousarray(values).view(np.uint8).reshape(len(values), width)).all()
    if values.ndim == 1:
        assert numbers(data, len(values), values.dtype).tolist() == values.tolist()


@pytest.mark.parametrize("case", ["text", "any order", "lengths", "no number"])
def test_packed_entries_and_back(case):
    text = letters(1, 900)
    entries = [(text[i:i + 11], 1 + i // 500, i % 500 // 100, i) for i in range(880)]
    if case == "any order":
        random.Random(2).shuffle(entries)
    if case == "lengths":
        entries = [(s[:i % 9 + (i > 8)], r, b, o) for i, (s, r, b, o) in enumerate(entries)]
    if case == "no number":
        entries = [(s, None if r == 1 else r, b, o) for s, r, b, o in entries] + [("A" * 11, 0, 0, 3)]
    batch = flat(*map(list, zip(*entries)))
    packed = [p for part in (batch.slice(0, 333), batch.slice(333), batch.slice(0, 0)) for p in index.packed_entries(part)]
    assert lists_back(packed) == expected(entries)
    # A row for each block of a batch, also of entries in no order.
    assert sum(len(p) for p in packed) <= 2 * 11


def test_entries_of_a_text_take_little_more_than_it():
    text = letters(3, 5010)
    batch = flat([text[i:i + 11] for i in range(5000)], [7] * 5000, [i // 1000 for i in range(5000)], list(range(5000)))
    packed, = index.packed_entries(batch)
    # As flat columns 11 + 8 bytes each.
    assert sum(len(packed.column(c)[i].as_py()) for c in ("seqs", "sizes", "steps") for i in range(5)) < 2 * 5000


def test_lists_made_in_tasks_are_the_same(spark):
    texts = [letters(5, 4500), "AB", "", "NNNNNNNANNNNNN", letters(6, 700, "AB"), None]
    refs = refs_of(spark, texts)
    refs = refs.union(refs.filter("ref_id = 1").withColumn("sequence", F.lit("ABCABCABC")))
    want = rows(index.build_index(index.postings(refs, 4, 100)))
    packed = index.postings(refs, 4, 100, packed=True)
    assert rows(index.build_index(packed)) == want
    # No k-mer becomes a row before it is packed.
    assert packed._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1
    wide = index.index_sequences(refs, 4, 100, 2, lambda lists: index.packed_lists(lists, 8), index.PACKED)
    assert rows(index.merge_lists(wide, 8)) == rows(index.merge_lists(index.build_index(index.postings(refs, 4, 100)), 8))
    digest = rows(entry._index_digest(index.build_index(packed, entry._digested, entry.DIGEST)))
    by = {}
    for s, r, b, v in want:
        by.setdefault((r, b), []).append(v)
    assert [d[:5] for d in digest] == sorted(
        ((r, b, len(v), sum(map(len, v)), max(map(len, v))) for (r, b), v in by.items()), key=str)
    check = index.index_rows_text(index.build_index(packed)).groupBy("ref_id", "block").agg(
        entry._checksum(F.concat_ws(":", "seq", "value")).alias("n"))
    assert sorted(d[5] for d in digest) == sorted(r.n for r in check.collect())


def test_kmers_are_counted_over_many_batches(spark):
    """Those of a task make one closely compressed piece a bucket, however few rows Arrow's batches have."""
    texts = [letters(i, 2000) for i in range(60)] + [None, "", "NNNNNNNNNNNNNNN", letters(3, 2000)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        moved = kmers.map_kmers(
            refs_of(spark, texts), 11, [], lambda found: index._counted(found, 5), "bucket int, size int, seqs binary, ns binary",
            together=index.COUNTED).collect()
        totals = rows(index.sequence_totals(refs_of(spark, texts), 11, 5))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = Counter(t[i:i + 11] for t in texts if t for i in range(len(t) - 10) if t[i:i + 11] != "N" * 11)
    assert totals == sorted(want.items(), key=str)
    assert sorted(r.bucket for r in moved) == [0, 1, 2, 3, 4] and sum(r.size for r in moved) == len(want)
    # Letters of three bits; with a number of eight bytes each, as before, 19 bytes.
    assert sum(len(r.seqs) + len(r.ns) for r in moved) < 5 * len(want)


def test_exported_lines(spark, tmp_path):
    texts = [letters(7, 30_000), "A\tB\tCDEFGHIJKL", "short"]
    refs = refs_of(spark, texts)
    lists = index.index_sequences(refs, 11, 1000, 2)
    lines = index.index_sequences(refs, 11, 1000, 2, files.tsv_lines, "value string")
    files.export_index_tsv(lists, f"{tmp_path}/none", compression="none")
    files.export_index_tsv(lists, f"{tmp_path}/lists")
    files.export_index_tsv(lines, f"{tmp_path}/lines")
    want = rows(spark.read.text(f"{tmp_path}/none"))
    assert rows(spark.read.text(f"{tmp_path}/lists")) == rows(spark.read.text(f"{tmp_path}/lines")) == want and len(want) == 29_994

    def size(name):
        return sum(f.stat().st_size for f in (tmp_path / name).glob("part-*"))

    assert size("lists") < 0.26 * size("none") and size("lines") < 0.26 * size("none")
    files.export_index_tsv(lists, f"{tmp_path}/lz4", compression="lz4")
    assert size("lines") < 0.7 * size("lz4")
    got = []
    for text in spark.read.text(f"{tmp_path}/lines", wholetext=True).collect():
        for some, number in files.lines_of_text(pa.scalar(text.value), 12, 1000):
            assert len(some) <= 1000
            got += zip(some.to_pylist(), map(int, number.to_pylist()))
    assert sorted(line for line, _ in got) == sorted(w for w, in want)
    assert all(number == (2 if line.count("\t") > 3 else 1) for line, number in got)


def test_exported_files_are_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "FILE_TEXTS", 1)
    text = letters(8, 250_000)
    lines = index.index_sequences(refs_of(spark, [text]), 11, 1000, 1, files.tsv_lines, "value string")
    files.export_index_tsv(lines, f"{tmp_path}/out")
    # A task of more than two slices.
    assert len(list((tmp_path / "out").glob("part-*.gz"))) == 3
    assert spark.read.text(f"{tmp_path}/out").count() == 249_990
