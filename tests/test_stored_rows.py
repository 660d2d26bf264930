"""Rows of a stored index: all lists of a k-mer together, moved in few closely compressed pieces."""

import glob
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from seedlane.functions.digest import text_hashes

from seedlane.operators.index import index_sequences
from seedlane.plans import reference
from seedlane.plans.reference import append_reference, build_reference, compact_reference, open_reference
from seedlane.sources import tables

K = 6


def refs_of(spark, texts, first=1):
    return spark.createDataFrame(list(enumerate(texts, first)), "ref_id long, sequence string").coalesce(1)


def words(seed, n, letters="ABCDEFGH"):
    return "".join(random.Random(seed).choices(letters, k=n))


def lists_of(texts, k, group, first=1):
    found = {}
    for n, text in enumerate(texts, first):
        for i in range(len(text) - k + 1):
            found.setdefault((text[i:i + k], n, i // group), []).append(i)
    return sorted((*key, at) for key, at in found.items())


def test_hashes_are_those_of_spark(spark):
    texts = [words(i, i % 40, "AZ09 ~\x01") for i in range(3000)] + [""]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(F.hash("t")).collect()
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    assert text_hashes(data, np.cumsum([0, *map(len, texts)])).tolist() == [r[0] for r in found]
    assert text_hashes(data[:0], np.zeros(1, np.int64)).tolist() == []


def test_a_row_has_the_lists_of_a_kmer(spark, tmp_path):
    texts = [words(1, 3000), words(2, 50) + words(1, 3000)[:2000], "AB", "", words(1, 3000)[500:]]
    stored = build_reference(refs_of(spark, texts), str(tmp_path), "r", K, group=100)
    want = lists_of(texts, K, 100)
    for now in (stored, open_reference(spark, str(tmp_path), "r")):
        assert sorted(map(tuple, now.index.select("seq", "ref_id", "block", "value").collect())) == want
    rows = stored.rows.collect()
    repeated = {s for s, n in Counter(r.seq for r in rows).items() if n > 1}
    assert len(rows) < 0.6 * len(want)
    assert not repeated - {r.seq for r in stored.hot.collect()}
    for file in glob.glob(f"{tmp_path}/r/segment-*/index/apart=false/*.parquet"):
        hashes = pq.read_table(file, columns=["hash"])["hash"].to_pylist()
        assert hashes == sorted(hashes)
    # Merged with another segment, these rows become longer.
    append_reference(refs_of(spark, [texts[0], words(3, 300)], 8), str(tmp_path), "r")
    merged = compact_reference(spark, str(tmp_path), "r")
    more = sorted(want + lists_of([texts[0], words(3, 300)], K, 100, 8))
    assert sorted(map(tuple, merged.index.select("seq", "ref_id", "block", "value").collect())) == more


def test_lists_are_moved_in_few_bytes(spark):
    """Those of a task go to a bucket in one piece of a few bytes a k-mer, whatever the batches they come in."""
    text = words(5, 200_000)
    plain = index_sequences(refs_of(spark, [text]), 11, 1000, 1)
    packed = index_sequences(
        refs_of(spark, [text]), 11, 1000, 1, lambda b: tables.lists_for_buckets(b, 1000, 8, {}), tables.PACKED).collect()
    assert len(packed) == 8 and {r.task for r in packed} == set(range(8))
    size = sum(len(r[name]) for r in packed for name in tables.PACKED_NAMES[4:])
    # Letters of three bits and positions of eighteen; a k-mer with its numbers is 11 + 8 + 8 + 2 bytes.
    assert size < 8.5 * plain.count()


@pytest.mark.parametrize("most", [1, 2, 7, 8])
def test_very_many_lists_are_in_several_rows(monkeypatch, most):
    monkeypatch.setattr(tables, "MOST_LISTS", most)
    rows = [{"seq": s, "ref_id": r, "block": 0, "value": [r]} for r in range(7) for s in ("ABCDEF", "BCDEFG")]
    batch = pa.RecordBatch.from_pylist(rows, pa.schema([
        ("seq", pa.string()), ("ref_id", pa.int64()), ("block", pa.int64()), ("value", pa.list_(pa.int64()))]))
    packed = tables.lists_for_buckets(iter([batch]), 100, 1, {})
    found = [r for some in tables.rows_of_bucket(packed, np.int16) for r in some.to_pylist()]
    assert all(len(r["refs"]) == len(r["blocks"]) == len(r["value"]) <= most for r in found)
    assert len(found) == 2 * -(-7 // most)
    assert sorted((r["seq"], n) for r in found for n in r["refs"]) == sorted((r["seq"], r["ref_id"]) for r in rows)


def test_missing_numbers_and_hot_kmers_in_tasks():
    rows = [{"seq": s, "ref_id": r, "block": b, "value": [b * 100 + i, b * 100 + i + 7]}
            for i, s in enumerate(("ABCDEF", "BCDEFG", "ZZZZZZ")) for r in (None, 5, 1 << 40) for b in (0, 3)]
    batch = pa.RecordBatch.from_pylist(rows, pa.schema([
        ("seq", pa.string()), ("ref_id", pa.int64()), ("block", pa.int64()), ("value", pa.list_(pa.int64()))]))
    packed = list(tables.lists_for_buckets(iter([batch.slice(0, 7), batch.slice(7)]), 100, 4, {"ZZZZZZ": 3}))
    tasks = sorted({t for p in packed for t in p.column("task").to_pylist()})
    found, apart = [], []
    for task in tasks:
        mine = iter([p.filter(pa.array([t == task for t in p.column("task").to_pylist()])) for p in packed])
        for some in tables.rows_of_bucket(mine, np.int16):
            apart += [(r["seq"], task) for r in some.to_pylist() if r["apart"]]
            found += [b.to_pylist() for b in tables.lists_of_rows(iter([some.drop_columns(["hash", "apart"])]), 100)]
    assert sorted(map(str, sum(found, []))) == sorted(map(str, rows))
    assert {s for s, _ in apart} == {"ZZZZZZ"} and len(apart) == 6 and len({t for _, t in apart}) > 1


def test_stored_by_an_earlier_version(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(reference, "FORM", 1)
    build_reference(refs_of(spark, ["ABCDEFGH"]), str(tmp_path), "r", 4)
    monkeypatch.undo()
    with pytest.raises(ValueError, match="build it again"):
        open_reference(spark, str(tmp_path), "r")


def test_nothing_shuffled_is_left(spark, tmp_path):
    """What was moved to store an index goes when it is stored; the session's settings are as before."""

    def shuffled():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f.getPath() for f in (found.apply(i) for i in range(found.size())) if f.getName().startswith("shuffle_")}

    before, settings = shuffled(), {key: spark.conf.get(key) for key in tables.STORING}
    packed = index_sequences(
        refs_of(spark, [words(9, 100_000)]), 11, 1000, 2, lambda b: tables.lists_for_buckets(b, 1000, 4, {}), tables.PACKED)
    tables.write_index(packed, f"{tmp_path}/index", 1000, 4)
    assert not shuffled() - before
    assert {key: spark.conf.get(key) for key in tables.STORING} == settings
    assert spark.read.parquet(f"{tmp_path}/index").agg(F.sum(F.size(F.flatten("value")))).first()[0] == 99_990
