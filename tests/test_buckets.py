"""The stored index in buckets: hot k-mers apart, offsets packed, joined where it lies."""

import glob
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from helpers import diagonals
from seedlane.operators import kmers, seeds
from seedlane.operators.index import hot_keys
from seedlane.plans import reference
from seedlane.plans.reference import append_reference, build_reference, compact_reference, open_reference
from seedlane.plans.search import SearchOptions, find_candidates_indexed
from seedlane.sources import tables

K = 6


def refs_of(spark, texts, first=1):
    return kmers.as_references(spark.createDataFrame(list(enumerate(texts, first)), "id long, t string"), "id", "t")


def queries_of(spark, texts):
    return kmers.as_queries(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t")


def words(seed, n, letters="ABCD"):
    draw = random.Random(seed)
    return "".join(draw.choice(letters) for _ in range(n))


def expected(queries, refs, least):
    return {
        (q, r, end, hits) for q, a in enumerate(queries) for r, b in enumerate(refs, 1)
        for end, hits in diagonals(a, b, K).items() if hits > least}


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def all_counted(monkeypatch):
    """Hot k-mers of small tables: every block is in the sample, one in 20 of all entries is hot."""
    monkeypatch.setattr(reference, "SAMPLE", 1.0)
    monkeypatch.setattr(reference, "hot_keys", lambda counts, least=1: hot_keys(counts, 20, least))
    monkeypatch.setattr(seeds, "hot_keys", lambda counts, least=1: hot_keys(counts, 20, least))


def test_buckets_stay_where_they_are(spark, tmp_path):
    texts = [words(i, 900) for i in range(30)]
    stored = build_reference(refs_of(spark, texts[:20]), str(tmp_path), "r", K, group=300)
    stored = append_reference(refs_of(spark, texts[20:], first=21), str(tmp_path), "r")
    asked = [texts[3][100:160], texts[25][:50], "NOTHING THERE"]
    queries = queries_of(spark, asked)
    keys = kmers.query_keys(queries, K)
    assert len(stored.buckets) == 2
    got = seeds.seed_hits_in_buckets(keys, stored.buckets, stored.group, stored.hot, lambda some: stored.entries_for(some, True))
    plan = executed(got)
    final = plan[:plan.index("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
    scans = [line for line in final.splitlines() if "Bucketed: true" in line]
    assert len(scans) == 2 and "SortMergeJoin" in final
    # Exchanges on the way from a bucketed scan up to the root of the plan: lines further to the left.
    lines = final.splitlines()
    for at in (i for i, line in enumerate(lines) if "Bucketed: true" in line):
        depth, above = len(lines[at]) - len(lines[at].lstrip(" :+-*()0123456789")), []
        for line in reversed(lines[:at]):
            here = len(line) - len(line.lstrip(" :+-*()0123456789"))
            if here < depth:
                depth = here
                above.append(line.strip())
        assert above and not any("Exchange hashpartitioning" in line or "ShuffleQueryStage" in line for line in above), above
    found = find_candidates_indexed(queries, stored, SearchOptions(k=K, threshold=3, broadcast=False))
    want = expected(asked, texts, 3)
    assert set(map(tuple, found.collect())) == want and want
    merged = compact_reference(spark, str(tmp_path), "r")
    assert len(merged.buckets) == 1
    again = find_candidates_indexed(queries, merged, SearchOptions(k=K, threshold=3, broadcast=False))
    assert set(map(tuple, again.collect())) == want


def test_hot_kmers_are_apart(spark, tmp_path, all_counted):
    """One k-mer makes up a third of the index, another one of the queries; all hits are found, once."""
    texts = ["Z" * 700, words(1, 700), words(2, 700), "", "ABC"]
    asked = [words(2, 700)[30:90], "Z" * 9, "Y" * 60 + words(1, 700)[5:40], words(2, 700)[30:90]]
    stored = build_reference(refs_of(spark, texts), str(tmp_path), "r", K, group=100)
    assert [r.seq for r in stored.hot.collect()] == ["Z" * K]
    segment = glob.glob(f"{tmp_path}/r/segment-*")[0]
    apart = spark.read.parquet(f"{segment}/index/apart=true")
    assert {r.seq for r in apart.collect()} == {"Z" * K} and apart.count() == 7
    # Dealt over several files by block, while a bucket is a single one.
    assert len(glob.glob(f"{segment}/index/apart=true/*.parquet")) > 1
    buckets = glob.glob(f"{segment}/index/apart=false/*.parquet")
    assert len({b.rsplit("_", 1)[1] for b in buckets}) == len(buckets)
    found = find_candidates_indexed(queries_of(spark, asked), stored, SearchOptions(k=K, threshold=1, broadcast=False))
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected(asked, texts, 1)
    assert {r.seq for r in stored.index.collect()} == {
        t[i:i + K] for t in texts for i in range(len(t) - K + 1)}


@pytest.mark.parametrize("group, kind", [(50, "int16"), (32768, "int16"), (32769, "int32")])
def test_offsets_are_packed(spark, tmp_path, group, kind):
    texts = [words(7, 40_000, "AB"), "ABABABAB"]
    stored = build_reference(refs_of(spark, texts), str(tmp_path), "r", K, group=group)
    got = {(r.seq, r.ref_id, at) for r in stored.index.collect() for at in r.value}
    assert got == {(t[i:i + K], n, i) for n, t in enumerate(texts, 1) for i in range(len(t) - K + 1)}
    assert all(at // group == r.block for r in stored.index.collect() for at in r.value)
    file = glob.glob(f"{tmp_path}/r/segment-*/index/apart=false/*.parquet")[0]
    assert kind in str(pq.read_schema(file).field("value").type)


def test_an_empty_reference(spark, tmp_path):
    stored = build_reference(refs_of(spark, ["", "AB"]), str(tmp_path), "r", K)
    queries = queries_of(spark, ["ABABABABAB"])
    for broadcast in (None, False):
        assert find_candidates_indexed(queries, stored, SearchOptions(k=K, broadcast=broadcast)).count() == 0
    none = find_candidates_indexed(queries.limit(0), stored, SearchOptions(k=K, broadcast=False))
    assert none.count() == 0


def test_opened_again_by_another_session(spark, tmp_path):
    texts = [words(3, 500)]
    build_reference(refs_of(spark, texts), str(tmp_path), "it's", K)
    asked = [texts[0][50:90]]
    other = spark.newSession()
    stored = open_reference(other, str(tmp_path), "it's")
    found = find_candidates_indexed(queries_of(other, asked), stored, SearchOptions(k=K, threshold=3, broadcast=False))
    assert set(map(tuple, found.collect())) == expected(asked, texts, 3)


@pytest.mark.parametrize("group, kind", [(100, np.int16), (1 << 20, np.int32)])
def test_lists_are_moved_in_few_rows(group, kind):
    """One row per batch and task, from which the same lists come back with their offsets as distances."""
    draw = random.Random(group)
    rows = []
    for ref_id in (3, 1 << 40, 5):
        for block in (0, 7):
            for seq in ("AB", "CDEFG", "", "H" * 300):
                value = sorted(draw.sample(range(block * group, (block + 1) * group), draw.randint(1, 9)))
                rows.append({"seq": seq, "ref_id": ref_id, "block": block, "value": value, "apart": seq == "AB", "task": draw.randint(0, 3)})
    batch = pa.RecordBatch.from_pylist(rows, pa.schema([
        ("seq", pa.string()), ("ref_id", pa.int64()), ("block", pa.int64()), ("value", pa.list_(pa.int64())),
        ("apart", pa.bool_()), ("task", pa.int32())])).slice(2)
    packed = list(tables.packed_lists(batch, group, kind))
    assert [len(p) for p in packed] == [len({r["task"] for r in rows[2:]})]
    got = [r for p in packed for b in tables.opened_lists(p, kind) for r in b.to_pylist()]
    want = [{**r, "value": [x - r["block"] * group for x in r["value"]]} for r in rows[2:]]
    assert sorted(map(str, got)) == sorted(str({k: v for k, v in r.items() if k != "task"}) for r in want)
    assert not sum(len(p) for p in tables.packed_lists(batch.slice(0, 0), group, kind))
