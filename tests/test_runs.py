"""K-mers moved as runs, bitmaps of keys, tasks dealt by cost, and stored references as numbered states."""

import random
from collections import Counter
from threading import Thread

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import helpers
from seedlane import append_reference, build_reference, compact_reference, open_reference
from seedlane.operators import filters, kmers, runs, seeds
from seedlane.plans import layout, reference


def refs_of(spark, texts, first=1):
    return kmers.as_references(spark.createDataFrame(list(enumerate(texts, first)), "id long, t string"), "id", "t")


def queries_of(spark, texts):
    return kmers.as_queries(spark.createDataFrame(list(enumerate(texts, 1)), "id long, t string"), "id", "t")


def texts_of(seed, n=30, letters="ACGTN"):
    draw = random.Random(seed)
    out = ["".join(draw.choices(letters, k=draw.randint(0, 300))) for _ in range(n)]
    return [*out, "", "A", "A" * 5000, "N" * 40, out[0], out[0] + out[1]]


@pytest.mark.parametrize("k", [1, 2, 5, 11])
def test_runs_hold_every_kmer_once(spark, k):
    texts = texts_of(k)
    found = runs.minimiser_runs(refs_of(spark, texts), k, ["ref_id"]).collect()
    got, word_of = Counter(), {}
    for r in found:
        run = bytes(r.run).decode()
        for i in range(len(run) - k + 1):
            got[(r.ref_id, r.offset + i, run[i:i + k])] += 1
            # Equal k-mers meet in one partition.
            assert word_of.setdefault(run[i:i + k], r.word) == r.word
    expected = Counter((n, i, t[i:i + k]) for n, t in enumerate(texts, 1) for i in range(len(t) - k + 1))
    assert got == expected
    if k == 11:
        assert len(found) < 0.4 * sum(expected.values())


def test_runs_are_found_slice_by_slice(monkeypatch):
    """A batch of Arrow may hold any amount of text; what is in memory at once does not grow with it."""
    texts = [t.encode() for t in texts_of(9, 200)]
    batch = pa.RecordBatch.from_pydict({
        "ref_id": list(range(len(texts))), "_p": [7] * len(texts), "_b": pa.array(texts, pa.binary())}).slice(3)
    whole = pa.Table.from_batches(runs.batch_runs(batch, 5, ["ref_id"])).to_pydict()
    monkeypatch.setattr(runs, "SLICE", 1000)
    asked, find = [], runs.runs_of
    monkeypatch.setattr(runs, "runs_of", lambda data, ends, k: asked.append(len(data)) or find(data, ends, k))
    assert pa.Table.from_batches(runs.batch_runs(batch, 5, ["ref_id"])).to_pydict() == whole
    assert sum(asked) == sum(map(len, texts[3:])) and len(asked) > 20
    assert sorted(asked)[-2] <= 1000 and max(asked) == 5000
    assert not list(runs.batch_runs(batch.slice(0, 0), 5, ["ref_id"]))


def test_totals_by_runs(spark):
    texts = texts_of(3)
    expected = Counter(s for t in texts for _, s in helpers.kmers(t, 7))
    found = runs.key_totals_by_runs(refs_of(spark, texts).repartition(3), 7)
    assert {r.seq: r.n for r in found.collect()} == expected
    plan = found._jdf.queryExecution().executedPlan().toString()
    # K-mers themselves are not moved.
    assert "hashpartitioning(seq" not in plan and "hashpartitioning(word" in plan
    assert runs.key_totals_by_runs(refs_of(spark, [""]), 7).count() == 0


@pytest.mark.parametrize("screen", [True, False])
def test_seed_hits_by_runs(spark, screen, monkeypatch):
    monkeypatch.setattr(runs, "SAMPLE", 0.9)
    monkeypatch.setattr(runs, "SEEN", 2)
    monkeypatch.setattr(runs, "HOT_SHARE", 20)
    texts = texts_of(5) + ["ACGTACGTAC" * 30] * 20
    asked = [texts[0][3:60], "ACGTACGTACGT", "A" * 30, "GGG", "", texts[4][:50], "N" * 20]
    queries, references = queries_of(spark, asked), refs_of(spark, texts)
    found = runs.seed_hits_by_runs(queries, references, 6, screen=screen)
    expected = Counter()
    for q, a in enumerate(asked, 1):
        for r, t in enumerate(texts, 1):
            for end, n in helpers.diagonals(a, t, 6).items():
                expected[(q, r, end)] += n
    assert Counter(map(tuple, found.collect())) == expected
    final = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin" in final and "ENSURE_REQUIREMENTS" not in final


def test_bitmap_of_keys(spark, monkeypatch):
    monkeypatch.setattr(filters, "LEAST_BITS", 1 << 15)
    keys = spark.range(700).select(F.concat(F.lit("k"), "id").alias("seq"))
    rows = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("seq"), "id")
    bits = filters.bitmap_bits(700)
    pages = filters.key_bitmap(keys, bits)
    assert pages.count() == bits >> filters.PAGE_BITS
    kept = {r.id for r in filters.likely_in(rows, pages, bits).collect()}
    assert set(range(700)) <= kept and len(kept) < 700 + 0.05 * 20_000
    assert filters.likely_in(rows, filters.key_bitmap(keys.limit(0), bits), bits).count() == 0
    assert filters.bitmap_bits(1 << 31) is None and filters.bitmap_bits(1 << 27) == 1 << 30


def test_entries_drop_out_before_the_shuffle(spark):
    texts = ["".join(random.Random(i).choices("ACDEFGHIKLMNPQRSTVWY", k=2000)) for i in range(20)]
    keys = kmers.query_keys(queries_of(spark, [texts[3][100:160]]), 8)
    from seedlane.operators.index import postings

    entries = postings(refs_of(spark, texts), 8, 1000)
    left = seeds.screened(entries, keys)
    assert left.count() < 0.05 * entries.count()
    hits = seeds.seed_hits(keys, entries, broadcast_keys=False)
    assert Counter(map(tuple, hits.collect())) == Counter(map(tuple, seeds.seed_hits(keys, entries).collect()))


def test_tasks_cost_alike(spark):
    draw = random.Random(1)
    lengths = [50_000] + [30_000, 28_000, 27_000, 26_000] + [draw.randint(50, 150) for _ in range(10_000)]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "id long, n long")
    tasks = 16
    dealt = layout.deal_by_cost(rows, F.col("n") * F.col("n"), ["id"], tasks)
    assert dealt.count() == len(lengths)
    loads = {r["p"]: r["c"] for r in dealt.repartition(tasks, "_deal").groupBy(F.spark_partition_id().alias("p")).agg(
        F.sum(F.col("n") * F.col("n")).alias("c")).collect()}
    assert sorted(loads.values())[-1] == 50_000**2 and sorted(loads.values())[-5] == 26_000**2
    # Small ones only: all tasks have about their share.
    small = layout.deal_by_cost(rows.filter("n < 200"), F.col("n") * F.col("n"), ["id"], tasks).repartition(tasks, "_deal")
    each = [r["c"] for r in small.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.col("n") * F.col("n")).alias("c")).collect()]
    assert len(each) == tasks and max(each) < 1.25 * sum(each) / tasks
    assert layout.deal_by_cost(rows.limit(0), F.col("n"), ["id"], tasks).count() == 0


def state(spark, folder):
    return reference._state(spark, folder, "r")


def test_states_are_numbered(spark, tmp_path):
    folder = str(tmp_path)
    build_reference(refs_of(spark, ["ABCDEFGH"]), folder, "r", 4, parts=2)
    append_reference(refs_of(spark, ["QRSTUVWX"], 5), folder, "r")
    number, how = state(spark, folder)
    assert number == 2 and len(how["segments"]) == 2
    # A writer that ended between creating its file and writing it.
    (tmp_path / "r" / "settings" / "000000003.json").write_bytes(b"")
    (tmp_path / "r" / "settings" / "000000004.json").write_bytes(b'{"k": 4, "segm')
    assert open_reference(spark, folder, "r").content.count() == 2
    append_reference(refs_of(spark, ["IJKLMNOP"], 9), folder, "r")
    number, how = state(spark, folder)
    assert number == 5 and len(how["segments"]) == 3
    assert not reference._publish(spark, folder, "r", 5, {})
    with pytest.raises(FileNotFoundError):
        open_reference(spark, folder, "other")


def test_two_appends_at_once(spark, tmp_path, monkeypatch):
    """Both have read the same state before either publishes."""
    folder = str(tmp_path)
    build_reference(refs_of(spark, ["ABCDEFGH"]), folder, "r", 4, parts=2)
    first = reference._add_segment
    errors = []

    def other(ref_id):
        try:
            append_reference(refs_of(spark, ["IJKLMNOP"], ref_id), folder, "r")
        except ValueError as error:
            errors.append(str(error))

    def slow(*args):
        monkeypatch.setattr(reference, "_add_segment", first)
        thread = Thread(target=other, args=(50,))
        thread.start()
        thread.join()
        return first(*args)

    monkeypatch.setattr(reference, "_add_segment", slow)
    append_reference(refs_of(spark, ["QRSTUVWX"], 5), folder, "r")
    assert {r.ref_id for r in open_reference(spark, folder, "r").content.collect()} == {1, 5, 50} and not errors

    # The same number twice: the second is refused.
    def slow_again(*args):
        monkeypatch.setattr(reference, "_add_segment", first)
        other(60)
        return first(*args)

    monkeypatch.setattr(reference, "_add_segment", slow_again)
    with pytest.raises(ValueError, match="already stored: ref_id 60"):
        append_reference(refs_of(spark, ["QRSTUVWX"], 60), folder, "r")
    assert open_reference(spark, folder, "r").content.filter("ref_id = 60").count() == 1 and not errors


def test_segments_are_merged(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    names = spark.createDataFrame([(5, "five")], "ref_id long, name string")
    build_reference(refs_of(spark, ["ABCDEFGH"]), folder, "r", 4, parts=2)
    append_reference(refs_of(spark, ["QRSTABCD"], 5), folder, "r", names=names)
    append_reference(refs_of(spark, ["ABCDABCD"], 7), folder, "r")
    before = open_reference(spark, folder, "r")
    index = sorted(map(tuple, before.index.select("seq", "ref_id", "block", "value").collect()))
    content = sorted(map(tuple, before.content.select("ref_id", "blockid", "value").collect()))
    real = reference._publish

    def late(spark_, folder_, name, number, how):
        monkeypatch.setattr(reference, "_publish", real)
        append_reference(refs_of(spark, ["MNOPQRST"], 9), folder, "r")
        return real(spark_, folder_, name, number, how)

    monkeypatch.setattr(reference, "_publish", late)
    merged = compact_reference(spark, folder, "r")
    assert len(state(spark, folder)[1]["segments"]) == 2
    assert sorted(map(tuple, merged.index.filter("ref_id < 9").select("seq", "ref_id", "block", "value").collect())) == index
    assert sorted(map(tuple, merged.content.filter("ref_id < 9").select("ref_id", "blockid", "value").collect())) == content
    assert merged.content.filter("ref_id = 9").count() == 1
    assert [tuple(r) for r in merged.names.collect()] == [(5, "five")]
    # What was opened before still works.
    assert before.index.count() == len(index)
    assert np.isclose(compact_reference(spark, folder, "r").index.count(), len(index) + 5)
    assert len(state(spark, folder)[1]["segments"]) == 1
