import random

import pytest
from pyspark.sql import functions as F

from seedlane.functions import arrays
from seedlane.functions.text import block_of, normalize, text_lines
from seedlane.operators import align, content, index, kmers, lines, metrics, seeds
from seedlane.sources import files

import helpers


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def refs_of(spark, *texts):
    rows = list(enumerate(texts, 1))
    return kmers.as_references(frame(spark, rows, "id long, t string"), "id", "t")


def lines_of(spark, *texts):
    return lines.split_lines(frame(spark, list(enumerate(texts, 1)), "id long, t string"), "id", "t")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_normalize(spark):
    df = frame(spark, [("aé\r\nbßc\n\nd",)], "t string")
    got = df.select(normalize(F.col("t")).alias("a"), text_lines(F.col("t")).alias("b")).first()
    assert got["a"] == "ABCD" and got["b"] == ["A", "BC", "D"]


def test_block_of_rounds_down(spark):
    df = frame(spark, [(-1,), (0,), (9,), (10,)], "p long")
    assert [r[0] for r in df.select(block_of(F.col("p"), 10)).collect()] == [-1, 0, 0, 1]


@pytest.mark.parametrize("piece", [1, 3, 4096])
def test_kmers(spark, monkeypatch, piece):
    monkeypatch.setattr(kmers, "PIECE", piece)
    texts = ["", "ACG", "ACGT", "NNNNNACGTNNNN", "ACGTACGTAC"]
    got = kmers.explode_kmers(refs_of(spark, *texts), 4, ["ref_id"])
    assert rows(got.select("ref_id", "offset", "seq")) == sorted(
        (i, o, s) for i, t in enumerate(texts, 1) for o, s in helpers.kmers(t, 4)
    )


def test_negative_position_is_refused(spark):
    df = frame(spark, [(1, -5, "ACGTACGT")], "ref_id long, offset long, line string")
    with pytest.raises(Exception, match="negative k-mer position"):
        kmers.in_line_kmers(df, 4).collect()


def test_in_line_kmers_do_not_cross_lines(spark):
    located = lines.line_offsets(lines_of(spark, "ACGTA\nCC\nGGGGT"))
    assert {(r["offset"], r["seq"]) for r in kmers.in_line_kmers(located, 4).collect()} == {
        (0, "ACGT"), (1, "CGTA"), (7, "GGGG"), (8, "GGGT")
    }


@pytest.mark.parametrize("span", [1, 2, 1000])
def test_lines(spark, span):
    texts = ["ab\n\ncde\r\nf", "single", "", "\n\n", "x\ny"]
    table = lines_of(spark, *texts)
    assert rows(lines.line_offsets(table, span).select("ref_id", "line_no", "offset", "size")) == [
        (1, 0, 0, 2), (1, 1, 2, 3), (1, 2, 5, 1), (2, 0, 0, 6), (5, 0, 0, 1), (5, 1, 1, 1)
    ]
    assert rows(lines.two_line_join(table, span).select("ref_id", "lines")) == [
        (1, "ABCDE"), (1, "CDEF"), (1, "F"), (2, "SINGLE"), (5, "XY"), (5, "Y")
    ]
    assert rows(lines.overlap_prefix_join(table, 3, span).select("ref_id", "lines")) == [
        (1, "ABCD"), (1, "CDEF"), (1, "F"), (2, "SINGLE"), (5, "XY"), (5, "Y")
    ]


def test_lines_to_queries(spark):
    table = lines_of(spark, "h\na\n>bb", "h\nccc", "h")
    every = [(1, "H", 1), (2, "A", 1), (3, ">BB", 3), (4, "H", 1), (5, "CCC", 3), (6, "H", 1)]
    assert rows(lines.lines_to_queries(table)) == every
    kept = [t for _, t, _ in every if t[0] != ">"]
    assert [r[1] for r in rows(lines.lines_to_queries(table, headers=True))] == kept


def test_lines_to_queries_of_hashed_ids(spark, monkeypatch):
    """Records are numbered in the order of their ids, in many tasks."""
    monkeypatch.setattr(lines, "SPAN", 2)
    data = [((i * 7919 + 3) ** 5 % 2**61 - 2**60, n, f"L{i}.{n}") for i in range(500) for n in range(i % 6)]
    table = spark.createDataFrame(data, "ref_id long, line_no long, line string")
    found = lines.lines_to_queries(table)
    assert [r.sequence for r in sorted(found.collect())] == [t for _, _, t in sorted(data)]
    assert [r.query_id for r in sorted(found.collect())] == list(range(1, len(data) + 1))


TEXTS = ["ABCDEFGHIJ" * 3 + "XYZ", "AB", "", "QRSTQRSTQRSTQRST"]


@pytest.mark.parametrize("group", [1, 4, 7, 100])
def test_index_ways_agree(spark, group):
    refs = refs_of(spark, *TEXTS)
    whole = rows(index.build_index(index.postings(refs, 4, group)))
    expected = {}
    for i, text in enumerate(TEXTS, 1):
        for o, s in helpers.kmers(text, 4):
            expected.setdefault((s, i, o // group), []).append(o)
    assert whole == sorted((*k, v) for k, v in expected.items())
    assert rows(index.index_sequences(refs, 4, group)) == whole
    assert rows(index.index_content(content.build_content(refs, 5), 4, group)) == whole
    back = index.index_entries(index.build_index(index.postings(refs, 4, group)))
    assert rows(back) == rows(index.postings(refs, 4, group))


def test_kmers_of_blocks_are_grouped_where_they_are(spark):
    """Neither shuffled nor sorted by k-mer: a block comes as text or in one piece and leaves as lists."""
    texts = [*TEXTS, "NNNNNNABCNNNN" * 30, "A" * 700]
    refs = refs_of(spark, *texts)
    # A number that comes twice has the lists of both texts.
    refs = refs.union(refs.filter("ref_id = 4").withColumn("sequence", F.lit("RSTQRSTQXYZ"))).repartition(3)
    expected = {}
    for i, text in [*enumerate(texts, 1), (4, "RSTQRSTQXYZ")]:
        for o, s in helpers.kmers(text, 4):
            expected.setdefault((s, i, o // 100), []).append(o)
    expected = sorted((*key, sorted(v)) for key, v in expected.items())
    flat = index.postings(refs, 4, 100)
    wide = {}
    for s, r, b, v in expected:
        wide.setdefault((s, r, b // 3), []).extend(v)
    for built, want in [
        (index.index_sequences(refs, 4, 100, 2), expected), (index.build_index(flat), expected),
        (index.merge_lists(index.build_index(flat), 3), sorted((*key, sorted(v)) for key, v in wide.items())),
    ]:
        assert rows(built) == want
        plan = built._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(seq" not in plan and "collect_list(offset" not in plan
    # K-mers of several lengths in one table.
    mixed = frame(spark, [("AB", 0, 1, 5), ("ABC", 0, 1, 5), ("AB", 0, 1, 2), ("AB", 0, 2, 9), ("AB", 1, 1, 120)],
                  "seq string, block long, ref_id long, offset long").coalesce(1)
    assert rows(index.build_index(mixed)) == [("AB", 1, 0, [2, 5]), ("AB", 1, 1, [120]), ("AB", 2, 0, [9]), ("ABC", 1, 0, [5])]


def test_merged_lists_and_export_text(spark):
    built = index.build_index(index.postings(refs_of(spark, "ABABABAB"), 2, 2))
    assert rows(index.merge_lists(built, 100)) == [("AB", 1, 0, [0, 2, 4, 6]), ("BA", 1, 0, [1, 3, 5])]
    texts = index.index_rows_text(index.merge_lists(built, 100))
    assert rows(texts.select("seq", "value")) == [("AB", "[0,2,4,6]"), ("BA", "[1,3,5]")]
    assert rows(index.list_counts(index.merge_lists(built, 100))) == [("AB", 4), ("BA", 3)]
    assert rows(index.key_totals(index.index_entries(built))) == [("AB", 4), ("BA", 3)]


def test_export_is_compressed(spark, tmp_path):
    text = "".join(random.Random(1).choices("ABCDEFGHIJ", k=20_000))
    built = index.index_sequences(refs_of(spark, text), 11, 1000, tasks=2)
    size = {}
    for how in ("lz4", "none"):
        files.export_index_tsv(built, f"{tmp_path}/{how}", compression=how)
        size[how] = sum(f.stat().st_size for f in (tmp_path / how).glob("part-*"))
    files.export_index_tsv(built, f"{tmp_path}/default")
    assert not list((tmp_path / "default").glob("part-*.txt"))
    assert size["lz4"] < 0.7 * size["none"]
    expected = rows(spark.read.text(f"{tmp_path}/none"))
    assert rows(spark.read.text(f"{tmp_path}/default")) == rows(spark.read.text(f"{tmp_path}/lz4")) == expected
    assert len(expected) == built.count() == 19_990


def test_hot_keys(spark):
    counts = frame(spark, [("A", 60), ("A", 30), ("B", 9), ("C", 1)], "seq string, n int")
    assert rows(index.hot_keys(counts, 10)) == [("A", 9)]
    assert rows(index.hot_keys(counts, 100)) == [("A", 90), ("B", 9)]
    assert rows(index.hot_keys(counts, 101)) == [("A", 91), ("B", 10), ("C", 2)]
    assert rows(index.hot_keys(counts.limit(0), 10)) == []


def test_lookup_keys(spark):
    entries = index.postings(refs_of(spark, "ABCABC"), 2)
    wanted = frame(spark, [("AB",), ("AB",), ("ZZ",)], "seq string")
    for n in (None, 10**12):
        assert rows(seeds.lookup_keys(entries, wanted, n).select("seq", "offset")) == [("AB", 0), ("AB", 3)]


def test_one_hot_kmer(spark):
    """A k-mer with most of all entries, in several queries, by every way of joining."""
    refs = refs_of(spark, "A" * 400, "ACGT" * 20, "A" * 30 + "CGT")
    queries = kmers.as_queries(
        frame(spark, [(1, "A" * 12), (2, "AAAAACGTACGT"), (3, "CGTACGTACG")], "id long, t string"), "id", "t"
    )
    keys, entries = kmers.query_keys(queries, 5), index.postings(refs, 5, 50)
    want = rows(seeds.diagonal_counts(seeds.seed_hits(keys, entries)))
    texts = {1: "A" * 400, 2: "ACGT" * 20, 3: "A" * 30 + "CGT"}
    assert want == sorted(
        (q["query_id"], r, e, h)
        for q in queries.collect() for r, t in texts.items()
        for e, h in helpers.diagonals(q["sequence"], t, 5).items()
    )
    for share in (2, 10, 10_000):
        hot = index.hot_keys(index.entry_counts(entries), share)
        got = seeds.seed_hits(keys, entries, broadcast_keys=False, hot=hot)
        assert rows(seeds.diagonal_counts(got)) == want


def test_top_diagonals(spark):
    found = frame(spark, [(1, 1, 5, 3), (1, 1, 6, 9), (1, 2, 5, 9), (2, 1, 1, 4)],
                  "query_id long, ref_id long, end_pos long, hits long")
    assert [tuple(r) for r in seeds.top_diagonals(found, 2).collect()] == [(1, 1, 6, 9), (1, 2, 5, 9)]
    assert rows(seeds.top_diagonals_per_query(found, 1)) == [(1, 1, 6, 9, 1), (2, 1, 1, 4, 1)]


def test_candidate_lists_and_chunks(spark):
    found = frame(spark, [(1, 1, e, 20) for e in (9, 3, 25, 7, 1, 5, 30)],
                  "query_id long, ref_id long, end_pos long, hits long")
    lists = seeds.candidate_lists(found, 20)
    assert rows(lists) == [(1, 1, 0, [1, 3, 5, 7, 9]), (1, 1, 1, [25, 30])]
    assert rows(seeds.candidate_chunks(lists, 2)) == [
        (1, 1, 0, 0, [1, 3]), (1, 1, 0, 1, [5, 7]), (1, 1, 0, 2, [9]), (1, 1, 1, 0, [25, 30])
    ]
    assert metrics.listed_candidates(lists).first()["candidates"] == 7


def test_queries_are_joined_either_way(spark):
    found = frame(spark, [(q, r, e, 20) for q in (1, 2) for r in range(5) for e in range(7)],
                  "query_id long, ref_id long, end_pos long, hits long")
    queries = frame(spark, [(1, "AA"), (2, "BB"), (3, "CC")], "query_id long, sequence string")
    small = rows(seeds.with_query_text(found, queries, True).select(*found.columns, "query"))
    assert len(small) == 70 and rows(
        seeds.with_query_text(found, queries, False).select(*found.columns, "query")) == small


def test_no_hits_is_an_empty_table(spark):
    refs, queries = refs_of(spark, "ABCDEFGH"), refs_of(spark, "12345678").withColumnRenamed("ref_id", "query_id")
    found = seeds.seed_hits(kmers.query_keys(queries, 4), index.postings(refs, 4))
    assert found.columns == ["query_id", "ref_id", "end_pos"] and found.count() == 0


def test_array_helpers(spark):
    df = frame(spark, [([5, 3, 5, 5, 3],), ([],)], "a array<long>")
    got = df.select(
        arrays.shift_all(F.col("a"), F.lit(10)).alias("shift"),
        arrays.count_by(F.col("a")).alias("counts"),
        arrays.values_over(F.col("a"), 2).alias("over"),
        arrays.chunked(F.col("a"), 2).alias("chunks"),
        arrays.array_text(F.col("a")).alias("text"),
        arrays.joined(F.col("a").cast("array<string>"), "").alias("joined"),
    ).collect()
    assert got[0]["shift"] == [15, 13, 15, 15, 13]
    assert [tuple(c) for c in got[0]["counts"]] == [(3, 2), (5, 3)]
    assert got[0]["over"] == [5]
    assert got[0]["chunks"] == [[5, 3], [5, 5], [3]]
    assert got[0]["text"] == "[5,3,5,5,3]" and got[0]["joined"] == "53553"
    assert got[1]["chunks"] == [] and got[1]["text"] == "[]" and got[1]["counts"] == []


@pytest.mark.parametrize("size", [1, 3, 10, 1000])
@pytest.mark.parametrize("width", [1, 4, 80])
def test_content_ways_agree(spark, size, width):
    texts = TEXTS
    wrapped = ["\n".join(t[i:i + width] for i in range(0, len(t), width)) for t in texts]
    located = lines.line_offsets(lines_of(spark, *wrapped))
    expected = sorted(
        (i, b, b * size, len(t[b * size:(b + 1) * size]), t[b * size:(b + 1) * size])
        for i, t in enumerate(texts, 1) for b in range(-(-len(t) // size))
    )
    assert rows(content.build_content(refs_of(spark, *texts), size)) == expected
    assert rows(content.build_content_from_lines(located, size)) == expected
    overlapped = content.build_content_from_lines(located, size, overlap=3)
    assert rows(overlapped.select("ref_id", "blockid", "value")) == sorted(
        (i, b, t[b * size:(b + 1) * size + 3])
        for i, t in enumerate(texts, 1) for b in range(-(-len(t) // size))
    )


def test_content_by_line(spark):
    located = lines.line_offsets(lines_of(spark, "ABC\nDEFG\nH\nIJKLM"))
    assert rows(content.content_by_line(located, 4)) == [
        (1, 0, 0, 7, "ABCDEFG"), (1, 1, 7, 1, "H"), (1, 2, 8, 5, "IJKLM")
    ]


@pytest.mark.parametrize("block", [1, 3, 7, 100])
def test_windows_are_slices(spark, block):
    text = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    placed = frame(spark, [(1, 1, e, 1, n) for e in range(0, 30, 3) for n in (4, 9)],
                   "query_id long, ref_id long, end_pos long, hits long, length int")
    for few in (True, False):
        for extension in (0, 5):
            got = content.fetch_windows(
                placed, content.build_content(refs_of(spark, text), block), block, extension, broadcast_placed=few
            ).collect()
            # The length of the query is no result column; every slice tells its own place.
            for r in got:
                here = text[r["ref_start"]:r["ref_end"] + 1]
                assert r["window"].rstrip() == here and len(r["window"]) == len(here) + r["missing"]
                assert r["ref_end"] == min(25, r["end_pos"] + (extension + 1) // 2)
                assert r["overhang"] == (r["lead"] > 0 or r["missing"] > 0)
            assert len(got) == sum(
                1 for p in placed.collect() if p["end_pos"] - p["length"] + 1 - extension // 2 <= 25
            )


def test_alignment_blocks(spark):
    a, b = "A" * 45 + "C", "A" * 44 + "GC"
    df = frame(spark, [(1, 1, 9, a, b)],
               "query_id long, ref_id long, end_pos long, aligned_ref string, aligned_query string")
    got = align.alignment_blocks(df).orderBy("block_no").collect()
    assert [(r["block_no"], r["sequence1"], r["marks"], r["sequence2"]) for r in got] == [
        (0, "A" * 40, "|" * 40, "A" * 40), (1, "AAAAAC", "|||| |", "AAAAGC")
    ]


def test_best_hit_and_score_filter(spark):
    df = frame(spark, [(1, 1, 5, 20, 0.7), (1, 2, 5, 20, 0.9), (1, 3, 1, 25, 0.9), (2, 1, 1, 16, 0.71)],
               "query_id long, ref_id long, end_pos long, hits long, score double")
    assert rows(align.best_hit(df).select("query_id", "ref_id")) == [(1, 3), (2, 1)]
    assert rows(align.above_score(df).select("ref_id", "score")) == [(1, 0.71), (2, 0.9), (3, 0.9)]


def test_balance(spark):
    df = frame(spark, [("a",)] * 6 + [("b",)] * 2, "k string")
    assert tuple(metrics.balance_by(df, "k").first()) == (2, 8, 4.0, 6, 50.0)
    even = spark.range(0, 80, 1, 4)
    assert tuple(metrics.partition_balance(even).first()) == (4, 80, 20.0, 20, 0.0)
