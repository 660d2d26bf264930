"""The small example references and queries with the values expected of them."""

import pytest
from pyspark.sql import functions as F

from seedlane import SearchOptions, build_reference, find_candidates, open_reference, search
from seedlane import search_reference
from seedlane.operators.content import build_content, fetch_windows
from seedlane.operators.align import align_candidates, ungapped_identity
from seedlane.operators.index import entry_counts, hot_keys, postings
from seedlane.operators.kmers import as_queries, as_references, explode_kmers, query_keys
from seedlane.operators.seeds import diagonal_counts, seed_hits, unmatched_queries, with_query_text

from helpers import EXAMPLE2_LINES, EXAMPLE_LINES, QUERY2_LINES, QUERY_SET, diagonals, slow_align

K = 11
EXAMPLE, EXAMPLE2, QUERY2 = ("".join(t).upper() for t in (EXAMPLE_LINES, EXAMPLE2_LINES, QUERY2_LINES))


@pytest.fixture(scope="module")
def refs(spark):
    rows = [(1, "".join(EXAMPLE_LINES)), (2, "\n".join(EXAMPLE2_LINES))]
    return as_references(spark.createDataFrame(rows, "id long, t string"), "id", "t")


@pytest.fixture(scope="module")
def queries(spark):
    rows = [*QUERY_SET, (5, "\n".join(QUERY2_LINES))]
    return as_queries(spark.createDataFrame(rows, "id long, t string"), "id", "t")


def test_key_counts(refs):
    keys = explode_kmers(refs, K, ["ref_id"]).groupBy("ref_id").agg(
        F.count("*").alias("n"), F.countDistinct("seq").alias("d")
    )
    assert {tuple(r) for r in keys.collect()} == {(1, 206, 112), (2, 154, 102)}


def test_query_key_counts(queries):
    counts = {r["query_id"]: r["count"] for r in query_keys(queries, K).groupBy("query_id").count().collect()}
    assert counts == {1: 7, 2: 26, 3: 15, 4: 17, 5: len(QUERY2) - K + 1}


def found_diagonals(refs, queries, **how):
    seeds = seed_hits(query_keys(queries, K), postings(refs, K), **how)
    return {
        (r["query_id"], r["ref_id"], r["end_pos"]): r["hits"]
        for r in diagonal_counts(seeds).collect()
    }


def test_diagonals_listed(refs, queries):
    frequent = {k: v for k, v in found_diagonals(refs, queries).items() if v > 5}
    common = {(344, 33), (258, 25), (301, 20), (318, 11), (311, 10), (268, 10), (354, 10)}
    assert {(e, h) for (q, r, e), h in frequent.items() if q == 5 and r == 2} == common
    assert {(e, h) for (q, r, e), h in frequent.items() if q == 5 and r == 1} == common
    assert {(q, e, h) for (q, r, e), h in frequent.items() if q < 5 and r == 2} == {
        (1, 55, 7), (1, 81, 7), (2, 55, 26), (2, 81, 16), (4, 163, 17), (4, 153, 10), (4, 173, 7)
    }
    assert {(q, e, h) for (q, r, e), h in frequent.items() if q < 5 and r == 1} == {
        (1, 55, 7), (1, 81, 7), (1, 192, 7), (2, 55, 26), (2, 81, 16), (2, 192, 16), (2, 218, 13),
        (4, 163, 17), (4, 153, 10), (4, 173, 7)
    }


@pytest.mark.parametrize("broadcast_keys,share", [(None, None), (False, None), (False, 20), (False, 3)])
def test_diagonals_by_definition(refs, queries, broadcast_keys, share):
    how = {"broadcast_keys": broadcast_keys}
    if share:
        how["hot"] = hot_keys(entry_counts(postings(refs, K)), share)
    expected = {}
    for q, text in [(i, t.upper()) for i, t in QUERY_SET] + [(5, QUERY2)]:
        for r, ref in ((1, EXAMPLE), (2, EXAMPLE2)):
            expected |= {(q, r, e): h for e, h in diagonals(text, ref, K).items()}
    assert found_diagonals(refs, queries, **how) == expected


def test_candidates_and_identity(spark, refs, queries):
    found = find_candidates(queries.filter("query_id < 5"), refs.filter("ref_id = 2"))
    lengths = queries.select("query_id", "length")
    windows = with_query_text(
        fetch_windows(found.join(lengths, "query_id"), build_content(refs, 50), 50), queries
    )
    rows = {
        (r["query_id"], r["end_pos"], r["hits"]): r["identity"]
        for r in ungapped_identity(windows).collect()
    }
    assert rows == {(2, 55, 26): 1.0, (2, 81, 16): pytest.approx(26 / 36), (4, 163, 17): 1.0}
    texts = {(r["query_id"], r["end_pos"]): r["window"] for r in windows.collect()}
    assert texts[(2, 81)] == "QRSTUVWXYZABCDEFGHIJKLMNOPQRSTUVWXYZ"
    missing = unmatched_queries(queries.filter("query_id < 5"), found)
    assert {r["query_id"] for r in missing.collect()} == {1, 3}


def test_search_reports_positions_and_scores(refs, queries):
    rows = search(queries, refs).collect()
    exact = {(r["query_id"], r["ref_id"], r["ref_start"], r["ref_end"]) for r in rows if r["score"] == 1.0}
    assert exact == {(2, 1, 20, 55), (2, 2, 20, 55), (4, 1, 137, 163), (4, 2, 137, 163)}
    # The long query fits nowhere as a whole.
    assert all(r["query_id"] != 5 for r in rows)


def test_threshold_five_finds_query_one(refs, queries):
    rows = search(queries.filter("query_id = 1"), refs, SearchOptions(threshold=5)).collect()
    assert {(r["ref_id"], r["ref_end"], r["score"]) for r in rows} == {
        (1, 55, 1.0), (1, 81, 1.0), (1, 192, 1.0), (2, 55, 1.0), (2, 81, 1.0)
    }


def test_adaptive_threshold(refs, queries):
    few = queries.filter("query_id < 5")
    # Mean length 26.25, a quarter of it rounded down is 6.
    rows = find_candidates(few, refs.filter("ref_id = 2"), SearchOptions(threshold="adaptive"))
    assert {(r["query_id"], r["end_pos"]) for r in rows.collect()} == {
        (1, 55), (1, 81), (2, 55), (2, 81), (4, 163), (4, 153), (4, 173)
    }


@pytest.mark.parametrize("block_size,group", [(10, 7), (50, 100), (1000, 100_000)])
def test_stored_reference_gives_the_same(spark, refs, queries, tmp_path, block_size, group):
    build_reference(refs, str(tmp_path), "toy", K, block_size, group, parts=4)
    stored = open_reference(spark, str(tmp_path), "toy")
    options = SearchOptions(threshold=5)
    assert sorted(search_reference(queries, stored, options).collect()) == sorted(
        search(queries, refs, options).collect()
    )


def test_index_under_another_name(spark, refs, queries, tmp_path):
    build_reference(refs, str(tmp_path), "a", 11, parts=4)
    build_reference(refs, str(tmp_path), "b", 8, parts=2, index_only=True)
    both = open_reference(spark, str(tmp_path), "a", "b")
    assert both.k == 8
    options = SearchOptions(k=8, threshold=5)
    assert sorted(search_reference(queries, both, options).collect()) == sorted(
        search(queries, refs, options).collect()
    )


def test_extension_keeps_exact_hits(refs, queries):
    rows = search(queries, refs, SearchOptions(extension=6)).collect()
    plain = {(r["query_id"], r["ref_id"], r["end_pos"]) for r in search(queries, refs).collect()}
    assert {(2, 1, 55), (4, 1, 163)} <= {(r["query_id"], r["ref_id"], r["end_pos"]) for r in rows}
    assert plain


def test_overhang(spark):
    # The reference ends inside the query, and another query begins before the reference.
    ref = as_references(spark.createDataFrame([(1, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")], "id long, t string"), "id", "t")
    queries = as_queries(
        spark.createDataFrame([(1, "MNOPQRSTUVWXYZ123456"), (2, "12345ABCDEFGHIJKLM")], "id long, t string"),
        "id", "t",
    )
    found = find_candidates(queries, ref, SearchOptions(k=5, threshold=2))
    placed = found.join(queries.select("query_id", "length"), "query_id")
    windows = with_query_text(fetch_windows(placed, build_content(ref, 10), 10), queries)
    got = {r["query_id"]: r for r in windows.collect()}
    assert got[1]["window"] == "MNOPQRSTUVWXYZ      " and got[1]["missing"] == 6
    assert (got[1]["ref_start"], got[1]["ref_end"], got[1]["overhang"]) == (12, 25, True)
    assert got[2]["window"] == "ABCDEFGHIJKLM" and got[2]["lead"] == 5 and got[2]["ref_start"] == 0
    padded = {r["query_id"]: r["score"] for r in align_candidates(windows, min_score=None).collect()}
    assert padded == {
        1: pytest.approx(14 / 20), 2: slow_align("ABCDEFGHIJKLM", "12345ABCDEFGHIJKLM")[0]
    }
    clipped = with_query_text(fetch_windows(placed, build_content(ref, 10), 10, pad=False), queries)
    rows = {r["query_id"]: r for r in align_candidates(clipped, pad=False).collect()}
    assert rows[1]["score"] == rows[2]["score"] == 1.0
    assert rows[1]["aligned_query"] == "MNOPQRSTUVWXYZ"
    assert rows[2]["aligned_query"] == "ABCDEFGHIJKLM"
    identity = {r["query_id"]: r["identity"] for r in ungapped_identity(windows).collect()}
    assert identity == {1: pytest.approx(14 / 20), 2: 1.0}
