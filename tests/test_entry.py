"""Registered queries against their SQL on the smallest data."""

import pytest

import __spark_entry__ as entry
from check_oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert {q.__name__ for q in entry.REGISTERED} == set(entry._search_sql())


@pytest.mark.parametrize("name", [q.__name__ for q in entry.REGISTERED])
def test_query(spark, con, name):
    rows, _, _, difference = compare(spark, con, name, SF)
    # No page of the smallest table has a candidate.
    assert difference is None and (rows > 0 or name == "page_candidates")


@pytest.mark.parametrize("name,kind", [
    ("key_lookup_shuffled", "SortMergeJoin"), ("seed_hits_shuffled", "SortMergeJoin"), ("seed_lists_shuffled", "SortMergeJoin"),
    ("fetch_windows_shuffled", "SortMergeJoin"), ("alignments_shuffled", "SortMergeJoin"),
])
def test_shuffled_forms_shuffle(spark, name, kind):
    """What they are for is larger than a broadcast; at most tables bounded by their definition are."""
    df = entry.queries()[name](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert kind in final
    for row in final.splitlines():
        if "BroadcastHashJoin" in row:
            assert "_parts" in row or "LeftOuter" in row, row


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns[:4] == ["query_id", "ref_id", "end_pos", "hits"] and df.count() > 0
