import numpy as np
from pyspark.sql import functions as F

from seedlane.llm import neighbours as N


def unit(v):
    v = np.array(v) / np.abs(v).max()
    return v / np.linalg.norm(v)


def plain(rows, asked, k=5):
    fine = {(i, tuple(v)) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in fine:
        if asked(i):
            a = unit(v)
            best = {}
            for j, w in fine:
                if j != i:
                    best[j] = max(best.get(j, -2), float(a @ unit(w)))
            out[i] = sorted(((-round(s, 10), j) for j, s in best.items()))[:k]
    return out


def check(spark, rows, asked, query, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS leaf", "2 AS ids")
    got = {}
    for r in N.nearest_neighbours(df, query, **options).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for found in got.values():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, len(found) + 1))
    return {q: [(-round(s, 10), i) for _, i, s in found] for q, found in got.items()}, plain(rows, asked)


def test_exact_on_a_small_table_with_odd_vectors(spark):
    draw = np.random.default_rng(3)
    rows = [(i, draw.normal(size=4).tolist()) for i in range(60)]
    rows += [(100 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(30)] + [(150, [2.0, 4.0, 6.0, 8.0])]
    rows += [(200, None), (250, [0.0] * 4), (300, [1.0, None, 0.0, 0.0]), (350, [float("nan")] * 4),
             (400, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.0]), (50, rows[50][1]), (500, [1e-200] * 4)]
    got, wanted = check(spark, rows, lambda i: i % 50 == 0, F.col("vec_id") % 50 == 0)
    assert got == wanted and set(got) == {0, 50, 100, 150, 500}


def test_few_and_no_candidates(spark):
    got, wanted = check(spark, [(0, [1.0]), (1, [2.0]), (2, [-1.0])], lambda i: i == 0, F.col("vec_id") == 0)
    assert got == wanted == {0: [(-1.0, 1), (1.0, 2)]}
    assert check(spark, [(0, [1.0])], lambda i: True, F.col("vec_id") == 0)[0] == {}
    assert check(spark, [(0, None)], lambda i: True, F.col("vec_id") == 0)[0] == {}


def test_ids_with_many_near_vectors(spark):
    """Eight vectors of one id take one place."""
    draw = np.random.default_rng(8)
    rows = [(0, [1.0, 0.0, 0.0, 0.0])] + [(7, [1.0, 0.001 * j, 0.0, 0.0]) for j in range(1, 9)]
    rows += [(20 + i, [1.0, *draw.normal(0, 1, 3).tolist()]) for i in range(20)]
    got, wanted = check(spark, rows, lambda i: i == 0, F.col("vec_id") == 0)
    assert got == wanted and len(got[0]) == 5


def test_pieces_and_small_leaves(spark, monkeypatch):
    monkeypatch.setattr(N, "PIECE", 7)
    draw = np.random.default_rng(5)
    rows = [(i, draw.normal(size=6).tolist()) for i in range(300)]
    got, wanted = check(spark, rows, lambda i: i % 10 == 0, F.col("vec_id") % 10 == 0, leaf=20, share=1.0, trees=3)
    assert got == wanted


def test_recall_of_a_forest(spark):
    draw = np.random.default_rng(7)
    centres = draw.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + 0.3 * draw.normal(size=16)).tolist()) for i in range(4000)]
    got, wanted = check(spark, rows, lambda i: i % 50 == 0, F.col("vec_id") % 50 == 0, leaf=64, sample=2000)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in wanted[q]}) for q in wanted)
    assert hits >= 0.9 * 5 * len(wanted)
