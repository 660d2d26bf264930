import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seedlane.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, id int, block string, part int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, "x", 2) for i, v, lab in rows], SCHEMA)


def plain(rows, every, positives=5, negatives=10, least=30, most=90):
    kept = {}
    for i, v, lab in rows:
        if i is None or v is None or lab is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own = (lab, [math.floor(256 * x) for x in v])
        kept[i] = min(kept.get(i, own), own)
    out = []
    for a, (lab, v) in kept.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, m) for i, (m, w) in kept.items() if i != a and len(w) == len(v))
        for ps, p, _ in [s for s in scored if s[2] == lab][:positives]:
            hard = [s for s in scored if s[2] != lab and least * -ps <= 100 * -s[0] <= most * -ps][:negatives]
            out += [(a, p, rank, i, -ps, -s) for rank, (s, i, _) in enumerate(hard, 1)]
    return sorted(out)


def result(df, every):
    return sorted(map(tuple, H.hard_negatives(df, F.col("id") % every == 0).collect()))


def sample(n, size, seed=1, clusters=12):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(clusters, size))
    own = rng.integers(clusters, size=n)
    vectors = middles[own] + 0.5 * rng.normal(size=(n, size)) * rng.uniform(0.2, 2, size=(n, 1))
    return [(int(i), [float(x) for x in v], int((c + rng.integers(2)) % 5)) for i, (v, c) in enumerate(zip(vectors, own))]


def test_equals_plain_python(spark):
    rows = sample(600, 6)
    expected = plain(rows, 20)
    assert expected and result(frame(spark, rows).repartition(4), 20) == expected


@pytest.mark.parametrize("leaf,fanout,block", [(4, 3, 40), (1, 2, 1000), (16, 32, 10)])
def test_small_trees_and_blocks(spark, monkeypatch, leaf, fanout, block):
    monkeypatch.setattr(H, "LEAF", leaf)
    monkeypatch.setattr(H, "FANOUT", fanout)
    monkeypatch.setattr(H, "BLOCK_ROWS", block)
    monkeypatch.setattr(H, "LABELS", 3)
    rows = sample(400, 3, seed=leaf)
    assert result(frame(spark, rows), 25) == plain(rows, 25)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = sample(60, 3) + [
        (100, None, 1), (101, [1.0, None, 2.0], 1), (102, [nan, 1.0, 1.0], 1), (103, [inf, 1.0, 1.0], 2), (104, [1.0, 1.0, 1.0], None),
        (None, [1.0, 1.0, 1.0], 1), (105, [], 1), (110, [], 1), (120, [], 2), (106, [0.0, 0.0, 0.0], 1), (130, [1.0, 2.0], 3), (131, [1.0, 2.0], 3),
        (132, [1.0, 1.0], 4), (140, [0.0, 0.0, 0.0], 3), (7, [9.0, 9.0, 9.0], 4), (8, [1.0, 1.0, 1.0], 1), (8, [1.0, 1.0, 1.0], 1),
    ]
    assert result(frame(spark, rows), 10) == plain(rows, 10)
    assert result(frame(spark, []), 10) == []
    assert result(frame(spark, rows).filter("label is null"), 10) == []


def test_ties_and_copies(spark):
    rows = [(i, [1.0, 0.5], i % 3) for i in range(300)] + [(1000 + i, [0.8, 0.2], i % 2) for i in range(30)]
    assert result(frame(spark, rows), 50) == plain(rows, 50)


def test_large_components_are_exact():
    rng = np.random.default_rng(3)
    vectors = rng.integers(-(2**30), 2**30, size=(20, 4))
    anchor = rng.integers(-(2**30), 2**30, size=4)
    expected = [sum(int(x) * int(y) for x, y in zip(v, anchor)) for v in vectors]
    assert H.scores(vectors, anchor).tolist() == expected
    huge = np.full((1, 4), 2**62)
    assert H.scores(huge, huge[0]).tolist() == [2**63 - 1]


@pytest.mark.parametrize("size", [2, 5, 20])
def test_tree(monkeypatch, size):
    monkeypatch.setattr(H, "LEAF", 8)
    rng = np.random.default_rng(size)
    vectors = np.floor(256 * rng.normal(size=(700, size)) * rng.uniform(0.1, 3, size=(700, 1))).astype(np.int64)
    tree = H.CoverTree(vectors)
    assert sorted(tree.order.tolist()) == list(range(700))
    points = tree.points
    for node, kids in enumerate(tree.children):
        start, stop = tree.span[node]
        away = np.sqrt(((points[tree.order[start:stop]] - points[tree.centre[node]]) ** 2).sum(axis=1))
        assert away.max() <= tree.radius[node] + 1e-6
        centres = points[[tree.centre[k] for k in kids]]
        if len(kids) > 1:
            apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2))[~np.eye(len(kids), dtype=bool)]
            # As far apart as the radius they leave.
            assert apart.min() >= max(tree.radius[k] for k in kids) - 1e-6
    for anchor in vectors[:20]:
        low, high = tree.bounds(anchor)
        exact = vectors[tree.order] @ anchor
        for node, (start, stop) in enumerate(tree.span):
            assert low[node] <= exact[start:stop].min() and exact[start:stop].max() <= high[node]


def test_clustered_vectors_need_few_leaves(monkeypatch):
    monkeypatch.setattr(H, "LEAF", 32)
    rng = np.random.default_rng(4)
    vectors = np.floor(256 * (8 * rng.normal(size=(60, 6))[rng.integers(60, size=6000)] + 0.1 * rng.normal(size=(6000, 6)))).astype(np.int64)
    block = H.Block(np.arange(6000), np.zeros(6000, np.int64), vectors)
    met, real = [], block.scores
    monkeypatch.setattr(block, "scores", lambda a, b, *more: met.append(b - a) or real(a, b, *more))
    for k in range(30):
        got = block.search(vectors[k], k, 0, True, [(-(2**63), 2**63 - 1)], 5)
        exact = sorted((-int(s), i) for i, s in enumerate(vectors @ vectors[k]) if i != k)[:5]
        assert got[0] == [(-s, i) for s, i in exact]
    assert sum(met) < 0.2 * 30 * 6000
