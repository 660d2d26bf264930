import random

import numpy as np
import pytest
import xxhash

from cases import TEXTS, documents, nothing
from seedlane.llm import simhash as S
from seedlane.llm.components import connected_components


def plain_bits(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    runs = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, linked):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_components(rows):
    bits = [plain_bits(t) for _, t in rows]
    close = [(i, j) for i in range(len(rows)) for j in range(i) if (bits[i] ^ bits[j]).bit_count() <= 3]
    root = roots(range(len(rows)), close)
    out = []
    for k, (doc_id, _) in enumerate(rows):
        ids = [i for j, (i, _) in enumerate(rows) if root[j] == root[k] and i is not None]
        out.append((doc_id, "%016x" % bits[k], min(ids, default=None)))
    return sorted(out, key=str)


def result(df):
    found = S.near_duplicates(df).select("doc_id", "fingerprint", "component_id").collect()
    return sorted(map(tuple, found), key=str)


def test_equals_plain_python(spark):
    assert result(documents(spark).repartition(4)) == plain_components([(i, t) for i, t, _, _ in TEXTS])


def test_group_of_near_copies(spark):
    draw = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[:draw.randint(50, 60)] + [draw.choice(words)])) for i in range(150)]
    rows += [(1000 + i, " ".join(draw.choices(words, k=30))) for i in range(50)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == plain_components(rows)


@pytest.mark.parametrize("tile,stream", [(4096, 65536), (3, 5)])
def test_links_connect_all_that_is_close(spark, monkeypatch, tile, stream):
    monkeypatch.setattr(S, "TILE", tile)
    monkeypatch.setattr(S, "STREAM", stream)
    random_ = np.random.default_rng(1)
    bits = {0, 2**64 - 1, *random_.integers(0, 2**63, 40, dtype=np.uint64).tolist()}
    for _ in range(160):
        bits.add(sorted(bits)[int(random_.integers(len(bits)))] ^ (1 << int(random_.integers(64))) ^ (1 << int(random_.integers(64))))
    bits = sorted(bits)
    signed = [(b - 2**64 if b >= 2**63 else b,) for b in bits]
    found = [(r.a % 2**64, r.b % 2**64) for r in S.links(spark.createDataFrame(signed, "bits long")).collect()]
    assert all((a ^ b).bit_count() > 0 for a, b in found)
    near = [(a, b) for a in bits for b in bits if a < b and (a ^ b).bit_count() <= 3]
    assert roots(bits, found) == roots(bits, near)


def test_one_of_each_group_stays(spark):
    docs = documents(spark)
    kept = S.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted([r.doc_id for r in kept.select("doc_id").collect()], key=str)
    groups = {c for _, _, c in plain_components([(i, t) for i, t, _, _ in TEXTS])}
    assert ids == sorted(groups, key=str)
    again = spark.createDataFrame([(7, "same text twice")] * 3 + [(None, "no id")] * 2, "doc_id long, text string")
    assert sorted([r.doc_id for r in S.drop_near_duplicates(again).collect()], key=str) == [7, None]


def test_empty_table(spark):
    assert S.near_duplicates(nothing(spark)).count() == 0
    assert S.drop_near_duplicates(nothing(spark)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(500, 600), (600, 500), (700, 700), (800, 400), (400, 900)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges for x in e}
    assert found == {n: r for n, r in roots(nodes, edges).items() if n != r}
