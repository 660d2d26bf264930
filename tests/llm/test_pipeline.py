"""The stages and queries on the given tables, against plain Python."""

import os
import zlib

import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from seedlane.plans.layout import settled
from test_mixing import chance, poisson_inverse
from test_simhash import plain_components

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in pipeline.STAGES:
        seen[name] = docs.collect()
        docs = settled(stage(spark, docs, SF))
        if name != "packing":
            assert docs.columns == columns
    texts = {r.doc_id: r.text for r in seen["toxicity"]}
    rows = {n: [(r.doc_id, r.text) for r in kept] for n, kept in seen.items()}
    assert set(rows["quality"]) < set(rows["toxicity"]) and set(rows["near_duplicates"]) < set(rows["quality"])
    groups = plain_components(rows["near_duplicates"])
    assert sorted(i for i, _ in rows["mixing"]) == sorted({c for _, _, c in groups})
    sources = [r.source for r in seen["mixing"]]
    weights = {s: sources.count(s) ** 0.5 for s in set(sources)}
    rate = {s: weights[s] * len(sources) / sum(weights.values()) / sources.count(s) for s in weights}
    wanted = sorted(r.doc_id for r in seen["mixing"] for _ in range(poisson_inverse(chance(r.doc_id, r.source), rate[r.source])))
    assert sorted(i for i, _ in rows["packing"]) == wanted
    assert all(texts[i] == t for i, t in rows["packing"])
    pieces = docs.collect()
    assert sum(r.start == 0 for r in pieces) == len(wanted)
    assert sorted(r.doc_id for r in pipeline.run(spark, SF).collect()) == sorted(r.doc_id for r in pieces)


def test_folds_and_rows_of_queries(spark):
    from seedlane.llm.queries import QUERIES

    ids = sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    assert set(QUERIES) <= set(entry.queries())
    for name, parts, out in (("op3_lm_scores", 7, 2), ("op5_language", 3, 1), ("op6_quality", 3, 1), ("op9_toxicity", 4, 2)):
        got = QUERIES[name](spark, SF).select("doc_id", "held_out").collect()
        assert sorted(r.doc_id for r in got) == ids
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == out) for r in got)
