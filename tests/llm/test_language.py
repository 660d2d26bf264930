import random

import numpy as np
from pyspark.sql import functions as F

from cases import TEXTS, documents, nothing
from seedlane.llm import language as L


def made(spark, n=120):
    draw = random.Random(2)
    parts = {"aa": ["ba", "bo", "bi", "bu"], "bb": ["ka", "lo", "mi", "nu"], "cc": ["zé", "ño", "wü", "xx"]}
    rows = [(i, " ".join("".join(draw.choices(parts[k], k=draw.randint(1, 4))) for _ in range(40)), k)
            for i in range(n) for k in [draw.choice(sorted(parts))]]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(spark):
    rows, docs = made(spark)
    filters = L.train_language(docs.filter("doc_id < 80"))
    got = {r.doc_id: r for r in L.predict_language(docs.filter("doc_id >= 80"), filters).collect()}
    assert all(got[i].lang_pred == k and 0 <= got[i].score <= 1 for i, _, k in rows[80:])


def test_counts_equal_plain_python(spark, monkeypatch):
    rows, docs = made(spark, 30)
    filters = L.train_language(docs)
    texts = [f" {t}   ".encode() for _, t, _ in rows]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([0] + [len(t) for t in texts])
    monkeypatch.setattr(L, "CHUNK", 101)
    found, total = filters.counts(data, ends)
    for k, text in enumerate(texts):
        folded = bytes(L.FOLDED[list(text)])
        codes = np.array([int.from_bytes(folded[i:i + 4], "little") for i in range(len(text) - 3)])
        masks = np.bitwise_and.reduce([filters.masks[0][p] for p in L.slots(codes)])
        assert total[k] == len(codes)
        assert found[k].tolist() == [int((masks >> np.uint64(b) & np.uint64(1)).sum()) for b in range(3)]


def test_more_languages_than_bits_of_a_word(spark):
    rows = [(i, f"{chr(97 + i // 10)}{chr(97 + i % 10)}qx" * 30, f"l{i:03d}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = L.train_language(docs)
    assert filters.masks.shape[0] == 2
    got = {r.doc_id: r.lang_pred for r in L.predict_language(docs, filters).collect()}
    assert sum(got[i] == k for i, _, k in rows) >= 95


def test_edges(spark):
    docs = documents(spark)
    filters = L.train_language(docs)
    got = L.predict_language(docs, filters).collect()
    assert len(got) == len(TEXTS) and {r.lang_pred for r in got} <= {"en", "de", "fr", "und"}
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (4, 5, 6, -5))
    assert by[7].lang_pred == "fr" and by[11].lang_pred == "en"
    nobody = L.train_language(docs.filter(F.lit(False)))
    assert {r.lang_pred for r in L.predict_language(docs, nobody).collect()} == {"und"}
    assert L.predict_language(nothing(spark), filters).count() == 0
    only = spark.createDataFrame([(1, "漢字")], "doc_id long, text string")
    assert L.predict_language(only, filters).first().lang_pred != "und"
