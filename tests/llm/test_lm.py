import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import TEXTS, documents, nothing
from seedlane.llm import lm as L

HELD = "coalesce(doc_id % 3 = 1, false)"


def held(doc_id):
    return doc_id is not None and math.fmod(doc_id, 3) == 1


@pytest.mark.parametrize("dictionary", [200_000, 3])
def test_base_scores_equal_plain_python(spark, dictionary):
    counts, END = Counter(), object()
    for i, t, _, _ in TEXTS:
        if not held(i):
            counts.update([*(t or "").encode().lower().split(), END])
    n, v = sum(counts.values()), len(counts)
    wanted = []
    for i, t, _, _ in TEXTS:
        words = [*(t or "").encode().lower().split(), END]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        wanted.append((i, held(i), len(words), sum(counts[w] > 0 for w in words), n, round(base, 6)))
    got = L.score_texts(documents(spark), F.expr(HELD), dictionary=dictionary).collect()
    assert sorted([(*r[:5], round(r.base_score, 6)) for r in got], key=str) == sorted(wanted, key=str)
    assert all(r.score < 0 for r in got)


def test_probabilities_add_up_to_one(spark):
    """Over all words seen and one unseen word per class, after any context."""
    docs = spark.createDataFrame([(i, f"a b c{i % 5} d{i % 50} a") for i in range(200)], "doc_id long, text string")
    counts = L.word_counts(docs.select(L.raw_text().alias("text")))
    vocabulary = L.gather_vocabulary(counts, 200)
    model = L.train_model(docs.select("doc_id", L.raw_text().alias("text")), F.col("doc_id"), vocabulary, 2)
    scorer = L.Scorer(model)
    k = vocabulary.classes
    for context in ([0, 1], [k - 1, k - 1], [2, vocabulary.own]):
        logs = scorer(np.tile(context, (k, 1)), np.arange(k))
        assert (10**logs).sum() == pytest.approx(1, abs=1e-4)
    known = {w: n for w, n in ((bytes(r["word"]), r["n"]) for r in counts.collect())}
    assert sum(known.values()) + 200 == vocabulary.tokens and len(known) + 1 == vocabulary.distinct
    inside = np.ones(L.OTHERS)
    for w, n in known.items():
        if vocabulary.numbers.get(w, 1 << 60) >= vocabulary.own:
            inside[L.other_class(w)] += n + 1
    assert inside.tolist() == vocabulary.rest.tolist()


def test_learns_what_follows(spark):
    rows = [(i, " ".join(["red car", "blue sky", "green grass"][(i * j) % 3] for j in range(60))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    got = L.score_texts(docs, F.col("doc_id") % 5 == 2).filter("held_out").collect()
    assert len(got) == 60
    assert sum(r.score for r in got) > 0.9 * sum(r.base_score for r in got)


def test_frequent_runs_count_by_their_share():
    """One run is a third of all tokens, the others occur once each, also after its context."""
    draw, k = np.random.default_rng(2), 500
    contexts = np.r_[np.full((401, 2), 5), draw.integers(10, k, (100_000, 2))]
    targets = np.r_[7, np.arange(20, 420), draw.integers(10, k, 100_000)]
    weights = np.r_[50_000.0, np.ones(100_400)]
    share = np.bincount(targets, weights, k) + 0.5
    share /= share.sum()
    d = L.DIMENSIONS
    model = L.Model(draw.normal(0, 0.3, (k, d)), draw.normal(0, 0.1, (k, d)), np.ones((2, d)), np.log(share))
    L.train_steps(model, contexts, targets, weights, share, [np.full(p.shape, 1e-4) for p in model], draw)
    logs = L.Scorer(model)(np.full((1, 2), 5), np.array([7]))
    assert 10 ** logs[0] > 0.8  # 50 000 of 50 400


def test_no_training_text_and_empty_table(spark):
    got = L.score_texts(documents(spark), F.lit(True)).collect()
    assert len(got) == len(TEXTS) and {r.train_tokens for r in got} == {0} == {r.n_known for r in got}
    assert L.score_texts(nothing(spark), F.expr(HELD)).count() == 0
