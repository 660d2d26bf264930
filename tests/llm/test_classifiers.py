import math
import pickle
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import TEXTS, documents, nothing
from seedlane.llm import quality as Q
from seedlane.llm import toxicity as X


def made(spark, mark, n=400):
    """Texts of which a third are marked; two labels in a hundred are wrong."""
    draw = random.Random(6)
    words = ["".join(draw.choices("abcdefghij", k=5)) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        text = draw.choices(words, k=draw.randint(20, 80))
        rows.append((i, mark(text, draw) if bad else " ".join(text)))
        labels.append((i, int(bad != (i % 50 == 7))))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, label int"), n


def insult(text, draw):
    for _ in range(draw.randint(2, 5)):
        text.insert(draw.randrange(len(text)), draw.choice(["Nasty!", "vile", "rotten"]) if draw.random() < 0.7 else "foulx" + draw.choice("abc"))
    return " ".join(text)


def spoil(text, draw):
    return " ".join(w + draw.choice(["%%%", "###"]) for w in text)


def test_toxicity_on_held_out_texts(spark):
    docs, labels, n = made(spark, insult)
    model = X.train_toxicity(docs, labels, "label", F.col("doc_id") < 300)
    got = {r.doc_id: r for r in X.score_toxicity(docs.filter("doc_id >= 300"), model).collect()}
    right = sum((got[i].score >= X.THRESHOLD) == (i % 3 == 0) == (got[i].predicted == 1) for i in range(300, n))
    assert right >= 98 and all(0 <= r.score <= 1 for r in got.values())
    kept = {r.doc_id for r in X.drop_toxic(docs, model).collect()}
    assert kept == {r.doc_id for r in X.score_toxicity(docs, model).collect() if not r.predicted}


def made_index(draw, examples, chance, counts=4):
    """An index of random examples, and their vectors by brute force."""
    terms = [np.flatnonzero(draw.random(len(chance)) < chance) for _ in range(examples)]
    numbers = [draw.integers(1, counts, len(t)) for t in terms]
    weight = draw.uniform(0.1, 5, len(chance))
    index = X.BlockMaxIndex(
        np.arange(examples) * 2, draw.integers(0, 2, examples), np.r_[0, np.cumsum([len(t) for t in terms])],
        np.concatenate(terms).astype(np.int32), np.concatenate(numbers).astype(np.int32), weight).built()
    dense = np.zeros((examples, len(chance)))
    for row, (t, n) in enumerate(zip(terms, numbers)):
        dense[row, t] = (1 + np.log(n)) * weight[t]
    return index, dense / np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-300), list(zip(terms, numbers))


@pytest.mark.parametrize("seed", range(4))
def test_nearest_examples_are_exact(seed, monkeypatch):
    """Frequent and rare terms, examples without any, many ties, postings in several parts."""
    monkeypatch.setattr(X, "TOGETHER", 7)
    monkeypatch.setattr(X, "POSTINGS", 50)
    draw = np.random.default_rng(seed)
    chance = [np.r_[np.full(4, 0.5), np.full(300, 0.01)], np.full(30, 0.05), np.full(400, 0.01), np.full(60, 0.4)][seed]
    index, dense, texts = made_index(draw, 700, chance, counts=2 if seed == 1 else 4)
    assert (index.column >= 0).sum() == [4, 30, 0, 60][seed] or seed in (1, 2)
    for but in (None, index.ids.tolist()):
        for i, (best, score) in enumerate(index.nearest_each(texts, 15, but)):
            cosine = np.round(dense @ dense[i], 12)
            if but is not None:
                cosine[i] = -1
            wanted = np.lexsort((np.arange(700), -np.round(cosine, 9)))[:15]
            wanted = wanted[cosine[wanted] > 0]
            assert np.allclose(score, cosine[wanted], atol=1e-9)
            assert np.allclose(cosine[best], score, atol=1e-9) and len(set(best.tolist())) == len(best)
            assert (np.diff(score) <= 0).all()
            assert all(x < y for x, y, tied in zip(best, best[1:], np.diff(score) == 0) if tied)


def test_blocks_beyond_the_bound_are_skipped(monkeypatch):
    """Texts of one of eight vocabularies leave the blocks of the others untouched."""
    draw = np.random.default_rng(2)
    chance = np.full((8, 40), 0.3)
    rows = [(np.flatnonzero(draw.random(40) < chance[i % 8]) + 40 * (i % 8)) for i in range(2048)]
    starts = np.r_[0, np.cumsum([len(t) for t in rows])]
    monkeypatch.setattr(X, "COMMON", 100)
    index = X.BlockMaxIndex(np.arange(2048), np.zeros(2048, np.int8), starts, np.concatenate(rows), np.ones(starts[-1], int), np.ones(320)).built()
    assert index.matrix.shape == (32, 64, 320)
    possible = (index.block_max[:, :40].max(axis=1) > 0).sum()
    assert possible <= 8
    again = pickle.loads(pickle.dumps(index))
    best, score = again.nearest(rows[0], np.ones(len(rows[0]), int), 15)
    assert best[0] == 0 and score[0] == 1 and (best % 8 == 0).all()


def test_every_score_and_evidence_by_brute_force(spark):
    """Weights, votes, calibration and evidence of every document against plain TF-IDF."""
    docs, labels, n = made(spark, insult)
    docs = docs.unionByName(spark.createDataFrame([(n, None), (n + 1, ""), (n + 2, "!!!"), (n + 3, "qqqq")], docs.schema))
    model = X.train_toxicity(docs, labels, "label", F.col("doc_id") < 300)
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    label = {r.doc_id: r.label for r in labels.collect() if r.doc_id < 300}

    def counts(text):
        words, found = X.words_of(text), {}
        for w in words:
            for t in (w, b"^" + w[:5])[:1 + (len(w) > 5)]:
                found[t] = found.get(t, 0) + 1
        return found

    each = {i: counts(t) for i, t in texts.items()}
    # Equal texts are one example, that of the smallest id.
    examples = sorted({t: i for i, t in sorted(texts.items(), reverse=True) if i in label}.values())
    rate = sum(label[i] for i in examples) / len(examples)
    weight, alone = {}, set()
    for term in {t for i in examples for t in each[i]}:
        idf = math.log((1 + len(texts)) / (1 + sum(term in c for c in each.values()))) + 0.01
        with_it = [label[i] for i in examples if term in each[i]]
        off = abs(sum(with_it) - len(with_it) * rate) / math.sqrt(len(with_it) * rate * (1 - rate))
        weight[term] = idf * (1 + (4 * rate / (1 - rate) * max(0, off - 2) ** 2 / len(with_it) if len(with_it) >= 3 else 0))
        if len(with_it) == 1:
            alone.add(term)

    def vector(found, but=frozenset()):
        out = {t: (1 + math.log(c)) * weight[t] for t, c in found.items() if t in weight and t not in but}
        length = math.sqrt(sum(v * v for v in out.values()))
        return {t: v / length for t, v in out.items()}

    vectors = {i: vector(each[i]) for i in examples}

    def nearest(own, but=None):
        found = [(sum(v * own.get(t, 0) for t, v in vectors[i].items()), i) for i in examples if i != but]
        return sorted((-round(s, 10), i) for s, i in found if s > 0)[:15]

    def vote(near):
        shares = [(1 / (1.05 + s), label[i]) for s, i in near]
        return sum(w * y for w, y in shares) / sum(w for w, _ in shares)

    left = [(vote(near), label[i]) for i in examples if (near := nearest(vector(each[i], alone), i))]
    x, y = X.isotonic(np.round([v for v, _ in left], 9), np.array([l for _, l in left]))
    got = {r.doc_id: r for r in X.score_toxicity(docs, model).collect()}
    assert set(got) == set(texts)
    for i, row in got.items():
        near = nearest(vector(each[i]))
        assert [e.cosine for e in row.evidence] == pytest.approx([-s for s, _ in near[:3]], abs=1e-9)
        assert [(e.doc_id, e.label) for e in row.evidence] == [(j, label[j]) for _, j in near[:3]]
        assert row.score == pytest.approx(float(np.interp(vote(near), x, y)) if near else rate, abs=1e-6)
        assert row.predicted == int(row.score >= 0.3)
    assert [got[n + k].evidence for k in range(4)] == [[]] * 4


def test_weights_keep_every_term():
    """Terms rise in weight with how surely they depend on the label, in either direction; none has weight 0."""
    n = np.array([1.0, 2, 3, 50, 50, 50, 1000])
    toxic = np.array([1.0, 2, 3, 50, 5, 0, 100])
    weight = X.term_weights(np.ones(7), n, toxic, 1000, 100)
    assert weight[0] == weight[1] == weight[4] == weight[6] == 1
    assert 1 + X.GAIN > weight[3] > weight[2] > 1 and weight[5] > 1
    assert (X.term_weights(np.ones(7), n, n, 1000, 1000) == 1).all()


def test_quality_on_held_out_texts(spark):
    docs, labels, n = made(spark, spoil)
    model = Q.train_quality(docs, labels.withColumn("label", 1 - F.col("label")), "label", F.col("doc_id") < 300)
    got = {r.doc_id: r for r in Q.score_quality(docs.filter("doc_id >= 300"), model).collect()}
    assert sum((got[i].predicted == 1) == (i % 3 != 0) == (got[i].score >= 0.5) for i in range(300, n)) >= 98
    kept = {r.doc_id for r in Q.drop_low_quality(docs, model).collect()}
    assert kept == {r.doc_id for r in Q.score_quality(docs, model).collect() if r.predicted}


def test_context_vectors_equal_plain_sums(spark):
    texts = ["a b c a", "b a", "", "x"]
    vectors = Q.context_vectors(spark.createDataFrame([(t,) for t in texts], "text string"))
    places, signs = Q.index_vectors(Q.WORDS, 1)
    want = np.zeros((Q.WORDS, Q.DIMENSIONS))
    for t in texts:
        rows, _ = Q.token_rows(t.encode(), Q.Shapes())
        for i, here in enumerate(rows):
            for j in range(max(0, i - Q.REACH), min(len(rows), i + Q.REACH + 1)):
                if i != j:
                    np.add.at(want[here], places[rows[j]], signs[rows[j]])
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-12)
    assert np.allclose(vectors[0], want)


def test_temperature_makes_probabilities(spark):
    draw = np.random.default_rng(0)
    true = draw.normal(0, 1.5, 20_000)
    labels = (draw.random(20_000) < 1 / (1 + np.exp(-true))).astype(float)
    temperature, bias = Q.fit_temperature(4 * true + 2, labels)
    assert temperature == pytest.approx(4, rel=0.1) and bias == pytest.approx(-0.5, abs=0.1)


@pytest.mark.parametrize("kind", ["toxicity", "quality"])
def test_edges(spark, kind):
    docs = documents(spark)
    ids = [(i, k % 2) for k, (i, *_) in enumerate(TEXTS)] + [(1, 1), (2, None)]
    labels = spark.createDataFrame(ids, "doc_id long, label int").selectExpr("*", "'x' AS text", "1 AS _id")
    train, score, drop = (
        (X.train_toxicity, X.score_toxicity, X.drop_toxic) if kind == "toxicity" else (Q.train_quality, Q.score_quality, Q.drop_low_quality))
    for some in (labels, labels.filter("label = 1"), labels.filter("false")):
        model = train(docs, some, "label")
        got = score(docs, model).collect()
        assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 for r in got)
        assert drop(docs, model).columns == docs.columns
        assert drop(docs, model).count() == sum(bool(r.predicted) == (kind == "quality") for r in got)
        assert score(nothing(spark), model).count() == 0 == drop(nothing(spark), model).count()
    train(nothing(spark), labels, "label")


def test_toxicity_terms_are_held_packed_on_the_driver(spark):
    docs, labels, n = made(spark, insult)
    model = X.train_toxicity(docs, labels, "label")
    assert model.numbers.found is None and model.index.order is None
    terms = sorted(set().union(*(X.terms_of(X.words_of(r.text.encode())) for r in docs.collect())))
    table, heads = pickle.loads(pickle.dumps(model.numbers)).tables()
    assert table == {t: i for i, t in enumerate(terms)} and len(model.numbers) == len(terms)
    assert heads == {t[1:]: i for t, i in table.items() if t[:1] == b"^"}
    assert X.Numbers.of(X.pa.array([], X.pa.binary())).tables() == ({}, {})


ODD = [b"", b"   ", b"\xff\xfe abcdefgh\x00abcdefgh Zz", b"a", b"!!!", "\u65e5\u672c\u8a9e the".encode()[:-5],
       b"^the the abcde abcdefg abcdezz", b"the\n\nThe\tand\x0bthe the", b"unheard-of", b"the " * 300]


@pytest.mark.parametrize("collide", [False, True])
def test_terms_of_many_texts_are_counted_at_once(monkeypatch, collide):
    """As text by text, in parts of few bytes, texts that are no valid UTF-8 among them; also if all hashes are equal."""
    monkeypatch.setattr(X, "LOOKED_UP", 20)
    if collide:
        monkeypatch.setattr(X, "hash", lambda word: 7, raising=False)
    known = sorted(set().union(*(X.terms_of(X.words_of(t)) for t in ODD if t != b"unheard-of")))
    number = {t: i for i, t in enumerate(known)}
    model = X.ToxicityModel(X.Numbers.of(X.pa.array(known, X.pa.binary())), np.ones(len(known)), None, np.zeros(1), np.zeros(1), 0.0)
    want = []
    for text in ODD * 2:
        found = {}
        for w in X.words_of(text):
            for t in (w, b"^" + w[:X.HEAD])[:1 + (len(w) > X.HEAD)]:
                if t in number:
                    found[number[t]] = found.get(number[t], 0) + 1
        want.append(sorted(found.items()))
    got = [list(zip(t.tolist(), c.tolist())) for t, c in model.counted(ODD * 2)]
    assert got == want and model.counted([]) == []
    assert model.numbers.found is None
    none = X.Numbers.of(X.pa.array([], X.pa.binary()))
    assert [n.tolist() for n in none.of_words([b"a", b"abcdefg"])] == [[-1, -1], [-1, -1]]


def test_a_searched_index_holds_each_posting_once():
    """Beside the matrix of frequent terms a task holds at most 16 bytes a posting: number, count, list."""
    draw = np.random.default_rng(4)
    index, _, texts = made_index(draw, 700, np.full(400, 0.04))
    again = pickle.loads(pickle.dumps(index)).built()
    held = sum(a.nbytes for name, a in vars(again).items() if isinstance(a, np.ndarray) and name not in ("matrix", "block_max"))
    small = 64 * (700 + 400)
    assert held <= 16 * index.starts[-1] + small
    for (a, b), (c, d) in zip(index.nearest_each(texts, 15), again.nearest_each(texts, 15)):
        assert a.tolist() == c.tolist() and b.tolist() == d.tolist()


def test_a_beginning_is_looked_up_once(monkeypatch):
    asked, look_up = [], X.Numbers._look_up
    monkeypatch.setattr(X.Numbers, "_look_up", lambda self, words, *more: asked.extend(words) or look_up(self, words, *more))
    numbers = X.Numbers.of(X.pa.array([b"^abcde", b"abcdefg", b"xyz"], X.pa.binary()))
    words, heads = numbers.of_words([b"abcdef", b"abcdefg", b"xyz", b"abcde", b"abcdeX", b"\xc3\xa4\xc3\xa4\xc3\xa4"])
    assert words.tolist() == [-1, 1, 2, -1, -1, -1] and heads.tolist() == [0, 0, -1, -1, 0, -1]
    assert asked.count(b"^abcde") == 1


def test_large_counts_weigh_as_small_ones_do():
    n = 3 * X.LOGS
    index = X.BlockMaxIndex(
        np.arange(2), np.array([0, 1], np.int8), np.array([0, 2, 4]), np.array([0, 1, 0, 2], np.int32), np.array([n, 1, 2, 5], np.int32),
        np.array([1.0, 2.0, 3.0]))
    best, score = index.nearest(np.array([0, 2]), np.array([n, 1]), 2)
    rows = np.array([[1 + np.log(n), 2, 0], [1 + np.log(2), 0, 3 * (1 + np.log(5))]])
    asked = np.array([1 + np.log(n), 0, 3])
    expected = rows @ asked / np.linalg.norm(rows, axis=1) / np.linalg.norm(asked)
    assert dict(zip(best.tolist(), score)) == pytest.approx(dict(enumerate(expected)), abs=1e-11)
