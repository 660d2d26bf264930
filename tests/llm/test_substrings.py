import random
import re
from collections import Counter

import pytest

from cases import TEXTS, documents, nothing
from seedlane.llm import substrings as S


def plain(rows, length):
    """``(id, n_words, n_removed, text left)`` by comparing all windows."""
    words = [[w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for _, t in rows]
    seen = Counter(tuple(w[i:i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for (doc_id, _), w in zip(rows, words):
        gone = {i + k for i in range(len(w) - length + 1) if seen[tuple(w[i:i + length])] > 1 for k in range(length)}
        out.append((doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def found(df, **how):
    rows = S.remove_repeats(df, **how).select("doc_id", "n_words", "n_removed", "text").collect()
    return sorted(map(tuple, rows), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def mixture(seed, documents=120, words=40, passages=6):
    """Texts with shared passages, cut short or changed at their ends, and runs of one word."""
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    shared = [draw.choices(vocabulary, k=draw.randint(4, 60)) for _ in range(passages)]
    rows = []
    for i in range(documents):
        text = []
        for _ in range(draw.randint(0, 4)):
            text += draw.choices(vocabulary, k=draw.randint(0, 15))
            own = list(draw.choice(shared))[draw.randint(0, 3):]
            if own and draw.random() < 0.4:
                own[draw.randrange(len(own))] = "changed"
            text += own
            if draw.random() < 0.1:
                text += ["same"] * draw.randint(1, 30)
        rows.append((i, "  ".join(text)))
    return rows


@pytest.mark.parametrize("length,gram", [(8, 3), (8, 8), (5, 1), (12, 4)])
def test_equals_plain_python(spark, length, gram):
    rows = mixture(length + gram)
    assert found(frame(spark, rows).repartition(5), length=length, gram=gram) == plain(rows, length)


def test_standard_length(spark):
    rows = mixture(3, documents=60, words=500, passages=4) + [(1000 + i, mixture(3)[5][1]) for i in range(3)]
    assert found(frame(spark, rows)) == plain(rows, 35)


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(S, "WORDS", 50)
    monkeypatch.setattr(S, "BYTES", 64)
    rows = mixture(9, documents=25)
    texts = [(t or "").encode() for _, t in rows]
    winnower = S.Winnower(8, 3)
    seen = set()
    for words, owner, place in S._pieces(iter(texts), 8):
        first, n, *_ = winnower.blocks(words, owner)
        seen |= {(int(owner[f]), int(place[f]) + k) for f, m in zip(first, n) for k in range(m)}
    every = {(i, p) for i, t in enumerate(texts) for p in range(len(t.split()) - 7)}
    assert seen == every


def test_odd_rows(spark):
    rows = [(i, t) for i, t, _, _ in TEXTS]
    assert found(documents(spark).repartition(3), length=6, gram=3) == plain(rows, 6)
    assert S.remove_repeats(documents(spark)).count() == len(TEXTS)
    assert found(nothing(spark)) == []


def test_hot_anchors_are_dealt(spark, monkeypatch):
    """A passage of a third of all rows, with another word after it each time."""
    draw = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(i, f"{passage} {' '.join(f'x{draw.randrange(10**6)}' for _ in range(8))}") for i in range(3000)]
    rows += [(10_000 + i, " ".join(f"y{draw.randrange(10**6)}" for _ in range(20))) for i in range(500)]
    rows += [(20_000 + i, "a copy of the very same short text that is here many times over") for i in range(2000)]
    assert found(frame(spark, rows), length=10, gram=4) == plain(rows, 10)


def test_no_pairs(spark):
    """What an anchor's places become is in proportion to their number."""
    passage = " ".join(f"p{i}" for i in range(20))
    for n in (500, 1000):
        rows = [(i, f"{passage} own{i} " + " ".join(f"z{i}_{k}" for k in range(8))) for i in range(n)]
        assert S.repeated_parts(frame(spark, rows), length=10, gram=4).count() <= 12 * n


def test_maximal_repeats(spark):
    shared = [f"s{i}" for i in range(50)]
    rows = [(1, " ".join(["a"] * 3 + shared + ["b"])), (2, " ".join(shared[5:] + ["c"])), (3, "nothing to find here")]
    got = sorted(map(tuple, S.maximal_repeats(frame(spark, rows), length=10, gram=4).collect()))
    assert got == [(1, 8, 45), (2, 0, 45)]


def test_malformed_text(spark):
    rows = [(1, bytes([0xFF, 0x20]) * 12), (2, bytes([0xFF, 0x20]) * 12 + b"end"), (3, b"\xc3 \xe2\x82")]
    df = spark.createDataFrame(rows, "doc_id long, text binary").selectExpr("doc_id", "cast(text as string) AS text")
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in S.remove_repeats(df, length=6, gram=2).collect()) == [
        (1, 12, 12), (2, 13, 12), (3, 2, 0)]
