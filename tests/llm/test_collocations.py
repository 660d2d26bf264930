import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cases import TEXTS, documents, nothing
from seedlane.llm import bitmap
from seedlane.llm import collocations as C


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_counts(rows, longest):
    found = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            for size in range(1, longest + 1):
                found[lang if lang is not None else "und"].update(
                    tuple(words[i:i + size]) for i in range(len(words) - size + 1))
    return found


def plain(rows, least, longest=5, top=2000):
    out = []
    for lang, counts in plain_counts(rows, longest).items():
        n = sum(c for p, c in counts.items() if len(p) == 1)
        cands = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        kept = []
        for p, a in cands.items():
            inside = any(
                len(q) > len(p) and 100 * c >= 100 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q, c in cands.items())
            if not inside:
                score, _, l, r = min((1000 * a * n // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n, -score))
    return sorted(out)


def sample(seed, n=150):
    draw = random.Random(seed)
    words = [f"W{i}" for i in range(14)] + ["Ünt", "das", "e" * 30]
    fixed = [draw.choices(words, k=draw.randint(2, 9)) for _ in range(5)]
    rows = []
    for _ in range(n):
        text = ""
        for _ in range(draw.randint(0, 12)):
            part = draw.choice(fixed) if draw.random() < 0.5 else draw.choices(words, k=draw.randint(1, 25))
            text += draw.choice([" ", "\t ", "  "]).join(part) + draw.choice([" ", ".", ", ", "\n", "!\r", "\x0b"])
        rows.append((text, draw.choice(["en", "de", None, "und"])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string")


def result(df, **how):
    return sorted(map(tuple, C.collocations(df, **how).collect()))


@pytest.mark.parametrize("least,longest,top", [(3, 5, 2000), (10, 3, 7), (2, 2, 2000), (5, 5, 20)])
def test_equals_plain_python(spark, least, longest, top):
    rows = sample(least)
    assert result(frame(spark, rows).repartition(4), least=least, longest=longest, top=top) == plain(rows, least, longest, top)


@pytest.mark.parametrize("trigger,held", [(1, 1 << 20), (2, 200), (1 << 30, 50)])
def test_any_parse_gives_the_same_counts(spark, monkeypatch, trigger, held):
    monkeypatch.setattr(C, "HELD", held)
    rows = sample(8, 40)
    counts, total = C.phrase_counts(C.parse(frame(spark, rows), trigger=trigger, short=2), least=1)
    got = {(r.lang, bytes(r.phrase).decode()): (r.n, r.size) for r in counts.collect()}
    expected = plain_counts(rows, 5)
    assert got == {(lang, " ".join(p)): (n, len(p)) for lang, c in expected.items() for p, n in c.items()}
    assert {r.lang: r.words for r in total.collect()} == {
        lang: sum(n for p, n in c.items() if len(p) == 1) for lang, c in expected.items() if c}


def test_full_bitmap_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(bitmap, "LEAST", 32)
    monkeypatch.setattr(bitmap, "MOST", 32)
    rows = sample(11, 60)
    assert result(frame(spark, rows), least=4) == plain(rows, 4)


def test_bitmap_holds_what_it_was_made_of(spark):
    values = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 3000)
    bits = bitmap.bitmap_of(spark.createDataFrame([(int(v),) for v in values], "h long"), "h")
    assert bitmap.may_hold(bits, values).all()
    others = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 3000)
    assert bitmap.may_hold(bits, others).mean() < 0.15


def test_copies_are_in_the_dictionary_once(spark):
    rows = [("a text that is here many times over, with a second piece", "en")] * 500
    parsed = C.parse(frame(spark, rows))
    assert parsed.count() <= 6 and {r.rows for r in parsed.collect()} == {500}


def test_large_numbers_are_exact(spark):
    big = 3 * 10**13 + 7
    counts = spark.createDataFrame([("en", "a", big, 1), ("en", "b", big - 1, 1), ("en", "a b", big // 3, 2)], "lang string, phrase string, n long, size int")
    total = spark.createDataFrame([("en", 9 * 10**13 + 1)], "lang string, words long")
    row = C.score_phrases(counts.selectExpr("lang", "cast(phrase as binary) AS phrase", "n", "size"), total).first()
    assert row.score == 1000 * (big // 3) * (9 * 10**13 + 1) // (big * (big - 1))


def test_odd_rows(spark):
    rows = [(t, lang) for _, t, lang, _ in TEXTS]
    assert result(documents(spark), least=2) == plain(rows, 2)
    assert result(nothing(spark)) == []
    odd = spark.createDataFrame([(b"\xff \xfe. \xff \xfe", "en")], "text binary, lang string").selectExpr("cast(text as string) AS text", "lang")
    assert [(r.a, r.l, r.r, r.n) for r in C.collocations(odd, least=2).collect()] == [(2, 2, 2, 4)]
