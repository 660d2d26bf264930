import hashlib

import pytest
import xxhash
from pyspark.sql import functions as F

from cases import TEXTS, documents, nothing
from seedlane.llm.fingerprints import (
    FRACTION, containment, fingerprint_edits, fingerprint_text, likeness, merged, sketch,
)

BOUND = (1 << 64) // FRACTION


def hash_of(parts):
    seed = 42
    for part in parts:
        seed = xxhash.xxh64_intdigest(part.encode(), seed)
    return seed


def order(h):
    """Signed order as bits: the sketch keeps the lowest signed numbers."""
    return h ^ (1 << 63)


def plain_sketch(text):
    words = [w for w in __import__("re").split(r"[ \t\n\x0b\x0c\r]+", (text or "").lower()) if w]
    hashes = {hash_of(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {hash_of([" ".join(words)])} if words else set()
    kept = {h for h in hashes if order(h) < BOUND}
    return sorted(kept or set(sorted(hashes, key=order)[:1]), key=order)


def plain_likeness(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def plain(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for k, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        s, e, n = plain_sketch(text), plain_sketch(edited), plain_sketch(after)
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join("%016x" % h for h in s),
                    "".join("%016x" % h for h in e), round(plain_likeness(s, e), 9), round(plain_likeness(s, n), 9)))
    return sorted(out, key=str)


def result(df):
    return sorted([(*r[:5], round(r[5], 9), round(r[6], 9)) for r in fingerprint_edits(df).collect()], key=str)


def test_equals_plain_python(spark):
    assert result(documents(spark).repartition(5)) == plain([(i, t) for i, t, _, _ in TEXTS])


@pytest.mark.parametrize("count", [1, 2, 50])
def test_next_over_many_parts(spark, count):
    rows = [(i * i - 7, f"text {i} " * (i % 9)) for i in range(count)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df) == plain(rows)


def test_empty_table(spark):
    assert fingerprint_edits(nothing(spark)).count() == 0


def test_containment_and_merging(spark):
    short = " ".join(f"w{i}" for i in range(400))
    rest = " ".join(f"v{i}" for i in range(8000))
    df = spark.createDataFrame([(short, short + " " + rest, rest)], "a string, b string, c string").select(
        *[sketch(F.col(c)).alias(c) for c in "abc"])
    row = df.select(containment(F.col("a"), F.col("b")), containment(F.col("a"), F.col("c")), likeness(F.col("a"), F.col("b"))).first()
    assert row[0] == 1.0 and row[1] == 0.0 and row[2] < 0.1
    both = df.select(fingerprint_text(merged(F.col("a"), F.col("c"))).alias("m"), fingerprint_text(F.col("b")).alias("b")).first()
    # Shingles across the seam are only in the text put together.
    m, b = ({x[i:i + 16] for i in range(0, len(x), 16)} for x in both)
    assert m <= b and len(b - m) <= 4
