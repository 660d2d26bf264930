"""K-mers that are cut, counted and digested inside tasks."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seedlane.functions.digest import md5_numbers
from seedlane.operators import index, kmers

DRAW = random.Random(5)
TEXTS = ["".join(DRAW.choices("ABCN", k=n)) for n in (9000, 150_000, 150_000)] + [
    "", "ABC", "ABCD", "NNNNNNNN", "ANNNNNB", "ABCABCABC" * 40]


def refs_of(spark, texts):
    refs = spark.createDataFrame(list(enumerate(texts, 1)), "ref_id long, sequence string")
    # More than one slice of one task.
    return refs.coalesce(1)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_kmers_in_tasks_are_those_of_rows(spark):
    refs = refs_of(spark, TEXTS).unionByName(spark.createDataFrame([(99, None)], "ref_id long, sequence string"))
    base = F.col("ref_id") * F.lit(7)
    got = kmers.map_kmers(refs, 4, ["ref_id"], lambda found: found, "ref_id long, seq string, offset long", base=base)
    assert rows(got) == rows(kmers.explode_kmers(refs, 4, ["ref_id"], base=base).select("ref_id", "seq", "offset"))


@pytest.mark.parametrize("buckets", [1, 3, 50])
def test_totals_by_bucket(spark, buckets):
    refs = refs_of(spark, TEXTS)
    got = index.sequence_totals(refs, 4, buckets)
    assert rows(got) == rows(index.key_totals(index.postings(refs, 4)))
    # No k-mer, and no bucket, becomes a row that is grouped or sorted by its text.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [bucket" in plan and "Aggregate [seq" not in plan


def test_totals_of_nothing(spark):
    assert index.sequence_totals(refs_of(spark, ["", "AB", "NNNN"]), 4).count() == 0


def test_negative_position_is_refused(spark):
    with pytest.raises(Exception, match="negative k-mer position"):
        kmers.map_kmers(refs_of(spark, ["ABCDE"]), 4, [], lambda found: found, "seq string, offset long", base=F.lit(-1)).collect()


def test_md5_of_many_texts():
    texts = [bytes([65 + i % 26]) * (i % 130) + str(i).encode() * (i % 2) for i in range(20_000)]
    edges = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = md5_numbers(np.frombuffer(b"".join(texts), np.uint8), edges).tolist()
    assert got == [int(hashlib.md5(t).hexdigest()[:8], 16) for t in texts]
    assert md5_numbers(np.zeros(0, np.uint8), np.zeros(1, np.int64)).tolist() == []
    assert Counter(md5_numbers(np.zeros(0, np.uint8), np.zeros(3, np.int64)).tolist()) == {0xD41D8CD9: 2}
