import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cases import TEXTS, documents, nothing
from seedlane.llm.mixing import mix_sources, poisson_tables


def chance(doc_id, source):
    text = f"copies0|{'' if doc_id is None else doc_id}|{source or ''}"
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 16**13


def poisson_inverse(u, rate):
    k, total = 0, math.exp(-rate)
    while u >= total:
        k += 1
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
    return k


def test_copies_equal_plain_python(spark):
    sizes = Counter(s for *_, s in TEXTS)
    weights = {s: n**0.5 for s, n in sizes.items()}
    rate = {s: weights[s] * len(TEXTS) / sum(weights.values()) / n for s, n in sizes.items()}
    wanted = Counter()
    for doc_id, text, _, source in TEXTS:
        for copy in range(poisson_inverse(chance(doc_id, source), rate[source])):
            wanted[doc_id, text, source, copy] += 1
    docs = documents(spark)
    mixed = mix_sources(docs)
    # The table has a column mix_copy of its own.
    assert mixed.columns == [*docs.columns, "_mix_copies", "_mix_copy", "_mix_key"]
    assert Counter((r.doc_id, r.text, r.source, r._mix_copy) for r in mixed.collect()) == wanted
    assert mix_sources(nothing(spark)).count() == 0


def test_weights_are_met_with_a_hot_source(spark):
    docs = spark.range(30_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"))
    got = {r.source: r["count"] for r in mix_sources(docs, weights={"hot": 1.0, "s0": 2.0, "s1": 1.0}).groupBy("source").count().collect()}
    assert set(got) == {"hot", "s0", "s1"}
    assert got["hot"] == pytest.approx(7500, rel=0.05) and got["s0"] == pytest.approx(15_000, rel=0.05)


def test_order_is_random_and_repeatable(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("x").alias("source"))
    first, second = ([r.doc_id for r in mix_sources(docs.repartition(n)).orderBy("mix_key").collect()] for n in (2, 7))
    assert first == second and first != sorted(first)


@pytest.mark.parametrize("rate", [0.001, 1.0, 21.5, 900.0, 50_000.0])
def test_distribution_functions(spark, rate):
    row = poisson_tables(spark.createDataFrame([("s", 1, rate)], "source string, rows long, rate double")).first()
    total, exact = 0.0, []
    for k in range(row["first"], row["first"] + len(row["cdf"])):
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        exact.append(total)
    assert row["cdf"] == pytest.approx(exact, abs=1e-9) and row["cdf"][-1] == pytest.approx(1, abs=1e-9)
