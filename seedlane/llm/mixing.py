"""Mixing of sources to target weights by Poisson replication.

Every source has a mean repetition rate: the rows it should have by its weight, over the rows it has.
A document's copies are the inverse Poisson distribution function of that rate at a uniform number that
the seed and the document decide, so the same document is repeated as often in every run and on any
cluster. The copies are exploded and dealt out by a random key, which also orders each partition: the
table as a whole is in random order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seedlane.llm.common import free_prefix
from seedlane.plans.layout import rows_fit, settled

# Hexadecimal digits of a hash that a double holds exactly.
DIGITS = 13
# Standard deviations around the mean beyond which the distribution is 0 or 1 in double precision.
REACH = 12
SALTS = 64


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) decided by the parts."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("double") / float(16**DIGITS)


def source_rates(
    docs: DataFrame, source: str = "source", weights: dict[str, float] | None = None,
    power: float = 0.5, total: int | None = None,
) -> DataFrame:
    """``(source, rows, rate)``: mean copies of a row of each source; null is a source of its own.

    ``weights`` are the wanted shares of the sources (those not named get none); without them a source
    weighs its rows to ``power``. ``total`` is the wanted number of rows, as many as now by default.
    """
    counted = docs.groupBy(F.col(source).cast("string").alias("source")).agg(F.count("*").alias("rows"))
    if weights is None:
        weight = F.pow(F.col("rows").cast("double"), F.lit(float(power)))
    else:
        named = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
        weight = F.coalesce(F.element_at(named, F.col("source")), F.lit(0.0))
    # One row of sums, joined as a scalar; sources are never gathered in one task.
    weighed = counted.withColumn("weight", weight)
    sums = weighed.agg(F.sum("weight").alias("weights"), F.sum("rows").alias("all")).first()
    wanted = float(total if total is not None else sums["all"] or 0)
    rate = F.col("weight") * wanted / (sums["weights"] or 1.0) / F.col("rows")
    return weighed.select("source", "rows", rate.alias("rate"))


def _log_factorial(k: Column) -> Column:
    """Exact up to 20, then Stirling's series, whose error is below a double's there."""
    x = k.cast("double")
    series = (
        x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x)
        + 1 / (1260 * x * x * x * x * x)
    )
    return F.when(k <= 20, F.log(F.factorial(F.least(k, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def poisson_tables(rates: DataFrame) -> DataFrame:
    """Add ``first`` and ``cdf``: the distribution function at ``first``, ``first + 1`` and so on."""
    reach = REACH * F.sqrt("rate")
    first = F.greatest(F.lit(0), F.floor(F.col("rate") - reach - 30)).cast("long")
    last = F.ceil(F.col("rate") + reach + 30).cast("long")
    spread = rates.filter("rate > 0").select(
        "source", "rate", first.alias("first"), F.explode(F.sequence(first, last)).alias("k")
    )
    mass = F.exp(F.col("k") * F.log("rate") - F.col("rate") - _log_factorial(F.col("k")))
    up_to = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return (
        spread.withColumn("mass", mass)
        .withColumn("cdf", F.sum("mass").over(up_to))
        .groupBy("source", "rate", "first")
        .agg(F.sort_array(F.collect_list("cdf")).alias("cdf"))
    )


def mix_sources(
    docs: DataFrame, id: str = "doc_id", source: str = "source", weights: dict[str, float] | None = None,
    power: float = 0.5, total: int | None = None, seed: int = 0, prefix: str = "mix_",
) -> DataFrame:
    """The table's rows, each as often as its source's weight asks for, in random order.

    All columns are kept, and ``mix_copies`` (how often the row is repeated), ``mix_copy`` (from 0) and
    ``mix_key`` (the place in the random order) are added; where columns of the table begin so, underscores
    are put before ``prefix``. A row without copies is gone: that is what a weight below a source's share
    means. Rows of one id and source get the same number of copies, each its own; null ids count as
    empty text, a null source is one more source, and an empty table gives no rows.
    """
    prefix = free_prefix(prefix, docs)
    rates = settled(poisson_tables(source_rates(docs, source, weights, power, total)))
    names = {c: f"{prefix}{c}" for c in rates.columns}
    rates = rates.withColumnsRenamed(names)
    key = F.col(source).cast("string")
    same = key.eqNullSafe(F.col(names["source"]))
    # One row per source, each with an array of about 60 numbers, or 24 roots of its rate.
    size = rates.agg(F.sum(F.size(names["cdf"]) * 8 + 100).alias("bytes"), F.count("*").alias("n")).first()
    if rows_fit(size["n"], (size["bytes"] or 0) // max(1, size["n"])):
        joined = docs.join(F.broadcast(rates), same)
    else:
        salt = F.pmod(F.xxhash64(F.col(id)), F.lit(SALTS)).cast("int")
        copies = rates.withColumn(f"{prefix}salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = docs.withColumn(f"{prefix}salt", salt).join(
            copies, same & (F.col(f"{prefix}salt") == F.col(f"{prefix}salt2"))
        ).drop(f"{prefix}salt", f"{prefix}salt2")
    chance = uniform(F.lit(f"copies{seed}"), F.col(id), key)
    below = F.size(F.filter(names["cdf"], lambda c: c <= F.col(f"{prefix}chance")))
    copies, copy = F.col(f"{prefix}copies"), F.col(f"{prefix}copy")
    mixed = (
        joined.withColumn(f"{prefix}chance", chance)
        .withColumn(f"{prefix}copies", (F.col(names["first"]) + below).cast("int"))
        .filter(copies > 0)
        .drop(*names.values(), f"{prefix}chance")
        .withColumn(f"{prefix}copy", F.explode(F.sequence(F.lit(0), copies - 1)))
        .withColumn(
            f"{prefix}key",
            F.md5(F.concat_ws("|", F.lit(f"order{seed}"), F.coalesce(F.col(id).cast("string"), F.lit("")),
                              F.coalesce(key, F.lit("")), copy.cast("string"))),
        )
    )
    return mixed.repartition(F.col(f"{prefix}key")).sortWithinPartitions(f"{prefix}key")


#: The query over ``documents`` in SQL.
MIX_SQL = """
WITH counted AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (
    SELECT source, sqrt(n::DOUBLE) * (SELECT sum(n) FROM counted)::DOUBLE
                   / (SELECT sum(sqrt(n::DOUBLE)) FROM counted) / n AS rate
    FROM counted),
ks AS (
    SELECT source, rate, greatest(0, floor(rate - 12 * sqrt(rate) - 30))::BIGINT AS lo,
           unnest(generate_series(greatest(0, floor(rate - 12 * sqrt(rate) - 30))::BIGINT,
                                  ceil(rate + 12 * sqrt(rate) + 30)::BIGINT)) AS k
    FROM rates),
cdfs AS (
    SELECT source, lo, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
    FROM ks),
chances AS (
    SELECT *, ('0x' || substr(md5('copies0|' || doc_id || '|' || source), 1, 13))::BIGINT / pow(16, 13) AS u
    FROM documents),
counts AS (
    SELECT d.doc_id, d.source, d.n_chars, d.text, d.lang, (min(t.lo) + count(*) FILTER (t.c <= d.u))::INTEGER AS copies
    FROM chances d JOIN cdfs t ON t.source = d.source
    GROUP BY d.doc_id, d.source, d.n_chars, d.text, d.lang)
SELECT doc_id, text, lang, source, n_chars, copies AS mix_copies, copy::INTEGER AS mix_copy,
       md5('order0|' || doc_id || '|' || source || '|' || copy) AS mix_key
FROM (SELECT *, unnest(generate_series(0, copies - 1)) AS copy FROM counts)
"""
