"""Array helpers, all native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shift_all(values: Column, by: Column) -> Column:
    """Every element plus ``by``."""
    return F.transform(values, lambda x: x + by)


def array_text(values: Column) -> Column:
    """``[1,2,3]``."""
    return F.concat(F.lit("["), F.array_join(values.cast("array<string>"), ","), F.lit("]"))


def joined(values: Column, separator: str = "") -> Column:
    """The strings of an array in one string."""
    return F.array_join(values, separator)


def chunked(values: Column, size: int) -> Column:
    """Consecutive slices of at most ``size`` elements; no slice for an empty array."""
    firsts = F.when(
        F.size(values) > 0, F.sequence(F.lit(1), F.size(values), F.lit(size))
    ).otherwise(F.array().cast("array<int>"))
    return F.transform(firsts, lambda i: F.slice(values, i, F.lit(size)))


def _bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where lambdas use it many times."""
    return F.transform(F.array(value), body)[0]


def count_by(values: Column) -> Column:
    """Array of ``(value, n)`` structs in value order.

    Sorts once and measures the runs. Counting over a table is
    :func:`seedlane.operators.seeds.diagonal_counts`.
    """
    none = F.array().cast("array<int>")

    def runs(ordered: Column) -> Column:
        size = F.size(ordered)
        last = F.filter(
            F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(none),
            lambda i: (i == size) | (F.get(ordered, i - 1) != F.get(ordered, i)),
        )
        return _bound(last, lambda ends: F.zip_with(
            ends,
            F.slice(F.concat(F.array(F.lit(0)), ends), F.lit(1), F.size(ends)),
            lambda end, before: F.struct(
                F.get(ordered, end - 1).alias("value"),
                (end - before).cast("long").alias("n"),
            ),
        ))

    return _bound(F.array_sort(values), runs)


def values_over(values: Column, threshold: int) -> Column:
    """Values that occur more than ``threshold`` times, in value order."""
    frequent = F.filter(count_by(values), lambda c: c["n"] > threshold)
    return F.transform(frequent, lambda c: c["value"])


def ordered_text(pieces: Column) -> Column:
    """Concatenate ``(position, text)`` structs in position order."""
    return F.array_join(F.transform(F.array_sort(pieces), lambda p: p["text"]), "")
