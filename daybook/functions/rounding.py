"""Averages to two places that every engine rounds alike: from a sum of whole hundredths, half up."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hundredths(value: Column) -> Column:
    return F.round(value * 100).cast("long")


def ratio2(total: Column, n: Column) -> Column:
    """total (in hundredths, not negative) / n, to two places; null for n = 0."""
    return F.when(n > 0, F.call_function("div", 2 * total + n, 2 * n) / F.lit(100.0))


def avg2(value: Column) -> Column:
    """Average of the values that aren't null."""
    return ratio2(F.sum(hundredths(value)), F.count(value))
