"""Vector arithmetic on array columns; in double precision, whatever the arrays hold."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length one; null for a zero vector. The norm is a lambda's argument, or it would be worked out for every element."""
    return F.get(F.transform(F.array(norm(a)), lambda size: F.when(size > 0, F.transform(_double(a), lambda x: x / size))), F.lit(0))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (norm(a) * norm(b))
