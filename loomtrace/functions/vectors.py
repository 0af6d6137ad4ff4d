"""Vector functions over arrays of doubles, in higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(0.0))


def cosine(a: Column, b: Column, zero: float) -> Column:
    """Cosine; ``zero`` where either vector is zero (searches use minus infinity, duplicates -1, compactness 0)."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(zero))


def one_hot(vocabulary: tuple[str, ...], value: Column) -> Column:
    return F.array(*[F.when(value == v, 1.0).otherwise(0.0) for v in vocabulary])
