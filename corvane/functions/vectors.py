"""Vector functions on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    """v over its length; a zero vector stays."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n))


def is_valid(v: Column, dim: int) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) == dim) & finite, F.lit(False))


def is_unit(v: Column, tolerance: float = 1e-4) -> Column:
    return F.abs(norm(v) - 1) < tolerance


def prepared(v: Column, dim: int) -> Column:
    """A query vector of unit length; null if it has another dimension, a value that is not finite, or no length."""
    return F.when(is_valid(v, dim) & (norm(v) > 0), normalised(v))
