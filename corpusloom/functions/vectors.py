"""Column functions on arrays of floats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def length(a: Column) -> Column:
    """Norm of a vector; a vector of zeros counts as of length one."""
    n = norm(a)
    return F.when(n == 0, F.lit(1.0)).otherwise(n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (length(a) * length(b))
