"""Vector expressions over ARRAY<DOUBLE> columns; all stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalise(v: Column) -> Column:
    """v over its length; a zero vector stays as it is."""
    # The length is an argument of the zip: inside the lambda it would be worked out for every position.
    return F.zip_with(v, F.array_repeat(norm(v), F.size(v)), lambda x, n: x / F.when(n > 0, n).otherwise(1.0))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - a.b of unit vectors, held to 0..2."""
    return F.least(F.greatest(1 - dot(a, b), F.lit(0.0)), F.lit(2.0))


def chi_squared(a: Column, b: Column) -> Column:
    """Colour histogram distance, held to 0..2; 2 where a side is empty."""
    parts = F.zip_with(a, b, lambda x, y: (x - y) * (x - y) / F.greatest(x + y, F.lit(1e-12)))
    value = F.least(F.greatest(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)), F.lit(2.0))
    return F.when(F.size(a) * F.size(b) > 0, value).otherwise(2.0)


def elementwise(aggregate, v: Column, dims: int) -> Column:
    """An array of one aggregate per position: a hash aggregate with ``dims`` buffers, no explode."""
    return F.array(*[aggregate(v[k]) for k in range(dims)])


def checksum(v: Column) -> Column:
    """Position-weighted sum, to compare vectors by one number."""
    return F.aggregate(F.transform(v, lambda x, k: x * (k + 1)), F.lit(0.0), lambda s, x: s + x)
