"""Vector functions as column expressions: exact, in double precision, summed from left to right."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Zero where a norm is; vectors of different lengths are an error."""
    same = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different lengths")).cast("double"))
    return F.coalesce(same, F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def normalized(v: Column) -> Column:
    """At unit length; a zero norm is an error."""
    norm = F.sqrt(dot(v, v))
    checked = F.when(norm > 0, norm).otherwise(F.raise_error(F.lit("a vector of norm zero")).cast("double"))
    scaled = F.transform(F.array(checked), lambda n: F.transform(v.cast("array<double>"), lambda x: x / n))  # so that the norm is not summed again for each element
    return F.when(F.size(v) == 0, v.cast("array<double>")).otherwise(scaled[0])


def is_valid(v: Column, dim: int) -> Column:
    """Of the stored dimension, without nulls, all finite."""
    return F.coalesce((F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
