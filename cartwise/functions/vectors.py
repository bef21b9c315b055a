"""Expressions over array vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product; the shorter side counts as zero-padded."""
    zero = F.lit(0.0)
    products = F.zip_with(
        a, b, lambda x, y: F.coalesce(x.cast("double"), zero) * F.coalesce(y.cast("double"), zero)
    )
    return F.aggregate(products, zero, lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine with zero padding; 0 where either side has no length."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.try_divide(dot(a, b), n))


def pad(a: Column, dim: int) -> Column:
    """Exactly ``dim`` entries: zeros appended or the tail cut."""
    return F.slice(F.concat(a, F.array_repeat(F.lit(0.0), dim)), 1, dim)
