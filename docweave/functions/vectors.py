"""Vector expressions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2))))


def l1(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def l_inf(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def jaccard(a: Column, b: Column) -> Column:
    """1 where both sets are empty."""
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / n)


def scaled_to_unit(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def divergence(p: Column, q: Column, floor: float = 1e-15) -> Column:
    """Kullback-Leibler divergence, base 2."""
    return total(F.zip_with(p, q, lambda x, y: F.when(x > 0, x * F.log(2.0, x / F.greatest(y, F.lit(floor)))).otherwise(0.0)))


def js_divergence(p: Column, q: Column) -> Column:
    m = F.zip_with(p, q, lambda x, y: (x + y) / 2)
    return (divergence(p, m) + divergence(q, m)) / 2
