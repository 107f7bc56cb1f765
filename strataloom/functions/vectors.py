"""Column functions on vectors (array<float> or array<double>), computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(a: Column) -> Column:
    """The vector at length 1; a null vector stays as it is. Vector and length are evaluated once, not
    for each of its numbers."""

    def scaled(v: Column) -> Column:
        return F.element_at(F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))), 1)

    return F.element_at(F.transform(F.array(a), scaled), 1)


def rounded(a: Column, digits: int) -> Column:
    """Every number of a vector rounded; one below zero keeps its sign where it becomes zero, as in SQL."""
    return F.transform(a, lambda x: F.signum(x) * F.round(F.abs(x), digits))


def blend(base: Column, other: Column, weight: float) -> Column:
    """RUL-12: both vectors at length 1 side by side, weighted by the roots of 1 - w and w."""
    return F.concat(F.transform(unit(base), lambda x: x * (1 - weight) ** 0.5), F.transform(unit(other), lambda x: x * weight**0.5))


def margin_confidence(margin: Column) -> Column:
    """MATH-05: sigmoid calibration of a margin."""
    return 1 / (1 + F.exp(-6 * margin))


def rank_discount(rank: Column) -> Column:
    return 1 / F.log2(rank + 2)
