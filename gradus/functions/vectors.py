"""Expressions over ``ARRAY<DOUBLE>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either side has no length."""
    return F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def unit(v: Column) -> Column:
    """The vector at length one; a zero vector stays as it is.

    The length is bound once by the aggregate's last step. Naming it in a lambda as a
    column would have it worked out again for every element.
    """
    def scaled(squares: Column) -> Column:
        return F.transform(v, lambda x: x / F.when(squares == 0, 1.0).otherwise(F.sqrt(squares)))

    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x, scaled)


def shares(v: Column) -> Column:
    """Elements over their sum; a zero sum leaves them as they are."""
    def scaled(total_: Column) -> Column:
        return F.transform(v, lambda x: x / F.when(total_ == 0, 1.0).otherwise(total_))

    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x, scaled)


def entropy(p: Column) -> Column:
    """Entropy of a membership vector over its largest possible value; raw for one component."""
    raw = -F.aggregate(p, F.lit(0.0), lambda acc, x: acc + F.when(x > 0, x * F.ln(x)).otherwise(F.lit(0.0)))
    return F.when(F.size(p) > 1, raw / F.ln(F.size(p).cast("double"))).otherwise(raw)
