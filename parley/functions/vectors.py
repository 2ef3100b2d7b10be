"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: str | Column) -> Column:
    return F.col(v).cast("array<double>") if isinstance(v, str) else v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_sim(a: Column, b: Column) -> Column:
    """H1."""
    return dot(a, b) / (norm(a) * norm(b) + 1e-10)


def l2_normalize(a: Column) -> Column:
    """H2: unchanged below 1e-10."""
    n = norm(a)
    return F.when(n < 1e-10, a).otherwise(F.transform(a, lambda x: x / n))


def effective_high(n: Column) -> Column:
    """H3: high threshold, which falls from .70 to .55 as a profile gains samples."""
    return 0.55 + 0.15 * F.exp(-n / 10.0)
