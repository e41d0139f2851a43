"""Vector distances and scores as columns (higher-order functions, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def distance(a: Column, b: Column, space: str) -> Column:
    """l2 is squared; cosine is 1 - cos and infinite for a zero vector; innerproduct is the negated product."""
    pair = lambda f: F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double")))
    if space == "l2":
        return _sum(pair(lambda x, y: (x - y) * (x - y)))
    if space == "l1":
        return _sum(pair(lambda x, y: F.abs(x - y)))
    if space == "linf":
        return F.array_max(pair(lambda x, y: F.abs(x - y)))
    if space in ("cosine", "cosinesimil"):
        norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
        return F.when(norm == 0, F.lit(float("inf"))).otherwise(1 - dot(a, b) / F.when(norm == 0, None).otherwise(norm))
    if space == "innerproduct":
        return -dot(a, b)
    if space == "hamming":
        return _sum(pair(lambda x, y: F.when(x != y, 1.0).otherwise(0.0)))
    raise ValueError(f"unknown space {space!r}")


def score(d: Column, space: str) -> Column:
    if space == "innerproduct":
        return F.when(d <= 0, 1 - d).otherwise(1 / (1 + d))
    return 1 / (1 + d)


def max_distance(min_score: float, space: str) -> float:
    if space == "innerproduct":
        return 1 - min_score if min_score >= 1 else 1 / min_score - 1
    return 1 / min_score - 1
