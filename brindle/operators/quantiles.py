"""Exact percentiles without a task that holds all values.

A rank is found in three passes over the rows, each counted in parts of the rows first: in buckets of the logarithm,
in even slices of the buckets that hold a wanted rank, and among the values of those slices.  A pass leaves a bounded
number of rows for each wanted rank, whatever the number of rows, but for the last: it has the distinct values of one
slice (at most some 20 million of all doubles).  Every step from value to bucket is monotone, so buckets are in order.
Interpolation is that of Spark's `percentile`.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FINE = 256  # buckets for each factor e of size
SLICES = 1 << 16


def _joined(rows: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the chosen buckets, which may have null keys."""
    chosen = chosen.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = functools.reduce(operator.and_, (F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys))
    return rows.join(chosen, on).drop(*(f"__r_{k}" for k in keys))


def _bucket(v: Column) -> Column:
    """Number of a value's bucket: rising with the value, infinite values apart, NaN last as in Spark's order."""
    a = F.floor(F.log1p(F.abs(v)) * FINE)
    number = F.when(v < 0, -a - 1).otherwise(a)
    return F.when(F.isnan(v), 1 << 40).when(F.abs(v) == float("inf"), F.when(v < 0, -(1 << 39)).otherwise(1 << 39)).otherwise(number).cast("long")


def _slice(v: Column, lo: Column, hi: Column) -> Column:
    """Number of a value's slice of its bucket, from the bucket's least to its greatest value."""
    return F.when(lo == hi, 0).otherwise(F.floor((v - lo) / (hi - lo) * SLICES)).cast("long")


def _ranked(counts: DataFrame, by: list[str], at: str, carried: list[str]) -> DataFrame:
    """Of counted buckets those that hold a rank of `__want`; `__start` becomes the rank of a bucket's first value."""
    w = Window.partitionBy(*by).orderBy(at)
    start = F.col("__start") + F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    out = counts.withColumn("__first", start)
    want = F.filter("__want", lambda r: (r >= F.col("__first")) & (r < F.col("__first") + F.col("__n")))
    out = out.withColumn("__want", want).filter(F.size("__want") > 0)
    return out.select(*by, *([at] if at not in by else []), *carried, "__want", F.col("__first").alias("__start"))


def percentiles(df: DataFrame, keys: list[str], v: Column, shares: dict[str, float]) -> DataFrame:
    """One row for each group that has a value: its keys and the percentile of each share (0 to 1) by name."""
    rows = df.select(*keys, v.cast("double").alias("__v")).filter("__v IS NOT NULL").withColumn("__b", _bucket(F.col("__v")))
    count, lo, hi = F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi")
    ps = list(dict.fromkeys(shares.values()))

    place = lambda p: (F.col("__total") - 1) * F.lit(float(p))
    ends = [f(place(p)).cast("long") for p in ps for f in (F.floor, F.ceil)]
    first = rows.groupBy(*keys, "__b").agg(count, lo, hi)
    first = first.withColumn("__total", F.sum("__n").over(Window.partitionBy(*keys)))
    first = first.withColumns({"__want": F.array_distinct(F.array(*ends)), "__start": F.lit(0).cast("long")})
    first = _ranked(first, keys, "__b", ["__lo", "__hi", "__total"])

    small = (lambda t: t) if keys else F.broadcast  # without keys two rows a share at most
    by, limits = [*keys, "__b"], ["__lo", "__hi"]
    cut = _joined(rows, small(first.select(*by, *limits)), by).withColumn("__s", _slice(F.col("__v"), F.col("__lo"), F.col("__hi")))
    second = _joined(cut.groupBy(*by, "__s").agg(count), small(first), by)
    second = _ranked(second, by, "__s", [*limits, "__total"])

    cut = _joined(rows, small(second.select(*by, *limits, F.col("__s").alias("__chosen"))), by)
    cut = cut.filter(_slice(F.col("__v"), F.col("__lo"), F.col("__hi")) == F.col("__chosen")).withColumnRenamed("__chosen", "__s")
    third = _joined(cut.groupBy(*by, "__s", "__v").agg(count), small(second.drop(*limits)), [*by, "__s"])
    third = _ranked(third, [*by, "__s"], "__v", ["__total"])

    pair = F.explode("__want").alias("__rank")
    found = third.select(*keys, "__v", "__total", pair).groupBy(*keys).agg(F.first("__total").alias("__total"), F.map_from_entries(F.collect_list(F.struct("__rank", "__v"))).alias("__at"))

    def value(p: float) -> Column:
        low, high = F.floor(place(p)).cast("long"), F.ceil(place(p)).cast("long")
        a, b = F.element_at("__at", low), F.element_at("__at", high)
        return F.when(a == b, a).otherwise((high - place(p)) * a + (place(p) - low) * b)

    return found.select(*keys, *(value(p).alias(n) for n, p in shares.items()))
