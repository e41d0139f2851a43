"""Pipeline aggregations over flat bucket tables: windows in bucket order, inside each parent bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(key: str, by: list[str] | None):
    return (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(key)


def cumulative_sum(t: DataFrame, key: str, path: str, name: str, by=None) -> DataFrame:
    return t.withColumn(name, F.sum(path).over(_order(key, by).rowsBetween(Window.unboundedPreceding, 0)))


def derivative(t: DataFrame, key: str, path: str, name: str, by=None) -> DataFrame:
    """Against the last value that is not null."""
    before = F.last(path, ignorenulls=True).over(_order(key, by).rowsBetween(Window.unboundedPreceding, -1))
    return t.withColumn(name, F.col(path) - before)


def serial_diff(t: DataFrame, key: str, path: str, name: str, lag: int = 1, by=None) -> DataFrame:
    return t.withColumn(name, F.col(path) - F.lag(path, lag).over(_order(key, by)))


def moving_fn(t: DataFrame, key: str, path: str, name: str, kind: str, window: int = 5, shift: int = 0, by=None, alpha: float = 0.3, beta: float = 0.1, gamma: float = 0.3, period: int = 1) -> DataFrame:
    """The frame is [i + shift - window, i + shift): at shift 0 it excludes the current bucket."""
    w = _order(key, by).rowsBetween(shift - window, shift - 1)
    v = F.col(path).cast("double")
    simple = {"max": F.max, "min": F.min, "unweightedAvg": F.avg, "stdDev": F.stddev_pop}
    if kind in simple:
        return t.withColumn(name, simple[kind](v).over(w))
    if kind == "sum":
        return t.withColumn(name, F.coalesce(F.sum(v).over(w), F.lit(0.0)))
    xs = F.collect_list(v).over(w)
    n = F.size("__xs")
    at = lambda i: F.element_at("__xs", i)
    if kind == "linearWeightedAvg":
        top = F.aggregate(F.zip_with("__xs", F.sequence(F.lit(1), n), lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x)
        out = top / (n * (n + 1) / 2)
    elif kind == "ewma":
        out = F.aggregate(F.slice("__xs", F.lit(2), n), at(1), lambda s, x: x * alpha + s * (1 - alpha))
    elif kind in ("holt", "holtWinters"):
        trend = F.coalesce(F.try_element_at("__xs", F.lit(2)) - at(1), F.lit(0.0))
        start = F.struct(at(1).alias("s"), trend.alias("b"))
        step = lambda a, x: F.struct((x * alpha + (a["s"] + a["b"]) * (1 - alpha)).alias("s"), (((x * alpha + (a["s"] + a["b"]) * (1 - alpha)) - a["s"]) * beta + a["b"] * (1 - beta)).alias("b"))
        out = F.aggregate(F.slice("__xs", F.lit(2), n), start, step, lambda a: a["s"] + a["b"])
        if kind == "holtWinters":
            out = F.when(n >= 2 * period, _seasonal(n, alpha, beta, gamma, period))
    else:
        raise ValueError(f"unknown moving function {kind!r}")
    return t.withColumn("__xs", xs).withColumn(name, F.when(n > 0, out)).drop("__xs")


def _seasonal(n: Column, alpha: float, beta: float, gamma: float, period: int) -> Column:
    """Additive Holt-Winters: level and trend from the first two periods, seasons as a growing array."""
    part = lambda i: F.aggregate(F.slice("__xs", i, F.lit(period)), F.lit(0.0), lambda s, x: s + x) / period
    level, trend = part(F.lit(1)), (part(F.lit(period + 1)) - part(F.lit(1))) / period
    start = F.struct(level.alias("s"), trend.alias("b"), F.transform(F.slice("__xs", F.lit(1), F.lit(period)), lambda x: x - level).alias("c"))

    def step(a, x):
        season = F.element_at(a["c"], F.size(a["c"]) - period + 1)
        s = (x - season) * alpha + (a["s"] + a["b"]) * (1 - alpha)
        return F.struct(s.alias("s"), ((s - a["s"]) * beta + a["b"] * (1 - beta)).alias("b"), F.concat(a["c"], F.array((x - s) * gamma + season * (1 - gamma))).alias("c"))

    return F.aggregate(F.slice("__xs", F.lit(period + 1), n), start, step, lambda a: a["s"] + a["b"] + F.element_at(a["c"], F.size(a["c"]) - period + 1))


def moving_avg(t: DataFrame, key: str, path: str, name: str, window: int = 5, by=None) -> DataFrame:
    return moving_fn(t, key, path, name, "unweightedAvg", window, 0, by)


def bucket_script(t: DataFrame, name: str, paths: dict[str, str], script: str) -> DataFrame:
    from ..functions.script import Script

    return t.withColumn(name, Script(script, F.col, {}, {f"params.{k}": F.col(v) for k, v in paths.items()}).column())


def bucket_selector(t: DataFrame, paths: dict[str, str], script: str) -> DataFrame:
    """Buckets with a missing path stay."""
    from ..functions.script import Script

    test = Script(script, F.col, {}, {f"params.{k}": F.col(v) for k, v in paths.items()}).column()
    for v in paths.values():
        test = test | F.col(v).isNull()
    return t.filter(test)


def bucket_sort(t: DataFrame, sort: list[tuple[str, str]], size: int | None = None, start: int = 0, by=None) -> DataFrame:
    order = [F.col(k).desc_nulls_last() if d == "desc" else F.col(k).asc_nulls_last() for k, d in sort]
    if not by:
        out = t.orderBy(*order).offset(start)
        return out.limit(size) if size is not None else out
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    out = t.withColumn("__r", rank).filter(F.col("__r") > start)
    return (out.filter(F.col("__r") <= start + size) if size is not None else out).drop("__r")


def sibling(t: DataFrame, kind: str, path: str, name: str, key: str | None = None, by=None, percents=(1, 5, 25, 50, 75, 95, 99), sigma: float = 2.0) -> DataFrame:
    """avg, sum, min, max, stats, extended_stats and percentiles of the buckets' values."""
    v = F.col(path).cast("double")
    g = t.groupBy(*(by or []))
    plain = {"avg_bucket": F.avg, "sum_bucket": F.sum, "min_bucket": F.min, "max_bucket": F.max}
    if kind in plain:
        out = [plain[kind](v).alias(name)]
        if kind in ("min_bucket", "max_bucket") and key:
            out.append((F.min_by if kind == "min_bucket" else F.max_by)(F.col(key), v).alias(f"{name}_key"))
        return g.agg(*out)
    cols = {"count": F.count(v), "min": F.min(v), "max": F.max(v), "avg": F.avg(v), "sum": F.sum(v)}
    if kind == "stats_bucket":
        return g.agg(*(c.alias(f"{name}_{k}") for k, c in cols.items()))
    if kind == "extended_stats_bucket":
        sd, mean = F.stddev_pop(v), F.avg(v)
        cols |= {"sum_of_squares": F.sum(v * v), "variance": F.var_pop(v), "std_deviation": sd, "upper": mean + sigma * sd, "lower": mean - sigma * sd}
        return g.agg(*(c.alias(f"{name}_{k}") for k, c in cols.items()))
    if kind == "percentiles_bucket":
        xs = F.array_sort(F.collect_list(v))  # nearest rank, round(p/100 * (n-1))
        rank = lambda p: (F.floor(F.lit(p / 100) * (F.size(xs) - 1) + 0.5) + 1).cast("int")
        return g.agg(*(F.try_element_at(xs, rank(p)).alias(f"{name}_{p}") for p in percents))
    raise ValueError(f"unknown pipeline [{kind}]")
