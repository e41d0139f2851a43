"""Exact percentiles and deviations against Spark's own, in parts that no task holds whole."""

import math
import random

import pytest
from pyspark.sql import functions as F

from brindle.engine import Engine
from brindle.operators import quantiles

SHARES = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.999, "e": 1.0, "f": 1 / 3}


def values():
    rng = random.Random(5)
    some = [rng.gauss(0, 10 ** rng.randint(-12, 12)) for _ in range(700)] + [rng.uniform(1e6, 1e6 + 1e-6) for _ in range(400)]
    rows = [("mixed", x) for x in some] + [("same", 3.5)] * 50 + [("one", -2.0), ("none", None), (None, 1.0), (None, 2.0), (None, None)]
    rows += [("zero", x) for x in (0.0, -0.0, 5e-324, -5e-324)] + [("far", x) for x in (math.inf, -math.inf, math.nan, 1.7e308, -1.7e308, math.nan)]
    return rows + [("close", 1.0 + k * 2.0**-52) for k in range(300)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(values(), "k string, v double").repartition(5)


def same(a, b):
    norm = lambda rs: sorted(repr(tuple(x + 0.0 if isinstance(x, float) else x for x in r)) for r in rs)
    assert norm(a) == norm(b)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_exact(rows, keys):
    want = rows.filter("v IS NOT NULL").groupBy(*keys).agg(*(F.percentile("v", p).alias(n) for n, p in SHARES.items()))
    same(quantiles.percentiles(rows, keys, F.col("v"), SHARES).collect(), want.collect())


def test_whole_numbers(spark):
    df = spark.range(1001).select((F.col("id") * 7 - 3000).alias("v"))
    assert quantiles.percentiles(df, [], F.col("v"), {"m": 0.5, "q": 0.9}).collect() == df.agg(F.percentile("v", 0.5).alias("m"), F.percentile("v", 0.9).alias("q")).collect()


def test_aggregations(spark, rows):
    e = Engine(spark)
    e.register("t", rows.filter("k IS NULL OR k != 'far'"))
    spec = {"n": {"value_count": {"field": "v"}}, "p": {"percentiles": {"field": "v", "percents": [25, 50]}}, "top": {"max": {"field": "v"}}, "m": {"median_absolute_deviation": {"field": "v"}}}
    out = e.aggregate("t", {"aggs": spec})
    assert out.columns == ["n", "p_25", "p_50", "top", "m"]
    assert "percentile(" not in out._jdf.queryExecution().optimizedPlan().toString()  # it holds all values in one task
    got = {r["k"]: r for r in e.aggregate("t", {"aggs": {"k": {"terms": {"field": "k"}, "aggs": spec}}}).collect()}
    assert got["none"]["n"] == 0 and got["none"]["p_50"] is None and got["none"]["m"] is None
    assert (got["same"]["p_25"], got["same"]["m"], got["one"]["p_50"]) == (3.5, 0.0, -2.0)
    lists = {k: sorted(v for q, v in values() if q == k) for k in ("mixed", "close")}
    for k, vs in lists.items():
        at = lambda xs, p: xs[math.floor((len(xs) - 1) * p)] * (1 - ((len(xs) - 1) * p) % 1) + xs[math.ceil((len(xs) - 1) * p)] * (((len(xs) - 1) * p) % 1)
        mid = at(vs, 0.5)
        assert math.isclose(got[k]["p_25"], at(vs, 0.25)) and math.isclose(got[k]["p_50"], mid) and math.isclose(got[k]["m"], at(sorted(abs(v - mid) for v in vs), 0.5), rel_tol=1e-6, abs_tol=1e-12)
    none = e.register("none", rows.filter("false")) and e.aggregate("none", {"aggs": spec}).collect()
    assert [tuple(r) for r in none] == [(0, None, None, None, None)]
