"""Score arithmetic: BM25, rank features, decay, field value factor, and their combination."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def idf(n: float, df: float) -> float:
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(freq: Column, length: Column, average: float, weight: float, k1: float = K1, b: float = B) -> Column:
    """weight is the sum of the terms' idf (times boost)."""
    return F.lit(weight) * freq / (freq + k1 * ((1 - b) + b * length / F.lit(average or 1.0)))


def term_freq(tokens: Column, term: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t == term)).cast("double")


def rank_feature(v: Column, spec: dict, positive: bool = True) -> Column:
    v = v.cast("double") if positive else 1 / v.cast("double")
    if "log" in spec:
        return F.ln(spec["log"]["scaling_factor"] + v)
    if "sigmoid" in spec:
        p, e = spec["sigmoid"]["pivot"], spec["sigmoid"]["exponent"]
        return F.pow(v, e) / (F.pow(v, e) + p**e)
    if "linear" in spec:
        return v
    p = spec.get("saturation", {}).get("pivot", 1.0)
    return v / (v + p)


def decay(kind: str, distance: Column, scale, offset, rate) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    scale, offset, rate = lit(scale), lit(offset), lit(rate)
    d = F.greatest(F.lit(0.0), distance - offset)
    if kind == "gauss":
        return F.exp(d * d * F.ln(rate) / (scale * scale))
    if kind == "exp":
        return F.exp(F.ln(rate) / scale * d)
    limit = scale / (1 - rate)
    return F.greatest(F.lit(0.0), (limit - d) / limit)


def value_factor(v: Column, spec: dict) -> Column:
    v = F.coalesce(v.cast("double"), F.lit(float(spec.get("missing", 0)))) * float(spec.get("factor", 1))
    return {
        "none": lambda: v, "log": lambda: F.log10(v), "log1p": lambda: F.log10(1 + v), "log2p": lambda: F.log10(2 + v), "ln": lambda: F.ln(v), "ln1p": lambda: F.log1p(v),
        "ln2p": lambda: F.ln(2 + v), "square": lambda: v * v, "sqrt": lambda: F.sqrt(v), "reciprocal": lambda: F.when(v == 0, 0.0).otherwise(1 / F.when(v == 0, None).otherwise(v)),
    }[spec.get("modifier", "none")]()


def combine(values: list[tuple[Column, Column, float]], mode: str) -> Column:
    """Score of matching functions: (matches, value, weight); null if none matches."""
    on = F.filter(F.array(*(F.when(m, F.struct(v.cast("double").alias("v"), F.lit(float(w)).alias("w"))) for m, v, w in values)), lambda x: x.isNotNull())
    each = F.transform(on, lambda x: x["v"])
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    out = {
        "multiply": lambda: F.aggregate(each, F.lit(1.0), lambda s, x: s * x), "sum": lambda: total(each), "first": lambda: F.try_element_at(each, F.lit(1)),
        "max": lambda: F.array_max(each), "min": lambda: F.array_min(each), "avg": lambda: total(each) / total(F.transform(on, lambda x: x["w"])),
    }[mode]()
    return F.when(F.size(on) > 0, out)


def boosted(score: Column, value: Column, mode: str) -> Column:
    out = {
        "multiply": lambda: score * value, "replace": lambda: value, "sum": lambda: score + value, "avg": lambda: (score + value) / 2, "max": lambda: F.greatest(score, value), "min": lambda: F.least(score, value),
    }[mode]()
    return F.when(value.isNull(), score).otherwise(out)
