"""Hybrid search: scores of several queries, normalised and combined; and rank evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAST = 0.001


def normalised(hits: DataFrame, how: str = "min_max", id_col: str = "_id") -> DataFrame:
    """(id, s) of one query's hits (id, _score); the sums come from one aggregation."""
    s = F.col("_score")
    if how == "rrf":
        rank = F.row_number().over(Window.orderBy(F.desc("_score"), id_col))  # over a query's top hits only
        return hits.select(id_col, (1 / (60 + rank)).alias("s"))
    a = hits.agg(F.min("_score").alias("__lo"), F.max("_score").alias("__hi"), F.sqrt(F.sum(s * s)).alias("__n"), F.avg("_score").alias("__m"), F.stddev_samp("_score").alias("__d"))
    j = hits.join(F.broadcast(a))  # one row
    if how == "min_max":
        v = F.when(F.col("__hi") == F.col("__lo"), 1.0).otherwise((s - F.col("__lo")) / F.when(F.col("__hi") == F.col("__lo"), None).otherwise(F.col("__hi") - F.col("__lo")))
        v = F.when(v == 0, LEAST).otherwise(v)
    elif how == "l2":
        v = F.try_divide(s, F.col("__n"))
    else:
        v = F.coalesce(F.try_divide(s - F.col("__m"), F.col("__d")), F.lit(0.0))
        v = F.when(v <= 0, LEAST).otherwise(v)
    return j.select(id_col, v.alias("s"))


def combined(parts: list[DataFrame], how: str = "arithmetic_mean", weights: list[float] | None = None, id_col: str = "_id") -> DataFrame:
    w = weights or [1.0] * len(parts)
    whole = None
    for k, p in enumerate(parts):
        p = p.select(id_col, F.lit(float(w[k])).alias("w"), "s")
        whole = p if whole is None else whole.unionByName(p)
    g = whole.groupBy(id_col)
    total = float(sum(w))
    if how == "rrf":
        out = F.sum(F.col("w") * F.col("s"))
    elif how == "geometric_mean":
        out = F.exp(F.sum(F.when(F.col("s") > 0, F.col("w") * F.ln(F.when(F.col("s") > 0, F.col("s"))))) / F.sum(F.when(F.col("s") > 0, F.col("w"))))
    elif how == "harmonic_mean":
        out = F.sum(F.when(F.col("s") > 0, F.col("w"))) / F.sum(F.when(F.col("s") > 0, F.col("w") / F.when(F.col("s") > 0, F.col("s"))))
    else:
        out = F.sum(F.col("w") * F.col("s")) / total
    return g.agg(out.alias("_score"))


def hybrid(engine, index: str, queries: list[dict], normalisation: str = "min_max", combination: str = "arithmetic_mean", weights=None, depth: int = 100, size: int = 10) -> DataFrame:
    id_col = engine.index(index).id_col
    parts = []
    for q in queries:
        top = engine.search(index, {"query": q, "size": depth}).select(id_col, "_score")
        parts.append(normalised(top, normalisation, id_col))
    return combined(parts, combination, weights, id_col).orderBy(F.desc("_score"), id_col).limit(size)


def rank_metrics(ranked: DataFrame, ratings: DataFrame, k: int = 10, threshold: int = 1) -> DataFrame:
    """Of each query: precision, recall, reciprocal rank and DCG.  ranked: (query, doc, rank from 1); ratings: (query, doc, rating)."""
    top = ranked.filter(F.col("rank") <= k).join(ratings, ["query", "doc"], "left")
    good = F.col("rating") >= threshold
    all_good = ratings.groupBy("query").agg(F.count_if(good).alias("__all"))
    out = top.groupBy("query").agg(F.count(F.lit(1)).alias("__n"), F.count_if(good).alias("__hit"), F.min(F.when(good, F.col("rank"))).alias("__first"), F.sum((F.pow(F.lit(2.0), F.coalesce("rating", F.lit(0))) - 1) / F.log2(F.col("rank") + 1)).alias("dcg"))
    out = out.join(all_good, "query", "left")
    return out.select("query", (F.col("__hit") / F.col("__n")).alias("precision"), F.try_divide("__hit", "__all").alias("recall"), F.coalesce(1 / F.col("__first"), F.lit(0.0)).alias("mrr"), "dcg")
