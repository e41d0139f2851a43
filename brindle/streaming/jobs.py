"""Transforms, rollups and event-time windows, the same plan for batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_AGGS = {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg, "value_count": F.count}


def transform(df: DataFrame, keys: dict, metrics: dict[str, tuple[str, str]]) -> DataFrame:
    """One row for each group: keys are columns or expressions, metrics are name -> (function, column)."""
    return df.groupBy(*(c.alias(k) for k, c in keys.items())).agg(*(_AGGS[f](c).alias(n) for n, (f, c) in metrics.items()))


def continuous(previous: DataFrame | None, source: DataFrame, batch: DataFrame, keys: dict, metrics: dict) -> DataFrame:
    """The transform's table after a batch: the groups that it touches are computed anew over all of `source`."""
    touched = batch.select(*(c.alias(k) for k, c in keys.items())).distinct()
    marked = source.withColumns({f"__{k}": c for k, c in keys.items()})
    again = marked.join(touched.select(*(F.col(k).alias(f"__{k}") for k in keys)), [f"__{k}" for k in keys], "left_semi")
    fresh = transform(again, keys, metrics)
    return fresh if previous is None else previous.join(touched, list(keys), "left_anti").unionByName(fresh)


def rollup(df: DataFrame, time_col: str, unit: str, dims: list[str], value: str) -> DataFrame:
    """Sums and counts from which averages of any coarser window follow."""
    t = F.date_trunc(unit, F.col(time_col)).cast("timestamp_ntz").alias("bucket")
    return df.groupBy(t, *dims).agg(F.sum(value).alias("sum"), F.count(value).alias("count"), F.min(value).alias("min"), F.max(value).alias("max"))


def rollup_search(table: DataFrame, keys: list) -> DataFrame:
    return table.groupBy(*keys).agg((F.sum("sum") / F.sum("count")).alias("avg"), F.sum("sum").alias("sum"), F.sum("count").alias("count"), F.min("min").alias("min"), F.max("max").alias("max"))


def tumbling(df: DataFrame, time_col: str, size: str, keys: list[str], late: str | None = None, slide: str | None = None) -> DataFrame:
    """Counts and sums by event-time window; `late` sets the watermark of a stream."""
    df = df.withWatermark(time_col, late) if late and df.isStreaming else df
    w = F.window(time_col, size, slide) if slide else F.window(time_col, size)
    out = df.groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), *keys, "n", "total")


def sessions(df: DataFrame, time_col: str, gap: str, key: str, late: str | None = None) -> DataFrame:
    df = df.withWatermark(time_col, late) if late and df.isStreaming else df
    out = df.groupBy(F.session_window(time_col, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


def replayed(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a streaming plan until all available input is read; the result is an in-memory table."""
    spark = df.sparkSession
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
