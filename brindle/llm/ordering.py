"""Gapless numbers over distributed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import shared_dir


def numbered(df: DataFrame, order: list, column: str, within: str | None = None) -> DataFrame:
    """`df` with a number from 0 by `order`; with `within`, the first of the order, numbers begin anew for each value.

    Rows are range-partitioned, sorted and checkpointed; each partition's count goes to the driver (one row for each
    partition and value of `within` in it), and a row's number is its place in the partition plus an offset."""
    spark = df.sparkSession
    shared_dir(spark)
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()
    rows = rows.withColumn("_at", F.monotonically_increasing_id())
    rows = rows.withColumns({"_part": F.shiftright("_at", 33).cast("int"), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    by = ["_part", within] if within else ["_part"]
    counts = sorted(rows.groupBy(*by).agg(F.min("_at").alias("low"), F.count(F.lit(1)).alias("n")).collect(), key=lambda r: (r["_part"], r["low"]))
    offsets, done = [], {}
    for r in counts:
        w = r[within] if within else 0
        offsets.append((r["_part"], w, done.get(w, 0) - r["low"]))
        done[w] = done.get(w, 0) + r["n"]
    kind = dict(df.dtypes)[within] if within else "int"
    name = within or "_none"
    table = spark.createDataFrame(offsets, f"_part int, `{name}` {kind}, _shift long")
    if not within:
        table = table.drop("_none")
    out = rows.join(F.broadcast(table), by, "left")  # a row for each partition
    return out.withColumn(column, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")
