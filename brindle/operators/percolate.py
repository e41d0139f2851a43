"""Percolation: stored queries against documents, one pass with a flag for each query."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import mapping_of
from ..plans.query import QueryCompiler


def percolate(docs: DataFrame, rules: dict[str, dict], mapping: dict | None = None) -> DataFrame:
    """(rule, every document column) of each match; the rules are a registry of bounded size, compiled to columns."""
    c = QueryCompiler(docs, mapping_of(docs, mapping), scoring=False)
    flags = [F.when(c.compile(q).pred, F.lit(n)) for n, q in rules.items()]
    return c.df.withColumn("rule", F.explode(F.filter(F.array(*flags), lambda x: x.isNotNull())))


def matching_rules(compiler: QueryCompiler, field: str, docs: list[dict]) -> list[str]:
    """Ids of the stored queries (a JSON string column) that match any of the given documents."""
    spark = compiler.df.sparkSession
    table = spark.read.json(spark.sparkContext.parallelize([json.dumps(d) for d in docs]))
    rules = {r["i"]: json.loads(r["q"]) for r in compiler.df.select(compiler.col("_id").alias("i"), F.col(field).alias("q")).toLocalIterator() if r["q"]}
    text = {n: {"type": "text"} for n, t in table.dtypes if t == "string"}
    return sorted(r["rule"] for r in percolate(table, rules, text).select("rule").distinct().collect())
