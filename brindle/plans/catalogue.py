"""The registered queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import Engine

KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id"}
MAPPINGS = {"part": {"p_name": {"type": "text"}}, "documents": {"text": {"type": "text"}}, "benchmark": {"text": {"type": "text"}}, "conversations": {"text": {"type": "text"}}}
QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def engine(spark, sf_dir: str, *names: str) -> Engine:
    e = Engine(spark)
    for n in names:
        e.register(n, spark.read.parquet(f"{sf_dir}/{n}.parquet"), MAPPINGS.get(n), KEYS.get(n))
    return e


def register(name: str, tables: str, fn: Callable[[Engine], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: fn(engine(spark, sf_dir, *tables.split()))
    if sql:
        SQL[name] = sql


def hits(index: str, body: dict, *columns: str):
    return lambda e: e.search(index, body).select(*columns)


def found(index: str, query: dict, *columns: str):
    return lambda e: e.filtered(index, query).select(*columns)


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def table(index: str, body: dict, digits: int = 4, **names: str):
    def run(e: Engine) -> DataFrame:
        df = rounded(e.aggregate(index, body), digits)
        for a, b in names.items():
            df = df.withColumnRenamed(a, b)
        return df

    return run


def flagship(spark, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "events")
    return rounded(e.aggregate("events", {"query": {"range": {"ts": {"gte": "2024-01-05", "lt": "2024-01-20"}}}, "aggs": {"event_type": {"terms": {"field": "event_type"}, "aggs": {"avg_value": {"avg": {"field": "value"}}}}}}))


def queries() -> dict[str, Callable]:
    from . import query_set  # noqa: F401  fills QUERIES

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
