"""Every registered query against its DuckDB SQL."""

import math

import duckdb
import pytest

from brindle.plans import catalogue

NAMES = sorted(catalogue.queries())
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: entries without SQL; tests/test_brute.py holds each against a plain version or its law
BRUTE = {"cardinality_approx", "common_terms", "hybrid_l2", "hybrid_min_max", "hybrid_rrf", "hybrid_z_score", "ingest_html_strip", "more_like_this", "moving_fn_holt", "moving_fn_holt_winters", "slice_partition", "terms_partition"}
NO_ROWS = {"common_terms"}  # no text holds its rarer word; common_terms_found has rows and SQL


@pytest.fixture(scope="module")
def duck(sf):
    d = duckdb.connect()
    for t in TABLES:
        d.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return d


def norm(rows):
    cell = lambda v: round(v, 6) + 0.0 if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(cell(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, duck, name):
    got = catalogue.queries()[name](spark, sf)
    cols = sorted(got.columns)
    rows = norm(tuple(r[c] for c in cols) for r in got.collect())
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert name in BRUTE and (rows or name in NO_ROWS)
        return
    want = duck.sql(sql)
    assert sorted(want.columns) == cols
    order = [want.columns.index(c) for c in cols]
    assert rows == norm(tuple(r[i] for i in order) for r in want.fetchall())
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "TIMESTAMP": "timestamp_ntz"}
    assert [dict(got.dtypes)[c] for c in cols] == [kinds.get(str(want.types[i]), str(want.types[i])) for i in order]


@pytest.mark.parametrize("name", [n for n in NAMES if n.endswith("_whole")])
def test_whole_results(spark, name):
    """At a size where the capped queries lose rows; none of the SQL has a limit."""
    d, sql = duckdb.connect(), catalogue.oracle_sql()[name]
    for t in TABLES:
        d.sql(f"create view {t} as select * from '/root/testdata/sf0.1/{t}.parquet'")
    assert "LIMIT" not in sql
    assert catalogue.queries()[name](spark, "/root/testdata/sf0.1").count() == d.sql(f"select count(*) from ({sql})").fetchall()[0][0]


def test_every_capped_query_has_a_whole_one():
    capped = "post_filter script_fields source_filter named_queries sql_case sql_between_in_like sql_functions sql_full_text ext_row_number ppl_fields_rename"
    assert {f"{n}_whole" for n in capped.split()} <= set(NAMES)
