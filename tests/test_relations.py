"""Parents and children of one index by a join field, inner hits, and errors."""

import pytest

from brindle.engine import Engine


@pytest.fixture
def forum(spark):
    rows = [
        ("q1", "question", None, "ann", 0), ("q2", "question", None, "bob", 0), ("q3", "question", None, "ann", 0),
        ("a1", "answer", "q1", "cid", 3), ("a2", "answer", "q1", "bob", 5), ("a3", "answer", "q2", "cid", 1), ("a4", "answer", None, "dan", 9),
    ]
    df = spark.createDataFrame(rows, "id string, name string, parent string, user string, votes long").selectExpr("id", "user", "votes", "named_struct('name', name, 'parent', parent) AS rel")
    e = Engine(spark)
    e.register("forum", df, {"rel": {"type": "join", "relations": {"question": "answer"}}}, "id")
    return e


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_children_by_join_field(forum):
    body = {"query": {"term": {"rel.name": "question"}}, "aggs": {"asker": {"terms": {"field": "user"}, "aggs": {"answers": {"children": {"type": "answer"}, "aggs": {"best": {"max": {"field": "votes"}}}}}}}}
    assert rows(forum.aggregate("forum", body), "asker", "doc_count", "best") == [("ann", 2, 5), ("bob", 1, 1)]
    tables = forum.aggregate_tables("forum", body)
    assert rows(tables["asker"], "asker", "doc_count") == [("ann", 2), ("bob", 1)]
    assert rows(tables["asker>answers"], "asker", "doc_count") == [("ann", 2), ("bob", 1)]


def test_parent_by_join_field(forum):
    body = {"aggs": {"up": {"parent": {"type": "answer"}, "aggs": {"asker": {"terms": {"field": "user"}}}}}}
    assert rows(forum.aggregate("forum", body), "asker", "doc_count") == [("ann", 1), ("bob", 1)]  # q1 once, and no parent of a4


def test_inner_hits_of_children(forum):
    got = forum.search("forum", {"query": {"has_child": {"type": "answer", "query": {"range": {"votes": {"gt": 0}}}, "inner_hits": {"name": "best", "size": 1, "sort": [{"votes": "desc"}]}}}, "sort": ["id"], "_source": ["id"]})
    assert [(r["id"], [h["id"] for h in r["inner_hits_best"]]) for r in got.collect()] == [("q1", ["a2"]), ("q2", ["a3"])]


def test_key_clash_is_an_error(forum):
    with pytest.raises(ValueError, match="bucket names"):
        forum.aggregate("forum", {"aggs": {"user": {"terms": {"field": "user"}, "aggs": {"answers": {"children": {"type": "answer"}}}}}})


def test_scripts_that_are_no_sum_are_an_error(forum):
    with pytest.raises(ValueError, match="only scripts that sum"):
        forum.aggregate("forum", {"aggs": {"m": {"scripted_metric": {"map_script": "state.x = doc['votes'].value", "combine_script": "return state.x", "reduce_script": "return states.size()"}}}})


def test_metrics_above_and_below_nested(spark):
    e = Engine(spark)
    e.register("boxes", spark.sql("SELECT * FROM VALUES (1, 10, array(named_struct('k', 'a', 'n', 1), named_struct('k', 'b', 'n', 2))), (2, 20, array(named_struct('k', 'a', 'n', 5), named_struct('k', 'a', 'n', 6))) AS t(id, w, parts)"), None, "id")
    body = {"aggs": {"in_parts": {"nested": {"path": "parts"}, "aggs": {"k": {"terms": {"field": "parts.k"}, "aggs": {"n": {"sum": {"field": "parts.n"}}, "back": {"reverse_nested": {}, "aggs": {"w": {"sum": {"field": "w"}}}}}}}}}}
    assert rows(e.aggregate("boxes", body), "k", "n", "doc_count", "w") == [("a", 12, 2, 30), ("b", 2, 1, 10)]
    assert rows(e.aggregate_tables("boxes", body)["in_parts>k"], "k", "n", "doc_count") == [("a", 12, 3), ("b", 2, 1)]
