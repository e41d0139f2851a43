"""Bulk lines, the order of writes to one id, and ids of their own."""

import json

from brindle.sources import writes


def bulk(spark, index, lines):
    rows = [(i, json.dumps(x)) for i, x in enumerate(lines)]
    actions = writes.bulk_lines(spark.createDataFrame(rows, "_seq long, value string"))
    return {r["_id"]: (r["_version"], r["doc"]) for r in writes.bulk(index, actions).collect()}


def test_bulk_lines(spark):
    index = spark.createDataFrame([("a", 1, {"x": "1"}), ("b", 4, {"y": "2"})], writes.INDEX)
    head = lambda op, i: {op: {"_index": "t", "_id": i}}
    got = bulk(spark, index, [
        head("update", "a"), {"doc": {"z": 5}}, head("update", "a"), {"doc": {"z": 5}}, head("delete", "b"), head("create", "b"), {"new": True},
        head("update", "c"), {"doc": {"p": 1}, "doc_as_upsert": True}, head("update", "d"), {"doc": {"p": 1}}, {"index": {"_index": "t"}}, {"free": "id"},
        head("index", "e"), {"n": 1}, head("index", "e"), {"n": 2}, head("update", "e"), {"doc": {"m": 3}}, head("delete", "nobody"),
    ])
    free = [i for i in got if len(i) == 40]
    assert len(free) == 1 and got[free[0]] == (1, {"free": "id"})
    assert got["a"] == (2, {"x": "1", "z": "5"})  # the second update changes nothing
    assert got["b"] == (6, {"new": "true"}) and got["c"] == (1, {"p": "1"}) and "d" not in got and "nobody" not in got
    assert got["e"] == (3, {"n": "2", "m": "3"})


def test_bulk_of_nothing(spark):
    index = spark.createDataFrame([("a", 1, {"x": "1"})], writes.INDEX)
    assert bulk(spark, index, [{"delete": {"_index": "t", "_id": "z"}}]) == {"a": (1, {"x": "1"})}
    assert writes.bulk(spark.createDataFrame([], writes.INDEX), spark.createDataFrame([], writes.ACTIONS)).count() == 0
