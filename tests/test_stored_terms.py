"""Searches by stored terms give what searches by analysis give."""

import pytest

from brindle.plans import catalogue

QUERIES = [
    {"match": {"text": "the que"}}, {"match": {"text": {"query": "the of and", "operator": "and"}}}, {"match_phrase": {"text": "of the"}}, {"match_phrase": {"text": {"query": "the of", "slop": 2}}},
    {"bool": {"must": [{"match": {"text": "que"}}], "filter": [{"term": {"lang": "es"}}]}}, {"combined_fields": {"query": "the de", "fields": ["text"]}}, {"match": {"text": "nosuchword"}},
]


@pytest.fixture
def both(spark, sf, tmp_path):
    plain, stored = catalogue.engine(spark, sf, "documents"), catalogue.engine(spark, sf, "documents")
    stored.analyze("documents", ["text"], str(tmp_path / "terms"))
    return plain, stored


def test_same_hits_and_scores(both):
    plain, stored = both
    for q in QUERIES:
        a, b = (e.search("documents", {"query": q, "size": None}) for e in both)
        assert a.columns == b.columns
        key = lambda df: [(r["doc_id"], round(r["_score"], 9)) for r in df.collect()]
        assert key(a) == key(b), q
        assert plain.filtered("documents", q).columns == stored.filtered("documents", q).columns
    tree = {"aggs": {"w": {"terms": {"field": "text", "size": 30}}}}
    assert plain.aggregate("documents", tree).collect() == stored.aggregate("documents", tree).collect()


def test_texts_are_not_read_for_a_count(both):
    plan = both[1].count("documents", {"match": {"text": "que"}})._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<__tok_text:array<string>>" in plan and "regexp" not in plan


def test_aliases_and_patterns(both):
    plain, stored = both
    for e in both:
        e.alias("spanish", ["documents"], {"term": {"lang": "es"}})
    body = {"query": {"match": {"text": "que de"}}, "size": None}
    for name in ("spanish", "doc*"):
        a, b = ([(r["doc_id"], round(r["_score"], 9)) for r in e.search(name, body).collect()] for e in both)
        assert a == b and a


def test_changed_rows_are_analysed_anew(both, spark):
    from pyspark.sql import functions as F

    stored = both[1]
    stored.register("documents", stored.index("documents").df.withColumn("text", F.lit("entirely new words")), {"text": {"type": "text"}}, "doc_id")
    assert stored.count("documents", {"match": {"text": "que"}}).first()[0] == 0
    assert stored.count("documents", {"match": {"text": "entirely"}}).first()[0] == stored.index("documents").df.count()
