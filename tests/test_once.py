"""Texts are analysed once for each row, whatever the length of the text and the number of terms."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from brindle.engine import Engine
from brindle.functions.analysis import Analyzers, token_filter, tokenizer

TEXTS = ["of the of the", "the of", "OF  the!", "of of the", "a a a", "of", "", None, "de la of-the"]


@pytest.fixture
def engine(spark):
    e = Engine(spark)
    e.register("docs", spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").repartition(3), {"text": {"type": "text"}}, "id")
    return e


def analyses(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all")


def test_phrase(engine):
    df = engine.filtered("docs", {"match_phrase": {"text": "of the"}})
    assert sorted(r["id"] for r in df.collect()) == [0, 2, 3, 8] and analyses(df) == 1
    assert [r["id"] for r in engine.filtered("docs", {"match_phrase": {"text": "a a a"}}).collect()] == [4]
    hits = {r["id"]: r["_score"] for r in engine.search("docs", {"query": {"match_phrase": {"text": "of the"}}, "size": None}).collect()}
    assert hits.keys() == {0, 2, 3, 8} and hits[0] == max(hits.values())


def test_filters_that_look_at_neighbours(spark):
    df = spark.createDataFrame([("a the b",), ("the",), ("",)], "t string")
    words = Analyzers().tokens(F.col("t"))
    got = df.select(token_filter("shingle", words, {"output_unigrams": False}).alias("s"), token_filter("common_grams", words, {"common_words": ["the"]}).alias("g"))
    assert analyses(got) == 2
    assert [(r["s"], r["g"]) for r in got.collect()] == [(["a the", "the b"], ["a", "a_the", "the", "the_b", "b"]), ([], ["the"]), ([], [])]
    paths = spark.createDataFrame([("a/b/c",)], "t string").select(tokenizer("path_hierarchy", F.col("t"), {}).alias("p"), tokenizer("path_hierarchy", F.col("t"), {"reverse": True}).alias("r")).first()
    assert paths["p"] == ["a", "a/b", "a/b/c"] and paths["r"] == ["a/b/c", "b/c", "c"]


def test_terms(engine):
    for q in ({"match": {"text": {"query": "of the", "operator": "and"}}}, {"match": {"text": {"query": "of the la", "minimum_should_match": 2}}}):
        df = engine.filtered("docs", q)
        assert sorted(r["id"] for r in df.collect()) == [0, 1, 2, 3, 8] and analyses(df) == 1


def test_more_like_this(spark):
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(6000)]
    texts = [words[i * 20 : i * 20 + rng.randint(0, 20)] for i in range(300)] + [[f"z{i}" for i in range(12_000)] + ["w1", "y"], ["y"] * 3 + ["w1", "w2"], *[["y"]] * 4]
    e = Engine(spark)
    e.register("docs", spark.createDataFrame([*((i, " ".join(t)) for i, t in enumerate(texts)), (999, None)], "id long, text string").repartition(3), {"text": {"type": "text"}}, "id")
    spec = {"fields": ["text"], "like": [{"_id": "300"}, {"_id": "7"}], "min_term_freq": 1, "max_query_terms": 8, "min_doc_freq": 2}
    df = e.filtered("docs", {"more_like_this": spec})
    counts, held = Counter(texts[300] + texts[7]), Counter(w for t in texts for w in set(t))
    best = sorted((w for w in counts if held[w] >= 2), key=lambda w: (-counts[w] * (math.log((len(texts) + 2) / (held[w] + 1)) + 1), w))[:8]
    assert "y" in best and "z5" not in best
    want = {i for i, t in enumerate(texts) if i not in (7, 300) and len(set(t) & set(best)) >= max(1, len(best) * 30 // 100)}
    assert want and {r["id"] for r in df.collect()} == want and analyses(df) == 1
    scored = e.search("docs", {"query": {"more_like_this": spec}, "size": None}).collect()
    assert {r["id"] for r in scored} == want and all(r["_score"] > 0 for r in scored)
