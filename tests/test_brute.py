"""Registered queries without SQL, each against a plain version in Python or the law it must keep."""

import math
import re
import statistics
from collections import Counter
from html.parser import HTMLParser

import pytest

from brindle.plans import catalogue


def run(spark, sf, name):
    return catalogue.queries()[name](spark, sf).collect()


@pytest.fixture(scope="module")
def orders(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").collect()


def holt(xs, alpha=0.3, beta=0.1):
    if not xs:
        return None
    s, b = xs[0], (xs[1] - xs[0] if len(xs) > 1 else 0.0)
    for x in xs[1:]:
        last, s = s, alpha * x + (1 - alpha) * (s + b)
        b = beta * (s - last) + (1 - beta) * b
    return s + b


def holt_winters(xs, period, alpha=0.3, beta=0.1, gamma=0.3):
    if len(xs) < 2 * period:
        return None
    s = sum(xs[:period]) / period
    b = (sum(xs[period : 2 * period]) / period - s) / period
    season = [x - s for x in xs[:period]]
    for x in xs[period:]:
        last, c = s, season[-period]
        s = alpha * (x - c) + (1 - alpha) * (s + b)
        b = beta * (s - last) + (1 - beta) * b
        season.append(gamma * (x - s) + (1 - gamma) * c)
    return s + b + season[-period]


@pytest.mark.parametrize("name, window, plain", [("moving_fn_holt", 6, holt), ("moving_fn_holt_winters", 24, lambda xs: holt_winters(xs, 6))])
def test_moving_models(spark, sf, orders, name, window, plain):
    sums = Counter()
    for r in orders:
        sums[r["o_orderdate"].year, r["o_orderdate"].month] += r["o_totalprice"]
    months = sorted(sums)
    got = sorted(run(spark, sf, name), key=lambda r: r["m"])
    assert [(r["m"].year, r["m"].month) for r in got] == months and any(r["x"] is not None for r in got)
    for i, r in enumerate(got):
        want = plain([sums[m] for m in months[max(0, i - window) : i]])
        assert (r["x"] is None) == (want is None) and (want is None or math.isclose(r["x"], want, rel_tol=1e-6, abs_tol=0.02)), i


@pytest.mark.parametrize("how", ["min_max", "l2", "z_score", "rrf"])
def test_hybrid(spark, sf, orders, how):
    def scaled(scores):
        top = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:100]
        v = [s for _, s in top]
        if how == "rrf":
            return {k: 1 / (61 + i) for i, (k, _) in enumerate(top)}
        if how == "l2":
            norm = math.sqrt(sum(s * s for s in v))
            return {k: s / norm for k, s in top}
        if how == "min_max":
            return {k: max((s - min(v)) / (max(v) - min(v)), 0.001) if max(v) > min(v) else 1.0 for k, s in top}
        mean, sd = statistics.mean(v), statistics.stdev(v)
        return {k: s if (s := (x - mean) / sd) > 0 else 0.001 for k, x in top}

    a = scaled({r["o_orderkey"]: r["o_totalprice"] / (r["o_totalprice"] + 1000) for r in orders})
    b = scaled({r["o_orderkey"]: 500 / (500 + abs(r["o_totalprice"] - 100000)) for r in orders})
    both = a.keys() | b.keys()
    # a mean leaves out the queries that did not find the document only where its weights say so: all count here
    want = {k: (a.get(k, 0) + b.get(k, 0)) / (1 if how == "rrf" else 2) for k in both}
    got = run(spark, sf, f"hybrid_{how}")
    assert len(got) == 10
    best = sorted(want.values(), reverse=True)[:10]
    for r, w in zip(sorted(got, key=lambda r: -r["_score"]), best, strict=True):
        assert abs(r["_score"] - w) < 2e-4 and abs(want[r["o_orderkey"]] - r["_score"]) < 2e-4


def test_slices_part_the_table(spark, sf, orders):
    e = catalogue.engine(spark, sf, "orders")
    parts = [[r["o_orderkey"] for r in e.search("orders", {"slice": {"id": i, "max": 4}, "sort": ["o_orderkey"], "size": None}).collect()] for i in range(4)]
    assert all(parts) and sorted(sum(parts, [])) == sorted(r["o_orderkey"] for r in orders)
    assert parts[1] == [r["o_orderkey"] for r in run(spark, sf, "slice_partition")]


def test_partitions_part_the_terms(spark, sf, orders):
    e, want = catalogue.engine(spark, sf, "orders"), Counter(r["o_custkey"] for r in orders)
    parts = [{r["k"]: r["doc_count"] for r in e.aggregate("orders", {"aggs": {"k": {"terms": {"field": "o_custkey", "include": {"partition": i, "num_partitions": 4}, "size": None}}}}).collect()} for i in range(4)]
    assert sum(map(len, parts)) == len(want) and {k: n for p in parts for k, n in p.items()} == want
    assert parts[0] == {r["k"]: r["doc_count"] for r in run(spark, sf, "terms_partition")}


def test_approximate_cardinality(spark, sf, orders):
    want = len({r["o_custkey"] for r in orders})
    assert abs(run(spark, sf, "cardinality_approx")[0]["n"] - want) <= 0.06 * want  # three times its standard error


def test_html_strip(spark, sf):
    class Text(HTMLParser):
        def __init__(self):
            super().__init__()
            self.parts = []

        def handle_data(self, data):
            self.parts.append(data)

    plain = {}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        t = Text()
        t.feed(r["html"])
        plain[r["page_id"]] = Counter(re.findall(r"\w+", " ".join(t.parts)))
    got = {r["page_id"]: r["html"] for r in run(spark, sf, "ingest_html_strip")}
    assert got.keys() == plain.keys()
    for k, html in got.items():
        assert not re.search(r"</?[A-Za-z][^<>]*>", html)
        assert Counter(re.findall(r"\w+", html)) <= plain[k]  # scripts and styles may be left out


def test_entities(spark):
    from brindle.functions.analysis import entities

    cases = {"&lt;b&gt; &amp;lt; &#38;gt;": "<b> &lt; &gt;", "caf&eacute; &#8364; &#x1F600;": "café € 😀", "&nosuch; & &; &#0; &#xD800;": "&nosuch; & &; &#0; &#xD800;", "plain": "plain", "": ""}
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "t string")
    assert {r["t"]: r["u"] for r in df.withColumn("u", entities(df["t"])).collect()} == {**cases, None: None}


def test_more_like_this(spark, sf):
    """Every hit shares a term with the document, which itself is none of the hits; a text of its own terms is one."""
    docs = {r["doc_id"]: set(re.findall(r"\w+", (r["text"] or "").lower())) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"] for r in run(spark, sf, "more_like_this")}
    assert got and 1 not in got and all(docs[i] & docs[1] for i in got)
    assert {i for i, t in docs.items() if i != 1 and t and t >= docs[1]} <= got


def test_common_terms(spark, sf):
    assert run(spark, sf, "common_terms") == []
    assert run(spark, sf, "common_terms_found")
