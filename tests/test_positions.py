"""Position queries by places against plain versions over all tokens; Python gets tokens only for patterns."""

import random

import pytest

from brindle.functions import positions

T = lambda v: {"term": {"value": v}}
PLANS = {
    "not": {"not": {"include": T("a"), "exclude": {"near": {"clauses": [T("b"), T("c")], "slop": 1, "ordered": False}}, "pre": 1, "post": 2}},
    "plain_not": {"not": {"include": T("a"), "exclude": T("b"), "pre": 0, "post": 0}},
    "ordered": {"near": {"clauses": [T("a"), {"or": {"clauses": [T("b"), T("c")]}}, T("a")], "slop": 2, "ordered": True}},
    "unordered": {"near": {"clauses": [T("b"), {"near": {"clauses": [T("a"), T("c")], "slop": 2, "ordered": True}}], "slop": 3, "ordered": False}},
    "prefix": {"first": {"match": {"near": {"clauses": [{"prefix": {"value": "b"}}, T("c")], "slop": 0, "ordered": True}}, "end": 9}},
    "sloppy": {"sloppy": {"terms": ["a", "b", "a"], "slop": 3}},
    "filtered": {"filtered": {"source": T("a"), "filter": T("c"), "how": "not_before"}},
    "gap": {"near": {"clauses": [T("a"), {"gap": {"width": 2}}, T("b")], "slop": 0, "ordered": True}},
    "regexp": {"containing": {"big": {"near": {"clauses": [T("a"), {"regexp": {"value": "b+"}}], "slop": 4, "ordered": False}}, "little": T("c")}},
}


def plain_near(parts, slop, ordered):
    found = set()

    def go(i, used):
        if i == len(parts):
            lo, hi = min(s for s, _ in used), max(e for _, e in used)
            if hi - lo - sum(e - s for s, e in used) <= slop:
                found.add((lo, hi))
            return
        for s, e in parts[i]:
            if not (used and s < used[-1][1] if ordered else any(s < b and a < e for a, b in used)):
                go(i + 1, [*used, (s, e)])

    go(0, [])
    return sorted(found)


def plain_sloppy(terms, slop, tokens):
    places, out = [[i for i, t in enumerate(tokens) if t == w] for w in terms], set()
    for start in places[0]:
        used = [start]
        for k in range(1, len(terms)):
            best = min((i for i in places[k] if i not in used), key=lambda i: abs(i - k - start), default=None)
            if best is None:
                break
            used.append(best)
        else:
            moved = [x - k for k, x in enumerate(used)]
            if max(moved) - min(moved) <= slop:
                out.add((min(used), max(used) + 1))
    return sorted(out)


def random_texts(n=300, longest=14):
    rng = random.Random(7)
    return [rng.choices(["a", "b", "c", "bb"], k=rng.randint(0, longest)) for _ in range(n)]


def test_plain_versions():
    for t in random_texts():
        spans = lambda w: [(i, i + 1) for i, x in enumerate(t) if x == w]
        wide = plain_near([spans("a"), spans("c")], 2, True)
        for slop in (0, 1, 3):
            assert positions.evaluate({"sloppy": {"terms": ["a", "b", "a"], "slop": slop}}, t) == plain_sloppy(["a", "b", "a"], slop, t)
            for ordered in (True, False):
                assert positions._near([spans("a"), spans("b"), spans("c")], slop, ordered) == plain_near([spans("a"), spans("b"), spans("c")], slop, ordered)
                assert set(positions._near([spans("b"), wide], slop, ordered)) <= set(plain_near([spans("b"), wide], slop, ordered))
        got = positions.evaluate(PLANS["not"], t)
        out = plain_near([spans("b"), spans("c")], 1, False)
        assert got == [(s, e) for s, e in spans("a") if not any(a < e + 2 and b > s - 1 for a, b in out)]


@pytest.mark.parametrize("name", PLANS)
def test_places_give_what_tokens_give(spark, name):
    plan, texts = PLANS[name], random_texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i long, t array<string>").repartition(3)
    df = df.select("i", positions.frequency(df["t"], plan).alias("f"))
    want = [positions.evaluate(plan, t) for t in texts]
    if name == "sloppy":
        want = [sum(1 / (1 + e - s - 3) for s, e in w) for w in want]
    else:
        want = [len(w) for w in want]
    assert {r["i"]: r["f"] for r in df.collect()} == {**dict(enumerate(want)), len(texts): 0} and any(want)
    reads = "AS tokens" in (shown := df._jdf.queryExecution().optimizedPlan().toString()) or ", tokens, " in shown
    assert reads == (name == "regexp")


def test_long_texts_take_no_time_by_pairs():
    long = ["a", "b"] * 100_000
    places = [list(range(0, len(long), 2)), list(range(1, len(long), 2))]
    assert len(positions.evaluate({"sloppy": {"at": [0, 1], "slop": 2}}, long, places)) > 0
    assert positions.evaluate({"not": {"include": {"at": 0}, "exclude": {"at": 1}}}, long, places) == positions.evaluate({"at": 0}, long, places)
    assert len(positions.evaluate({"near": {"clauses": [{"at": 0}, {"at": 1}], "slop": 0, "ordered": True}}, long, places)) == 100_000


def test_phrase_with_slop_sends_no_texts_to_python(spark, sf):
    from brindle.plans import catalogue

    df = catalogue.queries()["phrase_slop"](spark, sf)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "p0" in plan and " AS tokens" not in plan and ", tokens, " not in plan
    assert df.count() > 0
