from collections import defaultdict

from llm_brute import plain_kd, targets, words

from brindle.llm.mixing import mix, mixed
from brindle.llm.sharding import evened, kd_leaves, kd_shards


def check_mix(rows, got):
    """rows: [(doc_id, text, source)]"""
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want, taken, source_of = targets(dict(sizes)), defaultdict(int), defaultdict(list)
    for i, t, s in rows:
        source_of[i].append((s, len(words(t))))
    assert len(got) == len(rows)
    for r in got:
        s, n = next((s, n) for s, n in source_of[r["doc_id"]] if n == r["size"] and sizes[s] == r["source_size"])
        assert abs(r["target"] - want[s]) < 1e-6 * max(1, want[s]) and 0 <= r["taken"] <= 3 * n
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1, s


def test_mix(docs):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    got = mix(docs).collect()
    check_mix(rows, got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix(docs.repartition(3)).collect()))


def test_mix_skew(spark):
    """One source holds a third of all rows, another is tiny and stops at three epochs."""
    df = spark.range(900).selectExpr("id as doc_id", "array_join(array_repeat('w', cast(id % 50 as int)), ' ') as text", "if(id % 3 = 0, 'aa', if(id < 10, 'zz', concat('s', id % 7))) as source")
    check_mix([(r["doc_id"], r["text"], r["source"]) for r in df.collect()], mix(df).collect())


def test_mix_odd(odd, empty):
    got = mix(odd).collect()
    assert len(got) == odd.count() and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert {r["source_size"] for r in got if r["doc_id"] == 4} == {sum(len(words(r["text"])) for r in odd.collect() if r["source"] is None)}
    assert mix(empty).count() == 0 and mixed(empty).count() == 0
    assert mixed(odd).columns == odd.columns


def test_mixed_keeps_rows_without_an_id(spark):
    """Rows of null id get the repetitions planned for each, told apart by their text."""
    rows = [(None, f"w{k} x y", "a") for k in range(40)] + [(1, "only one of the second source", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sum(round(r["taken"] / r["size"]) for r in mix(df).collect())
    got = mixed(df)
    assert got.columns == df.columns and got.count() == want > 20
    assert 1 < got.filter("doc_id IS NULL").select("text").distinct().count() <= 40


def test_mixed_repeats_documents(docs):
    plan = {r["doc_id"]: r for r in mix(docs).collect()}
    times = defaultdict(int)
    for r in mixed(docs).select("doc_id").collect():
        times[r["doc_id"]] += 1
    for i, r in plan.items():
        assert abs(times[i] * r["size"] - r["taken"]) <= r["size"] / 2 + 1e-9


def check_shards(rows, got, near=0.02):
    sizes, slots = defaultdict(int), defaultdict(list)
    assert len(got) == len(rows)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(sizes) <= set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r["law"] for r in got} == {"bytes"} and all(r["grown_shard"] is None for r in got)
    total = sum(len((t or "").encode()) + 1 for _, t in rows)
    assert sum(sizes.values()) == total
    if near:
        assert max(sizes.values()) - min(sizes.values()) <= near * total / 16 + max(len((t or "").encode()) for _, t in rows)


def test_shards(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = kd_shards(docs).collect()
    check_shards(rows, got)
    place, text = {r["doc_id"]: r["shard"] for r in got}, defaultdict(set)
    for i, t in rows:
        text[t].add(place[i])
    assert all(len(s) == 1 for s in text.values())  # equal texts share a shard


def test_shards_odd(odd, empty):
    import zlib

    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = kd_shards(odd).collect()
    check_shards(rows, got, near=0)
    crc = {i: zlib.crc32((t or "").encode()) for i, t in rows if i is not None}
    assert all(r["text_crc32"] == crc[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert kd_shards(empty).count() == 0


def test_tree_equals_a_plain_one(spark):
    import random

    r = random.Random(4)
    units = {f"u{i}": (r.randint(1, 900), {"a": r.randint(0, 1 << 20), "b": int(r.random() ** 3 * (1 << 19)), "c": r.randint(0, 3) << 17}, i) for i in range(700)}
    df = spark.createDataFrame([(k, w, c["a"], c["b"], c["c"], t) for k, (w, c, t) in units.items()], "same string, w long, a long, b long, c long, tie long")
    for part in (1, 7):
        got = {x["same"]: x["shard"] for x in kd_leaves(df.repartition(part), ["a", "b", "c"], [1000] * 8).collect()}
        assert got == plain_kd(units, ["a", "b", "c"], 8)


def test_the_tree_decides_nearly_all(spark, monkeypatch):
    """Moves after the tree touch few bytes, and the loads end within half a percent."""
    from brindle.llm import sharding

    seen = {}

    def watched(loads, units, slack):
        moved = evened(loads, units, slack)
        weight = {k: w for k, w, _ in units}
        seen["share"] = sum(weight[k] for k in moved) / sum(loads)
        return moved

    monkeypatch.setattr(sharding, "evened", watched)
    sizes = defaultdict(int)
    for r in kd_shards(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect():
        sizes[r["shard"]] += r["size"]
    assert seen.get("share", 0) < 0.05
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 0.006 * sum(sizes.values()) / 16


def test_evened():
    units = [("a", 40, 0), ("b", 30, 0), ("c", 20, 1), ("d", 10, 1), ("e", 1, 2)]
    assert evened([500, 70, 30, 1], [], 0) == {}  # nothing can move
    moved = evened([70, 30, 500], units, 0)  # the third is fixed but for its smallest
    shard = {k: moved.get(k, s) for k, _, s in units}
    assert abs(sum(w for k, w, _ in units if shard[k] == 0) - sum(w for k, w, _ in units if shard[k] == 1)) <= 1
    assert evened([70, 30], [u for u in units if u[2] < 2], 50) == {}


def test_shards_of_groups(spark):
    """A group of half a leaf to a leaf stays whole; one above a leaf, of repeated and null ids, is dealt row by row."""
    rows = [(i, f"text {i} " * 10) for i in range(2000)]
    unit = len("group of copies ") * 12 + 1
    rows += [(5000 + i, "group of copies " * 12) for i in range(90)]
    rows += [(None if i % 2 else 7, "the hot text " * 15) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source")
    got = kd_shards(df).collect()
    check_shards(rows, got)
    total = sum(r["size"] for r in got)
    assert 0.5 < 90 * unit / (total / 16) < 1
    assert len({r["shard"] for r in got if (r["doc_id"] or 0) >= 5000}) == 1
    assert len({r["shard"] for r in got if r["doc_id"] in (None, 7)}) > 4
