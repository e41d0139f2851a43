import duckdb
import numpy as np
import pytest
from llm_brute import near_components, shingles, substring

from brindle.llm.exact_dedup import SQL, deduplicated, exact_dedup
from brindle.llm.near_dedup import BANDS, ROWS, NearOptions, band_keys, near_groups, odd_sketch, super_minhash
from brindle.llm.near_dedup import deduplicated as near_deduplicated
from brindle.llm.substring_dedup import FingerprintIndex, substring_dedup


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_exact_matches_sql(spark, sf, docs):
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    cols = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    want = sorted(duck.sql(f"select {', '.join(cols)} from ({SQL})").fetchall(), key=repr)
    assert rows_of(exact_dedup(docs), *cols) == want


def test_exact_odd(odd, empty):
    got = {r["doc_id"]: r for r in exact_dedup(odd).collect()}
    assert got[1]["group_size"] == 3 and got[2]["keep_id"] == 1 and not got[2]["kept"]  # nulls equal the empty text
    assert got[3]["group_size"] == 1 and got[7]["keep_id"] == 6 and got[7]["group_size"] == 3
    assert exact_dedup(empty).count() == 0
    kept = deduplicated(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.select("doc_id").collect()) == sorted(map(str, [1, 3, 4, 5, 6, 6, 8, 9, 10, None, None]))  # rows without an id stay


def test_exact_heavy_hitters(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'the same text', concat('text ', id)) as text")
    got = exact_dedup(df)
    assert got.filter("kept").count() == 2001
    assert got.filter("group_size = 1000 and keep_id = 0").count() == 1000


@pytest.mark.parametrize("n", [4, 5])
def test_near_matches_brute_force(docs, texts, n):
    want = near_components(list(texts.items()), n)
    got = near_groups(docs, NearOptions(shingle=n)).collect()
    assert len(got) == len(want)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_chains_and_large_groups(spark):
    """A chain whose ends are unlike, a large group of near copies, and many unlike texts behind a common passage."""
    base = [f"w{i}" for i in range(60)]
    rows = [(100 + k, " ".join([f"c{k}_{j}" for j in range(k * 3)] + base[k * 3 :])) for k in range(6)]
    rows += [(1000 + k, " ".join([*[f"g{i}" for i in range(100)], f"end{k}"])) for k in range(120)]
    shared = [f"s{i}" for i in range(40)]
    rows += [(2000 + k, " ".join([*shared, *[f"u{k}_{j}" for j in range(14)]])) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = near_components(rows, 4)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_groups(df, NearOptions(shingle=4)).collect()} == want


def test_near_small_sets_miss_no_pair(spark):
    """Pairs of exactly 0.8 with few shingles, each alone: four words, and the same with a fifth."""
    rows = []
    for k in range(3000):
        w = [f"p{k}_{j}" for j in range(5)]
        rows += [(2 * k, " ".join(w[:4])), (2 * k + 1, " ".join(w))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_groups(df, NearOptions(shingle=1)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i - i % 2 for i, _ in rows}


def test_near_bound_loses_no_link():
    """The odd sketch never differs in more bits than the sets do in elements; bands miss no pair of 0.8 in 3,000."""
    rng = np.random.default_rng(3)
    for n in (4, 60, 90, 900, 4000):
        for keep in (0.8, 0.9):
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            b = np.concatenate([a[: int(keep * n)], rng.integers(0, 2**63, n // 20).astype(np.uint64)])
            x, y = odd_sketch([a, b])
            assert sum(int(v).bit_count() for v in x ^ y) <= len(np.setxor1d(a, b))
    assert BANDS * np.log(1 - 0.8**ROWS) <= 25 * np.log(1 - 0.8**4)
    sets = rng.integers(0, 2**63, (3000, 75)).astype(np.uint64)
    keys = [band_keys(super_minhash(list(s))) for s in (sets, sets[:, :60])]
    assert (keys[0] == keys[1]).any(axis=1).all()


def test_near_repeated_ids_keep_the_links_of_each_row(spark):
    one, two = [f"a{i}" for i in range(80)], [f"b{i}" for i in range(80)]
    rows = [(5, " ".join(one)), (9, " ".join(one)), (9, " ".join(two)), (12, " ".join([*two, "more"])), (20, "something else entirely")]
    got = near_groups(spark.createDataFrame(rows, "doc_id long, text string"), NearOptions(shingle=4)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(5, 5), (9, 5), (9, 5), (12, 5), (20, 20)]


def test_near_odd(odd, empty):
    got = near_groups(odd, NearOptions(shingle=4)).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[1]["n_shingles"] == by[2]["n_shingles"] == by[3]["n_shingles"] == 0 and by[2]["component_id"] == 2
    assert by[7]["component_id"] == 6 and by[5]["n_shingles"] == 1 and by[4]["n_shingles"] == 5
    assert all(r["kept"] for r in got if r["doc_id"] is None)
    assert near_groups(empty).count() == 0
    kept = near_deduplicated(odd)
    assert kept.columns == odd.columns and 7 not in [r["doc_id"] for r in kept.collect()]
    assert len(shingles("One TWO", 4)) == 1


def test_substring_matches_brute_force(docs, texts):
    assert rows_of(substring_dedup(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(substring(list(texts.items())), key=repr)


def test_substring_odd(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    assert rows_of(substring_dedup(odd), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(substring(rows), key=repr)
    assert substring_dedup(empty).count() == 0


def test_substring_incremental(spark, docs, texts):
    """Two batches through one index find what one pass over both finds."""
    index = FingerprintIndex(spark)
    old, new = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")
    for k in range(5):  # enough runs for a compaction
        index.add(old.filter(f"doc_id % 10 = {2 * k}"))
    assert 1 <= len(index.runs) < 5
    got = rows_of(substring_dedup(new, index=index, history=old), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted((r for r in substring(list(texts.items())) if r[0] % 2), key=repr)
    index.drop()
