import binascii

import numpy as np
import pyarrow as pa
import pytest
from llm_brute import base_rules, private, sha

from brindle.llm import pii, quality_classifier, quality_rules


def test_base_rules(docs, texts, odd, empty):
    got = quality_rules.quality_rules(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        want = base_rules(texts[r["doc_id"]])
        assert {k: r[k] for k in want} == want, r["doc_id"]
        assert not (r["base_failed"] and r["kept"])
    rows = {r["doc_id"]: r["text"] for r in odd.collect() if r["doc_id"]}
    for r in quality_rules.quality_rules(odd).collect():
        if r["doc_id"]:
            want = base_rules(rows[r["doc_id"]])
            assert {k: r[k] for k in want} == want, r["doc_id"]
    assert quality_rules.quality_rules(empty).count() == 0


def test_rules_keep_clean_prose_and_drop_noise(spark, docs):
    import random

    r = random.Random(1)
    junk = [(9000 + i, " ".join("".join(r.choice("0123456789|=~^{}") for _ in range(6)) for _ in range(120)), "en") for i in range(5)]
    df = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(junk, "doc_id long, text string, lang string"))
    out = {x["doc_id"]: x for x in quality_rules.quality_rules(df).collect()}
    assert not any(out[i]["kept"] for i, _, _ in junk)
    good = {x["doc_id"] for x in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").filter("quality = 1").collect()}
    fine = [i for i in good if i in out and not out[i]["base_failed"]]
    assert sum(out[i]["kept"] for i in fine) >= 0.95 * len(fine)


def test_rules_of_rare_languages(spark, docs):
    import random

    r = random.Random(2)
    rare = [(9100 + i, " ".join("".join(r.choice("αβγδεζηθικλμ") for _ in range(5)) for _ in range(100)), "el") for i in range(2)]
    df = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(rare, "doc_id long, text string, lang string"))
    out = {x["doc_id"]: x for x in quality_rules.quality_rules(df).collect()}
    assert all(out[i]["kept"] and out[i]["char_distance"] is None and out[i]["word_distance"] is None for i, _, _ in rare)
    many = spark.range(700).selectExpr("id as doc_id", "repeat('some common words ', 350) as text", "'en' as lang")
    some = spark.range(10).selectExpr("id as doc_id", "repeat('λίγα άλλα λόγια ', 350) as text", "'el' as lang")
    few = spark.range(1).selectExpr("id as doc_id", "repeat('muutama sana ', 350) as text", "'fi' as lang")
    assert set(quality_rules.references(many.unionByName(some).unionByName(few))) == {"en", "el"}


def test_distance_is_jensen_shannon():
    p, q = np.array([0.5, 0.5, 0.0]), np.array([0.25, 0.25, 0.5])
    m = (p + q) / 2
    want = 0.5 * sum(a * np.log2(a / b) for a, b in zip(p, m, strict=True) if a) + 0.5 * sum(a * np.log2(a / b) for a, b in zip(q, m, strict=True) if a)
    assert quality_rules._terms(p, q).sum() == pytest.approx(want)


def parse(spans):
    return [(int(a), int(b), k) for k, a, b in (x.split(":") for x in spans.split(",") if x)]


def check_private(rows, got):
    for r in got:
        want = private(rows[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[2] == k for x in want) for k in pii.KINDS], r["doc_id"]
        assert r["base_sha256"] == sha(pii.joined(want))
        assert set(want) <= set(parse(r["spans"]))


def test_base_spans(docs, texts, odd, empty):
    check_private(texts, pii.personal_data(docs).collect())
    rows = {r["doc_id"]: r["text"] for r in odd.collect() if r["doc_id"]}
    check_private(rows, [r for r in pii.personal_data(odd).collect() if r["doc_id"]])
    assert pii.personal_data(empty).count() == 0


def test_base_spans_of_random_texts(spark):
    rng = np.random.default_rng(5)
    parts = [*"0123456789 .-+()@%_ax", "4111 1111 1111 1111", "a.b@c.de", "10.0.0.1", "300.1.2.3.4", "+49 (30) 123-4567", "@", "..", "\n", "é"]
    rows = {i: "".join(rng.choice(parts, rng.integers(1, 50))) for i in range(1500)}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    check_private(rows, pii.personal_data(df).collect())


def test_field_finds_secrets(spark):
    rows = [
        (1, "please set api_key = \"9f86d081884c7d659a2feaa0c55ad015a3bf4f1b\" before noon", True),
        (2, "the house has 42 rooms and was built in 1987 by 3 brothers", False),
        (3, "token: ghA81kLmQ92xZpTr55vBnWq0 belongs to nobody", True),
        (4, "on 12.03.2019 at 14:30 we met in room 7b for version v2.1", False),
    ]
    got = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string, x boolean")).collect()}
    assert [got[i]["n_added"] > 0 for i, _, _ in rows] == [x for _, _, x in rows]


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    k = len(pii.TAGS)
    field = pii.Field(rng.normal(size=(pii.N_FEATURES, k)), rng.normal(size=(k, k)))
    chains = [rng.integers(0, pii.N_FEATURES, (n, 6)) for n in (1, 4, 2, 4)]
    import itertools

    for c, tags in zip(chains, field.decode(chains), strict=True):
        e = field.emit[c].sum(axis=1)
        value = lambda p: sum(e[i, t] for i, t in enumerate(p)) + sum(field.move[a, b] for a, b in itertools.pairwise(p))  # noqa: B023, E731
        assert value(tags) == pytest.approx(max(map(value, itertools.product(range(k), repeat=len(c)))))


def test_classifier_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = {r["doc_id"]: r for r in quality_classifier.quality_scores(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r["held_out"] == (binascii.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    truth = [(r["quality"], got[r["doc_id"]]["score"]) for r in labels.filter("quality is not null").collect() if r["doc_id"] in got and got[r["doc_id"]]["held_out"]]
    good, bad = [s for q, s in truth if q == 1], [s for q, s in truth if q == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    right = np.mean([(s >= 0.3) == (q == 1) for q, s in truth])
    print("held out", len(truth), "auc", auc, "accuracy", right)
    assert auc > 0.95 and right > 0.9


def test_classifier_odd(odd, empty, no_labels, spark):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (6, 1, None), (8, None, 1), (None, 1, 0), (77, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality_classifier.quality_scores(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert {r["score"] for r in quality_classifier.quality_scores(odd, no_labels).collect()} == {0.5}
    assert quality_classifier.quality_scores(empty, labels).count() == 0
    kept = quality_classifier.accepted(odd, no_labels)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_classifier_reads_text_only():
    m = quality_classifier.train(["good fine words here"] * 30 + ["bad junk junk junk"] * 30, np.array([1] * 30 + [0] * 30))
    s = m.score(pa.array(["good fine words", "junk junk", None, ""]))
    assert s[0] > 0.8 and s[1] < 0.2 and s[2] == s[3]


def test_rules_do_not_depend_on_the_partitioning(docs):
    cols = ("doc_id", "kept", "char_distance", "word_distance")
    one, many = (sorted((tuple(r[c] for c in cols) for r in quality_rules.quality_rules(docs.repartition(n)).collect()), key=repr) for n in (1, 23))
    assert len(one) == len(many)
    for a, b in zip(one, many, strict=True):
        assert a[:2] == b[:2] and all((x is None and y is None) or abs(x - y) < 1e-9 for x, y in zip(a[2:], b[2:], strict=True))


def made_texts(seed=77, n=600):
    """Held-out texts by other templates than the labelled table's: (text, value of its secret or None)."""
    import random
    import string

    r = random.Random(seed)
    prose = "the harbour was quiet when our boat came home and nobody counted crates before supper though everyone remembered prices".split()
    some = lambda a, b: " ".join(r.choice(prose) for _ in range(r.randint(a, b)))
    pick = lambda letters, a, b: "".join(r.choice(letters) for _ in range(r.randint(a, b)))
    out = []
    for i in range(n):
        if i % 2:
            value = [
                lambda: pick("0123456789abcdef", 32, 64), lambda: "sk" + pick(string.ascii_letters + string.digits, 24, 40) + "7",
                lambda: pick(string.ascii_letters, 20, 32), lambda: "-".join(pick(string.ascii_lowercase, 5, 9) for _ in range(4)),
            ][i // 2 % 4]()
            form = ["{} export SECRET_KEY={} {}", '{} "passphrase": "{}", {}', "{} pwd := {} {}", "{} credential: {} {}", "{} access_key={}; {}"][i // 2 % 5]
            out.append((form.format(some(3, 30), value, some(3, 30)), value))
        else:
            form = ["{} the secret of {}", "{} key: remember the {}", "{} password is internationalisation {}", "{} in 1987 for 35 token {}", "{} a monkey authorised keys {}", "{} token = none {}"][i // 2 % 6]
            out.append((form.format(some(3, 30), some(3, 30)), None))
    return out


def test_field_held_out(spark):
    """Recall and precision of added spans on held-out texts, values taken whole."""
    rows = made_texts()
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    caught = wanted = given = 0
    for r in pii.personal_data(df).collect():
        text, value = rows[r["doc_id"]]
        got = [text[a:b] for a, b, k in parse(r["spans"]) if k == "secret"]
        wanted, given, caught = wanted + (value is not None), given + len(got), caught + (value in got)
    print("recall", caught / wanted, "precision", caught / max(given, 1))
    assert caught >= 0.95 * wanted and caught >= 0.95 * given


def test_labelled_table_is_bounded(spark, docs):
    table = pii.labelled_table(spark)
    with pytest.raises(ValueError, match="over 10 rows"):
        pii.personal_data(docs, table, max_rows=10)
    a, b = (pii.personal_data(docs, t).select("doc_id", "spans") for t in (table, table.repartition(5)))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))  # the order of the table does not matter
