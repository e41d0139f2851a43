"""Each stage against its own input, as the pipeline runs it."""

from collections import Counter

import numpy as np
from llm_brute import near_components

import __spark_entry__
import corpus_pipeline
from brindle.llm import quality_classifier
from brindle.llm.mixing import mix
from brindle.llm.token_count import default_tokenizer


def test_stages(spark, sf, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept, columns = [docs], docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], sf).write.parquet(f"{tmp_path}/{k}")
        kept.append(spark.read.parquet(f"{tmp_path}/{k}"))
    assert all(d.columns == columns for d in kept[:-1])
    rows = [[(r["doc_id"], r["text"]) for r in d.collect()] for d in kept[:-1]]
    scores = {r["doc_id"]: r["predicted"] for r in quality_classifier.quality_scores(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert sorted(rows[1]) == sorted(r for r in rows[0] if scores[r[0]])
    first = {}
    for i, t in sorted(rows[1]):
        first.setdefault(" ".join((t or "").split()), i)
    assert sorted(i for i, _ in rows[2]) == sorted(first.values())
    parts = near_components(rows[2], 5)
    assert sorted(i for i, _ in rows[3]) == sorted({c for _, c in parts.values()})
    plan = {r["doc_id"]: r for r in mix(kept[3]).collect()}
    times = Counter(i for i, _ in rows[4])
    assert all(abs(times[i] * r["size"] - r["taken"]) <= r["size"] / 2 + 1e-9 for i, r in plan.items())
    library = Tokenizer.from_file(default_tokenizer())
    assert sorted((r["doc_id"], list(r["ids"])) for r in kept[-1].collect()) == sorted((i, library.encode(t, add_special_tokens=False).ids) for i, t in rows[4])
    whole = corpus_pipeline.run(spark, sf)
    assert whole.columns == kept[-1].columns and whole.count() == kept[-1].count()


def test_empty_and_odd(spark, odd, empty, no_labels, tmp_path):
    no_labels.write.parquet(f"{tmp_path}/labels.parquet")
    for k, docs in enumerate((odd, empty)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}-{i}")
            docs = spark.read.parquet(f"{tmp_path}/{k}-{i}")
        assert k == 0 or docs.count() == 0


def test_registered():
    names = __spark_entry__.queries()
    assert sum(n.startswith("op") and n[2].isdigit() for n in names) == 10 and "pipeline" in names
    assert np.all([k in names for k in __spark_entry__.oracle_sql()])
