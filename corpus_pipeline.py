"""Corpus pipeline over `documents`: each stage works on all that its predecessor kept.

The classifier rejects documents below its threshold, exact and near copies leave one document each (five-word
shingles, similarity 0.8), the mix repeats or drops documents to meet the sources' target weights, and the last stage
encodes what is left.  All stages but the last return the columns of `documents`.

Defined results: null and empty texts go through the classifier like others; of those it accepts, exact dedup leaves one
empty one, and the mix, which counts words, leaves out every document without a word.  Rows without an id are never
named by another row: they stay in both dedup stages and are mixed by their text.  Rows that repeat an id stay or go
together.  Ties go to the smaller id.  Very long texts are read whole.  Columns beside the contract's pass through, whatever
their names, but for the last stage.  An empty table gives an empty result in every stage.
"""

from __future__ import annotations

from brindle.llm import bpe, exact_dedup, mixing, near_dedup, quality_classifier
from brindle.llm.session import stored, table


def classify(spark, docs, sf_dir):
    return quality_classifier.accepted(docs, table(spark, sf_dir, "labels"))


def dedup_exact(spark, docs, sf_dir):
    return exact_dedup.deduplicated(docs)


def dedup_near(spark, docs, sf_dir):
    return near_dedup.deduplicated(docs)


def mix_sources(spark, docs, sf_dir):
    return mixing.mixed(docs)


def encode(spark, docs, sf_dir):
    return bpe.encoded(docs, carry=("lang", "source"))


STAGES = [
    ("quality classifier", classify),
    ("exact dedup", dedup_exact),
    ("near dedup", dedup_near),
    ("source mixing", mix_sources),
    ("BPE encoding", encode),
]
#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
