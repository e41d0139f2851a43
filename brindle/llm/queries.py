"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from .bpe import encoded
from .exact_dedup import SQL as EXACT_SQL
from .exact_dedup import exact_dedup
from .mixing import mix
from .near_dedup import NearOptions, near_groups
from .pii import personal_data
from .quality_classifier import quality_scores
from .quality_rules import quality_rules
from .session import table
from .sharding import kd_shards
from .substring_dedup import substring_dedup
from .token_count import token_counts


def op1_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"))


def op2_bpe(spark, sf_dir):
    return encoded(table(spark, sf_dir, "documents"), digests=True)


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


def op9_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark, sf_dir):
    return substring_dedup(table(spark, sf_dir, "documents"))


def op5_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))


def op8_sharding(spark, sf_dir):
    return kd_shards(table(spark, sf_dir, "documents"))


def op4_pii(spark, sf_dir):
    return personal_data(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_near_dedup(spark, sf_dir):
    return near_groups(table(spark, sf_dir, "documents"), NearOptions(shingle=4))


QUERIES = {"op6_near_dedup": op6_near_dedup, "op4_pii": op4_pii, "op7_quality_classifier": op7_quality_classifier, "op5_mixing": op5_mixing, "op8_sharding": op8_sharding, "op10_substring_dedup": op10_substring_dedup, "op1_quality_rules": op1_quality_rules, "op2_bpe": op2_bpe, "op9_token_counts": op9_token_counts, "op3_exact_dedup": op3_exact_dedup}
ORACLES = {"op3_exact_dedup": EXACT_SQL}
