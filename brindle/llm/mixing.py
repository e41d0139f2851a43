"""Mixing sources to target weights by capped water-filling.

Targets share all words by weight; a source's target stops at `max_epochs` times its size and the excess is reshared by
weight until none is above.  The level is found from two sums a round, so the driver holds numbers, never sources.

A source's words are its whole repetitions of every document plus a fraction: documents in a seeded order until the
fraction's words are reached, the last one in part.  The place where it ends is found by histograms of the seeded hash
(256 bins, 256 bins inside one of them, then the few documents inside one of those), so no task holds a source, however
hot, and the mix meets its targets to the word.

Repeated rows of one id take what the most taken of them takes in `mixed`; rows without an id are told apart by text.

Defined results: null and empty texts have no words and nothing is taken; a null source is a source of its own, last
in the order; a source without words has target 0; repeated rows count as documents; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import numbered
from .session import bounded_arrow, stored
from .textkit import flat, mapper, words

WEIGHTS, MAX_EPOCHS, SEED = (5, 2, 1), 3, 42
FEW_SOURCES = 100_000  # above, facts of sources are joined by shuffling instead of broadcasting


def word_sizes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` without its text, with `size`: its number of words."""

    def one(piece: pa.RecordBatch) -> pa.RecordBatch:
        _, _, bounds = words(*flat(piece.column(piece.schema.names.index("text"))))
        rest = [(n, c) for n, c in zip(piece.schema.names, piece.columns, strict=True) if n != "text"]
        return pa.RecordBatch.from_arrays([c for _, c in rest] + [pa.array(np.diff(bounds))], [n for n, _ in rest] + ["size"])

    bounded_arrow(docs.sparkSession)
    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c != text_col)
    return docs.withColumn("text", F.col(text_col).cast("string")).mapInArrow(mapper(one), f"{kinds}, size long")


def water_level(sources: DataFrame, total: int, cap: int) -> float:
    """The level at which min(level * weight, cap * size) sums to the total."""
    free = sources.agg(F.sum("weight")).first()[0]
    level, capped = total / free, -1
    while True:
        over = F.lit(level) * F.col("weight") > cap * F.col("source_size")
        n, full, free = sources.agg(
            F.count(F.when(over, 1)), F.sum(F.when(over, cap * F.col("source_size")).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))
        ).first()
        if n == capped or not free:
            return level
        level, capped = (total - full) / free, n


def _boundary(bins: DataFrame, bin_col: str, need: str) -> DataFrame:
    """Of each source, the bin in which its running sum passes `need`, and what is still needed there."""
    run = F.sum("size").over(Window.partitionBy("skey").orderBy(bin_col))
    cum = bins.withColumn("cum", run)
    hit = cum.filter((F.col("cum") > F.col(need)) & (F.col("cum") - F.col("size") <= F.col(need)))
    return hit.select("skey", F.col(bin_col).alias(f"{bin_col}_at"), (F.col(need) - (F.col("cum") - F.col("size"))).alias(f"{need}_in"))


def _row_key(doc_id, text):
    """The id, or for a null id a hash of the text, so that rows without an id do not meet in one place."""
    return F.coalesce(doc_id.cast("long"), F.xxhash64(text.cast("string")))


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row."""
    return plan(docs, **options).drop("row_key")


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, size, source_size, target, taken and row_key of every row."""
    source = F.col(source_col).cast("string")
    rows = word_sizes(docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source)).alias("skey"),  # nulls last
        F.col(text_col).alias("text"), _row_key(F.col(id_col), F.col(text_col)).alias("row_key"),
    ))
    u = F.xxhash64(F.lit(seed), "row_key")
    rows = rows.withColumns({"u": u, "coarse": F.shiftrightunsigned(u, 56).cast("int"), "fine": F.shiftrightunsigned(u, 48).cast("int").bitwiseAND(255)})
    rows = stored(rows, "sizes")
    sources = numbered(rows.groupBy("skey").agg(F.sum("size").alias("source_size")), [F.col("skey")], "rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = stored(sources.withColumn("weight", weight.cast("long")).drop("rank"), "sources")
    n, total = sources.agg(F.count(F.lit(1)), F.sum("source_size")).first()
    few = (lambda d: F.broadcast(d)) if n <= FEW_SOURCES else (lambda d: d)
    level = water_level(sources, total, max_epochs) if total else 0.0
    size = F.col("source_size")
    target = F.least(F.lit(level) * F.col("weight"), (max_epochs * size).cast("double"))
    facts = sources.withColumn("target", target)
    whole = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long")
    facts = facts.withColumn("whole", whole).withColumn("need", F.round(F.col("target") - F.col("whole") * size).cast("long"))
    bins = rows.groupBy("skey", "coarse").agg(F.sum("size").alias("size"))
    first = _boundary(bins.join(few(facts.select("skey", "need")), "skey"), "coarse", "need")
    facts = stored(facts.join(first, "skey", "left"), "facts")
    inside = rows.join(few(facts.select("skey", "coarse_at", "need_in")), "skey").filter("coarse = coarse_at")
    bins = inside.groupBy("skey", "fine").agg(F.sum("size").alias("size"), F.first("need_in").alias("need_in"))
    facts = stored(facts.join(_boundary(bins, "fine", "need_in"), "skey", "left"), "facts")
    # a null coarse_at: all words of the source, or none, make up the fraction
    all_rows = rows.join(few(facts), "skey")
    at_end = (F.col("coarse") == F.col("coarse_at")) & (F.col("fine") == F.col("fine_at"))
    order = Window.partitionBy("skey").orderBy("u", "row_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(order), F.lit(0))
    last = all_rows.filter(at_end).withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("need_in_in") - before)))
    took = F.when(F.col("coarse_at").isNull(), F.col("need") > 0).otherwise(
        (F.col("coarse") < F.col("coarse_at")) | ((F.col("coarse") == F.col("coarse_at")) & (F.col("fine") < F.col("fine_at")))
    )
    rest = all_rows.filter(~F.coalesce(at_end, F.lit(False))).withColumn("extra", F.when(took, F.col("size")).otherwise(0))
    return last.unionByName(rest).select(
        "doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("extra")).cast("long").alias("taken"), "row_key"
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with their own columns: each as often as whole repetitions fall to it; a document that
    the mix takes in part counts if it is at least half taken.  Documents without words are left out."""
    taken = plan(docs, **options).filter("taken > 0").groupBy("row_key").agg(F.max(F.round(F.col("taken") / F.col("size")).cast("int")).alias("times"))
    # the documents go as one struct, so that no name of theirs can clash
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    rows = docs.select(_row_key(docs[id_col], docs[text_col]).alias("row_key"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    rows = rows.join(taken.filter("times > 0"), "row_key").select("row", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return rows.select(*(F.col("row")[c].alias(c) for c in docs.columns))
