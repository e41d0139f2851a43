"""Exact deduplication with a heavy-hitter split, in DataFrame operations only.

1. Every text is normalised (each run of `[\\x20\\x09-\\x0D]` becomes one space) and digested with SHA-256.
2. `freqItems`, Spark's mergeable Misra-Gries summary, finds every digest whose share of the rows exceeds the
   support.  It holds at most 1/support entries, whatever the input.
3. The candidates are verified: exact counts and winners (smallest id) come from one aggregation with map-side
   combine.  Their table, at most 1/support rows, is broadcast, so copies of frequent texts never meet in a task.
4. All other digests are shuffled as usual; each has at most support * rows rows, a fraction of a partition.

Defined results: a null text counts as empty; all-blank texts equal one space and are equal to each other but not
to the empty text; rows that repeat both id and text are all kept or all dropped; a null id is larger than any other
(a group of null ids only keeps them all), and rows of null id, which no key can name, stay in `deduplicated`; an empty table gives an empty result; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import stored

SUPPORT = 1 / 1024


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def support_for(df: DataFrame, support: float = SUPPORT) -> float:
    """A digest rarer than this is smaller than a quarter of an average shuffle partition."""
    return min(support, 1 / (4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def groups(rows: DataFrame, id_col: str, key: str, support: float = SUPPORT) -> DataFrame:
    """`rows` with keep_id (smallest id of the key) and group_size; the input is read three times, so store it first."""
    heavy = rows.freqItems([key], support_for(rows, support)).select(F.explode(F.col(f"{key}_freqItems")).alias(key))
    winners = (
        rows.join(F.broadcast(heavy), key, "left_semi").groupBy(key)
        .agg(F.min(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    winners = F.broadcast(winners)  # at most 1/support rows
    hot = rows.join(winners, key)
    by_key = Window.partitionBy(key)
    rest = rows.join(winners.select(key), key, "left_anti").select(
        "*", F.min(id_col).over(by_key).alias("keep_id"), F.count(F.lit(1)).over(by_key).alias("group_size")
    )
    return hot.unionByName(rest)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.sha2(normalised(F.col(text_col)), 256).alias("text_sha256")
    )
    found = groups(stored(digests, "digests"), "doc_id", "text_sha256", support)
    return found.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def deduplicated(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """The documents that stay, with their own columns; a repeated row of a kept id stays once per row."""
    drop = exact_dedup(docs, support=support).filter(~F.col("kept")).select(F.col("doc_id").alias("_drop_id"))
    return docs.join(drop, docs["doc_id"] == drop["_drop_id"], "left_anti")


SQL = """
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(min(doc_id) OVER g AS BIGINT) AS keep_id,
       CAST(count(*) OVER g AS BIGINT) AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""
