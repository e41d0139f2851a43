"""Writes as DataFrame operations: an index is a table of (_id, _version, doc), and a write gives the next table.

`doc` maps field names to JSON values.  Writes to one id are folded in the order of `_seq` inside the JVM; only those
from the last write on that decides alone (index or delete) are gathered, so that a long history of an id costs one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ingest import apply, where

DOC = "map<string,string>"
INDEX = f"_id string, _version long, doc {DOC}"
#: op is index, create, update or delete; upsert is the document of an update whose id is not there
ACTIONS = f"_seq long, op string, _id string, doc {DOC}, upsert {DOC}"
_ALONE = ("index", "delete")


def numbered_ids(rows: DataFrame, seq: str = "_seq") -> DataFrame:
    """Rows without an _id get one that the same row gets again: a hash of its number and document."""
    made = F.sha1(F.concat_ws("/", F.col(seq).cast("string"), F.to_json("doc")))
    return rows.withColumn("_id", F.coalesce("_id", made))


def bulk_lines(lines: DataFrame) -> DataFrame:
    """Actions of newline-delimited JSON given as (_seq, value): an action line, followed by a document line unless the
    action is delete.  An action's document is found by its number, `_seq` + 1, so lines need not stand in one task."""
    lines = lines.withColumn("op", F.try_element_at(F.json_object_keys("value"), F.lit(1)))
    at = lambda k: F.expr(f"get_json_object(value, concat('$.', op, '.{k}'))")
    # an action line has one key, and its value names an index
    one = (F.size(F.json_object_keys("value")) == 1) & F.col("op").isin("index", "create", "update", "delete") & at("_index").isNotNull()
    heads = lines.filter(one).select("_seq", "op", at("_id").alias("_id"))
    bodies = lines.filter(~F.coalesce(one, F.lit(False))).select((F.col("_seq") - 1).alias("_seq"), F.from_json("value", DOC).alias("body"))
    rows = heads.join(bodies, "_seq", "left")
    part = lambda k: F.from_json(F.col("body")[k], DOC)
    doc = F.when(F.col("op") == "update", F.coalesce(part("doc"), F.create_map().cast(DOC))).otherwise(F.col("body"))
    upsert = F.when(F.col("op") == "update", F.coalesce(part("upsert"), F.when(F.col("body")["doc_as_upsert"] == "true", part("doc"))))
    return rows.select("_seq", "op", "_id", doc.alias("doc"), upsert.alias("upsert"))


def merged(old: Column, new: Column) -> Column:
    """Fields of `new` over those of `old`."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def bulk(index: DataFrame, actions: DataFrame) -> DataFrame:
    """The index after the actions.  create and update without upsert do nothing where they do not apply; an update
    that changes nothing leaves the version."""
    actions = numbered_ids(actions)
    last = actions.groupBy("_id").agg(F.max(F.when(F.col("op").isin(*_ALONE), F.col("_seq"))).alias("from"), F.count_if(F.col("op").isin(*_ALONE)).alias("alone"))
    kept = actions.join(last, "_id").filter(F.col("from").isNull() | (F.col("_seq") >= F.col("from")))
    todo = kept.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("_seq", "op", F.to_json("doc").alias("doc"), F.to_json("upsert").alias("upsert")))).alias("todo"), F.max("alone").alias("alone"))
    start = F.struct((F.coalesce("_version", F.lit(0)) + F.greatest(F.coalesce("alone", F.lit(0)) - 1, F.lit(0))).cast("long").alias("v"), F.col("doc").alias("d"))

    def fold(state: Column, a: Column) -> Column:
        doc, upsert, here = F.from_json(a["doc"], DOC), F.from_json(a["upsert"], DOC), state["d"].isNotNull()
        after = merged(state["d"], doc)
        nothing = F.to_json(F.array_sort(F.map_entries(after))) == F.to_json(F.array_sort(F.map_entries(state["d"])))
        next_doc = (
            F.when(a["op"] == "index", doc).when(a["op"] == "delete", F.lit(None).cast(DOC))
            .when(a["op"] == "create", F.coalesce(state["d"], doc)).when(here, after).otherwise(upsert)
        )
        grows = (
            F.when(a["op"] == "index", F.lit(True)).when(a["op"] == "delete", here).when(a["op"] == "create", ~here)
            .when(here, ~nothing).otherwise(upsert.isNotNull())
        )
        return F.struct((state["v"] + grows.cast("long")).alias("v"), next_doc.alias("d"))

    both = index.join(todo, "_id", "full_outer")
    out = both.withColumn("end", F.when(F.col("todo").isNull(), start).otherwise(F.aggregate("todo", start, fold)))
    return out.filter("end.d IS NOT NULL").select("_id", F.col("end.v").alias("_version"), F.col("end.d").alias("doc"))


def delete_by_query(df: DataFrame, pred: Column) -> DataFrame:
    return df.filter(~F.coalesce(pred, F.lit(False)))


def update_by_query(df: DataFrame, pred: Column, processors: list[dict]) -> DataFrame:
    """Rows that the query finds go through the processors (a script is one); a drop processor deletes them."""
    pred = F.coalesce(pred, F.lit(False))
    drops = [p["drop"] for p in processors if "drop" in p]
    rest = [p for p in processors if "drop" not in p]
    out = where(df.withColumn("__hit", pred), F.col("__hit"), lambda d: apply(d, rest))
    for s in drops:
        from ..functions.script import Script

        on = Script(s["if"], F.col).column() if "if" in s else F.lit(True)
        out = out.filter(~(F.col("__hit") & F.coalesce(on, F.lit(False))))
    return out.drop("__hit")


def reindex(source: DataFrame, pred: Column | None = None, processors: list[dict] | None = None, fields: list[str] | None = None, max_docs: int | None = None) -> DataFrame:
    """The documents that a new index takes from another."""
    out = source if pred is None else source.filter(pred)
    out = out.select(*fields) if fields else out
    out = out.limit(max_docs) if max_docs is not None else out
    return apply(out, processors or [])
