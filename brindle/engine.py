"""The engine: named indices over DataFrames, search requests, aggregations, SQL and PPL.

A search is one lazy DataFrame.  Hits and aggregations share the filtered parent, and Catalyst plans both."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.analysis import Analyzers
from .model import Mapping, mapping_of
from .operators import aggs
from .plans.query import TOKENS, QueryCompiler


@dataclass
class Index:
    name: str
    df: DataFrame
    mapping: Mapping
    id_col: str | None = None
    settings: dict[str, Any] = field(default_factory=dict)

    def column(self, name: str) -> Column:
        return F.col(self.mapping.resolve(name))

    def id_column(self) -> Column:
        return F.col(self.id_col or "_id").cast("string")


class Engine:
    def __init__(self, spark: SparkSession):
        self.spark, self.indices, self.aliases, self.scripts = spark, {}, {}, {}

    # -- catalogue ------------------------------------------------------------------------------------------------

    def register(self, name: str, df: DataFrame, mapping: dict | None = None, id_col: str | None = None, settings: dict | None = None) -> Index:
        df = self.shown(df)  # rows taken from an analysed index and changed would carry terms of the old texts
        self.indices[name] = Index(name, df, mapping_of(df, mapping), id_col, settings or {})
        df.createOrReplaceTempView(name)
        return self.indices[name]

    def analyze(self, name: str, fields: list[str], path: str) -> Index:
        """Store the terms of text fields under `path`, a folder that all executors reach, and search by them.

        Written once: the rows with a column of terms for each field, and for each field a (term, df) table sorted by
        term, so that a query reads the row groups of its terms only.  The rows are a snapshot of the index."""
        ix = self.index(name)
        c = self.compiler(ix, scoring=False)
        ix.df.withColumns({TOKENS + f: c.tokens(f) for f in fields}).write.parquet(f"{path}/rows")
        rows, kept = self.spark.read.parquet(f"{path}/rows"), {}
        for k, f in enumerate(fields):
            t = F.col(f"`{TOKENS}{f}`")
            terms = rows.select(F.explode(F.array_distinct(t)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
            terms.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms-{k}")
            n, mean = rows.filter(F.size(t) > 0).agg(F.count(F.lit(1)), F.avg(F.size(t))).first()
            kept[f] = self.spark.read.parquet(f"{path}/terms-{k}"), n, mean or 1.0
        self.indices[name] = Index(name, rows, ix.mapping, ix.id_col, {**ix.settings, "terms": kept})
        return self.indices[name]

    @staticmethod
    def shown(df: DataFrame) -> DataFrame:
        """Without the stored terms."""
        return df.drop(*(n for n in df.columns if n.startswith(TOKENS)))

    def alias(self, name: str, targets: list[str], query: dict | None = None) -> None:
        self.aliases[name] = (targets, query)

    def index(self, expression: str) -> Index:
        """A name, an alias, `a,b` or a pattern; several indices are united by column name and marked by `_index`."""
        if expression in self.indices:
            return self.indices[expression]
        if expression in self.aliases:
            targets, query = self.aliases[expression]
            out = self.index(",".join(targets))
            if query:
                c = self.compiler(out, scoring=False)
                pred = c.compile(query).pred
                out = Index(expression, c.df.filter(pred), out.mapping, out.id_col, {k: v for k, v in out.settings.items() if k != "terms"})
            return out
        names = []
        for part in expression.split(","):
            rx = re.compile(re.escape(part.lstrip("-")).replace(r"\*", ".*") + r"\Z")
            found = [n for n in self.indices if rx.match(n)]
            names = [n for n in names if n not in found] if part.startswith("-") else names + [n for n in found if n not in names]
        if not names:
            raise KeyError(f"no such index [{expression}]")
        first, whole = self.indices[names[0]], None
        for n in names:
            d = self.indices[n].df.withColumn("_index", F.lit(n))
            whole = d if whole is None else whole.unionByName(d, allowMissingColumns=True)
        fields = {k: v for n in reversed(names) for k, v in self.indices[n].mapping.fields.items()}
        if len(names) > 1:  # an index without stored terms would have none
            whole = self.shown(whole)
        return Index(expression, whole, Mapping(fields, first.mapping.aliases), first.id_col, {k: v for k, v in first.settings.items() if k != "terms"})

    def compiler(self, ix: Index, scoring: bool = True, now=None) -> QueryCompiler:
        c = QueryCompiler(ix.df, ix.mapping, ix.id_col, self, Analyzers(ix.settings.get("analysis", {}) | {"similarity": ix.settings.get("similarity", {})}), scoring, now)
        c.terms = ix.settings.get("terms", {})
        return c

    def filtered(self, name: str, query: dict | None) -> DataFrame:
        c = self.compiler(self.index(name), scoring=False)
        pred = c.compile(query).pred
        return self.shown(c.df.filter(pred))

    def matches(self, name: str, query: dict | None) -> DataFrame:
        """Matching documents with `_score`."""
        c = self.compiler(self.index(name))
        got = c.compile(query)
        return c.df.withColumns({"_score": got.score.cast("double"), "_match": got.pred}).filter("_match").drop("_match").transform(self.shown)

    # -- search ---------------------------------------------------------------------------------------------------

    def search(self, name: str, body: dict[str, Any]) -> DataFrame:
        """The hits: source columns, `_score`, and what the request adds."""
        ix = self.index(name)
        for f, spec in (body.get("derived") or {}).items():
            ix = Index(ix.name, ix.df.withColumn(f, self.compiler(ix).script(spec["script"])).drop(TOKENS + f), ix.mapping, ix.id_col, {k: v for k, v in ix.settings.items() if k != "terms"})
            ix.mapping = mapping_of(ix.df)
        sort = body.get("sort") or [{"_score": "desc"}]
        sort = sort if isinstance(sort, list) else [sort]
        needs_score = "sort" not in body or any("_score" in (s if isinstance(s, dict) else {s: 0}) for s in sort) or "min_score" in body or "rescore" in body or body.get("track_scores")
        c = self.compiler(ix, bool(needs_score))
        got = c.compile(body.get("query"))
        pred, score = got.pred, got.score
        if "post_filter" in body:
            pred = pred & c.compile(body["post_filter"]).pred
        rescore = body.get("rescore")
        second = c.compile(rescore["query"]["rescore_query"]) if rescore else None
        extra = {f: c.script(s["script"]) for f, s in (body.get("script_fields") or {}).items()}
        keys = [self._key(c, s) for s in sort]
        tie = F.col(ix.id_col) if ix.id_col else None
        df = c.df.withColumns({"_score": score.cast("double"), "_match": pred, **extra, **{f"inner_hits_{n}": v for n, v in c.inner.items()}, **{f"_sort{i}": k.cast("double") if str(n) == "_geo" else k for i, (k, _, _, n) in enumerate(keys) if n != "_score"}})
        if c.named:
            df = df.withColumn("matched_queries", F.filter(F.array(*(F.when(p, F.lit(n)) for n, p in c.named.items())), lambda x: x.isNotNull()))
        if second is not None:
            df = df.withColumns({"_second": second.score.cast("double"), "_second_on": second.pred})
        df = self.shown(df.filter("_match").drop("_match"))
        if "min_score" in body:
            df = df.filter(F.col("_score") >= float(body["min_score"]))
        order = []
        for i, (_, desc, first, n) in enumerate(keys):
            k = F.col("_score" if n == "_score" else f"_sort{i}")
            order.append((k.desc_nulls_first() if first else k.desc_nulls_last()) if desc else (k.asc_nulls_first() if first else k.asc_nulls_last()))
        if tie is not None:
            order.append(tie.asc())
        if second is not None:
            df = self._rescored(df, rescore, tie)
        if "slice" in body:
            df = df.filter(F.pmod(F.xxhash64(c.col("_id") if not ix.id_col else tie), F.lit(body["slice"]["max"])) == body["slice"]["id"])
        if "collapse" in body:
            w = Window.partitionBy(c.col(body["collapse"]["field"])).orderBy(*order)
            df = df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")
        if "search_after" in body:
            df = df.filter(self._after(keys, body["search_after"], tie))
        df = df.orderBy(*order)
        if body.get("from"):
            df = df.offset(int(body["from"]))
        if body.get("size", 10) is not None:  # null: all hits
            df = df.limit(int(body.get("size", 10)))
        df = df.drop(*(f"_sort{i}" for i in range(len(keys))), "_second", "_second_on")
        return df.select(*self._source(df, body)) if "_source" in body else df

    def _source(self, df: DataFrame, body: dict) -> list[str]:
        spec = body["_source"]
        if spec is True:
            return df.columns
        spec = spec if isinstance(spec, dict) else {"includes": [] if spec is False else [spec] if isinstance(spec, str) else spec}
        inc, exc = spec.get("includes", spec.get("include", ["*"])), spec.get("excludes", spec.get("exclude", []))
        like = lambda n, ps: any(re.fullmatch(re.escape(p).replace(r"\*", ".*"), n) for p in ps)
        own = set(body.get("script_fields") or {}) | {"_score", "matched_queries"}
        return [n for n in df.columns if n in own or n.startswith("inner_hits_") or (like(n, inc) and not like(n, exc))]

    def _key(self, c: QueryCompiler, spec) -> tuple[Column, bool, bool, str]:
        name, o = (spec, {}) if isinstance(spec, str) else next(iter(spec.items()))
        o = {"order": o} if isinstance(o, str) else o
        desc, first = o.get("order", "desc" if name == "_score" else "asc") == "desc", o.get("missing") == "_first"
        if name == "_score":
            return F.lit(0), desc, first, "_score"
        if name == "_script":
            return c.script(o["script"]), desc, first, name
        if name == "_geo_distance":
            from .functions import geo

            f = next(k for k in o if k not in ("order", "unit", "mode", "distance_type"))
            return geo.haversine(c.col(f), *geo.point(o[f])), desc, first, "_geo"
        k = c.col(name)
        if c.many(name):
            mode = o.get("mode", "max" if desc else "min")
            total = F.aggregate(k, F.lit(0.0), lambda s, v: s + v.cast("double"))
            k = {"min": lambda: F.array_min(k), "max": lambda: F.array_max(k), "sum": lambda: total, "avg": lambda: total / F.size(k), "median": lambda: F.array_sort(k)[F.size(k).cast("int") / 2]}[mode]()
        if o.get("missing") not in (None, "_last", "_first"):
            k = F.coalesce(k, F.lit(o["missing"]))
        return k, desc, first, name

    def _after(self, keys, values: list, tie: Column | None) -> Column:
        """Strictly after the given key values, key by key."""
        cols = [(F.col("_score" if n == "_score" else f"_sort{i}"), d) for i, (_, d, _, n) in enumerate(keys)]
        if tie is not None and len(values) > len(keys):
            cols.append((tie, False))
        out, same = F.lit(False), F.lit(True)
        for (k, desc), v in zip(cols, values, strict=False):
            past = k.isNull() if v is None else ((k < F.lit(v)) if desc else (k > F.lit(v))) | k.isNull()
            out = out | (same & (F.lit(False) if v is None else past))
            same = same & (k.isNull() if v is None else k == F.lit(v))
        return F.coalesce(out, F.lit(False))

    def _rescored(self, df: DataFrame, spec: dict, tie: Column | None) -> DataFrame:
        """Only the window's best rows are scored anew; their rank comes from a top-k, not from a global window."""
        o = spec["query"]
        qw, rw, mode = float(o.get("query_weight", 1)), float(o.get("rescore_query_weight", 1)), o.get("score_mode", "total")
        order = [F.desc("_score"), *([tie.asc()] if tie is not None else [])]
        top = df.orderBy(*order).limit(int(spec.get("window_size", 10)))
        a, b = F.col("_score") * qw, F.col("_second") * rw
        new = {"total": a + b, "multiply": F.col("_score") * F.col("_second"), "avg": (a + b) / 2, "max": F.greatest(a, b), "min": F.least(a, b)}[mode]
        key = tie if tie is not None else F.col("_id")
        rest = df.join(top.select(key.alias("_top")), key == F.col("_top"), "left_anti")
        top = top.withColumn("_score", F.when(F.col("_second_on"), new).otherwise(F.col("_score") if mode == "multiply" else a))
        return top.unionByName(rest if mode == "multiply" else rest.withColumn("_score", F.col("_score") * qw))

    def count(self, name: str, query: dict | None = None) -> DataFrame:
        return self.filtered(name, query).agg(F.count(F.lit(1)).alias("count"))

    # -- aggregations ----------------------------------------------------------------------------------------------

    def aggregate(self, name: str, body: dict[str, Any]) -> DataFrame:
        """The flat table of the request's one aggregation tree: bucket keys, doc_count, metrics."""
        return self._aggs(name, body).table(body.get("aggs") or body["aggregations"])

    def aggregate_tables(self, name: str, body: dict[str, Any]) -> dict[str, DataFrame]:
        """Any aggregation tree: a flat table for each of its bucket aggregations and sibling pipelines, by path."""
        return self._aggs(name, body).tables(body.get("aggs") or body["aggregations"])

    def _aggs(self, name: str, body: dict[str, Any]) -> aggs.AggCompiler:
        ix = self.index(name)
        c = self.compiler(ix, scoring=False)
        return aggs.AggCompiler(c, c.df.filter(c.compile(body.get("query")).pred), ix)

    # -- SQL and PPL --------------------------------------------------------------------------------------------------

    def sql(self, text: str) -> DataFrame:
        from .plans import sqlfront

        return sqlfront.sql(self, text)

    def ppl(self, text: str) -> DataFrame:
        from .plans import sqlfront

        return sqlfront.ppl(self, text)
