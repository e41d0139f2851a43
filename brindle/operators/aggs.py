"""Aggregation trees compiled to groupBys: every level of buckets is a set of grouping columns.

The result of a chain of levels is flat: one row for each bucket of the deepest level, with the keys of all levels,
doc_count, its metrics, and those of the levels above repeated.  A level above is grouped on its own only if it has
metrics, an order or a size.  A tree with sibling buckets gives one such table for each of its bucket aggregations.
Overlapping buckets (ranges, filters, several values of a field) come from one explode before the groupBy."""

from __future__ import annotations

import functools
import operator
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..plans import dates
from . import pipeline, quantiles

METRICS = {"avg", "sum", "min", "max", "value_count", "stats", "extended_stats", "percentiles", "percentile_ranks", "median_absolute_deviation", "cardinality", "weighted_avg", "matrix_stats", "geo_bounds", "geo_centroid", "top_hits", "scripted_metric"}
PIPES = {"cumulative_sum", "derivative", "serial_diff", "moving_fn", "moving_avg", "bucket_script", "bucket_selector", "bucket_sort"}
SIBLINGS = {"avg_bucket", "sum_bucket", "min_bucket", "max_bucket", "stats_bucket", "extended_stats_bucket", "percentiles_bucket"}
MAX_BUCKETS = 65_535  # of one histogram, empty ones included; more is an error
# the scripts of a scripted_metric that sums: what a row adds to the state, and a loop over states or a plain return
_ADDS = re.compile(r"state\.(\w+)\s*(?:\.add\((?P<item>.*)\)|\+=\s*(?P<term>.*?))\s*;?", re.S)
_SUMS = re.compile(r"return (?:state\.\w+|states\.sum\(\));?|(?:double|long|int|float|def) (\w+) = 0(?:\.0)?;? ?for ?\((?:\w+ )?(\w+) ?(?:in|:) ?(?:states|state\.\w+)\) ?\{ ?\1 \+= \2;? ?\} ?return \1;?")
PERCENTS = (1, 5, 25, 50, 75, 95, 99)


def label(p: float) -> str:
    return str(int(p)) if float(p) == int(p) else str(p).replace(".", "_")


def mean_bounds(c: Column, sigma: float) -> dict[str, Column]:
    sd, mean = F.stddev_pop(c), F.avg(c)
    return {"upper": mean + sigma * sd, "lower": mean - sigma * sd}


def kind_of(a: dict) -> str:
    return next(k for k in a if k not in ("aggs", "aggregations", "meta"))


@dataclass
class Level:
    name: str
    kind: str
    spec: dict
    below: dict[str, dict]

    def of(self, kinds: set[str]) -> dict[str, dict]:
        return {n: a for n, a in self.below.items() if kind_of(a) in kinds}


def _levels(tree: dict[str, dict]) -> dict[str, Level]:
    return {n: Level(n, kind_of(a), a[kind_of(a)], a.get("aggs") or a.get("aggregations") or {}) for n, a in tree.items() if kind_of(a) not in METRICS | PIPES | SIBLINGS}


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null."""
    right = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = functools.reduce(operator.and_, (F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys))
    return left.join(right, on, how).drop(*(f"__r_{k}" for k in keys))


def beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The right table's columns by keys that may be null, or those of its only row; nulls where it has none."""
    return matched(left, right, keys, "left") if keys else left.join(F.broadcast(right), F.lit(True), "left")


class AggCompiler:
    def __init__(self, compiler, df: DataFrame, index):
        self.c, self.df, self.index = compiler, df, index
        self.root, self.keys = compiler, []

    def value(self, spec: dict) -> Column:
        v = self.c.script(spec["script"]) if "script" in spec and "field" not in spec else self.c.col(spec["field"])
        return F.coalesce(v, F.lit(spec["missing"])) if "missing" in spec else v

    # -- metrics ----------------------------------------------------------------------------------------------------

    def metric(self, name: str, kind: str, s: dict) -> dict[str, Column]:
        if kind == "weighted_avg":
            v, w = self.value(s["value"]), self.value(s["weight"])
            both = v.isNotNull() & w.isNotNull()
            return {name: F.try_divide(F.sum(F.when(both, v * w)), F.sum(F.when(both, w)))}
        if kind == "matrix_stats":
            return self.matrix(name, s)
        if kind == "top_hits":
            fields = s.get("_source") or self.c.df.columns
            keys = [(next(iter(k.items())) if isinstance(k, dict) else (k, "asc")) for k in s.get("sort", [])]
            n = int(s.get("size", 3))
            cols = [self.c.col(k) for k, _ in keys]
            down = [(o if isinstance(o, str) else o.get("order", "asc")) == "desc" for _, o in keys]
            hit = F.struct(*(v.alias(f"k{i}") for i, v in enumerate(cols)), F.struct(*(F.col(f).alias(f) for f in fields)).alias("hit"))

            def compare(a: Column, b: Column) -> Column:
                out = F.lit(0)
                for i in reversed(range(len(keys))):  # nulls last
                    x, y, sign = a[f"k{i}"], b[f"k{i}"], -1 if down[i] else 1
                    both = F.when(x.isNull() & y.isNull(), out).when(x.isNull(), 1).when(y.isNull(), -1)
                    out = both.when(x < y, -sign).when(x > y, sign).otherwise(out)
                return out

            best = F.slice(F.array_sort(F.collect_list(hit), compare), 1 + int(s.get("from", 0)), n)
            return {name: F.transform(best, lambda h: h["hit"])}
        if kind == "scripted_metric":
            return {name: self.scripted(name, s)}
        v = self.value(s)
        if kind == "geo_bounds":
            return {f"{name}_{k}": f(v[x]) for k, f, x in (("top", F.max, "lat"), ("bottom", F.min, "lat"), ("left", F.min, "lon"), ("right", F.max, "lon"))}
        if kind == "geo_centroid":
            return {f"{name}_lat": F.avg(v["lat"]), f"{name}_lon": F.avg(v["lon"])}
        if kind == "value_count":
            return {name: F.count(v)}
        if kind == "cardinality":
            return {name: F.count_distinct(v) if s.get("exact", True) else F.approx_count_distinct(v, s.get("rsd", 0.02))}
        if kind == "percentiles":  # the exact ones of tables are computed by quantiles.percentiles()
            return {f"{name}_{label(p)}": (F.percentile(v, p / 100) if not s.get("approximate") else F.percentile_approx(v, p / 100)) for p in s.get("percents", PERCENTS)}
        if kind == "percentile_ranks":
            return {f"{name}_{label(p)}": F.avg((v <= p).cast("double")) * 100 for p in s["values"]}
        if kind == "median_absolute_deviation":
            raise ValueError("median_absolute_deviation is computed by deviation()")
        plain = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max}
        if kind in plain:
            return {name: plain[kind](v)}
        out = {f"{name}_count": F.count(v), **{f"{name}_{k}": f(v) for k, f in plain.items()}}
        if kind == "extended_stats":
            d = v.cast("double")
            out |= {f"{name}_{k}": x for k, x in {"sum_of_squares": F.sum(d * d), "variance": F.var_pop(d), "variance_sampling": F.var_samp(d), "std_deviation": F.stddev_pop(d), "std_deviation_sampling": F.stddev_samp(d), **mean_bounds(d, float(s.get("sigma", 2)))}.items()}
        return out

    def scripted(self, name: str, s: dict) -> Column:
        """Scripts that sum an expression of each row; others are an error."""
        source = lambda k: s[k]["source"] if isinstance(s.get(k), dict) else s.get(k, "")
        adds = _ADDS.fullmatch(source("map_script").strip())
        if not adds or not all(_SUMS.fullmatch(re.sub(r"\s+", " ", source(k)).strip()) for k in ("combine_script", "reduce_script")):
            raise ValueError(f"[{name}]: only scripts that sum an expression of each row are compiled")
        total = F.sum(self.c.script({"source": adds["item"] or adds["term"], "params": s.get("params", {})}).cast("double"))
        return F.coalesce(total, F.lit(0.0))

    def matrix(self, name: str, s: dict) -> dict[str, Column]:
        """Over documents that hold every field."""
        cols = {f: self.c.col(f).cast("double") for f in s["fields"]}
        whole = functools.reduce(operator.and_, (c.isNotNull() for c in cols.values()))
        cols = {f: F.when(whole, c) for f, c in cols.items()}
        out = {f"{name}_count": F.count(next(iter(cols.values())))}
        for f, c in cols.items():
            out |= {f"{name}_{f}_mean": F.avg(c), f"{name}_{f}_variance": F.var_samp(c), f"{name}_{f}_skewness": F.skewness(c), f"{name}_{f}_kurtosis": F.kurtosis(c) + 3}
        names = list(cols)
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                out |= {f"{name}_{a}_{b}_covariance": F.covar_samp(cols[a], cols[b]), f"{name}_{a}_{b}_correlation": F.corr(cols[a], cols[b])}
        return out

    # -- buckets ----------------------------------------------------------------------------------------------------

    def overlapping(self, df: DataFrame, name: str, tests: dict[str, Column]) -> tuple[DataFrame, list[str]]:
        on = F.filter(F.array(*(F.when(t, F.lit(k)) for k, t in tests.items())), lambda x: x.isNotNull())
        return df.withColumn(name, F.explode(on)), [name]

    def bucket(self, df: DataFrame, name: str, kind: str, s: dict) -> tuple[DataFrame, list[str]]:
        """`df` with the bucket's key columns."""
        if kind in ("terms", "rare_terms", "significant_terms"):
            if "field" in s and self.c.is_text(s["field"]):
                df = df.withColumn(name, F.explode(F.array_distinct(self.c.tokens(s["field"]))))
            elif "field" in s and self.c.many(s["field"]):
                df = df.withColumn(name, F.explode(F.array_distinct(self.c.col(s["field"]))))
            else:
                df = df.withColumn(name, self.value(s)).filter(F.col(name).isNotNull())
            for how, keep in (("include", True), ("exclude", False)):
                if how in s:
                    df = df.filter(self.listed(F.col(name), s[how]) if keep else ~self.listed(F.col(name), s[how]))
            return df, [name]
        if kind == "multi_terms":
            keys = [f"{name}_{i}" for i in range(len(s["terms"]))]
            df = df.withColumns({k: self.value(t) for k, t in zip(keys, s["terms"], strict=True)})
            return df.dropna(subset=keys), keys
        if kind == "histogram":
            i, o = float(s["interval"]), float(s.get("offset", 0))
            df = df.withColumn(name, F.floor((self.value(s) - o) / i) * i + o)
            if "hard_bounds" in s:
                df = df.filter(F.col(name).between(s["hard_bounds"]["min"], s["hard_bounds"]["max"]))
            return df.filter(F.col(name).isNotNull()), [name]
        if kind == "date_histogram":
            return df.withColumn(name, date_floor(self.value(s), s)).filter(F.col(name).isNotNull()), [name]
        if kind in ("range", "date_range", "ip_range", "geo_distance"):
            tests = {}
            v = self.value(s) if kind != "geo_distance" else geo.haversine(self.c.col(s["field"]), *geo.point(s["origin"])) / geo.meters(f"1{s.get('unit', 'm')}")
            if kind == "date_range":
                v = v.cast("timestamp_ntz")
            if kind == "ip_range":
                from ..plans.query import cidr, ip_key, ip_text

                v = ip_key(v)
            for r in s["ranges"]:
                lo, hi = r.get("from"), r.get("to")
                if kind == "ip_range" and "mask" in r:
                    a, b = cidr(r["mask"])
                    tests[r.get("key", r["mask"])] = v.between(a, b)
                    continue
                lit = (lambda x: F.lit(dates.evaluate(x)).cast("timestamp_ntz")) if kind == "date_range" else (lambda x: F.lit(ip_text(x))) if kind == "ip_range" else F.lit
                t = v.isNotNull()
                t = t & (v >= lit(lo)) if lo is not None else t
                t = t & (v < lit(hi)) if hi is not None else t
                tests[r.get("key", f"{'*' if lo is None else lo}-{'*' if hi is None else hi}")] = t
            return self.overlapping(df, name, tests)
        if kind in ("filter", "missing"):
            test = self.c.compile(s).pred if kind == "filter" else self.c.col(s["field"]).isNull()
            return self.overlapping(df, name, {kind: test})
        if kind in ("filters", "adjacency_matrix"):
            named = s["filters"] if isinstance(s["filters"], dict) else {str(i): q for i, q in enumerate(s["filters"])}
            tests = {k: self.c.compile(q).pred for k, q in named.items()}
            if kind == "adjacency_matrix":
                sep, ks = s.get("separator", "&"), sorted(tests)
                tests |= {f"{a}{sep}{b}": tests[a] & tests[b] for i, a in enumerate(ks) for b in ks[i + 1 :]}
            elif s.get("other_bucket") or "other_bucket_key" in s:
                tests[s.get("other_bucket_key", "_other_")] = ~functools.reduce(operator.or_, tests.values())
            return self.overlapping(df, name, tests)
        if kind == "composite":
            keys = []
            for source in s["sources"]:
                (key, one), = source.items()
                (how, o), = one.items()
                if o.get("missing_bucket"):
                    df = df.withColumn(key, self.value(o))
                else:
                    df, _ = self.bucket(df, key, how, o)
                keys.append(key)
            return df, keys
        if kind in ("geohash_grid", "geotile_grid"):
            f = geo.geohash(self.c.col(s["field"]), s.get("precision", 5)) if kind == "geohash_grid" else geo.geotile(self.c.col(s["field"]), s.get("precision", 7))
            return df.filter(self.c.col(s["field"]).isNotNull()).withColumn(name, f), [name]
        if kind == "nested":
            doc = F.col(self.index.id_col) if self.index.id_col else F.monotonically_increasing_id()
            df = df if "__doc" in df.columns else df.withColumn("__doc", doc)
            at = f"__{s['path']}"
            df = df.withColumn(at, F.explode(self.c.col(s["path"]))).withColumn(name, F.lit(s["path"]))
            self.c.element, self.c.element_path = F.col(at), s["path"]  # levels below read the objects
            return df, [name]
        if kind == "reverse_nested":
            self.c.element, self.c.element_path = None, ""
            return df.dropDuplicates([*self.keys, "__doc"]).withColumn(name, F.lit("root")), [name]
        if kind in ("children", "parent"):
            return self.related(df, name, kind, s)
        if kind == "global":
            return self.index.df.withColumn(name, F.lit("global")), [name]
        if kind == "auto_date_histogram":
            return df.withColumn(name, date_floor(self.value(s), self.ladder(df, s))), [name]
        if kind in ("sampler", "diversified_sampler"):
            key = self.index.id_col or "_id"
            if kind == "diversified_sampler":
                w = Window.partitionBy(self.c.col(s["field"])).orderBy(key)
                df = df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= s.get("max_docs_per_value", 1)).drop("__r")
            return df.orderBy(key).limit(int(s.get("shard_size", 100))).withColumn(name, F.lit("sample")), [name]
        raise ValueError(f"unknown aggregation [{kind}]")

    def related(self, df: DataFrame, name: str, kind: str, s: dict) -> tuple[DataFrame, list[str]]:
        """Children of the bucket's parents, or the distinct parents of its children: by the index's join field, or in
        `index`, whose (or this one's) `parent_field` holds the `id_field` of the parent."""
        down, ix = kind == "children", self.c.engine.index(s["index"]) if "index" in s else self.index
        other = self.c.engine.compiler(ix, scoring=False)
        rows = other.df
        if "index" in s:
            mine, theirs = s["id_field" if down else "parent_field"], s["parent_field" if down else "id_field"]
        else:
            rel = self.c._join_field()
            mine, theirs = ("_id", f"{rel}.parent") if down else (f"{rel}.parent", "_id")
            if down:
                rows = rows.filter(other.col(f"{rel}.name") == s["type"])
            else:
                df = df.filter(self.c.col(f"{rel}.name") == s["type"])
        if clash := sorted(set(self.keys) & set(rows.columns)):
            raise ValueError(f"bucket names {clash} are columns of [{ix.name}]")
        left = df.select(*self.keys, self.c.col(mine).cast("string").alias("__mine")).filter("__mine IS NOT NULL")
        out = (left if down else left.distinct()).join(rows.withColumn("__theirs", other.col(theirs).cast("string")), F.col("__mine") == F.col("__theirs"))
        self.c = other
        return out.drop("__mine", "__theirs").withColumn(name, F.lit(s.get("type", ix.name))), [name]

    def listed(self, c: Column, spec: Any) -> Column:
        if isinstance(spec, dict):
            return F.pmod(F.xxhash64(c), F.lit(spec["num_partitions"])) == spec["partition"]
        return c.isin(list(spec)) if isinstance(spec, list) else c.cast("string").rlike(f"^(?:{spec})$")

    def ladder(self, df: DataFrame, s: dict) -> dict:
        """The first step of the ladder that gives few enough buckets, from one min/max pass."""
        v = F.unix_seconds(self.value(s).cast("timestamp"))
        lo, hi = df.agg(F.min(v), F.max(v)).first()
        steps = [("1s", 1), ("5s", 5), ("10s", 10), ("30s", 30), ("1m", 60), ("5m", 300), ("10m", 600), ("30m", 1800), ("1h", 3600), ("3h", 10800), ("12h", 43200), ("1d", 86400), ("7d", 604800), ("month", 2629746), ("quarter", 7889238), ("year", 31556952)]
        for text, n in steps:
            if lo is None or (hi - lo) // n + 1 <= s.get("buckets", 10):
                break
        return {"calendar_interval": text} if n > 604800 else {"fixed_interval": text}

    # -- the tree -----------------------------------------------------------------------------------------------------

    def table(self, tree: dict[str, dict]) -> DataFrame:
        """The flat table of a chain of bucket levels; metrics may stand at any level."""
        chain, here = [], tree
        while level := _levels(here):
            if len(level) > 1 or any(kind_of(a) in SIBLINGS for a in here.values()):
                raise ValueError(f"one bucket aggregation to a level makes a flat table; ask for tables() of {sorted(here)}")
            chain += level.values()
            here = chain[-1].below
        return self.flat({n: a for n, a in tree.items() if kind_of(a) in METRICS}, chain)

    def tables(self, tree: dict[str, dict]) -> dict[str, DataFrame]:
        """Any tree: the table of each bucket aggregation by its path (names joined by >), of each sibling pipeline by
        its own, and the metrics of the whole under an empty path."""
        out: dict[str, DataFrame] = {}
        top = {n: a for n, a in tree.items() if kind_of(a) in METRICS}
        if top:
            out[""] = self.flat(top, [])

        def walk(here: dict[str, dict], chain: list[Level]) -> None:
            for level in _levels(here).values():
                out[">".join(x.name for x in [*chain, level])] = self.flat({}, [*chain, level])
                walk(level.below, [*chain, level])
            above = ">".join(x.name for x in chain)
            for n, a in here.items():
                if (kind := kind_of(a)) in SIBLINGS:
                    *path, value = a[kind]["buckets_path"].split(">")
                    t = out[">".join(filter(None, [above, *path]))]
                    by = [c for x in chain for c in self.keys_of(x)]
                    extra = {k: a[kind][k] for k in ("percents", "sigma") if k in a[kind]}
                    out[">".join(filter(None, [above, n]))] = pipeline.sibling(t, kind, self.path(value), n, by=by or None, **extra)

        walk(tree, [])
        return out

    def keys_of(self, level: Level) -> list[str]:
        if level.kind == "multi_terms":
            return [f"{level.name}_{i}" for i in range(len(level.spec["terms"]))]
        return [next(iter(x)) for x in level.spec["sources"]] if level.kind == "composite" else [level.name]

    @staticmethod
    def path(text: str) -> str:
        return "doc_count" if text == "_count" else text.split(">")[-1].replace(".", "_")

    def flat(self, top: dict[str, dict], chain: list[Level]) -> DataFrame:
        if not chain:
            return self.grouped(self.df, [], top).drop("doc_count")
        df, keys, out, uppers = self.df, [], None, []
        self.c = self.root
        self.c.element, self.c.element_path = None, ""
        for k, level in enumerate(chain):
            self.keys = keys
            df, own = self.bucket(df, level.name, level.kind, level.spec)
            parents, keys = keys, [*keys, *own]
            metrics, pipes = level.of(METRICS), level.of(PIPES)
            deepest = k == len(chain) - 1
            if not deepest and not (metrics or pipes or level.kind in ("terms", "multi_terms", "rare_terms", "composite") or level.spec.get("min_doc_count", 0) > 1):
                continue
            t = self.grouped(df, keys, metrics)
            if level.kind in ("histogram", "date_histogram") and not level.spec.get("min_doc_count", 0):
                t = self.fill(t, level, own[0], parents, metrics) if deepest else t
            t = self.piped(self.cut(t, level.kind, level.spec, own, parents), pipes, own[0], parents)
            if deepest:
                out = t
            else:
                uppers.append((keys, t.drop("doc_count")))
        for by, t in uppers:
            if clash := sorted((set(t.columns) & set(out.columns)) - set(by)):
                raise ValueError(f"names {clash} stand at several levels of one chain")
            out = matched(out, t, by)
        return out.join(F.broadcast(self.grouped(self.df, [], top).drop("doc_count"))) if top else out  # one row

    def grouped(self, df: DataFrame, keys: list[str], metrics: dict[str, dict]) -> DataFrame:
        columns, deviations, shares = {}, {}, {}
        for n, a in metrics.items():
            kind = kind_of(a)
            if kind == "median_absolute_deviation":
                deviations[n] = self.value(a[kind])
            elif kind == "percentiles" and not a[kind].get("approximate") and not df.isStreaming and a[kind].get("percents", PERCENTS):
                shares[n] = {f"{n}_{label(p)}": p / 100 for p in a[kind].get("percents", PERCENTS)}
                columns |= dict.fromkeys(shares[n])
            else:
                columns |= self.metric(n, kind, a[kind])
        count = F.sum(F.coalesce(F.col("_doc_count"), F.lit(1))) if "_doc_count" in df.columns else F.count(F.lit(1))
        out = df.groupBy(*keys).agg(count.cast("long").alias("doc_count"), *(v.alias(n) for n, v in columns.items() if v is not None))
        for n, named in shares.items():
            out = beside(out, quantiles.percentiles(df, keys, self.value(metrics[n]["percentiles"]), named), keys)
        if shares:
            out = out.select(*keys, "doc_count", *columns)
        for n, v in deviations.items():
            out = self.deviation(df, keys, n, v, out)
        return out

    def piped(self, t: DataFrame, pipes: dict[str, dict], key: str, by: list[str]) -> DataFrame:
        """Parent pipelines by their buckets_path, in the order of the request."""
        for n, a in pipes.items():
            kind, s = kind_of(a), a[kind_of(a)]
            paths = s.get("buckets_path", {})
            paths = {k: self.path(v) for k, v in paths.items()} if isinstance(paths, dict) else self.path(paths)
            if kind == "bucket_script":
                t = pipeline.bucket_script(t, n, paths, s["script"])
            elif kind == "bucket_selector":
                t = pipeline.bucket_selector(t, paths, s["script"])
            elif kind == "bucket_sort":
                order = [(next(iter(x.items())) if isinstance(x, dict) else (x, "asc")) for x in s.get("sort", [])]
                order = [({"_key": key}.get(k, self.path(k)), v if isinstance(v, str) else v.get("order", "asc")) for k, v in order] or [(key, "asc")]
                t = pipeline.bucket_sort(t, order, s.get("size"), s.get("from", 0), by or None)
            elif kind == "moving_fn":
                options = {k: s[k] for k in ("alpha", "beta", "gamma", "period") if k in s}
                t = pipeline.moving_fn(t, key, paths, n, s["script"].split("MovingFunctions.")[-1].split("(")[0], s["window"], s.get("shift", 0), by, **options)
            elif kind == "serial_diff":
                t = pipeline.serial_diff(t, key, paths, n, s.get("lag", 1), by)
            elif kind == "moving_avg":
                t = pipeline.moving_avg(t, key, paths, n, s.get("window", 5), by)
            else:
                t = {"cumulative_sum": pipeline.cumulative_sum, "derivative": pipeline.derivative}[kind](t, key, paths, n, by)
        return t

    def fill(self, t: DataFrame, level: Level, key: str, parents: list[str], metrics: dict[str, dict]) -> DataFrame:
        """Empty buckets between the least and the greatest of each parent, or the extended bounds."""
        s, bounds = level.spec, level.spec.get("extended_bounds")
        if level.kind == "histogram":
            i, o = float(s["interval"]), float(s.get("offset", 0))
            number = lambda c: F.round((c - o) / i).cast("long")
            start, lit = (lambda n: n * i + o), (lambda x: F.floor((F.lit(float(x)) - o) / i) * i + o)
        else:
            number, start = _steps(s)
            lit = lambda x: date_floor(F.lit(dates.evaluate(x)), s)
        t = t.withColumn("__i", number(F.col(key)))
        lo, hi = F.min("__i"), F.max("__i")
        if bounds:
            lo, hi = F.least(lo, number(lit(bounds["min"]))), F.greatest(hi, number(lit(bounds["max"])))
        frame = t.groupBy(*parents).agg(lo.alias("__lo"), hi.alias("__hi"))
        far = F.raise_error(F.lit(f"[{level.name}] has over {MAX_BUCKETS} buckets")).cast("long")
        numbers = F.sequence(F.col("__lo"), F.when(F.col("__hi") - F.col("__lo") < MAX_BUCKETS, F.col("__hi")).otherwise(far))
        every = frame.filter("__lo IS NOT NULL").select(*parents, F.explode(numbers).alias("__i"))
        out = matched(every, t.drop(key), [*parents, "__i"], "left").withColumn(key, start(F.col("__i"))).drop("__i")
        zero = ["doc_count", *(n for n, a in metrics.items() if kind_of(a) in ("sum", "value_count", "cardinality"))]
        return out.fillna(0, zero).select(*(c for c in t.columns if c != "__i"))

    def deviation(self, df: DataFrame, keys: list[str], name: str, v: Column, out: DataFrame) -> DataFrame:
        """Median of distances to the median."""
        rows = df.select(*keys, v.cast("double").alias("__x"))
        m = quantiles.percentiles(rows, keys, F.col("__x"), {"__m": 0.5})
        return beside(out, quantiles.percentiles(beside(rows, m, keys), keys, F.abs(F.col("__x") - F.col("__m")), {name: 0.5}), keys)

    def cut(self, out: DataFrame, kind: str, s: dict, own: list[str], parents: list[str]) -> DataFrame:
        """min_doc_count, order and size; inside a parent bucket by a window."""
        if kind == "rare_terms":
            return out.filter(F.col("doc_count") <= s.get("max_doc_count", 1))
        if "min_doc_count" in s and s["min_doc_count"] > 1:
            out = out.filter(F.col("doc_count") >= s["min_doc_count"])
        if kind == "composite":
            order = []
            for source in s["sources"]:
                (key, one), = source.items()
                (_, o), = one.items()
                last = o.get("missing_order") == "last"
                c = F.col(key)
                order.append((c.desc_nulls_last() if last else c.desc_nulls_first()) if o.get("order") == "desc" else (c.asc_nulls_last() if last else c.asc_nulls_first()))
            if "after" in s:
                test, same = F.lit(False), F.lit(True)
                for source in s["sources"]:
                    (key, one), = source.items()
                    (_, o), = one.items()
                    v = F.lit(s["after"][key])
                    test = test | (same & ((F.col(key) < v) if o.get("order") == "desc" else (F.col(key) > v)))
                    same = same & (F.col(key) == v)
                out = out.filter(test)
            return out.orderBy(*order).limit(int(s.get("size", 10)))
        if kind not in ("terms", "multi_terms"):
            return out
        order = s.get("order", {"_count": "desc"})
        order = order if isinstance(order, list) else [order]
        cols = [(F.col({"_count": "doc_count", "_key": own[0]}.get(k, k.replace(".", "_"))), v) for o in order for k, v in o.items()]
        sort = [c.desc() if v == "desc" else c.asc() for c, v in cols] + [F.col(k).asc() for k in own]
        if s.get("size", 10) is None:  # all buckets
            return out
        if not parents:
            return out.orderBy(*sort).limit(int(s.get("size", 10)))
        w = Window.partitionBy(*parents).orderBy(*sort)
        return out.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= int(s.get("size", 10))).drop("__r")


def _steps(s: dict):
    """Number of a date bucket from its start, and the start from its number."""
    zone = s.get("time_zone", "UTC")
    shift = int((dates.seconds(s["offset"].lstrip("+-")) * (-1 if s["offset"].startswith("-") else 1) if "offset" in s else 0) * 1e6)
    unit = s.get("calendar_interval") or (s.get("interval") if s.get("interval") in dates.CALENDAR else None)
    unit = dates.CALENDAR[unit] if unit else None
    months = {"month": 1, "quarter": 3, "year": 12}.get(unit)
    step = {"week": 604800, "day": 86400, "hour": 3600, "minute": 60, "second": 1}.get(unit) or (0 if months else dates.seconds(s.get("fixed_interval") or s["interval"]))
    monday = 4 * 86_400_000_000 if unit == "week" else 0  # the epoch was a Thursday

    def local(c: Column) -> Column:
        t = F.from_utc_timestamp(c.cast("timestamp"), zone) if zone != "UTC" else c.cast("timestamp")
        return F.timestamp_micros(F.unix_micros(t) - F.lit(shift))

    def number(c: Column) -> Column:
        t = local(c)
        if months:
            return F.floor((F.year(t) * 12 + F.month(t) - 1) / months).cast("long")
        return F.floor((F.unix_micros(t) - F.lit(monday)) / F.lit(int(step * 1e6))).cast("long")

    def start(n: Column) -> Column:
        if months:
            m = n * months
            t = F.make_timestamp(F.floor(m / 12).cast("int"), (m % 12 + 1).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
        else:
            t = F.timestamp_micros(n * F.lit(int(step * 1e6)) + F.lit(monday))
        t = F.timestamp_micros(F.unix_micros(t) + F.lit(shift))
        return (F.to_utc_timestamp(t, zone) if zone != "UTC" else t).cast("timestamp_ntz")

    return number, start


def date_floor(v: Column, s: dict) -> Column:
    """The start of the calendar or fixed interval, in the asked zone, as a timestamp without zone."""
    v, zone = v.cast("timestamp_ntz"), s.get("time_zone", "UTC")
    shift = dates.seconds(s["offset"].lstrip("+-")) * (-1 if s["offset"].startswith("-") else 1) if "offset" in s else 0
    t = v.cast("timestamp")
    if zone != "UTC":
        t = F.from_utc_timestamp(t, zone)
    if shift:
        t = F.timestamp_micros(F.unix_micros(t) - int(shift * 1e6))
    unit = s.get("calendar_interval") or (s.get("interval") if s.get("interval") in dates.CALENDAR else None)
    if unit:
        t = F.date_trunc(dates.CALENDAR[unit], t)
    else:
        step = int(dates.seconds(s.get("fixed_interval") or s["interval"]) * 1e6)
        t = F.timestamp_micros(F.unix_micros(t) - F.pmod(F.unix_micros(t), F.lit(step)))
    if shift:
        t = F.timestamp_micros(F.unix_micros(t) + int(shift * 1e6))
    if zone != "UTC":
        t = F.to_utc_timestamp(t, zone)
    return t.cast("timestamp_ntz")


def filled(table: DataFrame, key: str, step: Any, by: list[str] | None = None, bounds: tuple | None = None) -> DataFrame:
    """Empty buckets between the least and the greatest key (or the extended bounds), with doc_count 0."""
    lo, hi = F.min(key), F.max(key)
    if bounds:
        lo, hi = F.least(lo, F.lit(bounds[0])), F.greatest(hi, F.lit(bounds[1]))
    frame = table.groupBy(*(by or [])).agg(lo.alias("__lo"), hi.alias("__hi"))
    every = frame.select(*(by or []), F.explode(F.sequence("__lo", "__hi", step if isinstance(step, Column) else F.lit(step))).alias(key))
    return every.join(table, [*(by or []), key], "left").fillna(0, ["doc_count"])


def significant(engine, name: str, query: dict, field: str, size: int = 10, min_doc_count: int = 3) -> DataFrame:
    """Terms more frequent in the query's documents than in all: (fg - bg) * fg / bg of the shares."""
    ix = engine.index(name)
    c = engine.compiler(ix, scoring=False)
    on = c.compile(query).pred
    term = F.explode(F.array_distinct(c.tokens(field) if c.is_text(field) else F.array(c.col(field)))).alias("key")
    rows = c.df.select(on.alias("__on"), term).filter(F.col("key").isNotNull())
    totals = c.df.agg(F.count(F.lit(1)).alias("__n"), F.count_if(on).alias("__f"))
    out = rows.groupBy("key").agg(F.count_if("__on").alias("doc_count"), F.count(F.lit(1)).alias("bg_count")).filter(F.col("doc_count") >= min_doc_count)
    fg, bg = F.col("doc_count") / F.col("__f"), F.col("bg_count") / F.col("__n")
    out = out.join(F.broadcast(totals)).withColumn("score", (fg - bg) * (fg / bg)).filter("score > 0")  # totals: one row
    return out.select("key", "doc_count", "bg_count", "score").orderBy(F.desc("score"), "key").limit(size)


