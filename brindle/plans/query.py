"""The JSON query DSL compiled to a predicate column and a score column.

Clauses that need another table (lookups, parent and child) add a flag column to the DataFrame by a left join on a
unique key, so they combine freely inside `bool`; Catalyst turns those that are required into inner joins.
Statistics for BM25 are computed in one aggregation for each scored text clause, and not at all when `scoring` is off.
"""

from __future__ import annotations

import base64
import json
import math
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, positions, scoring, vectors
from ..functions.analysis import Analyzers, once, shingles
from ..functions.script import Script
from ..model import NUMERIC, RANGES, TEXT, Mapping
from . import dates

LARGE_LIST = 1000


@dataclass
class Compiled:
    pred: Column
    score: Column


def minimum_should_match(spec: Any, n: int) -> int:
    """`3`, `-1`, `75%`, `-25%`, or conditionals such as `2<75% 9<-3`; clamped to 0..n."""
    text = str(spec).strip()
    if "<" in text:
        out = n
        for part in text.split():
            at, _, rest = part.partition("<")
            if n > int(at):
                out = minimum_should_match(rest, n)
        return out
    if text.endswith("%"):
        p = int(text[:-1])
        k = n * abs(p) // 100
        k = k if p >= 0 else n - k
    else:
        k = int(text)
        k = k if k >= 0 else n + k
    return max(0, min(n, k))


def _one(spec: dict, key: str) -> tuple[str, dict[str, Any]]:
    """{field: value} or {field: {key: value, ...}} without the clause's own options."""
    name = next(k for k in spec if k not in ("boost", "_name"))
    v = spec[name]
    out = dict(v) if isinstance(v, dict) else {key: v}
    for k in ("boost", "_name"):
        if k in spec:
            out[k] = spec[k]
    return name, out


TOKENS = "__tok_"  # before the name of a text field: its stored terms


def _order(inner: dict) -> list[tuple[str, bool]]:
    """(field, descending) of the sort of inner hits."""
    spec = inner.get("sort", [])
    pairs = [(k, "asc") if isinstance(k, str) else next(iter(k.items())) for k in (spec if isinstance(spec, list) else [spec])]
    return [(k, (o if isinstance(o, str) else o.get("order", "asc")) == "desc") for k, o in pairs]


def _best(objects: Column, keys: list[tuple[str, bool]], inner: dict) -> Column:
    """The first objects of an array by the keys, nulls last; without keys in the order of the array."""

    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for k, down in reversed(keys):
            x, y, sign = a.getField(k), b.getField(k), -1 if down else 1
            both = F.when(x.isNull() & y.isNull(), out).when(x.isNull(), 1).when(y.isNull(), -1)
            out = both.when(x < y, -sign).when(x > y, sign).otherwise(out)
        return out

    return F.slice(F.array_sort(objects, compare) if keys else objects, 1 + int(inner.get("from", 0)), int(inner.get("size", 3)))


class QueryCompiler:
    def __init__(self, df: DataFrame, mapping: Mapping, id_col: str | None = None, engine=None, analyzers: Analyzers | None = None, scoring: bool = True, now=None):
        self.df, self.mapping, self.id_col, self.engine = df, mapping, id_col, engine
        self.analyzers, self.scoring, self.now = analyzers or Analyzers(), scoring, now
        self.named: dict[str, Column] = {}
        self.inner: dict[str, Column] = {}  # inner hits by name
        self.n_flags = 0
        self._stats: dict[str, tuple] = {}
        self.terms: dict[str, tuple] = {}  # by field: stored (term, df), number and mean length of documents with terms
        self.element: Column | None = None  # inside `nested`: the object
        self.element_path = ""

    # -- fields --------------------------------------------------------------------------------------------------

    def col(self, name: str) -> Column:
        name = self.mapping.resolve(name)
        if self.element is not None and name.startswith(self.element_path + "."):
            return self.element.getField(name[len(self.element_path) + 1 :])
        head, _, tail = name.rpartition(".")
        f = self.mapping.get(head) if head else None
        if f is not None and f.kind not in ("object", "nested", "join") and tail in f.properties:
            return self.col(head)  # a multi-field has its parent's value
        if f is not None and f.kind == "flat_object":
            return F.try_element_at(self.col(head), F.lit(tail))
        if name == "_id" and self.id_col and "_id" not in self.df.columns:
            return F.col(self.id_col).cast("string")
        if name.split(".")[0] not in self.df.columns:
            return F.lit(None)
        return F.col(name)

    def kind(self, name: str) -> str:
        return self.mapping.kind(name) or "keyword"

    def many(self, name: str) -> bool:
        f = self.mapping.get(name)
        return bool(f and f.many and f.kind not in ("nested", "knn_vector"))

    def is_text(self, name: str) -> bool:
        return self.kind(name) in TEXT

    def analyzer(self, name: str, search: bool = False) -> Any:
        f = self.mapping.get(name)
        o = f.options if f else {}
        return (o.get("search_analyzer") if search else None) or o.get("analyzer", "standard")

    def tokens(self, name: str) -> Column:
        for suffix, n in (("._2gram", 2), ("._3gram", 3), ("._4gram", 4)):
            if name.endswith(suffix):
                return shingles(self.tokens(name.removesuffix(suffix)), n, n)
        if (kept := TOKENS + name) in self.df.columns and self.element is None:
            return F.col(f"`{kept}`")
        c = self.col(name)
        return self.analyzers.tokens(F.array_join(c, " ") if self.many(name) else c, self.analyzer(name))

    def analyzed(self, name: str, text: str, analyzer: Any = None) -> list[str]:
        analyzer = analyzer or self.analyzer(name, True)
        if analyzer == "standard":
            return re.findall(r"\w+", str(text).lower())
        return self.analyzers.analyze(self.df.sparkSession, str(text), analyzer)

    def any_of(self, name: str, test) -> Column:
        c = self.col(name)
        return F.coalesce(F.exists(c, test) if self.many(name) else test(c), F.lit(False))

    # -- entry ----------------------------------------------------------------------------------------------------

    def compile(self, query: dict | None) -> Compiled:
        if not query:
            query = {"match_all": {}}
        if len(query) != 1:
            raise ValueError(f"a query has one clause, found {sorted(query)}")
        (name, spec), = query.items()
        f = getattr(self, f"q_{name}", None)
        if f is None:
            raise ValueError(f"unknown query [{name}]")
        out = f(spec)
        if isinstance(spec, dict):
            inner = spec
            if "boost" not in spec and "_name" not in spec:
                inner = next((v for v in spec.values() if isinstance(v, dict) and ("boost" in v or "_name" in v)), {}) if name not in ("bool", "dis_max", "boosting", "constant_score", "nested", "function_score") else {}
            if (b := float(inner.get("boost", 1))) != 1:
                out = Compiled(out.pred, out.score * b)
            if "_name" in inner:
                self.named[inner["_name"]] = out.pred
        return out

    def const(self, pred: Column, score: float = 1.0) -> Compiled:
        return Compiled(F.coalesce(pred, F.lit(False)), F.lit(float(score)))

    def q_match_all(self, s):
        return self.const(F.lit(True))

    def q_match_none(self, s):
        return self.const(F.lit(False))

    # -- exact values ---------------------------------------------------------------------------------------------

    def _value(self, name: str, v: Any):
        kind = self.kind(name)
        if kind == "date":
            return F.lit(dates.evaluate(v, self.now)).cast("timestamp_ntz")
        if kind == "boolean":
            return F.lit(v if isinstance(v, bool) else str(v).lower() == "true")
        if kind in NUMERIC:
            return F.lit(v if not isinstance(v, str) else float(v) if "." in v else int(v))
        return F.lit(str(v).lower() if isinstance(v, bool) else str(v))

    def _equals(self, name: str, v: Any, fold: bool = False) -> Column:
        kind = self.kind(name)
        if kind == "ip" and "/" in str(v):
            lo, hi = cidr(str(v))
            return self.any_of(name, lambda c: ip_key(c).between(lo, hi))
        if kind == "date":
            return self.any_of(name, lambda c: c.cast("timestamp_ntz") == self._value(name, v))
        if fold:
            return self.any_of(name, lambda c: F.lower(c) == str(v).lower())
        want = self._value(name, v)
        return self.any_of(name, lambda c: c == want)

    def q_term(self, s):
        name, o = _one(s, "value")
        if self.is_text(name):
            term = str(o["value"]).lower() if o.get("case_insensitive") else str(o["value"])
            return self._bm25(name, [term], lambda t: F.array_contains(t, term))
        if name == "_id":
            return self.const(self.col("_id") == str(o["value"]))
        return self.const(self._equals(name, o["value"], o.get("case_insensitive", False)))

    def q_terms(self, s):
        name = next(k for k in s if k not in ("boost", "_name"))
        values = s[name]
        if isinstance(values, dict):
            return self.const(self._lookup(name, values))
        if any("/" in str(v) for v in values) and self.kind(name) == "ip":
            out = F.lit(False)
            for v in values:
                out = out | self._equals(name, v)
            return self.const(out)
        if self.is_text(name):
            return self.const(F.arrays_overlap(self.tokens(name), F.array(*(F.lit(str(v)) for v in values))))
        if len(values) > LARGE_LIST and not self.many(name):
            table = self.df.sparkSession.createDataFrame([(str(v),) for v in dict.fromkeys(values)], "v string")
            return self.const(self._flag(self.col(name).cast("string"), table, "v"))
        wanted = [self._value(name, v) for v in values]
        if self.kind(name) == "date":
            return self.const(self.any_of(name, lambda c: c.cast("timestamp_ntz").isin(wanted)))
        return self.const(self.any_of(name, lambda c: c.isin(wanted)))

    def _flag(self, key: Column, table: DataFrame, on: str, payload: dict[str, Column] | None = None) -> Column:
        """Left join on a unique key; the flag is whether the key was found."""
        self.n_flags += 1
        mark = f"__flag{self.n_flags}"
        right = table.select(F.col(on).alias(f"{mark}_k"), F.lit(True).alias(mark), *(v.alias(f"{mark}_{k}") for k, v in (payload or {}).items()))
        right = right.filter(F.col(f"{mark}_k").isNotNull())
        if not payload:
            right = right.distinct()
        self.df = self.df.join(right, key == F.col(f"{mark}_k"), "left").drop(f"{mark}_k")
        return F.coalesce(F.col(mark), F.lit(False))

    def _lookup(self, name: str, spec: dict) -> Column:
        other = self.engine.index(spec["index"])
        table = other.df
        if "id" in spec:
            table = table.filter(other.id_column() == str(spec["id"]))
        elif "query" in spec:
            table = self.engine.filtered(spec["index"], spec["query"])
        path = other.column(spec["path"])
        f = other.mapping.get(spec["path"])
        value = F.explode(path) if f and f.many else path
        return self._flag(self.col(name), table.select(value.alias("v")).distinct(), "v")

    def q_terms_set(self, s):
        name, o = _one(s, "terms")
        c = self.tokens(name) if self.is_text(name) else self.col(name) if self.many(name) else F.array(self.col(name))
        hits = sum((F.array_contains(c, self._value(name, v) if not self.is_text(name) else F.lit(v)).cast("int") for v in o["terms"]), F.lit(0))
        if "minimum_should_match_field" in o:
            need = F.greatest(self.col(o["minimum_should_match_field"]), F.lit(1))
        elif "minimum_should_match_script" in o:
            spec = o["minimum_should_match_script"]
            need = F.greatest(self.script(spec, {"params.num_terms": F.lit(len(o["terms"]))}), F.lit(1))
        else:
            need = F.lit(len(o["terms"]))
        return self.const(hits >= need)

    def q_ids(self, s):
        return self.const(self.col("_id").isin([str(v) for v in s["values"]]))

    def q_exists(self, s):
        name = s["field"]
        c = self.col(name)
        f = self.mapping.get(name)
        if f is None and name.split(".")[0] not in self.df.columns:
            return self.const(F.lit(False))
        if f and (f.many or f.kind in ("nested", "knn_vector", "completion")):
            return self.const(c.isNotNull() & (F.size(c) > 0))
        return self.const(c.isNotNull())

    def q_range(self, s):
        name, o = _one(s, "gte")
        if "from" in o:
            o["gte" if o.pop("include_lower", True) else "gt"] = o.pop("from")
        if "to" in o:
            o["lte" if o.pop("include_upper", True) else "lt"] = o.pop("to")
        kind = self.kind(name)
        if kind in RANGES:
            return self.const(self._range_field(name, kind, o))
        bounds = {k: self._bound(name, kind, k, o[k], o) for k in ("gte", "gt", "lte", "lt") if o.get(k) is not None}

        def test(c: Column) -> Column:
            if kind == "date":
                c = c.cast("timestamp_ntz")
            elif kind == "ip":
                c = ip_key(c)
            out = F.lit(True)
            for k, v in bounds.items():
                out = out & {"gte": c >= v, "gt": c > v, "lte": c <= v, "lt": c < v}[k]
            return out & c.isNotNull()

        return self.const(self.any_of(name, test))

    def _bound(self, name: str, kind: str, k: str, v: Any, o: dict):
        if kind in ("date", "date_range"):
            t = dates.evaluate(v, self.now, k in ("lte", "gt"), o.get("format"), o.get("time_zone"))
            return F.lit(t).cast("timestamp_ntz")
        if kind in ("ip", "ip_range"):
            return F.lit(ip_text(str(v)))
        if kind in NUMERIC or kind in RANGES:
            return F.lit(float(v) if isinstance(v, str) and "." in v else int(v) if isinstance(v, str) else v)
        return F.lit(str(v))

    def _range_field(self, name: str, kind: str, o: dict) -> Column:
        cast = (lambda c: c.cast("timestamp_ntz")) if kind == "date_range" else ip_key if kind == "ip_range" else (lambda c: c)
        lo, hi = cast(self.col(name)["gte"]), cast(self.col(name)["lte"])
        b = {k: self._bound(name, kind, k, o[k], o) for k in ("gte", "gt", "lte", "lt") if o.get(k) is not None}
        relation = o.get("relation", "intersects").lower()
        out = F.lit(True)
        for k, v in b.items():
            if relation == "intersects":
                test = {"gte": hi >= v, "gt": hi > v, "lte": lo <= v, "lt": lo < v}[k] | (hi.isNull() if k in ("gte", "gt") else lo.isNull())
            elif relation == "contains":
                test = (lo.isNull() | (lo <= v)) if k in ("gte", "gt") else (hi.isNull() | (hi >= v))
            else:
                test = {"gte": lo >= v, "gt": lo > v, "lte": hi <= v, "lt": hi < v}[k]
            out = out & F.coalesce(test, F.lit(relation != "within"))
        return out & self.col(name).isNotNull()

    # -- patterns -------------------------------------------------------------------------------------------------

    def _pattern(self, name: str, test) -> Compiled:
        if self.is_text(name):
            return self.const(F.exists(self.tokens(name), test))
        return self.const(self.any_of(name, lambda c: test(c.cast("string"))))

    def q_prefix(self, s):
        name, o = _one(s, "value")
        v, fold = str(o["value"]), o.get("case_insensitive") or self.is_text(name)
        return self._pattern(name, lambda c: F.startswith(F.lower(c), F.lit(v.lower())) if fold else F.startswith(c, F.lit(v)))

    def _regex(self, name: str, rx: str, fold: bool) -> Compiled:
        fold = fold or self.is_text(name)
        return self._pattern(name, lambda c: c.rlike(f"{'(?i)' if fold else ''}^(?:{rx})\\z"))

    def q_wildcard(self, s):
        name, o = _one(s, "value")
        return self._regex(name, java_wildcard(str(o.get("value", o.get("wildcard")))), o.get("case_insensitive", False))

    def q_regexp(self, s):
        name, o = _one(s, "value")
        if len(o["value"]) > 1000:
            raise ValueError("a regexp has at most 1000 characters")
        return self._regex(name, o["value"], o.get("case_insensitive", False))

    def fuzzy_test(self, term: str, o: dict):
        d, head = positions.fuzzy_edits(o.get("fuzziness", "AUTO"), term), term[: o.get("prefix_length", 0)]
        if d == 0:
            return lambda c: c == term
        if o.get("transpositions", True):
            # a swap of neighbours is one edit: the term's own swaps are few, so they are listed
            swaps = [term[:i] + term[i + 1] + term[i] + term[i + 2 :] for i in range(len(term) - 1) if term[i] != term[i + 1]]
            near = lambda c: F.levenshtein(c, F.lit(term), d).between(0, d)
            extra = (lambda c: c.isin(swaps)) if d == 1 else (lambda c: F.exists(F.array(*map(F.lit, swaps)), lambda w: F.levenshtein(c, w, d - 1).between(0, d - 1)))
            test = (lambda c: near(c) | extra(c)) if swaps else near
        else:
            test = lambda c: F.levenshtein(c, F.lit(term), d).between(0, d)
        return lambda c: test(c) & F.startswith(c, F.lit(head)) if head else test(c)

    def q_fuzzy(self, s):
        name, o = _one(s, "value")
        term = str(o["value"]).lower() if self.is_text(name) else str(o["value"])
        return self._pattern(name, self.fuzzy_test(term, o))

    # -- compound -------------------------------------------------------------------------------------------------

    def q_bool(self, s):
        parts = {k: [self.compile(q) for q in (v if isinstance(v, list) else [v])] for k, v in s.items() if k in ("must", "filter", "should", "must_not")}
        must, flt, should, no = (parts.get(k, []) for k in ("must", "filter", "should", "must_not"))
        pred = F.lit(True)
        for c in [*must, *flt]:
            pred = pred & c.pred
        for c in no:
            pred = pred & ~c.pred
        need = s.get("minimum_should_match")
        need = minimum_should_match(need, len(should)) if need is not None else int(bool(should) and not must and not flt)
        if should and need == 1:
            any_ = should[0].pred
            for c in should[1:]:
                any_ = any_ | c.pred
            pred = pred & any_
        elif need:
            pred = pred & (sum((c.pred.cast("int") for c in should), F.lit(0)) >= need)
        score = F.lit(0.0)
        for c in must:
            score = score + c.score
        for c in should:
            score = score + F.when(c.pred, c.score).otherwise(0.0)
        b = float(s.get("boost", 1))
        return Compiled(pred, score if must or should else F.lit(0.0 if flt else 1.0)) if b == 1 else Compiled(pred, score)

    def q_constant_score(self, s):
        return Compiled(self.compile(s["filter"]).pred, F.lit(1.0))

    def q_boosting(self, s):
        a, b = self.compile(s["positive"]), self.compile(s["negative"])
        return Compiled(a.pred, F.when(b.pred, a.score * float(s["negative_boost"])).otherwise(a.score))

    def q_dis_max(self, s):
        return self._best([self.compile(q) for q in s["queries"]], float(s.get("tie_breaker", 0)))

    def _best(self, parts: list[Compiled], tie: float) -> Compiled:
        pred = F.lit(False)
        for c in parts:
            pred = pred | c.pred
        scores = [F.when(c.pred, c.score).otherwise(0.0) for c in parts]
        best = F.greatest(*scores) if len(scores) > 1 else scores[0]
        return Compiled(pred, best + tie * (sum(scores[1:], scores[0]) - best) if tie else best)

    def q_wrapper(self, s):
        return self.compile(json.loads(base64.b64decode(s["query"])))

    def script(self, spec: dict | str, bound: dict[str, Column] | None = None) -> Column:
        spec = {"source": spec} if isinstance(spec, str) else spec
        source = spec.get("source") or self.engine.scripts[spec["id"]]
        whole = {"byte", "short", "integer", "long", "unsigned_long", "token_count"}
        kinds = lambda n: "list" if self.many(n) or self.kind(n) == "knn_vector" else "int" if self.kind(n) in whole else "num" if self.kind(n) in NUMERIC else "str" if self.kind(n) in ("keyword", "text") else "any"
        return Script(source, self.col, spec.get("params"), bound, kinds).column()

    def q_script(self, s):
        return self.const(self.script(s["script"]))

    # -- text -----------------------------------------------------------------------------------------------------

    def stats(self, name: str, terms: list[str]) -> tuple[int, float, dict[str, int]]:
        """Documents, average length and document frequencies, in one aggregation."""
        known = self._stats.setdefault(name, (None, None, {}))
        new = [t for t in dict.fromkeys(terms) if t not in known[2]]
        if new or known[0] is None:
            if name in self.terms:
                table, n, mean = self.terms[name]
                found = {r["term"]: r["df"] for r in table.filter(F.col("term").isin(new)).collect()}
                self._stats[name] = known = (n, mean, known[2] | {x: found.get(x, 0) for x in new})
                return known
            t = self.df.select(self.tokens(name).alias("t"))
            row = t.agg(F.count(F.when(F.size("t") > 0, 1)).alias("n"), F.avg(F.when(F.size("t") > 0, F.size("t"))).alias("a"), *(F.count(F.when(F.array_contains("t", x), 1)).alias(f"d{i}") for i, x in enumerate(new))).first()
            self._stats[name] = known = (row["n"], row["a"] or 1.0, known[2] | {x: row[f"d{i}"] for i, x in enumerate(new)})
        return known

    def frequencies(self, name: str, terms: list[str]) -> tuple[int, dict[str, int]]:
        """Number of rows and document frequencies in one pass: a text is analysed once and keeps only these terms."""
        if name in self.terms:
            table = self.terms[name][0]
            return self.df.count(), {r["term"]: r["df"] for r in table.filter(F.col("term").isin(terms)).collect()}
        mine = F.array_distinct(F.filter(self.tokens(name), lambda t: t.isin(terms)))
        row = F.array(F.lit(None).cast("string"))  # a null for each row; of explode_outer no filter is inferred, which would analyse again
        found = {r["t"]: r["count"] for r in self.df.select(F.explode_outer(F.concat(row, F.coalesce(mine, F.array().cast("array<string>")))).alias("t")).groupBy("t").count().collect()}
        return found.pop(None, 0), found

    def _bm25(self, name: str, terms: list[str], pred, weights: dict[str, float] | None = None) -> Compiled:
        tokens = self.tokens(name)
        p = F.coalesce(once(tokens, pred) if len(terms) > 1 else pred(tokens), F.lit(False))
        if not self.scoring:
            return Compiled(p, F.lit(1.0))
        n, average, df = self.stats(name, terms)
        o = self.similarity(name)

        def score(tokens: Column) -> Column:
            out = F.lit(0.0)
            for t in dict.fromkeys(terms):
                if df.get(t):
                    out = out + scoring.bm25(scoring.term_freq(tokens, t), F.size(tokens).cast("double"), average, scoring.idf(n, df[t]) * terms.count(t), **o)
            return out

        return Compiled(p, once(tokens, score))

    def similarity(self, name: str) -> dict[str, float]:
        f = self.mapping.get(name)
        own = (f.options.get("similarity") if f else None) or {}
        own = self.analyzers.settings.get("similarity", {}).get(own, {}) if isinstance(own, str) else own
        return {k: float(own[k]) for k in ("k1", "b") if k in own}

    def q_match(self, s):
        name, o = _one(s, "query")
        if not self.is_text(name):
            return self.const(self._equals(name, o["query"]))
        terms = self.analyzed(name, o["query"], o.get("analyzer"))
        if not terms:
            return self.const(F.lit(o.get("zero_terms_query") == "all"))
        n = len(terms)
        need = n if o.get("operator", "or").lower() == "and" else minimum_should_match(o["minimum_should_match"], n) if "minimum_should_match" in o else 1
        if "fuzziness" in o:
            each = [self.fuzzy_test(t, o) for t in terms]
            return self.const(sum((F.exists(self.tokens(name), f).cast("int") for f in each), F.lit(0)) >= max(need, 1))
        if need == n:
            return self._bm25(name, terms, lambda t: F.forall(F.array(*map(F.lit, terms)), lambda w: F.array_contains(t, w)) if n > 1 else F.array_contains(t, terms[0]))
        if need <= 1:
            return self._bm25(name, terms, lambda t: F.arrays_overlap(t, F.array(*map(F.lit, terms))))
        return self._bm25(name, terms, lambda t: sum((F.array_contains(t, w).cast("int") for w in terms), F.lit(0)) >= need)

    def _phrase(self, name: str, terms: list[str], slop: int) -> Compiled:
        if not terms:
            return self.const(F.lit(False))
        tokens = self.tokens(name)
        if len(terms) == 1:
            return self._bm25(name, terms, lambda t: F.array_contains(t, terms[0]))
        freq = positions.frequency(tokens, {"sloppy": {"terms": terms, "slop": slop}}) if slop else positions.phrase_at(tokens, terms)
        if not self.scoring:
            return Compiled(freq > 0, F.lit(1.0))
        n, average, df = self.stats(name, terms)
        weight = sum(scoring.idf(n, df[t]) for t in terms if df[t])
        return Compiled(freq > 0, scoring.bm25(freq, F.size(tokens).cast("double"), average, weight, **self.similarity(name)))

    def q_match_phrase(self, s):
        name, o = _one(s, "query")
        if not self.is_text(name):
            return self.const(self._equals(name, o["query"]))
        return self._phrase(name, self.analyzed(name, o["query"], o.get("analyzer")), int(o.get("slop", 0)))

    def q_match_phrase_prefix(self, s):
        name, o = _one(s, "query")
        terms = self.analyzed(name, o["query"], o.get("analyzer"))
        clauses = [*({"term": {"value": t}} for t in terms[:-1]), {"prefix": {"value": terms[-1]}}]
        return self.const(positions.frequency(self.tokens(name), {"near": {"clauses": clauses, "slop": int(o.get("slop", 0)), "ordered": True}}) > 0)

    def q_match_bool_prefix(self, s):
        name, o = _one(s, "query")
        terms = self.analyzed(name, o["query"], o.get("analyzer"))
        tests = [*(F.array_contains(self.tokens(name), t) for t in terms[:-1]), F.exists(self.tokens(name), lambda t: F.startswith(t, F.lit(terms[-1])))]
        n = len(tests)
        need = n if o.get("operator", "or") == "and" else max(1, minimum_should_match(o.get("minimum_should_match", 1), n))
        base = self._bm25(name, terms[:-1], lambda t: F.lit(True)) if n > 1 else self.const(F.lit(True), 0)
        return Compiled(sum((t.cast("int") for t in tests), F.lit(0)) >= need, base.score + F.when(tests[-1], 1.0).otherwise(0.0))

    def _fields(self, names: list[str]) -> list[tuple[str, float]]:
        out = []
        for n in names or ["*"]:
            n, _, b = n.partition("^")
            found = self.mapping.matching(n) if "*" in n else [n]
            out += [(f, float(b or 1)) for f in found if "*" not in n or self.is_text(f) or self.kind(f) == "keyword"]
        return out

    def q_multi_match(self, s):
        kind, rest = s.get("type", "best_fields"), {k: v for k, v in s.items() if k not in ("fields", "type", "tie_breaker", "boost", "_name")}
        clause = {"phrase": "match_phrase", "phrase_prefix": "match_phrase_prefix", "bool_prefix": "match_bool_prefix"}.get(kind, "match")
        parts = []
        if kind == "cross_fields" and s.get("operator", "or") == "and":
            fields = self._fields(s.get("fields", []))
            terms = self.analyzed(fields[0][0], s["query"])
            return self.q_bool({"must": [{"dis_max": {"queries": [{"match": {f: {"query": t, "boost": b}}} for f, b in fields]}} for t in terms]})
        for f, b in self._fields(s.get("fields", [])):
            c = self.compile({clause: {f: rest if self.is_text(f) else {"query": s["query"]}}})
            parts.append(Compiled(c.pred, c.score * b))
        return self._best(parts, 1.0 if kind in ("most_fields", "cross_fields", "bool_prefix") else float(s.get("tie_breaker", 0)))

    def q_combined_fields(self, s):
        fields = self._fields(s["fields"])
        terms = self.analyzed(fields[0][0], s["query"])
        need = len(terms) if s.get("operator", "or") == "and" else max(1, minimum_should_match(s.get("minimum_should_match", 1), len(terms)))
        tokens = {f: self.tokens(f) for f, _ in fields}
        has = [F.coalesce(sum((F.array_contains(tokens[f], t).cast("int") for f, _ in fields), F.lit(0)), F.lit(0)) > 0 for t in terms]
        pred = sum((h.cast("int") for h in has), F.lit(0)) >= need
        if not self.scoring:
            return Compiled(pred, F.lit(1.0))
        both = [F.array_contains(tokens[f], t) for t in terms for f, _ in fields]
        length = sum((F.size(tokens[f]) * b for f, b in fields), F.lit(0.0))
        del both
        row = self.df.agg(F.count(F.when(length > 0, 1)).alias("n"), F.avg(F.when(length > 0, length)).alias("a"), *(F.count(F.when(h, 1)).alias(f"d{i}") for i, h in enumerate(has))).first()
        score = F.lit(0.0)
        for i, t in enumerate(terms):
            if row[f"d{i}"]:
                freq = sum((scoring.term_freq(tokens[f], t) * b for f, b in fields), F.lit(0.0))
                score = score + scoring.bm25(freq, length, row["a"], scoring.idf(row["n"], row[f"d{i}"]))
        return Compiled(pred, score)

    def q_common(self, s):
        name, o = _one(s, "query")
        terms = self.analyzed(name, o["query"])
        n, _, df = self.stats(name, terms)
        cut = float(o.get("cutoff_frequency", 0.01))
        cut = cut * n if cut < 1 else cut
        rare = [t for t in terms if df[t] <= cut] or terms
        need = len(rare) if o.get("low_freq_operator", "or") == "and" else 1
        return self._bm25(name, terms, lambda t: sum((F.array_contains(t, w).cast("int") for w in rare), F.lit(0)) >= need)

    def q_query_string(self, s):
        from .querystring import parse

        return self.compile(parse(s["query"], s.get("fields") or ([s["default_field"]] if s.get("default_field", "*") != "*" else self._text_fields()), s.get("default_operator", "or"), False, self))

    def q_simple_query_string(self, s):
        from .querystring import parse

        return self.compile(parse(s["query"], s.get("fields") or self._text_fields(), s.get("default_operator", "or"), True, self))

    def _text_fields(self) -> list[str]:
        return [n for n, f in self.mapping.fields.items() if f.kind in TEXT] or [n for n, f in self.mapping.fields.items() if f.kind == "keyword"]

    def q_more_like_this(self, s):
        fields = s.get("fields") or self._text_fields()
        texts = [x for x in (s["like"] if isinstance(s["like"], list) else [s["like"]]) if isinstance(x, str)]
        ids = [str(x["_id"]) for x in (s["like"] if isinstance(s["like"], list) else [s["like"]]) if isinstance(x, dict)]
        should, stop = [], set(s.get("stop_words", []))
        unlike = s.get("unlike") or []
        for x in unlike if isinstance(unlike, list) else [unlike]:
            stop |= set(self.analyzed(fields[0], x))
        for name in fields:
            counts: dict[str, int] = {}
            for t in texts:
                for w in self.analyzed(name, t):
                    counts[w] = counts.get(w, 0) + 1
            if ids:
                picked = self.df.filter(self.col("_id").isin(ids)).select(F.explode_outer(self.tokens(name)).alias("t")).groupBy("t").count()
                for r in picked.collect():
                    if r["t"] is not None:
                        counts[r["t"]] = counts.get(r["t"], 0) + r["count"]
            terms = [t for t, n in counts.items() if n >= s.get("min_term_freq", 2) and t not in stop and len(t) >= s.get("min_word_length", 0)]
            if not terms:
                continue
            n, df = self.frequencies(name, terms)
            ranked = sorted((t for t in terms if s.get("min_doc_freq", 5) <= df.get(t, 0) <= s.get("max_doc_freq", 2**31)), key=lambda t: (-counts[t] * (math.log((n + 1) / (df[t] + 1)) + 1), t))
            if chosen := ranked[: s.get("max_query_terms", 25)]:
                should.append((name, chosen))
        if not should:
            return self.const(F.lit(False))
        terms = [(name, t) for name, chosen in should for t in chosen]
        need = minimum_should_match(s.get("minimum_should_match", "30%"), len(terms))
        held = sum((F.coalesce(F.array_size(F.array_intersect(self.tokens(name), F.array(*map(F.lit, chosen)))), F.lit(0)) for name, chosen in should), F.lit(0))
        score = F.lit(1.0)
        if self.scoring:
            for name, chosen in should:
                self.stats(name, chosen)
            score = self.q_bool({"should": [{"term": {name: t}} for name, t in terms]}).score
        out = Compiled(held >= need, score)
        if ids and not s.get("include"):
            out = Compiled(out.pred & ~self.col("_id").isin(ids), out.score)
        return out

    # -- spans and intervals --------------------------------------------------------------------------------------

    def _span(self, q: dict) -> tuple[str, dict]:
        (kind, s), = q.items()
        if kind == "span_term":
            name, o = _one(s, "value")
            return name, {"term": {"value": str(o["value"])}}
        if kind == "span_multi":
            (how, m), = s["match"].items()
            name, o = _one(m, "value")
            return name, {how: {"value": str(o["value"]).lower(), **{k: v for k, v in o.items() if k in ("fuzziness", "prefix_length")}}}
        if kind == "span_gap":
            name, width = next(iter(s.items()))
            return name, {"gap": {"width": width}}
        if kind in ("span_or", "span_near"):
            parts = [self._span(c) for c in s["clauses"]]
            name = parts[0][0]
            plans = [p for _, p in parts]
            return name, {"or": {"clauses": plans}} if kind == "span_or" else {"near": {"clauses": plans, "slop": s.get("slop", 0), "ordered": s.get("in_order", True)}}
        if kind == "span_first":
            name, p = self._span(s["match"])
            return name, {"first": {"match": p, "end": s["end"]}}
        if kind == "span_not":
            name, a = self._span(s["include"])
            d = s.get("dist", 0)
            return name, {"not": {"include": a, "exclude": self._span(s["exclude"])[1], "pre": s.get("pre", d), "post": s.get("post", d)}}
        if kind in ("span_containing", "span_within"):
            name, a = self._span(s["big"])
            return name, {kind.removeprefix("span_"): {"big": a, "little": self._span(s["little"])[1]}}
        if kind in ("field_masking_span", "span_field_masking"):
            return s["field"], self._span(s["query"])[1]
        raise ValueError(f"unknown span [{kind}]")

    def _spanned(self, q: dict) -> Compiled:
        name, plan = self._span(q)
        freq = positions.frequency(self.tokens(name), plan)
        return Compiled(freq > 0, freq / (freq + scoring.K1))

    def _interval(self, name: str, rule: dict) -> dict:
        (kind, s), = ((k, v) for k, v in rule.items() if k not in ("boost", "_name"))
        if kind == "match":
            terms = self.analyzed(name, s["query"], s.get("analyzer"))
            ordered = s.get("ordered", False) or s.get("mode") == "ordered"
            out = {"all_of": {"clauses": [{"term": {"value": t}} for t in terms], "max_gaps": s.get("max_gaps", -1), "ordered": ordered}}
        elif kind == "all_of":
            out = {"all_of": {"clauses": [self._interval(name, r) for r in s["intervals"]], "max_gaps": s.get("max_gaps", -1), "ordered": s.get("ordered", False) or s.get("mode") == "ordered"}}
        elif kind == "any_of":
            out = {"any_of": {"clauses": [self._interval(name, r) for r in s["intervals"]]}}
        else:
            out = {kind: {"value": s.get("prefix", s.get("pattern", s.get("term"))), **{k: v for k, v in s.items() if k in ("fuzziness", "prefix_length")}}}
        if "filter" in s:
            (how, inner), = s["filter"].items()
            out = {"filtered": {"source": out, "filter": self._interval(name, inner), "how": how}}
        return out

    def q_intervals(self, s):
        name, rule = next((k, v) for k, v in s.items() if k not in ("boost", "_name"))
        freq = positions.frequency(self.tokens(name), self._interval(name, rule))
        return Compiled(freq > 0, freq / (freq + 1))

    # -- objects and relations -----------------------------------------------------------------------------------

    def q_nested(self, s):
        path, outer = s["path"], (self.element, self.element_path)
        c = self.col(path)
        holder: list[Compiled] = []

        def test(o: Column) -> Column:
            self.element, self.element_path = o, path
            try:
                holder.append(self.compile(s["query"]))
            finally:
                self.element, self.element_path = outer
            return holder[-1].pred

        pred = F.coalesce(F.exists(c, test), F.lit(False))
        if (i := s.get("inner_hits")) is not None:
            self.inner[i.get("name", path)] = _best(F.filter(c, test), [(k.removeprefix(f"{path}."), d) for k, d in _order(i)], i)
        mode = s.get("score_mode", "avg")
        if mode == "none" or not self.scoring:
            return Compiled(pred, F.lit(0.0))

        def value(o: Column) -> Column:
            self.element, self.element_path = o, path
            try:
                got = self.compile(s["query"])
            finally:
                self.element, self.element_path = outer
            return F.when(got.pred, got.score)

        scores = F.filter(F.transform(c, value), lambda v: v.isNotNull())
        total = F.aggregate(scores, F.lit(0.0), lambda a, v: a + v)
        return Compiled(pred, {"sum": total, "max": F.array_max(scores), "min": F.array_min(scores), "avg": total / F.size(scores)}[mode])

    def _join_field(self) -> str:
        return next(n for n, f in self.mapping.fields.items() if f.kind == "join")

    def q_has_child(self, s):
        """Children in the same index (a join field), or in `index` with `parent_field` naming their parent's id."""
        if "index" in s:
            kids = self.engine.matches(s["index"], s.get("query"))
            key, mine = F.col(s["parent_field"]), self.col(s.get("id_field", self.id_col or "_id"))
        else:
            rel = self._join_field()
            sub = QueryCompiler(self.df, self.mapping, self.id_col, self.engine, self.analyzers, self.scoring, self.now)
            got = sub.compile({"bool": {"filter": [{"term": {f"{rel}.name": s["type"]}}], "must": [s.get("query") or {"match_all": {}}]}})
            kids = sub.df.filter(got.pred).withColumn("_score", got.score)
            key, mine = F.col(f"{rel}.parent"), self.col("_id")
        i, hits = s.get("inner_hits"), []
        if i is not None:  # ranked by a window on the key that the groupBy below shares
            by = [F.col(k).desc_nulls_last() if d else F.col(k).asc_nulls_last() for k, d in _order(i) or [("_score", True)]]
            hit = F.struct("_at", F.struct(*(c for c in kids.columns if c != "_score")).alias("hit"))
            kids = kids.withColumn("_at", F.row_number().over(Window.partitionBy(key).orderBy(*by)) - int(i.get("from", 0)))
            ranked = F.array_sort(F.collect_list(F.when(F.col("_at").between(1, int(i.get("size", 3))), hit)))
            hits = [F.transform(ranked, lambda h: h["hit"]).alias("hits")]
        found = kids.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n"), *hits, *(f("_score").alias(n) for n, f in (("max", F.max), ("min", F.min), ("sum", F.sum), ("avg", F.avg))))
        found = found.filter(F.col("n").between(s.get("min_children", 1), s.get("max_children", 2**31 - 1)))
        mode = s.get("score_mode", "none")
        flag = self._flag(mine, found, "k", ({} if mode == "none" else {"s": F.col(mode)}) | ({"hits": F.col("hits")} if hits else {}))
        if hits:
            self.inner[i.get("name", s.get("type", s.get("index")))] = F.col(f"__flag{self.n_flags}_hits")
        return Compiled(flag, F.lit(1.0) if mode == "none" else F.coalesce(F.col(f"__flag{self.n_flags}_s"), F.lit(0.0)))

    def q_has_parent(self, s):
        if "index" in s:
            parents = self.engine.matches(s["index"], s.get("query"))
            key, mine = F.col(s["id_field"]), self.col(s["parent_field"])
        else:
            rel = self._join_field()
            sub = QueryCompiler(self.df, self.mapping, self.id_col, self.engine, self.analyzers, self.scoring, self.now)
            got = sub.compile({"bool": {"filter": [{"term": {f"{rel}.name": s["parent_type"]}}], "must": [s.get("query") or {"match_all": {}}]}})
            parents = sub.df.filter(got.pred).withColumn("_score", got.score)
            key, mine = sub.col("_id"), self.col(f"{rel}.parent")
        found = parents.groupBy(key.alias("k")).agg(F.max("_score").alias("s"))
        if s.get("score"):
            flag = self._flag(mine, found, "k", {"s": F.col("s")})
            return Compiled(flag, F.coalesce(F.col(f"__flag{self.n_flags}_s"), F.lit(0.0)))
        return self.const(self._flag(mine, found, "k"))

    def q_parent_id(self, s):
        rel = self._join_field()
        return self.const((self.col(f"{rel}.name") == s["type"]) & (self.col(f"{rel}.parent") == str(s["id"])))

    def q_percolate(self, s):
        """Stored queries that match the given documents; see operators.percolate for whole tables."""
        from ..operators.percolate import matching_rules

        docs = s.get("documents") or [s["document"]]
        ids = matching_rules(self, s["field"], docs)
        return self.const(self.col("_id").isin(ids) if ids else F.lit(False))

    # -- geo, features, vectors ------------------------------------------------------------------------------------

    def q_geo_distance(self, s):
        name = next(k for k in s if k not in ("distance", "distance_type", "boost", "_name", "validation_method", "ignore_unmapped"))
        lat, lon = geo.point(s[name])
        return self.const(self.any_of(name, lambda c: geo.haversine(c, lat, lon) <= geo.meters(s["distance"])))

    def q_geo_bounding_box(self, s):
        name = next(k for k in s if k not in ("type", "boost", "_name", "validation_method", "ignore_unmapped"))
        return self.const(self.any_of(name, lambda c: geo.box(c, s[name])))

    def q_geo_polygon(self, s):
        name = next(k for k in s if k not in ("boost", "_name", "validation_method", "ignore_unmapped"))
        return self.const(self.any_of(name, lambda c: geo.polygon(c, s[name]["points"])))

    def q_geo_shape(self, s):
        name = next(k for k in s if k not in ("boost", "_name", "ignore_unmapped"))
        return self.const(self.any_of(name, lambda c: geo.shape(c, s[name]["shape"], s[name].get("relation", "intersects").lower())))

    q_xy_shape = q_geo_shape

    def distance_from(self, name: str, origin: Any) -> tuple[Column, Any]:
        """(distance column, converter of lengths in the same unit)."""
        if self.kind(name) == "geo_point":
            return geo.haversine(self.col(name), *geo.point(origin), radius=6_371_008.7714), geo.meters
        if self.kind(name) == "date":
            at = F.lit(dates.evaluate(origin, self.now))
            micros = lambda c: F.unix_micros(c.cast("timestamp")) / 1000.0
            return F.abs(micros(self.col(name)) - micros(at)), lambda v: dates.seconds(v) * 1000
        return F.abs(self.col(name).cast("double") - float(origin)), float

    def q_distance_feature(self, s):
        d, convert = self.distance_from(s["field"], s["origin"])
        pivot = float(convert(s["pivot"]))
        return Compiled(self.col(s["field"]).isNotNull(), pivot / (pivot + d))

    def q_rank_feature(self, s):
        name = s["field"]
        f = self.mapping.get(name)
        c = self.col(name)
        head, _, tail = name.rpartition(".")
        if head and self.kind(head) == "rank_features":
            c = F.try_element_at(self.col(head), F.lit(tail))
        positive = (f.options if f else {}).get("positive_score_impact", True)
        return Compiled(c.isNotNull(), scoring.rank_feature(c, s, positive))

    def q_script_score(self, s):
        q = self.compile(s["query"])
        v = self.script(s["script"], {"_score": q.score}).cast("double")
        return Compiled(q.pred & (v >= float(s["min_score"])) if "min_score" in s else q.pred, v)

    def q_function_score(self, s):
        q = self.compile(s.get("query"))
        specs = s.get("functions") or [{k: v for k, v in s.items() if k in ("weight", "field_value_factor", "random_score", "script_score", "gauss", "exp", "linear")}]
        parts = []
        for spec in specs:
            on = self.compile(spec["filter"]).pred if "filter" in spec else F.lit(True)
            w = float(spec.get("weight", 1))
            parts.append((on, self._function(spec, q.score) * w, w))
        value = scoring.combine(parts, s.get("score_mode", "multiply"))
        if "max_boost" in s:
            value = F.least(value, F.lit(float(s["max_boost"])))
        out = scoring.boosted(q.score, value, s.get("boost_mode", "multiply"))
        return Compiled(q.pred & (out >= float(s["min_score"])) if "min_score" in s else q.pred, out)

    def _function(self, spec: dict, score: Column) -> Column:
        if "field_value_factor" in spec:
            return scoring.value_factor(self.col(spec["field_value_factor"]["field"]), spec["field_value_factor"])
        if "script_score" in spec:
            return self.script(spec["script_score"]["script"], {"_score": score})
        if "random_score" in spec:
            o = spec["random_score"] or {}
            h = F.xxhash64(F.lit(o.get("seed", 0)), self.col(o.get("field", "_id")).cast("string"))
            return F.pmod(h, F.lit(1 << 24)) / float(1 << 24)
        for kind in ("gauss", "exp", "linear"):
            if kind in spec:
                name, o = next((k, v) for k, v in spec[kind].items() if k != "multi_value_mode")
                d, convert = self.distance_from(name, o.get("origin", "now"))
                out = scoring.decay(kind, d, convert(o["scale"]), convert(o.get("offset", 0) or 0) if o.get("offset") else 0, o.get("decay", 0.5))
                return F.coalesce(out, F.lit(1.0))
        return F.lit(1.0)

    def q_knn(self, s):
        name, o = _one(s, "vector")
        f = self.mapping.get(name)
        space = o.get("space_type") or ((f.options.get("method") or {}).get("space_type") or f.options.get("space_type") if f else None) or "l2"
        d = vectors.distance(self.col(name), F.array(*(F.lit(float(x)) for x in o["vector"])), space)
        pred = self.col(name).isNotNull()
        if "filter" in o:
            pred = pred & self.compile(o["filter"]).pred
        if "min_score" in o:
            return Compiled(pred & (d <= vectors.max_distance(float(o["min_score"]), space)), vectors.score(d, space))
        if "max_distance" in o:
            return Compiled(pred & (d <= float(o["max_distance"])), vectors.score(d, space))
        key = self.id_col or "_id"
        best = self.df.filter(pred).select(F.col(key).alias("k"), d.alias("d")).orderBy("d", "k").limit(int(o["k"]))
        return Compiled(self._flag(F.col(key), best.select("k"), "k"), vectors.score(d, space))


for _kind in ("span_term", "span_or", "span_near", "span_not", "span_first", "span_containing", "span_within", "span_multi", "field_masking_span", "span_field_masking"):
    setattr(QueryCompiler, f"q_{_kind}", (lambda k: lambda self, s: self._spanned({k: s}))(_kind))
QueryCompiler.q_bool_prefix = QueryCompiler.q_match_bool_prefix


def java_wildcard(pattern: str) -> str:
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out += "\\Q" + pattern[i] + "\\E"
        else:
            out += ".*" if c == "*" else "." if c == "?" else "\\Q" + c + "\\E"
        i += 1
    return out


def ip_text(ip: str) -> str:
    """Fixed-width text that sorts as addresses do; IPv4 is mapped into IPv6."""
    import ipaddress

    a = ipaddress.ip_address(ip)
    return f"{int(a) if a.version == 6 else (0xFFFF << 32) | int(a):032x}"


def cidr(text: str) -> tuple[str, str]:
    import ipaddress

    net = ipaddress.ip_network(text, strict=False)
    return ip_text(str(net[0])), ip_text(str(net[-1]))


def ip_key(c: Column) -> Column:
    """ip_text for IPv4 columns, and for IPv6 in full or compressed form."""
    four = F.split(c, "\\.")
    v4 = F.concat(F.lit("0" * 20 + "ffff"), *(F.lpad(F.lower(F.hex(F.try_element_at(four, F.lit(i)).try_cast("long"))), 2, "0") for i in range(1, 5)))
    halves = F.split(c, "::")
    group = lambda s: F.transform(F.filter(F.split(s, ":"), lambda g: g != ""), lambda g: F.lpad(F.lower(g), 4, "0"))
    left, right = group(F.try_element_at(halves, F.lit(1))), group(F.coalesce(F.try_element_at(halves, F.lit(2)), F.lit("")))
    v6 = F.concat(F.array_join(left, ""), F.repeat(F.lit("0000"), 8 - F.size(left) - F.size(right)), F.array_join(right, ""))
    return F.when(F.contains(c, F.lit(":")), v6).otherwise(v4)
