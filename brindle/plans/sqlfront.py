"""SQL and PPL front ends.

SQL is Spark's own parser over the registered views, with the search engine's defaults: a statement without grouping
and limit returns 200 rows, and full-text predicates `match(field, 'text')` and so on are compiled by the query DSL.
PPL is a pipe of commands, each applied in order to the DataFrame of the one before."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_ROWS = 200
_FULL_TEXT = re.compile(r"\b(match|matchquery|match_query|match_phrase|wildcard_query|regexp_query|query_string|simple_query_string|multi_match)\s*\(", re.I)
_GROUPED = re.compile(r"\b(group\s+by|(?:count|sum|avg|min|max|var_pop|var_samp|stddev_pop|stddev_samp|percentile|percentile_approx)\s*\()", re.I)


def _call(text: str, at: int) -> tuple[list[str], int]:
    """Arguments of the call whose parenthesis opens at `at`, and the position after it."""
    args, depth, quote, cur, i = [], 0, "", "", at
    while True:
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
            cur += c
        elif c in "'\"":
            quote = c
            cur += c
        elif c == "(":
            depth += 1
            cur += c if depth > 1 else ""
        elif c == ")":
            depth -= 1
            if not depth:
                return [*args, cur.strip()], i + 1
            cur += c
        elif c == "," and depth == 1:
            args.append(cur.strip())
            cur = ""
        else:
            cur += c
        i += 1


def _clause(fn: str, args: list[str]) -> dict:
    plain = [a.strip("'\"`") for a in args]
    options = dict(p.split("=", 1) for p in plain[2:] if "=" in p)
    options = {k.strip(): v.strip(" '\"") for k, v in options.items()}
    fn = fn.lower()
    if fn in ("query_string", "simple_query_string", "multi_match"):
        fields = [f.strip(" '\"") for f in plain[0].strip("[]").split(",")]
        return {fn: {"fields": fields, "query": plain[1], **options}}
    name = {"matchquery": "match", "match_query": "match", "wildcard_query": "wildcard", "regexp_query": "regexp"}.get(fn, fn)
    return {name: {plain[0]: {"value" if name in ("wildcard", "regexp") else "query": plain[1], **options}}}


def sql(engine, text: str) -> DataFrame:
    text = text.strip().rstrip(";")
    source = re.search(r"\bfrom\s+([\w.*-]+)", text, re.I)
    found = list(_FULL_TEXT.finditer(text)) if source else []
    if found:  # each full-text predicate becomes a flag column of a view
        ix = engine.index(source[1])
        c = engine.compiler(ix, scoring=False)
        flags, out, last = {}, "", 0
        for k, m in enumerate(found):
            args, end = _call(text, m.end() - 1)
            flags[f"__match{k}"] = c.compile(_clause(m[1], args)).pred
            out += text[last : m.start()] + f"__match{k}"
            last = end
        view = f"{source[1]}__matched"
        c.df.withColumns(flags).createOrReplaceTempView(view)
        text = re.sub(rf"\bfrom\s+{re.escape(source[1])}\b", f"FROM {view}", out + text[last:], count=1, flags=re.I)
    text = re.sub(r"\blimit\s+(\d+)\s*,\s*(\d+)", r"LIMIT \2 OFFSET \1", text, flags=re.I)
    df = engine.spark.sql(text)
    df = df.drop(*(c for c in df.columns if c.startswith("__match")))
    limited = re.search(r"\blimit\b|\b(union|intersect|except)\b", text, re.I)
    return df if limited or _GROUPED.search(text) else df.limit(DEFAULT_ROWS)


_AGG = re.compile(r"(\w+)\s*\(\s*([^)]*)\s*\)(?:\s+as\s+(\w+))?", re.I)


def _stage(df: DataFrame, engine, ix, stage: str) -> DataFrame:
    name, _, rest = stage.strip().partition(" ")
    name, rest = name.lower(), rest.strip()
    words = [w.strip() for w in rest.split(",") if w.strip()]
    if name == "where":
        return df.filter(rest)
    if name == "fields":
        if rest.startswith("-"):
            return df.drop(*(w.lstrip("- ") for w in words))
        return df.select(*(w.lstrip("+ ") for w in words))
    if name == "stats":
        parts = re.split(r"\bby\b", rest, flags=re.I)
        keys = [k.strip() for k in parts[1].split(",")] if len(parts) > 1 else []
        made = []
        for fn, arg, alias in _AGG.findall(parts[0]):
            fn, arg = fn.lower(), arg.strip()
            made.append(F.expr("count(1)" if fn == "count" and not arg else f"count(distinct {arg})" if fn in ("distinct_count", "dc") else f"{fn}({arg})").alias(alias or f"{fn}({arg})"))
        kept = df.dropna(subset=keys) if keys else df
        out = kept.groupBy(*keys).agg(*made)
        return out.select(*(c for c in out.columns if c not in keys), *keys)
    if name == "rename":
        for a, b in re.findall(r"(\w+)\s+as\s+(\w+)", rest, re.I):
            df = df.withColumnRenamed(a, b)
        return df
    if name in ("top", "rare"):
        m = re.match(r"(?:(\d+)\s+)?([\w., ]+?)(?:\s+by\s+([\w., ]+))?$", rest, re.I)
        keys = [k.strip() for k in m[2].split(",")]
        n = F.count(F.lit(1)).alias("count")
        return df.dropna(subset=keys).groupBy(*keys).agg(n).orderBy(F.desc("count") if name == "top" else F.asc("count"), *keys).limit(int(m[1] or 10)).select(*keys)
    if name == "sort":
        return df.orderBy(*(F.col(w.lstrip("+- ")).desc_nulls_last() if w.startswith("-") else F.col(w.lstrip("+ ")).asc_nulls_last() for w in words))
    if name == "head":
        return df.limit(int(rest or 10))
    if name == "dedup":
        return df.select(*words).distinct()
    if name == "eval":
        for m in re.finditer(r"(\w+)\s*=\s*((?:[^,()]|\([^()]*\))+)", rest):
            df = df.withColumn(m[1], F.expr(m[2].strip()))
        return df
    raise ValueError(f"unknown command [{name}]")


def ppl(engine, text: str) -> DataFrame:
    first, *rest = [s for s in re.split(r"\|(?=(?:[^']*'[^']*')*[^']*$)", text) if s.strip()]
    m = re.match(r"\s*(?:search\s+)?source\s*=\s*([\w.*-]+)\s*(.*)$", first, re.I | re.S)
    ix = engine.index(m[1])
    df = ix.df.filter(m[2]) if m[2].strip() else ix.df
    for stage in rest:
        df = _stage(df, engine, ix, stage)
    return df
