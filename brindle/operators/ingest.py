"""Ingest processors: stateless DataFrame transforms, the same for batch and streams."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.analysis import char_filter

#: fixed values: the common named patterns
PATTERNS = {
    "WORD": r"\b\w+\b", "NOTSPACE": r"\S+", "SPACE": r"\s*", "DATA": r".*?", "GREEDYDATA": r".*", "INT": r"[+-]?\d+", "NUMBER": r"[+-]?\d+(?:\.\d+)?", "POSINT": r"[1-9]\d*",
    "IP": r"\d{1,3}(?:\.\d{1,3}){3}", "HOSTNAME": r"[A-Za-z0-9][A-Za-z0-9.-]*", "USERNAME": r"[A-Za-z0-9._-]+", "USER": r"[A-Za-z0-9._-]+", "QS": r'"(?:[^"\\]|\\.)*"',
    "URIPROTO": r"[A-Za-z][A-Za-z0-9+.-]*", "URIHOST": r"[A-Za-z0-9.-]+(?::\d+)?", "URIPATH": r"(?:/[^\s?#]*)+", "URIPARAM": r"\?\S*", "LOGLEVEL": r"(?i:trace|debug|info|warn(?:ing)?|error|fatal)",
    "TIMESTAMP_ISO8601": r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?", "HTTPDATE": r"\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4}", "UUID": r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",
}
_CASTS = {"integer": "int", "long": "long", "float": "float", "double": "double", "string": "string", "boolean": "boolean"}
_BYTES = {"b": 0, "kb": 1, "mb": 2, "gb": 3, "tb": 4, "pb": 5}


def grok_regex(pattern: str, own: dict[str, str] | None = None) -> tuple[str, list[tuple[str, str]]]:
    """A regex with one group for each named part, and the parts' names and types."""
    bank, fields = {**PATTERNS, **(own or {})}, []

    def put(m: re.Match) -> str:
        body = re.sub(r"%\{(\w+)\}", put, bank[m[1]])
        body = re.sub(r"\((?!\?)", "(?:", body)
        if m.lastindex and m.lastindex > 1 and m[2]:
            name, _, kind = m[2].partition(":")
            fields.append((name, kind))
            return f"({body})"
        return f"(?:{body})"

    return re.sub(r"%\{(\w+)(?::([\w.@:]+))?\}", put, pattern), fields


def dissect_regex(pattern: str) -> tuple[str, list[str]]:
    names, out, last = [], "", 0
    for m in re.finditer(r"%\{([^}]*)\}", pattern):
        out += "\\Q" + pattern[last : m.start()] + "\\E" if m.start() > last else ""
        key = m[1]
        skip, pad = key.startswith("?") or not key.strip("->"), "->" in key
        out += ("(?:.*?)" if skip else "(.*?)") + (r"\s*" if pad else "")
        if not skip:
            names.append(key.replace("->", "").lstrip("+"))
        last = m.end()
    return f"(?s)^{out}" + ("\\Q" + pattern[last:] + "\\E" if last < len(pattern) else "") + "$", names


def bytes_of(c: Column) -> Column:
    n, unit = F.regexp_extract(c, r"^\s*([\d.]+)", 1).cast("double"), F.lower(F.regexp_extract(c, r"([A-Za-z]+)\s*$", 1))
    power = F.coalesce(*(F.when(unit == k, F.lit(float(1024**v))) for k, v in _BYTES.items()))
    return (n * power).cast("long")


def chunks(c: Column, limit: int, overlap: float = 0.0, most: int = -1) -> Column:
    """Runs of `limit` words; the last allowed chunk takes the remainder."""
    tokens = F.filter(F.split(c, r"\s+"), lambda t: t != "")
    step = max(1, limit - int(limit * overlap))
    starts = F.when(F.size(tokens) > 0, F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(tokens) - int(limit * overlap)), F.lit(step))).otherwise(F.array().cast("array<int>"))
    if most > 0:
        starts = F.slice(starts, 1, most)
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, F.when(i == starts[most - 1], F.size(tokens)).otherwise(limit) if most > 0 else F.lit(limit)), " "))


def apply(df: DataFrame, processors: list[dict[str, Any]]) -> DataFrame:
    """Each processor in turn.  `if` is a script; rows for which it is not true keep their values.

    A row fails a processor if its field is null (without `ignore_missing`), or if a value cannot be converted, parsed
    or matched.  With `ignore_failure` or `on_failure` such a row keeps its values, and the latter's processors run on
    it; otherwise the result is null.  `fail` raises unless it is caught."""
    for p in processors:
        (kind, s), = p.items()
        df = _conditional(df, kind, s)
    return df


def _conditional(df: DataFrame, kind: str, s: dict) -> DataFrame:
    on, caught = F.lit(True), "on_failure" in s or s.get("ignore_failure", False)
    if "if" in s:
        from ..functions.script import Script

        on = F.coalesce(Script(s["if"], F.col).column(), F.lit(False))
    if kind == "drop":
        return df.filter(~on) if "if" in s else df.limit(0)
    if kind == "fail":
        if caught:
            return where(df, on, lambda d: apply(d, s.get("on_failure", [])))
        return df.filter(F.when(on, F.raise_error(F.lit(s["message"])).cast("boolean")).otherwise(F.lit(True)))
    if not caught:
        return where(df, on, lambda d: _one(d, kind, s)) if "if" in s else _one(df, kind, s)
    mark = next(f"__failed{i}" for i in range(len(df.columns) + 1) if f"__failed{i}" not in df.columns)
    df = df.withColumn(mark, on & _fails(df, kind, s))
    df = where(df, on & ~F.col(mark), lambda d: _one(d, kind, s))
    return where(df, F.col(mark), lambda d: apply(d, s.get("on_failure", []))).drop(mark)


def _fails(df: DataFrame, kind: str, s: dict) -> Column:
    """Rows that the processor cannot do."""
    f = s.get("field", s.get("source_field"))
    if not isinstance(f, str) or kind in ("set", "append", "remove", "script", "pipeline"):
        return F.lit(False)
    if f not in df.columns:
        return F.lit(not s.get("ignore_missing", False))
    missing = F.lit(False) if s.get("ignore_missing") else F.col(f).isNull()
    if kind in ("convert", "date", "json"):
        return missing | (F.col(f).isNotNull() & _SIMPLE[kind](F.col(f), s).isNull())
    if kind == "grok":
        hits = [F.col(f).rlike(grok_regex(p, s.get("pattern_definitions"))[0]) for p in s["patterns"]]
        return missing | ~F.coalesce(F.greatest(*hits) if len(hits) > 1 else hits[0], F.lit(True))
    if kind == "dissect":
        return missing | ~F.coalesce(F.col(f).rlike(dissect_regex(s["pattern"])[0]), F.lit(True))
    return missing


def where(df: DataFrame, on: Column, step) -> DataFrame:
    """`step` applied to the rows for which `on` holds; in the others every column keeps its value.

    Columns that the step adds are null in the others, and columns that it removes are null in its own rows."""
    names, p = df.columns, "__"
    while any(c.startswith(f"{p}was_") for c in names):
        p += "_"
    new = step(df.withColumns({f"{p}on": on, **{f"{p}was_{c}": F.col(c) for c in names}}))
    held, kinds, out = F.col(f"{p}on"), dict(new.dtypes), []
    for c in [*names, *(c for c in new.columns if c not in names and not c.startswith((f"{p}was_", f"{p}on")))]:
        was = F.col(f"{p}was_{c}") if c in names else None
        if c not in new.columns:
            out.append(F.when(~held, was).alias(c))
        elif was is None:
            out.append(F.when(held, F.col(c)).alias(c))
        elif kinds[c] != kinds[f"{p}was_{c}"] and "void" not in (kinds[c], kinds[f"{p}was_{c}"]):
            raise ValueError(f"a conditional processor may not change the type of [{c}] from {kinds[f'{p}was_{c}']} to {kinds[c]}; give it a target_field")
        else:
            out.append(F.when(held, F.col(c)).otherwise(was).alias(c))
    return new.select(*out)


_SIMPLE = {
    "lowercase": lambda c, s: F.lower(c), "uppercase": lambda c, s: F.upper(c), "trim": lambda c, s: F.trim(c), "urldecode": lambda c, s: F.url_decode(c),
    "html_strip": lambda c, s: char_filter("html_strip", c, {}), "bytes": lambda c, s: bytes_of(c), "split": lambda c, s: F.split(c, s["separator"]),
    "join": lambda c, s: F.array_join(c, s["separator"]), "sort": lambda c, s: F.sort_array(c, s.get("order", "asc") == "asc"), "gsub": lambda c, s: F.regexp_replace(c, s["pattern"], s["replacement"]),
    "convert": lambda c, s: c.try_cast(_CASTS[s["type"]]) if s["type"] in _CASTS else c, "kv": lambda c, s: F.str_to_map(c, F.lit(s["field_split"]), F.lit(s["value_split"])),
    "json": lambda c, s: F.from_json(c, s["schema"]) if "schema" in s else F.try_parse_json(c), "text_chunking": lambda c, s: chunks(c, s["token_limit"], s.get("overlap_rate", 0), s.get("max_chunk_limit", -1)),
    "date": lambda c, s: F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in s["formats"])),
}


def _one(df: DataFrame, kind: str, s: dict) -> DataFrame:
    f = s.get("field")
    if kind in _SIMPLE:
        return df.withColumn(s.get("target_field", "@timestamp" if kind == "date" else f), _SIMPLE[kind](F.col(f), s))
    if kind == "set":
        v = F.col(s["copy_from"]) if "copy_from" in s else F.lit(s["value"])
        return df if f in df.columns and s.get("override") is False else df.withColumn(f, v)
    if kind == "dot_expander":
        head, *rest = f.split(".")
        value = F.col(f"`{f}`")
        for part in reversed(rest):
            value = F.struct(value.alias(part))
        return df.withColumn(head, value).drop(f)
    if kind == "append":
        return df.withColumn(f, F.concat(F.col(f), F.array(*map(F.lit, s["value"] if isinstance(s["value"], list) else [s["value"]]))))
    if kind == "rename":
        return df.withColumnRenamed(f, s["target_field"])
    if kind == "copy":
        return df.withColumn(s["target_field"], F.col(s["source_field"]))
    if kind == "remove":
        return df.drop(*(f if isinstance(f, list) else [f]))
    if kind == "remove_by_pattern":
        rx = [re.compile(re.escape(p).replace(r"\*", ".*") + r"\Z") for p in s["field_pattern"]]
        return df.drop(*(c for c in df.columns if not c.startswith("__") and any(r.match(c) for r in rx)))
    if kind == "csv":
        parts = F.split(F.col(f), re.escape(s.get("separator", ",")), -1)
        return df.withColumns({t: F.try_element_at(parts, F.lit(i + 1)) for i, t in enumerate(s["target_fields"])})
    if kind == "split_to_fields":
        parts = F.split(F.col(f), s["separator"])
        return df.withColumns({t: F.try_element_at(parts, F.lit(i + 1)) for i, t in enumerate(s["target_fields"])})
    if kind == "grok":
        out: dict[str, Column] = {}
        for pattern in reversed(s["patterns"]):
            rx, names = grok_regex(pattern, s.get("pattern_definitions"))
            hit = F.col(f).rlike(rx)
            for i, (n, t) in enumerate(names):
                v = F.regexp_extract(F.col(f), rx, i + 1)
                v = v.try_cast({"int": "int", "long": "long", "float": "float", "double": "double", "boolean": "boolean"}[t]) if t else v
                out[n] = F.when(hit, v).otherwise(out[n]) if n in out else F.when(hit, v)
        return df.withColumns(out)
    if kind == "dissect":
        rx, names = dissect_regex(s["pattern"])
        return df.withColumns({n: F.when(F.col(f).rlike(rx), F.regexp_extract(F.col(f), rx, i + 1)) for i, n in enumerate(names)})
    if kind == "date_index_name":
        t = F.coalesce(*(F.try_to_timestamp(F.col(f), F.lit(x)) for x in s.get("date_formats", ["yyyy-MM-dd'T'HH:mm:ss"])))
        unit = {"y": "year", "M": "month", "w": "week", "d": "day", "h": "hour"}[s["date_rounding"]]
        return df.withColumn("_index", F.concat(F.lit(s.get("index_name_prefix", "")), F.date_format(F.date_trunc(unit, t), s.get("index_name_format", "yyyy-MM-dd"))))
    if kind == "fingerprint":
        fields = s.get("fields", [c for c in df.columns if not c.startswith("__")])
        text = F.concat(*(F.concat(F.lit(f"|{n}|"), F.coalesce(F.col(n).cast("string"), F.lit(""))) for n in sorted(fields)), F.lit("|"))
        how = s.get("hash_method", "SHA-1@2.16.0").split("@")[0]
        h = {"MD5": lambda: F.md5(text), "SHA-1": lambda: F.sha1(text), "SHA-256": lambda: F.sha2(text, 256)}[how]()
        return df.withColumn(s.get("target_field", "fingerprint"), h)
    if kind == "user_agent":
        c = F.col(f)
        name = F.regexp_extract(c, r"(Firefox|Edg|Chrome|Safari|curl|bot)", 1)
        return df.withColumn(s.get("target_field", "user_agent"), F.struct(F.when(name != "", name).otherwise("Other").alias("name"), F.regexp_extract(c, r"(?:Firefox|Edg|Chrome|Version|curl)/([\d.]+)", 1).alias("version")))
    if kind == "script":
        from ..functions.script import Script

        m = re.fullmatch(r"\s*ctx\.(\w+)\s*=\s*(.*?);?\s*", s["source"], re.S)
        return df.withColumn(m[1], Script(m[2], F.col, s.get("params")).column())
    if kind == "foreach":
        (inner, o), = s["processor"].items()
        return df.withColumn(f, F.transform(F.col(f), lambda x: _SIMPLE[inner](x, o)))
    if kind == "pipeline":
        return apply(df, s["processors"])
    raise ValueError(f"unknown processor [{kind}]")
