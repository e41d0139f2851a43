"""Mappings: field types of an index, inferred from a schema or from JSON samples."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = {"byte", "short", "integer", "long", "unsigned_long", "float", "half_float", "double", "scaled_float", "token_count", "rank_feature"}
TEXT = {"text", "match_only_text", "search_as_you_type", "annotated_text"}
RANGES = {f"{k}_range" for k in ("integer", "long", "float", "double", "date", "ip")}
SPARK = {
    "byte": T.ByteType(), "short": T.ShortType(), "integer": T.IntegerType(), "long": T.LongType(), "unsigned_long": T.DecimalType(20, 0),
    "float": T.FloatType(), "half_float": T.FloatType(), "double": T.DoubleType(), "scaled_float": T.DoubleType(), "boolean": T.BooleanType(),
    "date": T.TimestampType(), "date_nanos": T.LongType(), "token_count": T.IntegerType(), "rank_feature": T.FloatType(),
    "rank_features": T.MapType(T.StringType(), T.FloatType()), "knn_vector": T.ArrayType(T.FloatType()), "flat_object": T.MapType(T.StringType(), T.StringType()),
    "geo_point": T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]),
    "xy_point": T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]),
    "join": T.StructType([T.StructField("name", T.StringType()), T.StructField("parent", T.StringType())]),
    "completion": T.ArrayType(T.StringType()),
}
_BOUND = {"integer_range": T.IntegerType(), "long_range": T.LongType(), "float_range": T.FloatType(), "double_range": T.DoubleType(), "date_range": T.TimestampType(), "ip_range": T.StringType()}


@dataclass(frozen=True)
class FieldType:
    kind: str
    many: bool = False  # the field holds an array of values
    options: dict[str, Any] = field(default_factory=dict)
    properties: dict[str, FieldType] = field(default_factory=dict)


@dataclass
class Mapping:
    fields: dict[str, FieldType] = field(default_factory=dict)
    aliases: dict[str, str] = field(default_factory=dict)

    def resolve(self, name: str) -> str:
        return self.aliases.get(name, name)

    def get(self, name: str) -> FieldType | None:
        name = self.resolve(name)
        if name in self.fields:
            return self.fields[name]
        head, _, tail = name.rpartition(".")
        if not head:
            return None
        parent = self.get(head)
        if parent is None:
            return None
        if tail in parent.properties:
            return parent.properties[tail]
        return FieldType("keyword") if parent.kind == "flat_object" else None

    def kind(self, name: str) -> str | None:
        f = self.get(name)
        return f.kind if f else None

    def matching(self, pattern: str) -> list[str]:
        rx = re.compile(re.escape(pattern).replace(r"\*", ".*") + r"\Z")
        return [n for n in self.fields if rx.match(n)]


def from_spark(kind: T.DataType) -> FieldType:
    if isinstance(kind, T.ArrayType):
        inner = from_spark(kind.elementType)
        if isinstance(kind.elementType, (T.FloatType, T.DoubleType)):
            return FieldType("knn_vector")
        if inner.kind == "object":
            return FieldType("nested", True, {}, inner.properties)
        return FieldType(inner.kind, True, inner.options, inner.properties)
    if isinstance(kind, T.StructType):
        names = set(kind.names)
        if names == {"lat", "lon"}:
            return FieldType("geo_point")
        if names == {"gte", "lte"}:
            inner = from_spark(kind["gte"].dataType).kind
            return FieldType({"keyword": "ip_range"}.get(inner, f"{inner}_range"))
        return FieldType("object", False, {}, {f.name: from_spark(f.dataType) for f in kind})
    if isinstance(kind, T.MapType):
        return FieldType("rank_features" if isinstance(kind.valueType, (T.FloatType, T.DoubleType)) else "flat_object")
    simple = kind.simpleString()
    if simple.startswith("decimal"):
        return FieldType("double" if "," in simple and not simple.endswith(",0)") else "long")
    return FieldType({
        "tinyint": "byte", "smallint": "short", "int": "integer", "bigint": "long", "float": "float", "double": "double",
        "boolean": "boolean", "timestamp": "date", "timestamp_ntz": "date", "date": "date", "string": "keyword",
    }.get(simple, "keyword"))


def mapping_of(df: DataFrame, declared: dict[str, Any] | None = None) -> Mapping:
    """The mapping of a DataFrame's schema, overridden by a declaration in mapping JSON."""
    out = Mapping({f.name: from_spark(f.dataType) for f in df.schema})
    for name, spec in (declared or {}).items():
        if spec.get("type") == "alias":
            out.aliases[name] = spec["path"]
            continue
        had = out.fields.get(name, FieldType("object"))
        out.fields[name] = declare(spec, had)
    return out


def declare(spec: dict[str, Any], had: FieldType | None = None) -> FieldType:
    had = had or FieldType("object")
    props = {**had.properties, **{k: declare(v, had.properties.get(k)) for k, v in spec.get("properties", {}).items()}}
    props |= {k: declare(v) for k, v in spec.get("fields", {}).items()}
    kind = spec.get("type", "object" if "properties" in spec else had.kind)
    options = {k: v for k, v in spec.items() if k not in ("type", "properties", "fields")}
    return FieldType(kind, had.many or kind == "nested", options, props)


_DATE = re.compile(r"\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?)?\Z|\d{4}/\d{2}/\d{2}( \d{2}:\d{2}:\d{2})?( Z)?\Z")


def infer_value(v: Any) -> FieldType | None:
    """Type of one JSON value: fractions are float, whole numbers long, date-like strings date, other strings text."""
    if v is None:
        return None
    if isinstance(v, bool):
        return FieldType("boolean")
    if isinstance(v, int):
        return FieldType("long")
    if isinstance(v, float):
        return FieldType("float")
    if isinstance(v, str):
        return FieldType("date") if _DATE.match(v) else FieldType("text", False, {}, {"keyword": FieldType("keyword", False, {"ignore_above": 256})})
    if isinstance(v, list):
        inner = None
        for x in v:
            inner = merge(inner, infer_value(x))
        return FieldType(inner.kind, True, inner.options, inner.properties) if inner else None
    props: dict[str, FieldType] = {}
    for k, x in v.items():
        got = merge(props.get(k), infer_value(x))
        if got:
            props[k] = got
    return FieldType("object", False, {}, props)


_WIDER = {("long", "float"): "float", ("float", "long"): "float", ("date", "text"): "text", ("text", "date"): "text"}


def merge(a: FieldType | None, b: FieldType | None) -> FieldType | None:
    if a is None or b is None:
        return a or b
    kind = a.kind if a.kind == b.kind else _WIDER.get((a.kind, b.kind))
    if kind is None:
        raise ValueError(f"a field cannot be both {a.kind} and {b.kind}")
    props = dict(a.properties)
    for k, v in b.properties.items():
        props[k] = merge(props.get(k), v)
    return FieldType(kind, a.many or b.many, a.options, props)


def infer_mapping(lines: DataFrame, column: str = "value", sample: int = 10_000) -> Mapping:
    """Mapping of JSON documents, one to a row; `sample` rows are read, so later types may need a declaration."""
    whole = None
    for (line,) in lines.select(F.col(column)).limit(sample).toLocalIterator():
        whole = merge(whole, infer_value(json.loads(line)))
    return Mapping(dict(whole.properties) if whole else {})


def spark_type(f: FieldType) -> T.DataType:
    if f.kind in ("object", "nested"):
        inner: T.DataType = T.StructType([T.StructField(k, spark_type(v)) for k, v in f.properties.items()])
    elif f.kind in _BOUND:
        inner = T.StructType([T.StructField("gte", _BOUND[f.kind]), T.StructField("lte", _BOUND[f.kind])])
    else:
        inner = SPARK.get(f.kind, T.StringType())
    return T.ArrayType(inner) if f.many and f.kind not in ("knn_vector", "completion") else inner


def mapping_to_struct(m: Mapping) -> T.StructType:
    return T.StructType([T.StructField(k, spark_type(v)) for k, v in m.fields.items()])
