"""Script expressions compiled to columns.

The expression subset of the Java-like script language: literals, `doc['f'].value`, `params.x`, `ctx._source.f`,
`_score`, `_value`, arithmetic, comparison, logic, the conditional and elvis operators, Math.*, casts, and string and
list methods.  Division of whole numbers truncates, as in Java.  A leading `return` and a final `;` are allowed.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+\.\d*(?:[eE][+-]?\d+)?[fFdD]?|\d+[eE][+-]?\d+|\d+[lLfFdD]?)|(?P<str>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<id>[A-Za-z_]\w*)|(?P<op>\?:|\?\.|===|!==|==|!=|<=|>=|&&|\|\||<<|>>|[-+*/%<>!?:().,\[\]&|^~;]))""")
_MATH = {
    "abs": F.abs, "ceil": F.ceil, "floor": F.floor, "sqrt": F.sqrt, "cbrt": F.cbrt, "exp": F.exp, "expm1": F.expm1, "log": F.ln, "log10": F.log10, "log1p": F.log1p,
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "signum": F.signum,
    "rint": F.rint, "toRadians": F.radians, "toDegrees": F.degrees,
}
_MATH2 = {"pow": F.pow, "atan2": F.atan2, "hypot": F.hypot, "max": F.greatest, "min": F.least}


class Typed:
    """A column that may be known to be whole, for integer division and string `+`."""

    def __init__(self, col: Column, kind: str = "any"):
        self.col, self.kind = col, kind


class Script:
    """Compiles one source against field columns, parameters and bindings such as `_score`."""

    def __init__(self, source: str, field, params: dict[str, Any] | None = None, bound: dict[str, Column] | None = None, kinds=None):
        self.field, self.params, self.bound, self.kinds = field, params or {}, bound or {}, kinds or (lambda name: "any")
        self.tokens, at = [], 0
        source = re.sub(r"^\s*return\b", "", source.strip()).rstrip("; \n")
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise ValueError(f"cannot read script at {source[at:at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.tokens.append(("end", ""))
        self.i = 0

    def column(self) -> Column:
        out = self.ternary()
        if self.tokens[self.i][0] != "end":
            raise ValueError(f"script statements are not expressions: {self.tokens[self.i][1]!r}")
        return out.col

    def peek(self) -> str:
        return self.tokens[self.i][1] if self.tokens[self.i][0] in ("op", "id") else ""

    def take(self, *ops: str) -> str | None:
        if self.tokens[self.i][0] in ("op", "id") and self.tokens[self.i][1] in ops:
            self.i += 1
            return self.tokens[self.i - 1][1]
        return None

    def need(self, op: str) -> None:
        if not self.take(op):
            raise ValueError(f"script: {op!r} expected, found {self.tokens[self.i][1]!r}")

    def ternary(self) -> Typed:
        cond = self.binary(0)
        if self.take("?:"):
            other = self.ternary()
            return Typed(F.coalesce(cond.col, other.col), cond.kind)
        if self.take("?"):
            a = self.ternary()
            self.need(":")
            b = self.ternary()
            return Typed(F.when(cond.col, a.col).otherwise(b.col), a.kind if a.kind == b.kind else "any")
        return cond

    LEVELS = (("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!=", "===", "!=="), ("<", ">", "<=", ">=", "instanceof"), ("+", "-"), ("*", "/", "%"))

    def binary(self, level: int) -> Typed:
        if level == len(self.LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while op := self.take(*self.LEVELS[level]):
            right = self.binary(level + 1)
            left = self.apply(op, left, right)
        return left

    def apply(self, op: str, x: Typed, y: Typed) -> Typed:
        a, b, whole = x.col, y.col, x.kind == y.kind == "int"
        if op in ("==", "==="):
            return Typed(a.eqNullSafe(b), "bool")
        if op in ("!=", "!=="):
            return Typed(~a.eqNullSafe(b), "bool")
        if op == "+" and "str" in (x.kind, y.kind):
            return Typed(F.concat(F.coalesce(a.cast("string"), F.lit("null")), F.coalesce(b.cast("string"), F.lit("null"))), "str")
        if op in ("/", "%"):
            if whole:
                return Typed(F.when(b == 0, None).otherwise((F.signum(a) * F.signum(b) * F.floor(F.abs(a) / F.abs(b))).cast("long")), "int") if op == "/" else Typed(F.try_mod(a, b), "int")
            return Typed(F.try_divide(a.cast("double"), b.cast("double")) if op == "/" else F.try_mod(a, b), "num")
        f = {
            "||": lambda: a | b, "&&": lambda: a & b, "|": lambda: a.bitwiseOR(b), "^": lambda: a.bitwiseXOR(b), "&": lambda: a.bitwiseAND(b),
            "<": lambda: a < b, ">": lambda: a > b, "<=": lambda: a <= b, ">=": lambda: a >= b, "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b,
        }[op]
        return Typed(f(), "bool" if op in ("||", "&&", "<", ">", "<=", ">=") else "int" if whole else "num")

    def unary(self) -> Typed:
        if self.take("!"):
            return Typed(~self.unary().col, "bool")
        if self.take("-"):
            x = self.unary()
            return Typed(-x.col, x.kind)
        if self.take("+"):
            return self.unary()
        if self.peek() == "(" and self.tokens[self.i + 1][1] in ("int", "long", "double", "float", "boolean", "String") and self.tokens[self.i + 2][1] == ")":
            kind = self.tokens[self.i + 1][1]
            self.i += 3
            x = self.unary()
            if kind in ("int", "long"):
                return Typed(x.col.cast(kind), "int")
            return Typed(x.col.cast("string" if kind == "String" else kind), "str" if kind == "String" else "num")
        return self.postfix()

    def args(self) -> list[Typed]:
        out = []
        if not self.take(")"):
            out.append(self.ternary())
            while self.take(","):
                out.append(self.ternary())
            self.need(")")
        return out

    def literal(self, v: Any) -> Typed:
        if isinstance(v, list):
            return Typed(F.array(*map(F.lit, v)), "list")
        kind = "bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "num" if isinstance(v, float) else "str" if isinstance(v, str) else "any"
        return Typed(F.lit(v), kind)

    def postfix(self) -> Typed:
        kind, text = self.tokens[self.i]
        self.i += 1
        if kind == "num":
            plain = text.rstrip("lLfFdD")
            return Typed(F.lit(float(plain)), "num") if any(c in text for c in ".eEfFdD") else Typed(F.lit(int(plain)), "int")
        if kind == "str":
            x = Typed(F.lit(re.sub(r"\\(.)", r"\1", text[1:-1])), "str")
        elif text == "(":
            x = self.ternary()
            self.need(")")
        elif text == "[":
            items = []
            while not self.take("]"):
                items.append(self.ternary())
                self.take(",")
            x = Typed(F.array(*(i.col for i in items)), "list")
        elif text in ("true", "false", "null"):
            return self.literal({"true": True, "false": False, "null": None}[text])
        elif text == "Math":
            self.need(".")
            return self.math()
        elif text in ("Integer", "Long", "Double", "Float", "String", "Boolean"):
            self.need(".")
            name = self.tokens[self.i][1]
            self.i += 1
            self.need("(")
            a = self.args()
            to = {"parseInt": "int", "parseLong": "long", "parseDouble": "double", "parseFloat": "float", "valueOf": "string" if text == "String" else text.lower().replace("integer", "int"), "toString": "string", "parseBoolean": "boolean"}
            if name in to:
                return Typed(a[0].col.try_cast(to[name]), "str" if to[name] == "string" else "int" if to[name] in ("int", "long") else "num")
            return Typed({"max": F.greatest, "min": F.least}[name](a[0].col, a[1].col), a[0].kind) if name in ("max", "min") else Typed({"sum": lambda p, q: p + q}[name](a[0].col, a[1].col), a[0].kind)
        elif text == "doc":
            x = self.document()
        elif text == "ctx":
            path = []
            while self.take(".", "?."):
                path.append(self.tokens[self.i][1])
                self.i += 1
            path = [p for p in path if p != "_source"]
            x = Typed(self.field(".".join(path)), self.kinds(".".join(path)))
        elif text == "params":
            if self.take("["):
                name = self.tokens[self.i][1].strip("'\"")
                self.i += 1
                self.need("]")
            else:
                self.need(".")
                name = self.tokens[self.i][1]
                self.i += 1
            v = self.bound.get(f"params.{name}")
            x = Typed(v, "num") if v is not None else self.literal(self.params[name])
        elif text in self.bound:
            x = Typed(self.bound[text], "num")
        elif kind == "id" and self.peek() == "(":
            self.i += 1
            return self.helper(text, self.args())
        elif kind == "id":
            x = Typed(self.field(text), self.kinds(text))
        else:
            raise ValueError(f"script: unexpected {text!r}")
        while True:
            if self.take("."):
                name = self.tokens[self.i][1]
                self.i += 1
                if self.take("("):
                    x = self.method(x, name, self.args())
                elif name in ("length",):
                    x = Typed(F.size(x.col), "int")
                else:
                    x = Typed(x.col.getField(name))
            elif self.take("["):
                i = self.ternary()
                self.need("]")
                x = Typed(F.try_element_at(x.col, (i.col + 1).cast("int")) if x.kind == "list" else x.col[i.col])
            else:
                return x

    def document(self) -> Typed:
        self.need("[")
        name = self.tokens[self.i][1].strip("'\"")
        self.i += 1
        self.need("]")
        col, kind = self.field(name), self.kinds(name)
        if not self.take("."):
            return Typed(col, kind)
        what = self.tokens[self.i][1]
        self.i += 1
        if what == "value":
            return Typed(F.try_element_at(col, F.lit(1)) if kind == "list" else col, kind)
        if what in ("empty", "isEmpty"):
            if self.take("("):
                self.need(")")
            return Typed(col.isNull(), "bool")
        if what in ("size", "length"):
            if self.take("("):
                self.need(")")
            return Typed(F.size(col) if kind == "list" else F.when(col.isNull(), 0).otherwise(1), "int")
        if what == "values":
            return Typed(col, "list")
        return Typed(col.getField(what), "num")

    def math(self) -> Typed:
        name = self.tokens[self.i][1]
        self.i += 1
        if name in ("PI", "E"):
            return Typed(F.lit({"PI": 3.141592653589793, "E": 2.718281828459045}[name]), "num")
        self.need("(")
        a = self.args()
        if name == "round":
            return Typed(F.floor(a[0].col + 0.5).cast("long"), "int")
        if name in ("floorDiv", "floorMod"):
            d = F.floor(a[0].col / a[1].col)
            return Typed(d if name == "floorDiv" else a[0].col - d * a[1].col, "int")
        if name in _MATH:
            out = _MATH[name](a[0].col)
            return Typed(out if name in ("abs",) else out.cast("double"), a[0].kind if name == "abs" else "num")
        return Typed(_MATH2[name](a[0].col, a[1].col), a[0].kind if a[0].kind == a[1].kind and name in ("max", "min") else "num")

    def helper(self, name: str, a: list[Typed]) -> Typed:
        from . import scoring, vectors

        c = [x.col for x in a]
        if name in ("cosineSimilarity", "l2Squared", "l1Norm", "dotProduct"):
            f = {"cosineSimilarity": lambda u, v: 1 - vectors.distance(u, v, "cosine"), "l2Squared": lambda u, v: vectors.distance(u, v, "l2"), "l1Norm": lambda u, v: vectors.distance(u, v, "l1"), "dotProduct": vectors.dot}[name]
            return Typed(f(c[1], c[0]), "num")
        m = re.fullmatch(r"decayNumeric(Gauss|Exp|Linear)", name)
        if m:
            return Typed(scoring.decay(m[1].lower(), F.abs(c[4] - c[0]), c[1], c[2], c[3]), "num")
        if name == "saturation":
            return Typed(c[0] / (c[0] + c[1]), "num")
        if name == "sigmoid":
            return Typed(F.pow(c[0], c[2]) / (F.pow(c[1], c[2]) + F.pow(c[0], c[2])), "num")
        raise ValueError(f"unknown script function {name!r}")

    def method(self, x: Typed, name: str, a: list[Typed]) -> Typed:
        c, p = x.col, [y.col for y in a]
        strings = {
            "length": lambda: (F.length(c), "int"), "toUpperCase": lambda: (F.upper(c), "str"), "toLowerCase": lambda: (F.lower(c), "str"), "trim": lambda: (F.trim(c), "str"),
            "startsWith": lambda: (F.startswith(c, p[0]), "bool"), "endsWith": lambda: (F.endswith(c, p[0]), "bool"), "indexOf": lambda: (F.instr(c, p[0]) - 1, "int"),
            "substring": lambda: (F.substring(c, p[0] + 1, (p[1] - p[0]) if len(p) > 1 else F.length(c)), "str"), "charAt": lambda: (F.substring(c, p[0] + 1, F.lit(1)), "str"),
            "replace": lambda: (F.replace(c, p[0], p[1]), "str"), "concat": lambda: (F.concat(c, p[0]), "str"), "equals": lambda: (c.eqNullSafe(p[0]), "bool"),
            "equalsIgnoreCase": lambda: (F.lower(c) == F.lower(p[0]), "bool"), "isBlank": lambda: (F.trim(c) == "", "bool"), "repeat": lambda: (F.repeat(c, p[0]), "str"),
            "splitOnToken": lambda: (F.split(c, F.concat(F.lit("\\Q"), p[0], F.lit("\\E"))), "list"), "compareTo": lambda: (F.when(c < p[0], -1).when(c > p[0], 1).otherwise(0), "int"),
            "sha1": lambda: (F.sha1(c), "str"), "sha256": lambda: (F.sha2(c, 256), "str"), "encodeBase64": lambda: (F.base64(c.cast("binary")), "str"), "decodeBase64": lambda: (F.unbase64(c).cast("string"), "str"),
            "toString": lambda: (c.cast("string"), "str"), "isNaN": lambda: (F.isnan(c), "bool"), "intValue": lambda: (c.cast("int"), "int"), "doubleValue": lambda: (c.cast("double"), "num"),
        }
        lists = {
            "size": lambda: (F.size(c), "int"), "get": lambda: (F.try_element_at(c, (p[0] + 1).cast("int")), "any"), "contains": lambda: (F.array_contains(c, p[0]), "bool"), "isEmpty": lambda: (F.size(c) <= 0, "bool"),
            "sum": lambda: (F.aggregate(c, F.lit(0.0), lambda s, v: s + v.cast("double")), "num"), "max": lambda: (F.array_max(c), "any"), "min": lambda: (F.array_min(c), "any"), "sort": lambda: (F.array_sort(c), "list"),
            "reverse": lambda: (F.reverse(c), "list"), "join": lambda: (F.array_join(c, a[0].col), "str"), "unique": lambda: (F.array_distinct(c), "list"), "indexOf": lambda: (F.array_position(c, p[0]) - 1, "int"),
        }
        dates = {
            "getYear": F.year, "getMonthValue": F.month, "getDayOfMonth": F.dayofmonth, "getDayOfYear": F.dayofyear, "getHour": F.hour, "getMinute": F.minute, "getSecond": F.second,
            "getDayOfWeek": lambda t: F.weekday(t) + 1, "toEpochMilli": F.unix_millis, "toEpochSecond": F.unix_seconds,
        }
        if name in dates:
            return Typed(dates[name](c.cast("timestamp")), "int")
        table = lists if x.kind == "list" and name in lists else strings
        if name == "contains" and x.kind != "list":
            return Typed(F.contains(c, p[0]), "bool")
        if name == "isEmpty" and x.kind != "list":
            return Typed(F.length(c) == 0, "bool")
        if name not in table:
            table = lists
        if name not in table:
            raise ValueError(f"unknown script method {name!r}")
        col, kind = table[name]()
        return Typed(col, kind)
