"""The query_string and simple_query_string mini-grammars, parsed to the JSON DSL."""

from __future__ import annotations

import re

_LEX = re.compile(r'\s*(?:(?P<phrase>"(?:\\.|[^"\\])*")(?:~(?P<slop>\d+))?|(?P<range>[\[{][^\]}]*\sTO\s[^\]}]*[\]}])|(?P<regex>/(?:\\.|[^/\\])*/)|(?P<op>\(|\)|&&|\|\||[+\-!|](?=\S))|(?P<field>[\w.*]+):(?=\S)|(?P<word>(?:\\.|[^\s()"|])+))(?:\^(?P<boost>[\d.]+))?')


def parse(text: str, fields: list[str], default: str, simple: bool, compiler) -> dict:
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            at += 1
            continue
        tokens.append(m)
        at = m.end()
    return _Parser(tokens, fields, default.lower(), simple, compiler).whole()


class _Parser:
    def __init__(self, tokens, fields, default, simple, compiler):
        self.t, self.fields, self.default, self.simple, self.c, self.i = tokens, fields, default, simple, compiler, 0

    def whole(self) -> dict:
        return self.group(self.fields) or {"match_all": {}}

    def op(self, *names: str) -> bool:
        if self.i < len(self.t) and (self.t[self.i]["op"] in names or (not self.simple and self.t[self.i]["word"] in names)):
            self.i += 1
            return True
        return False

    def group(self, fields: list[str]) -> dict | None:
        parts: list[tuple[str, dict]] = []  # occur, query
        joined = None
        while self.i < len(self.t):
            if self.t[self.i]["op"] == ")":
                self.i += 1
                break
            if self.op("AND", "&&") or (self.simple and self.op("+")):
                joined = "and"
                continue
            if self.op("OR", "||", "|"):
                joined = "or"
                continue
            occur = "must" if not self.simple and self.op("+") else "must_not" if self.op("-", "!", "NOT") else ""
            q = self.atom(fields)
            if q is None:
                continue
            if joined == "and":
                if parts and parts[-1][0] in ("", "should"):
                    parts[-1] = ("must", parts[-1][1])
                occur = occur or "must"
            elif joined == "or":
                if parts and parts[-1][0] == "":
                    parts[-1] = ("should", parts[-1][1])
                occur = occur or "should"
            parts.append((occur, q))
            joined = None
        if not parts:
            return None
        plain = "must" if self.default == "and" else "should"
        out: dict[str, list] = {}
        for occur, q in parts:
            out.setdefault(occur or plain, []).append(q)
        if len(parts) == 1 and parts[0][0] != "must_not":
            return parts[0][1]
        return {"bool": out}

    def atom(self, fields: list[str]) -> dict | None:
        m = self.t[self.i]
        self.i += 1
        if m["op"] == "(":
            return self.group(fields)
        if m["op"]:
            return None
        if m["field"]:
            name = m["field"]
            if self.i >= len(self.t):
                return None
            if name == "_exists_":
                word = self.t[self.i]["word"]
                self.i += 1
                return {"exists": {"field": word}}
            return self.atom(self.c.mapping.matching(name) if "*" in name else [name])
        each = [self.leaf(m, *(f.partition("^")[::2])) for f in fields]
        return each[0] if len(each) == 1 else {"dis_max": {"queries": each}}

    def leaf(self, m, field: str, field_boost: str) -> dict:
        boost = float(m["boost"] or 1) * float(field_boost or 1)
        if m["phrase"]:
            return {"match_phrase": {field: {"query": re.sub(r"\\(.)", r"\1", m["phrase"][1:-1]), "slop": int(m["slop"] or 0), "boost": boost}}}
        if m["range"]:
            text = m["range"]
            lo, hi = (x.strip() for x in text[1:-1].split(" TO "))
            spec = {"boost": boost}
            if lo != "*":
                spec["gte" if text[0] == "[" else "gt"] = lo
            if hi != "*":
                spec["lte" if text[-1] == "]" else "lt"] = hi
            return {"range": {field: spec}}
        if m["regex"]:
            return {"regexp": {field: {"value": m["regex"][1:-1], "boost": boost}}}
        word = m["word"]
        cmp = None if self.simple else re.match(r"(>=|<=|>|<)(.+)", word)
        if cmp:
            return {"range": {field: {{">=": "gte", "<=": "lte", ">": "gt", "<": "lt"}[cmp[1]]: cmp[2], "boost": boost}}}
        fuzzy = re.fullmatch(r"(.+?)~(\d?)", word)
        if fuzzy:
            return {"fuzzy": {field: {"value": fuzzy[1], "fuzziness": fuzzy[2] or "AUTO", "boost": boost}}}
        if "*" in word or (not self.simple and "?" in word):
            return {"exists": {"field": field}} if word == "*" else {"wildcard": {field: {"value": word, "boost": boost}}}
        return {"match": {field: {"query": re.sub(r"\\(.)", r"\1", word), "boost": boost}}}
