"""Position queries: phrases with slop, spans and intervals, over token arrays.

A plan is plain JSON, evaluated for each document in an Arrow-batched UDF; it yields a frequency, so 0 is no match.
Each operator returns sorted (start, end) pairs, ends exclusive.  Python gets the places of a plan's terms and prefixes,
found in the JVM, and the tokens only for patterns and fuzzy terms; it unpacks one document of a batch at a time.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Sequence
from itertools import accumulate
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .analysis import once

Span = tuple[int, int]


def osa(a: str, b: str, limit: int) -> int:
    """Edit distance with transpositions of neighbours; anything over `limit` is limit + 1."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if two is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        two, one = one, row
    return min(one[-1], limit + 1)


def fuzzy_edits(fuzziness: Any, term: str) -> int:
    text = str(fuzziness)
    if text.upper().startswith("AUTO"):
        low, high = (int(x) for x in text[5:].split(",")) if ":" in text else (3, 6)
        return 0 if len(term) < low else 1 if len(term) < high else 2
    return min(2, int(float(text)))


def wildcard_regex(pattern: str) -> str:
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += ".*" if c == "*" else "." if c == "?" else re.escape(c)
        i += 1
    return out


def _matcher(kind: str, plan: dict):
    v = plan["value"]
    if kind == "prefix":
        return lambda t: t.startswith(v)
    if kind in ("wildcard", "regexp"):
        rx = re.compile(wildcard_regex(v) if kind == "wildcard" else v)
        return lambda t: rx.fullmatch(t) is not None
    if kind == "fuzzy":
        d, head = fuzzy_edits(plan.get("fuzziness", "AUTO"), v), v[: plan.get("prefix_length", 0)]
        return lambda t: t.startswith(head) and osa(t, v, d) <= d
    return lambda t: t == v


def _near(parts: list[list[Span]], slop: int, ordered: bool) -> list[Span]:
    """Spans that take one of each part with at most `slop` positions between; parts do not overlap."""
    found: set[Span] = set()
    starts = [[s for s, _ in p] for p in parts]
    widths = [max((e - s for s, e in p), default=0) for p in parts]

    def go(i: int, used: list[Span]) -> None:
        if i == len(parts):
            lo, hi = min(s for s, _ in used), max(e for _, e in used)
            if hi - lo - sum(e - s for s, e in used) <= slop:
                found.add((lo, hi))
            return
        first = 0
        if used:  # of the part, only what is near enough to the spans used
            low, high, taken = min(a for a, _ in used), max(b for _, b in used), sum(b - a for a, b in used)
            limit = slop + sum(max(0, p[0][1] - p[0][0]) for p in parts[i + 1 :] if p)
            first = bisect_left(starts[i], used[-1][1] if ordered else high - widths[i] - taken - limit)
        for s, e in parts[i][first:] if not used else _until(parts[i], starts[i], first, low + taken + limit):
            if not ordered and any(s < b and a < e for a, b in used):
                continue
            if used and max(e, high) - min(s, low) - taken - (e - s) > limit:
                continue
            go(i + 1, [*used, (s, e)])

    if all(parts):
        go(0, [])
    return sorted(found)


def _until(spans: list[Span], starts: list[int], first: int, last: int):
    """Spans from number `first` on that start at `last` at the latest."""
    for k in range(first, len(spans)):
        if starts[k] > last:
            return
        yield spans[k]


def _minimal(spans: list[Span]) -> list[Span]:
    """Drop spans that contain another."""
    out: list[Span] = []
    for s, e in sorted(set(spans), key=lambda x: (x[1], -x[0])):
        if not out or s > out[-1][0]:
            out.append((s, e))
    return sorted(out)


def evaluate(plan: dict, tokens: Sequence[str], places: Sequence[list[int]] = ()) -> list[Span]:
    """Spans of a plan; `places` are those of the leaves that `located` took out of it."""
    (kind, p), = plan.items()
    if kind == "at":
        return [(i, i + 1) for i in places[p]]
    if kind in ("term", "prefix", "wildcard", "regexp", "fuzzy"):
        ok = _matcher(kind, p)
        return [(i, i + 1) for i, t in enumerate(tokens) if ok(t)]
    if kind == "or":
        return sorted({s for c in p["clauses"] for s in evaluate(c, tokens, places)})
    if kind == "near":
        return _near([evaluate(c, tokens, places) for c in p["clauses"]], p["slop"], p["ordered"])
    if kind == "first":
        return [(s, e) for s, e in evaluate(p["match"], tokens, places) if e <= p["end"]]
    if kind == "gap":
        return [(i, i + p["width"]) for i in range(len(tokens) - p["width"] + 1)]
    if kind == "not":
        out = evaluate(p["exclude"], tokens, places)
        pre, post = p.get("pre", 0), p.get("post", 0)
        starts, ends = [a for a, _ in out], [0, *accumulate((b for _, b in out), max)]  # the furthest end of the first n
        return [(s, e) for s, e in evaluate(p["include"], tokens, places) if not (n := bisect_left(starts, e + post)) or ends[n] <= s - pre]
    if kind in ("containing", "within"):
        big, little = evaluate(p["big"], tokens, places), evaluate(p["little"], tokens, places)
        inside = lambda x, y: y[0] <= x[0] and x[1] <= y[1]
        return [b for b in big if any(inside(x, b) for x in little)] if kind == "containing" else [x for x in little if any(inside(x, b) for b in big)]
    if kind == "all_of":  # intervals: minimal
        gaps = p["max_gaps"] if p["max_gaps"] >= 0 else 1 << 30
        return _minimal(_near([evaluate(c, tokens, places) for c in p["clauses"]], gaps, p["ordered"]))
    if kind == "any_of":
        return _minimal([s for c in p["clauses"] for s in evaluate(c, tokens, places)])
    if kind == "filtered":
        source, other, how = evaluate(p["source"], tokens, places), evaluate(p["filter"], tokens, places), p["how"]
        tests = {
            "containing": lambda x, y: x[0] <= y[0] and y[1] <= x[1], "contained_by": lambda x, y: y[0] <= x[0] and x[1] <= y[1],
            "overlapping": lambda x, y: x[0] < y[1] and y[0] < x[1], "before": lambda x, y: x[1] <= y[0], "after": lambda x, y: x[0] >= y[1],
        }
        wanted, test = not how.startswith("not_"), tests[how.removeprefix("not_")]
        return [x for x in source if any(test(x, y) for y in other) == wanted]
    if kind == "sloppy":
        return sloppy([places[k] for k in p["at"]] if "at" in p else [[i for i, t in enumerate(tokens) if t == w] for w in p["terms"]], p["slop"])
    raise ValueError(f"unknown position operator {kind!r}")


def sloppy(places: list[list[int]], slop: int) -> list[Span]:
    """Phrase matches in which the terms' displacements from their query places differ by at most `slop`."""
    if not all(places):
        return []
    out = set()
    for start in places[0]:
        used, lo, hi = [start], start, start
        for k in range(1, len(places)):
            best = _nearest(places[k], start + k, used)
            if best is None:
                break
            used.append(best)
            lo, hi = min(lo, best - k), max(hi, best - k)
        else:
            if hi - lo <= slop:
                out.add((min(used), max(used) + 1))
    return sorted(out)


def _nearest(places: list[int], to: int, used: list[int]) -> int | None:
    """The unused place nearest to a position, the earlier one of two."""
    at = bisect_left(places, to)
    before = next((i for i in reversed(range(at)) if places[i] not in used), None)
    after = next((i for i in range(at, len(places)) if places[i] not in used), None)
    if before is None or after is None:
        return None if before is after else places[after if before is None else before]
    return places[before] if to - places[before] <= places[after] - to else places[after]


def located(plan: dict) -> tuple[dict, list[tuple[str, str]], bool]:
    """The plan with numbers for its terms and prefixes, those (kind, value) pairs, and whether it still reads tokens."""
    leaves: list[tuple[str, str]] = []

    def number(kind: str, value: str) -> int:
        if (kind, value) not in leaves:
            leaves.append((kind, value))
        return leaves.index((kind, value))

    reads = False

    def walk(q: dict) -> dict:
        nonlocal reads
        (kind, p), = q.items()
        if kind in ("term", "prefix"):
            return {"at": number(kind, p["value"])}
        if kind == "sloppy":
            return {kind: {"at": [number("term", w) for w in p["terms"]], "slop": p["slop"]}}
        if kind in ("wildcard", "regexp", "fuzzy"):
            reads = True
            return q
        inner = ("match", "include", "exclude", "big", "little", "source", "filter")
        return {kind: {k: [walk(c) for c in v] if k == "clauses" else walk(v) if k in inner else v for k, v in p.items()}}

    return walk(plan), leaves, reads


def frequency(tokens: Column, plan: dict) -> Column:
    """Number of matches of a plan, weighted by 1/(1 + extra width) as sloppy phrases are."""
    width = len(plan["sloppy"]["terms"]) if "sloppy" in plan else None
    numbered, leaves, reads = located(plan)
    text, count = json.dumps(numbered), len(leaves)

    def document(t: Column) -> Column:
        none = F.array().cast("array<int>")

        def places(kind: str, value: str) -> Column:
            at = F.transform(t, lambda x, i: F.when(x == value if kind == "term" else F.startswith(x, F.lit(value)), i))
            return F.coalesce(F.array_compact(at), none)

        return F.struct(F.coalesce(F.array_size(t), F.lit(0)).alias("n"), *(places(*leaf).alias(f"p{k}") for k, leaf in enumerate(leaves)), *([t.alias("tokens")] if reads else []))

    @F.arrow_udf("double")
    def run(docs: pa.Array) -> pa.Array:
        p, n = json.loads(text), docs.field("n").to_numpy()
        lists = [docs.field(f"p{k}") for k in range(count)]
        lists = [(x.offsets.to_numpy(), x.values.to_numpy()) for x in lists]
        words = docs.field("tokens") if reads else None

        def one(i: int) -> float:
            if not n[i]:
                return 0.0
            got = evaluate(p, words[i].as_py() if reads else range(n[i]), [v[at[i] : at[i + 1]].tolist() for at, v in lists])
            return float(sum(1 / (1 + (e - s - width)) for s, e in got)) if width else float(len(got))

        return pa.array([one(i) for i in range(len(docs))], pa.float64())

    return run(once(tokens, document))


def phrase_at(tokens: Column, terms: list[str]) -> Column:
    """Exact phrase occurrences (slop 0), inside the JVM."""
    n, want = len(terms), F.array(*map(F.lit, terms))
    return F.coalesce(once(tokens, lambda t: F.array_size(F.filter(t, lambda x, i: (x == terms[0]) & (F.slice(t, i + 1, F.lit(n)) == want)))), F.lit(0)).cast("double")
