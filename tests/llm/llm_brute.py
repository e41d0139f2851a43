"""Slow, plain versions of the operators' contracts."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def words(text):
    return WORD.findall(text or "")


def base_rules(text):
    w, text = words(text), text or ""
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often = Counter(grams)
    inside = set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            inside |= set(range(i, i + 8))
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"), "n_dup_lines": dup, "n_repeat_words": len(inside), "base_failed": len(w) < 20 or 100 * len(inside) > 30 * len(w)}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def private(text):
    """(start, end, kind) of the base patterns."""
    text, out = text or "", []
    digits = lambda m: re.sub(r"[^0-9]", "", m[0])
    out += [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) < 256 for x in m[0].split("."))]
    out += [(m.start(), m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[0], ["email", "ip", "card", "phone"].index(s[2])))


def shingles(text, n):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def near_components(rows, n, percent=80):
    """[(doc_id, size, component)] in the order of rows [(doc_id, text)] of distinct ids."""
    sets = {i: shingles(t, n) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b]:
                same = len(sets[a] & sets[b])
                if 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def substring(rows, width=35):
    """doc_id, n_words, n_removed, sha of what is kept, for each row of [(doc_id, text)]."""
    all_words = [words(t) for _, t in rows]
    often = Counter(tuple(w[i : i + width]) for w in all_words for i in range(len(w) - width + 1))
    out = []
    for (i, _), w in zip(rows, all_words, strict=True):
        gone = set()
        for k in range(len(w) - width + 1):
            if often[tuple(w[k : k + width])] > 1:
                gone |= set(range(k, k + width))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def targets(sizes, weights=(5, 2, 1), cap=3):
    """Water-filling over {source: size}; None sorts last."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        each = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if each[s] > cap * sizes[s]]
        if not over:
            return {**fixed, **each}
        fixed |= {s: cap * sizes[s] for s in over}
        if len(fixed) == len(order):
            return fixed


def plain_kd(units, dims, leaves):
    """units: {key: (weight, {dim: coordinate}, tie)}; the leaf of each by a recursive tree cut at the weighted median."""
    out = {}

    def split(keys, first, span):
        if span == 1:
            out.update(dict.fromkeys(keys, first))
            return
        if not keys:
            return
        at = lambda k, d: units[k][1][d]
        d = max(dims, key=lambda d: max(at(k, d) for k in keys) - min(at(k, d) for k in keys))
        keys = sorted(keys, key=lambda k: (at(k, d), units[k][2]))
        want, done, n = sum(units[k][0] for k in keys) / 2, 0, 0
        while n < len(keys) and done + units[keys[n]][0] < want:
            done, n = done + units[keys[n]][0], n + 1
        if n < len(keys) and done + units[keys[n]][0] - want < want - done:
            n += 1
        split(keys[:n], first, span // 2)
        split(keys[n:], first + span // 2, span // 2)

    split(list(units), 0, leaves)
    return out
