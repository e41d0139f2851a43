"""Quality rules: base counts, and Jensen-Shannon distances of a document's histograms to language references.

The references are counted over all documents in a first pass: for each language that has `ENOUGH` words, or `MIN_LANG`
of all words where that is less, the distribution over eight character classes, and over the language's common words
(each at least `COMMON` of its words) with one bin for the rest.  So a language has at most 1/COMMON words, however many
languages there are.  In a first pass each task sums in numpy and drops, as it goes, words below half of COMMON of what
it has seen (lossy counting), which leaves at most 2/COMMON candidates to a language; a second pass counts these whole,
so the references do not depend on how the rows are dealt out.

A document fails if its distance to its language's reference is over a limit, provided that it is long enough for the
histogram to mean something; of a document whose language has no reference only the base rule decides.

Defined results: a null or empty text has no words and fails the base rule; a null language takes the
nearest reference; without a reference the distances are null and only the base rule counts; repeated rows are judged
each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import bounded_arrow, stored
from .textkit import _IS_WS, counts_by, cover, cut, flat, hash_spans, mapper, mix, windows, words

MIN_LANG, COMMON = 1 / 50, 1 / 1000
ENOUGH = 10 / COMMON  # words of a language: a common word was seen ten times
SYMBOLS = b"#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "blank", "point", "mark", "symbol", "wide")
_CLASS = np.full(256, 6, np.uint8)
_CLASS[[*range(97, 123)]] = 0
_CLASS[[*range(65, 91)]] = 1
_CLASS[[*range(48, 58)]] = 2
_CLASS[_IS_WS] = 3
_CLASS[list(b".,;:'\"()-?")] = 4
_CLASS[list(b"!")] = 5
_CLASS[0xC0:] = 7
_CLASS[0x80:0xC0] = 8  # continuation bytes: not counted
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TAIL = np.zeros(256, bool)
_TAIL[list(b".,;:'\"()-?!")] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    max_repeat_percent: int = 30
    max_char_distance: float = 0.27
    min_chars: int = 300  # below, the character histogram says too little
    max_word_distance: float = 0.48
    min_word_words: int = 80  # below, the word histogram says too little


def common_form(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words in lower case (A-Z) without one trailing mark."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    trimmed = ends - (_TAIL[buf[ends - 1]] & (ends - starts > 1))
    return hash_spans(_LOWER[buf], starts, trimmed)


def class_counts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Texts x classes."""
    n, k = len(off) - 1, len(CLASSES) + 1
    doc = np.repeat(np.arange(n), np.diff(off))
    return np.bincount(doc * k + _CLASS[buf[: off[-1]]], minlength=n * k).reshape(n, k)[:, :-1]


def base(buf: np.ndarray, off: np.ndarray) -> tuple[dict[str, np.ndarray], tuple]:
    starts, ends, wb = words(buf, off)
    text = buf[: off[-1]]
    n_words = np.diff(wb)
    solid = ~_IS_WS[text]
    raw, dup_lines = buf.tobytes(), np.zeros(len(off) - 1, np.int64)
    breaks = counts_by(off, text == 10)
    for i in np.flatnonzero(breaks):
        seen = set()
        for line in raw[off[i] : off[i + 1]].split(b"\n"):
            if line in seen:
                dup_lines[i] += 1
            elif line.strip():
                seen.add(line)
    repeated = np.zeros(len(starts), bool)
    h, at = windows(hash_spans(buf, starts, ends), wb, 8)
    if len(h):
        doc = np.searchsorted(wb, at, side="right")
        h = mix(h ^ mix(doc.astype(np.uint64)))
        order = np.argsort(h, kind="stable")
        same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        repeated = cover(len(starts), at[twice], 8)
    return {
        "n_words": n_words, "word_chars": counts_by(off, solid & ((text & 0xC0) != 0x80)),
        "n_symbols": counts_by(off, _SYMBOL[text]), "n_dup_lines": dup_lines, "n_repeat_words": counts_by(wb, repeated),
    }, (starts, ends, wb)


def references(docs: DataFrame) -> dict:
    """Language -> (class distribution, sorted word hashes, their shares)."""

    def count(batches):
        chars: dict[str, np.ndarray] = {}
        seen: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        total: dict[str, int] = {}
        for batch in batches:
            for piece in cut(batch):
                buf, off = flat(piece.column(0))
                starts, ends, wb = words(buf, off)
                h = common_form(buf, starts, ends)
                langs = piece.column(1).to_pylist()
                table = class_counts(buf, off)
                kinds = {x: k for k, x in enumerate(dict.fromkeys(langs))}
                of = np.array([kinds[x] for x in langs])
                word_of = np.repeat(of, np.diff(wb))
                for lang, k in kinds.items():
                    if lang is None:
                        continue
                    mine = h[word_of == k]
                    chars[lang] = chars.get(lang, 0) + table[of == k].sum(axis=0)
                    total[lang] = total.get(lang, 0) + len(mine)
                    a, n = seen.get(lang, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
                    a, back = np.unique(np.concatenate([a, mine]), return_inverse=True)
                    n = np.bincount(back, np.concatenate([n, np.ones(len(mine), np.int64)]), len(a)).astype(np.int64)
                    if len(a) > 16 / COMMON:
                        keep = n >= COMMON / 2 * total[lang]
                        a, n = a[keep], n[keep]
                    seen[lang] = a, n
        rows = []
        for lang, (a, n) in seen.items():
            keep = n >= COMMON / 2 * total[lang]
            rows += [(lang, "c", k, int(x)) for k, x in enumerate(chars[lang])] + [(lang, "t", 0, total[lang])]
            rows += [(lang, "w", k, x) for k, x in zip(a[keep].view(np.int64).tolist(), n[keep].tolist(), strict=True)]
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip(("lang", "kind", "key", "n"), map(list, zip(*rows, strict=True)), strict=True)))

    counted = docs.select(F.col("text").cast("string"), F.col("lang").cast("string").alias("lang")).mapInArrow(count, "lang string, kind string, key long, n long")
    sums = counted.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    sums = stored(sums, "references")
    totals = sums.filter("kind = 't'").select("lang", F.col("n").alias("total"))
    all_words = totals.agg(F.sum("total")).first()[0] or 0
    large = totals.filter(F.col("total") >= min(ENOUGH, max(1.0, MIN_LANG * all_words)))
    # a common word is in the sums, with COMMON / 2 of all words at least, as a task leaves out less than that of it
    rows = sums.join(F.broadcast(large), "lang").filter((F.col("kind") == "c") | ((F.col("kind") == "w") & (F.col("n") >= COMMON / 2 * F.col("total"))))
    out: dict = {}
    for lang, kind, key, n, whole in rows.select("lang", "kind", "key", "n", "total").collect():
        entry = out.setdefault(lang, (np.zeros(len(CLASSES)), {}, whole))
        if kind == "c":
            entry[0][key] = n
        else:
            entry[1][np.uint64(np.int64(key).view(np.uint64))] = 0.0
    for lang, key, n in _exact(docs, {x: np.array(sorted(e[1]), np.uint64) for x, e in out.items()}).collect():
        out[lang][1][np.uint64(np.int64(key).view(np.uint64))] = n / out[lang][2]
    out = {x: (c, {k: v for k, v in w.items() if v >= COMMON}, n) for x, (c, w, n) in out.items()}
    done = {}
    for lang, (c, w, _) in sorted(out.items()):
        keys = np.array(sorted(w), np.uint64)
        done[lang] = (c / max(c.sum(), 1), keys, np.array([w[k] for k in keys]))
    return done


def _exact(docs: DataFrame, asked: dict[str, np.ndarray]) -> DataFrame:
    """(lang, key, n): whole counts of the asked words of each language."""

    def count(batches):
        found = {x: np.zeros(len(k), np.int64) for x, k in asked.items()}
        for batch in batches:
            for piece in cut(batch):
                buf, off = flat(piece.column(0))
                starts, ends, wb = words(buf, off)
                h = common_form(buf, starts, ends)
                langs = np.array(piece.column(1).to_pylist(), object)
                word_of = np.repeat(langs, np.diff(wb))
                for lang in {x for x in langs.tolist() if x in asked}:
                    keys, mine = asked[lang], h[word_of == lang]
                    if len(keys):
                        at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
                        found[lang] += np.bincount(at[keys[at] == mine], minlength=len(keys))
        for lang, n in found.items():
            on = np.flatnonzero(n)
            if len(on):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(on)), pa.array(asked[lang][on].view(np.int64)), pa.array(n[on])], ["lang", "key", "n"])

    rows = docs.select(F.col("text").cast("string"), F.col("lang").cast("string").alias("lang"))
    return rows.mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


class Reference:
    """The references as arrays: classes (languages x classes), and the shares of words and the rest that are not zero."""

    def __init__(self, refs: dict):
        self.langs = {k: i for i, k in enumerate(refs)}
        self.keys = np.unique(np.concatenate([r[1] for r in refs.values()])) if refs else np.zeros(0, np.uint64)
        self.chars = np.array([r[0] for r in refs.values()]).reshape(len(refs), len(CLASSES))
        at, shares, n = [np.zeros(0, np.int64)], [np.zeros(0)], len(self.keys) + 1
        for i, (_, keys, share) in enumerate(refs.values()):
            at += [i * n + np.searchsorted(self.keys, keys), [i * n + n - 1]]
            shares += [share, [max(0.0, 1 - share.sum())]]
        self.at, self.shares = np.concatenate(at).astype(np.int64), np.concatenate(shares)  # ascending places

    def share(self, ref: np.ndarray, bin_: np.ndarray) -> np.ndarray:
        wanted = ref * (len(self.keys) + 1) + bin_
        found = np.minimum(np.searchsorted(self.at, wanted), len(self.at) - 1)
        return np.where(self.at[found] == wanted, self.shares[found], 0.0)

    def distances(self, buf, off, spans, langs: list) -> tuple[np.ndarray, np.ndarray]:
        """Jensen-Shannon distances (base 2, 0 to 1) by characters and by words; NaN without a reference or content."""
        starts, ends, wb = spans
        n, n_ref = len(off) - 1, len(self.langs)
        if not n_ref:
            return np.full(n, np.nan), np.full(n, np.nan)
        own = np.array([self.langs.get(x, -1) for x in langs])
        table = class_counts(buf, off).astype(float)
        p = table / np.maximum(table.sum(axis=1, keepdims=True), 1)
        h = common_form(buf, starts, ends)
        at = np.minimum(np.searchsorted(self.keys, h), max(len(self.keys) - 1, 0))
        rest = len(self.keys)
        bin_ = np.where(self.keys[at] == h, at, rest) if rest else np.zeros(len(h), np.int64)
        n_words = np.diff(wb)
        key, count = np.unique(np.repeat(np.arange(n), n_words) * (rest + 1) + bin_, return_counts=True)
        doc, bin_ = key // (rest + 1), key % (rest + 1)
        share = count / np.maximum(n_words[doc], 1)

        def against(ref: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """ref: for each text the reference's index; rows: texts that are asked for."""
            q = self.chars[ref]
            c = _terms(p, q).sum(axis=1)
            on = rows[doc]
            qs = self.share(ref[doc[on]], bin_[on])
            w = np.bincount(doc[on], _terms(share[on], qs), n) + 0.5 * (1 - np.bincount(doc[on], qs, n))
            return c, w

        c, w = np.full(n, np.inf), np.full(n, np.inf)
        known = own >= 0
        if known.any():
            a, b = against(np.maximum(own, 0), known)
            c[known], w[known] = a[known], b[known]
        unnamed = np.array([x is None for x in langs], bool)
        if unnamed.any():
            for k in range(n_ref):
                a, b = against(np.full(n, k), unnamed)
                c[unnamed], w[unnamed] = np.minimum(c, a)[unnamed], np.minimum(w, b)[unnamed]
        c, w = np.sqrt(np.clip(c, 0, 1)), np.sqrt(np.clip(w, 0, 1))
        c[table.sum(axis=1) == 0] = np.nan
        w[n_words == 0] = np.nan
        c[~known & ~unnamed] = w[~known & ~unnamed] = np.nan
        return c, w


def _terms(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        return 0.5 * (np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0))


def quality_rules(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, char_distance, word_distance of every row."""
    bounded_arrow(docs.sparkSession)
    reference = Reference(references(docs))

    def one(piece: pa.RecordBatch) -> pa.RecordBatch:
        buf, off = flat(piece.column(1))
        out, spans = base(buf, off)
        chars, word = reference.distances(buf, off, spans, piece.column(2).to_pylist())
        n, size = out["n_words"], np.diff(off)
        failed = (n < rules.min_words) | (100 * out["n_repeat_words"] > rules.max_repeat_percent * n)
        odd = ((size >= rules.min_chars) & (chars > rules.max_char_distance)) | ((n >= rules.min_word_words) & (word > rules.max_word_distance))
        cols = {"doc_id": piece.column(0)} | {k: pa.array(v) for k, v in out.items()}
        cols |= {"base_failed": pa.array(failed), "kept": pa.array(~failed & ~odd)}
        cols |= {"char_distance": pa.array(chars, from_pandas=True), "word_distance": pa.array(word, from_pandas=True)}
        return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"
    return rows.mapInArrow(mapper(one), schema)
