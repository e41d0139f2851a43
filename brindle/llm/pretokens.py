"""Byte-level BPE pre-tokens of a flat UTF-8 buffer, found with numpy.

The pattern is the public one of byte-level BPE tokenizers:
`'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`.
Character classes come from the tokenizers library's own regex engine, so its Unicode version holds.
"""

from __future__ import annotations

import functools
import re

import numpy as np

from .textkit import U64, mix

LETTER, DIGIT, SPACE, OTHER = 0, 1, 2, 3


def build_classes() -> tuple[np.ndarray, np.ndarray]:
    """Class of every code point as runs (starts, kinds); made once on the driver, a few KB to ship."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    table = np.full(0x110000, OTHER, np.uint8)
    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], np.int64)
    kinds = [(k, Split(Regex(p), "removed")) for k, p in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+"))]
    for i in range(0, len(points), 8192):
        part = points[i : i + 8192]
        text = part.astype("<u4").tobytes().decode("utf-32-le")
        for kind, split in kinds:  # `removed` leaves what does not match; the gaps are the class
            hit = np.ones(len(part), bool)
            for _, (a, b) in split.pre_tokenize_str(text):
                hit[a:b] = False
            table[part[hit]] = kind
    starts = np.flatnonzero(np.diff(table, prepend=255))
    return starts, table[starts]


_runs: tuple[np.ndarray, np.ndarray] | None = None


def classes() -> tuple[np.ndarray, np.ndarray]:
    global _runs
    if _runs is None:
        _runs = build_classes()
    return _runs


def use_classes(runs: tuple[np.ndarray, np.ndarray]) -> None:
    """On an executor: take the runs that the driver has made."""
    global _runs
    if _runs is None:
        _runs = runs


@functools.cache
def class_table() -> np.ndarray:
    """Class of every code point."""
    starts, kinds = classes()
    return np.repeat(kinds, np.diff(starts, append=0x110000))


def byte_classes(buf: np.ndarray) -> np.ndarray:
    """The class of each byte's character."""
    table = class_table()
    lut = np.full(256, OTHER, np.uint8)
    lut[:128] = table[:128]
    cls = lut[buf]
    lead = np.flatnonzero(buf >= 0xC0)
    if len(lead):
        b = buf[lead].astype(np.int32)
        at = lambda k: buf[np.minimum(lead + k, len(buf) - 1)].astype(np.int32) & 0x3F
        two = ((b & 0x1F) << 6) | at(1)
        three = ((b & 0x0F) << 12) | (at(1) << 6) | at(2)
        four = ((b & 0x07) << 18) | (at(1) << 12) | (at(2) << 6) | at(3)
        kind = table[np.clip(np.where(b < 0xE0, two, np.where(b < 0xF0, three, four)), 0, 0x10FFFF)]
        cls[lead] = kind
        for k, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
            on = b >= least
            cls[np.minimum(lead[on] + k, len(buf) - 1)] = kind[on]
    return cls


def find_all(raw: bytes, what: bytes) -> np.ndarray:
    out, i = [], raw.find(what)
    while i >= 0:
        out.append(i)
        i = raw.find(what, i + len(what))
    return np.array(out, np.int64)


def pretokens(buf: np.ndarray, off: np.ndarray, special: bytes = b"<|endoftext|>"):
    """(starts, ends, is_special) of all pre-tokens; texts are [off[i], off[i+1]) and the buffer has padding."""
    n = int(off[-1])
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, bool)
    buf = buf[: n + 8]
    cls = byte_classes(buf[:n])
    seg = np.zeros(n + 1, bool)  # where a segment begins: texts and special tokens
    seg[off] = True
    at = find_all(buf[:n].tobytes(), special)
    if len(at):  # a hit must lie inside one text
        doc = np.searchsorted(off, at, side="right")
        at = at[at + len(special) <= off[doc]]
        seg[at] = seg[at + len(special)] = True
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(cls[1:], cls[:-1], out=start[1:])
    start |= seg[:n]
    space = cls == SPACE
    # whitespace followed by something else in the same segment: its last character stands alone or joins what follows
    nxt = np.flatnonzero(space[:-1] & ~space[1:] & ~seg[1:n]) + 1
    last = nxt - 1
    while True:  # back to the lead byte
        cont = (buf[last] & 0xC0) == 0x80
        if not cont.any():
            break
        last = last - cont
    start[last] = True
    start[nxt[buf[last] == 0x20]] = False
    # contractions: an apostrophe alone that begins a pre-token, then s t m d re ve ll
    q = np.flatnonzero((buf[:n] == 0x27) & start)
    if len(q):
        q = q[q + 1 < n]
        q = q[~seg[q + 1]]
        one, two = buf[q + 1], buf[q + 2]
        single = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        double = (((one == 0x72) | (one == 0x76)) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C))
        double &= (q + 2 < n) & ~seg[np.minimum(q + 2, n)]
        start[q[single | double] + 1] = False
        tail = np.concatenate([q[single] + 2, q[double] + 3])
        start[q[double] + 2] = False
        start[tail[tail < n]] = True
    is_special = None
    if len(at):
        inside = (at[:, None] + np.arange(1, len(special))).ravel()
        start[inside] = False
        start[at] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], n)
    is_special = np.isin(starts, at) if len(at) else np.zeros(len(starts), bool)
    return starts, ends, is_special


WIDE = 32  # spans up to this many bytes are keyed by their own content


class Keys:
    """Distinct spans of a buffer.  `code` maps each span to a distinct one; `first` is where each of those occurs first.

    Spans of at most WIDE bytes are grouped by a hash of their content and compared byte for byte with the group's
    first; longer ones, and any that differ, are grouped as Python bytes.  The grouping is exact.
    """

    def __init__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        import pandas as pd

        length = ends - starts
        pad = np.zeros(len(buf) + WIDE, np.uint8)
        pad[: len(buf)] = buf
        view = np.ndarray((len(pad) - 7,), "<u8", buffer=pad, strides=(1,))
        masks = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 8)] + [2**64 - 1], dtype=U64)
        h = mix(length.astype(U64) + U64(0x9E37))
        parts = []
        for c in range(0, WIDE, 8):
            need = length > c
            part = np.zeros(len(starts), U64)
            if c < 8:
                part = view[starts] & masks[np.clip(length, 0, 8)]
                h = mix(h ^ part)
            else:
                who = np.flatnonzero(need)
                if len(who):
                    part[who] = view[starts[who] + c] & masks[np.clip(length[who] - c, 0, 8)]
                    h[who] = mix(h[who] ^ part[who])
            parts.append(part)
        code, _ = pd.factorize(h)
        first = np.full(code.max(initial=-1) + 1, -1, np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        rep = first[code]
        same = (length == length[rep]) & (length <= WIDE)
        for part in parts:
            same &= part == part[rep]
        odd = np.flatnonzero(~same)
        if len(odd):
            raw, seen, extra = buf.tobytes(), {}, []
            code = code.copy()
            for i in odd:
                key = raw[starts[i] : ends[i]]
                k = seen.get(key)
                if k is None:
                    k = seen[key] = len(first) + len(extra)
                    extra.append(i)
                code[i] = k
            first = np.concatenate([first, np.array(extra, np.int64)])
        self.code, self.first, self.starts, self.ends = code, first, starts[first], ends[first]
        self.hash = h[first]
        self.parts = [p[first] for p in parts]

    def bytes_of(self, buf: np.ndarray, which: np.ndarray) -> list[bytes]:
        raw = buf.tobytes()
        return [raw[a:b] for a, b in zip(self.starts[which].tolist(), self.ends[which].tolist(), strict=True)]


def safe_cuts(raw: bytes, lo: int, hi: int, limit: int) -> list[int]:
    """Cuts of [lo, hi) into ranges of about `limit` bytes: before a space between two ASCII letters, where a pre-token
    always begins whatever surrounds it.  A stretch without such a place stays whole."""
    cuts = [lo]
    while hi - cuts[-1] > limit:
        m = _SAFE.search(raw, cuts[-1] + limit, hi)
        if not m:
            break
        cuts.append(m.start() + 1)
    return [*cuts, hi]


_SAFE = re.compile(rb"[A-Za-z] [A-Za-z]")


def byte_slices(buf: np.ndarray, off: np.ndarray, limit: int):
    """(doc, lo, hi, offsets) of ranges of one flat buffer for pretokens(): whole texts up to `limit` bytes, longer texts in parts."""
    raw, doc, n = None, 0, len(off) - 1
    while doc < n:
        end = max(doc + 1, int(np.searchsorted(off, off[doc] + limit, side="right")) - 1)
        end = min(end, n)
        lo, hi = int(off[doc]), int(off[end])
        if end == doc + 1 and hi - lo > limit:
            raw = raw or buf.tobytes()
            cuts = safe_cuts(raw, lo, hi, limit)
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield doc, a, b, np.array([0, b - a], np.int64)
        else:
            yield doc, lo, hi, off[doc : end + 1] - lo
        doc = end


def padded(buf: np.ndarray, lo: int, hi: int) -> np.ndarray:
    out = np.zeros(hi - lo + 8, np.uint8)
    out[:-8] = buf[lo:hi]
    return out
