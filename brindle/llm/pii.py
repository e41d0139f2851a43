"""Personal data: base patterns, and a linear-chain conditional random field over word-shape features.

Base spans come from the patterns for e-mail, IP, card and phone, with their numeric checks.  The field adds spans that
the patterns miss, such as secrets.  It reads words near one with a digit, an `@` or a cue such as `password` (a chain is
a maximal run of words within REACH words of such a word); its features are the shapes of a word and of its neighbours,
and whether a cue stands before it, with a separator or without.  It is trained on the driver by stochastic gradient
ascent of the likelihood from the small labelled table made by `labelled_table` or given (at most MAX_ROWS rows; more is
an error), and decoded by Viterbi over all chains of a slice at once.  An added span must pass its kind's numeric check, as a whole or
else word by word (two cards in a row defeat the pattern, not the field); one that overlaps a base span
is dropped, but a secret stays where it holds the whole of each (digits inside a key may pass for a card).

Defined results: null and empty texts have no spans; spans count code points, ends exclusive; texts without digits,
`@` and cues have no spans; repeated rows are read each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import bounded_arrow
from .textkit import counts_by, flat, mapper, words

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", "email", "ip", "card", "phone", "secret")
ORDER = {k: i for i, k in enumerate((*KINDS, "secret"))}
REACH = 2
MAX_ROWS = 10_000  # of a labelled table; training is on the driver

# ---- base patterns ----------------------------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits does, and giving digits back never helps
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the e-mail pattern, found from each `@` outwards."""
    out, end, p = [], 0, text.find("@")
    while p >= 0:
        begin = p
        while begin > end and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, p + 1) if begin < p else None
        if m:
            out.append((begin, m.end()))
            end = m.end()
        p = text.find("@", max(p + 1, end))
    return out


def _octet(x: str) -> bool:
    x = x.lstrip("0")
    return len(x) < 4 and int(x or 0) < 256


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start, then kind as listed."""
    found = [(a, b, "email") for a, b in emails(text)]
    found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
    if "+" in text:
        found += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], ORDER[s[2]]))


# ---- word shapes ------------------------------------------------------------------------------------------------------

_EDGE = "\"'`.,;:!?()[]{}<>#*$%&|="
_CUES = frozenset(("token", "secret", "key", "apikey", "api_key", "password", "passwd", "pwd", "passphrase", "auth", "bearer", "credential", "access_key", "secret_key"))
_SHAPES = tuple(
    re.compile(p) for p in (
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[^@]*@.*", r"\d{1,3}(\.\d{1,3}){3}", r"\d{13,19}", r"\d{4}([ -]?\d{4}){0,3}",
        r"\+\d{1,3}", r"\(?\d{2,4}\)?", r"\d{3}-\d{4}", r"\+?\d[\d().-]{7,}", r"\d+", r"\d+([.,:/-]\d+)+%?", r"[0-9a-f]{24,}", r"[0-9A-F]{24,}",
        r"(?=.*\d)(?=.*[A-Za-z])[A-Za-z0-9_+/-]{20,}", r"(?=.*\d)(?=.*[A-Za-z])[A-Za-z0-9_-]{2,19}", r"[=:]+|=>|:=",
    )
)
N_SHAPES, N_SIZES = len(_SHAPES) + 6, 6
N_FEATURES = 3 * N_SHAPES + N_SIZES + 5
_BLANK, _CUE, _LETTERS, _MIXED, _CUE_SEP, _PAIR = range(len(_SHAPES), N_SHAPES)
_SEPARATOR = len(_SHAPES) - 1
# a name, its separator and the opening marks of a value, as in key, "key": and key="
_NAMED = re.compile(r"[\"'`(\[{<#*$%&|]*([A-Za-z_]+)[\"']?(:=|=>|[=:]*)[\"'(]*")
_CUE_BYTES = re.compile("(?:{})(?![a-z_])".format("|".join(sorted(_CUES, key=lambda c: (-len(c), c)))).encode())


def named(word: str) -> tuple[bool, bool, int]:
    """(the word is or begins with a cue, a separator follows it, where the value in the same word begins or 0)."""
    m = _NAMED.match(word)
    if not m or m[1].lower() not in _CUES:
        return False, False, 0
    value = bool(word[m.end() :].strip(_EDGE))
    return bool(m[2]) or not value, bool(m[2]), m.end() if value and m[2] else 0


def shape(word: str) -> tuple[int, int, bool]:
    """(shape, size bucket, quoted)."""
    core = word.strip(_EDGE)
    size = min(N_SIZES - 1, len(core) // 5)
    quoted = '"' in word or "'" in word
    if not core:
        return (_SEPARATOR if set(word) <= {"=", ":", ">"} else _BLANK), size, quoted
    cue, separated, value = named(word)
    if value:
        return _PAIR, min(N_SIZES - 1, len(word[value:].strip(_EDGE)) // 5), quoted
    if cue:
        return (_CUE_SEP if separated else _CUE), size, quoted
    for i, p in enumerate(_SHAPES):
        if p.fullmatch(core):
            return i, size, quoted
    return (_MIXED if any(c.isdigit() for c in core) else _LETTERS), size, quoted


def chain_features(chain: list[str]) -> np.ndarray:
    """Words x active features."""
    s = [shape(w) for w in chain]
    pad = (_LETTERS, 0, False)
    rows = []
    for i, (k, size, quoted) in enumerate(s):
        before, after = s[i - 1] if i else pad, s[i + 1] if i + 1 < len(s) else pad
        far = s[i - 2] if i > 1 else pad
        cue = int(before[0] in (_CUE, _CUE_SEP) or far[0] in (_CUE, _CUE_SEP))
        cue += before[0] == _CUE_SEP or (cue and before[0] == _SEPARATOR)
        at = 3 * N_SHAPES
        rows.append((k, N_SHAPES + before[0], 2 * N_SHAPES + after[0], at + size, at + N_SIZES + quoted, at + N_SIZES + 2 + cue))
    return np.array(rows, np.int64).reshape(len(chain), 6)


# ---- the field --------------------------------------------------------------------------------------------------------


class Field:
    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    def decode(self, chains: list[np.ndarray]) -> list[np.ndarray]:
        """Best tags of all chains; chains are sorted by length and stepped together."""
        if not chains:
            return []
        order = np.argsort([-len(c) for c in chains], kind="stable")
        length = np.array([len(chains[i]) for i in order])
        offset = np.concatenate([[0], np.cumsum(length)[:-1]])
        emission = self.emit[np.concatenate([chains[i] for i in order])].sum(axis=1)
        best = emission[offset]
        back = []
        for t in range(1, length[0]):
            n = int(np.searchsorted(-length, -t, side="left"))
            step = best[:n, :, None] + self.move
            back.append(step.argmax(axis=1))
            best = np.concatenate([step.max(axis=1) + emission[offset[:n] + t], best[n:]])
        tags = [np.zeros(k, np.int64) for k in length]
        now = best.argmax(axis=1)
        for i, k in enumerate(length):
            tags[i][-1] = now[i]
            for t in range(k - 1, 0, -1):
                tags[i][t - 1] = back[t - 1][i][tags[i][t]]
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(chains)
        for i, k in enumerate(order):
            out[k] = tags[i]
        return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(table: list[tuple[list[str], list[str]]], epochs: int = 12, rate: float = 0.15, decay: float = 1e-4, seed: int = 5) -> Field:
    k = len(TAGS)
    emit, move = np.zeros((N_FEATURES, k)), np.zeros((k, k))
    data = [(chain_features(w), np.array([TAGS.index(t) for t in tags])) for w, tags in table if w]
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        step = rate / (1 + epoch / 4)
        for i in rng.permutation(len(data)):
            x, y = data[i]
            e = emit[x].sum(axis=1)
            n = len(y)
            a, b = np.zeros((n, k)), np.zeros((n, k))
            a[0] = e[0]
            for t in range(1, n):
                a[t] = _lse(a[t - 1][:, None] + move, 0) + e[t]
            for t in range(n - 2, -1, -1):
                b[t] = _lse(move + (e[t + 1] + b[t + 1])[None, :], 1)
            z = _lse(a[-1], 0)
            p = np.exp(a + b - z)
            g = -p
            g[np.arange(n), y] += 1
            g_move = np.zeros((k, k))
            for t in range(1, n):
                g_move[y[t - 1], y[t]] += 1
                g_move -= np.exp(a[t - 1][:, None] + move + (e[t] + b[t])[None, :] - z)
            for c in range(x.shape[1]):
                np.add.at(emit, x[:, c], step * g)
            emit *= 1 - step * decay
            move += step * g_move - step * decay * move
    return Field(emit, move)


def _made(seed: int = 11, n: int = 400) -> list[tuple[list[str], list[str]]]:
    """The labelled table: made-up chains of words with tags, and negatives that look alike."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("an", "er", "the", "on", "ti", "lo", "que", "ver", "sch", "é")) for _ in range(r.randint(1, 4))) + r.choice(("", "", ",", "."))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    mark = lambda w: w + r.choice(("", "", "", ",", ".", "###", "&&&"))

    def secret():
        kind = r.randrange(6)
        if kind < 2:
            return "".join(r.choice("0123456789abcdef") for _ in range(r.choice((32, 40, 64))))
        if kind == 4:  # letters only
            return "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(17, 40)))
        if kind == 5:  # a passphrase
            return "-".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(4, 8))) for _ in range(r.randint(4, 6)))
        letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789" + "_-" * (kind == 3)
        return "".join(r.choice(letters) for _ in range(r.randint(24, 44))) + digits(2)

    rows = []
    for _ in range(n):
        kind = r.randrange(16)
        head = [(word(), "O") for _ in range(r.randint(0, 3))]
        tail = [(word(), "O") for _ in range(r.randint(0, 3))]
        cue = r.choice(("token", "key", "secret", "password", "api_key"))
        if kind == 0:
            mid = [(cue, "O"), (r.choice(("=", ":")), "O"), (mark(f"{(q := r.choice(('', chr(34))))}{secret()}{q}"), "secret")]
        elif kind == 1:
            mid = [(f'{cue}{r.choice("=:")}', "O"), (mark(secret()), "secret")]
        elif kind == 2:
            mid = [(mark(f"{word().strip('.,')}.{digits(2)}@mail{digits(1)}.example.com"), "email")]
        elif kind == 3:
            mid = [(mark(".".join(str(r.randint(0, 255)) for _ in range(4))), "ip")]
        elif kind == 4:
            mid = [(mark(digits(16)), "card")] if r.random() < 0.5 else [(digits(4), "card"), (digits(4), "card"), (digits(4), "card"), (mark(digits(4)), "card")]
        elif kind == 5:
            mid = [(f"+{r.randint(1, 99)}", "phone"), (f"({digits(3)})", "phone"), (mark(f"{digits(3)}-{digits(4)}"), "phone")]
        elif kind == 6:
            mid = [(f"({digits(3)})", "phone"), (mark(f"{digits(3)}-{digits(4)}"), "phone")]
        elif kind == 7:
            mid = [(mark(digits(r.randint(1, 6))), "O")]
        elif kind == 8:
            mid = [(mark(f"{r.randint(1, 31)}.{r.randint(1, 12)}.{r.randint(1990, 2030)}"), "O"), (f"{r.randint(0, 23)}:{digits(2)}", "O")]
        elif kind == 9:
            mid = [(mark(f"{word().strip('.,')}{digits(2)}"), "O"), (mark(f"v{digits(1)}.{digits(1)}"), "O")]
        elif kind == 10:
            mid = [(cue, "O"), (r.choice(("=", ":", "is")), "O"), (mark(digits(r.randint(1, 4))), "O")]
        elif kind == 11:  # the value in the word of its name
            mid = [(mark(f'{r.choice((cue, chr(34) + cue + chr(34)))}{r.choice("=:")}{r.choice(("", chr(34)))}{secret()}'), "secret")]
        elif kind == 12:
            mid = [(cue, "O"), (r.choice(("=", ":")), "O"), (word()[:14], "O"), (word(), "O")]
        elif kind == 13:
            mid = [(f'{cue}{r.choice("=:")}', "O"), (word()[:14], "O"), (word(), "O")]
        elif kind == 14:  # a cue in prose, and a long word
            mid = [(cue, "O"), *((x, "O") for x in (r.choice(("is", "was", "the", "of")),) * r.randrange(2)), (word() + word().strip(",.") + word(), "O")]
        else:
            mid = [("@", "O"), (mark(f"@{word().strip('.,')}"), "O"), (mark(f"{digits(3)},{digits(3)}"), "O")]
        rows.append([*head, *mid, *tail])
    return [([w for w, _ in x], [t for _, t in x]) for x in rows]


def labelled_table(spark: SparkSession) -> DataFrame:
    """The small labelled table: words array<string>, tags array<string>."""
    return spark.createDataFrame(_made(), "words array<string>, tags array<string>")


# ---- spans ------------------------------------------------------------------------------------------------------------


_INNER = _EDGE.replace("(", "")


def plausible(kind: str, text: str) -> bool:
    """The numeric checks hold for added spans too."""
    digits = "".join(_DIGITS.findall(text))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "ip":
        return bool(_IP.fullmatch(text)) and all(map(_octet, text.split(".")))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "email":
        return bool(emails(text))
    return len(text) >= 16


class Finder:
    def __init__(self, field: Field):
        self.field = field

    def find(self, texts: pa.Array) -> list[tuple[list, list]]:
        """(base spans, all spans) of each text."""
        buf, off = flat(texts)
        starts, ends, wb = words(buf, off)
        text = buf[: off[-1]]
        hot = ((text >= 48) & (text <= 57)) | (text == 64)
        out: list[tuple[list, list]] = [([], [])] * (len(off) - 1)
        raw = buf.tobytes()
        low = raw[: len(text)].lower()
        at_cues = np.array([m.start() for m in _CUE_BYTES.finditer(low)], np.int64)
        before = text[np.maximum(at_cues - 1, 0)] | 32
        joined_on = ((before >= 97) & (before <= 122)) | (before == 127)  # a letter or _ in the same text
        at_cues = at_cues[~joined_on | np.isin(at_cues, off[:-1])]
        some = np.union1d(np.flatnonzero(counts_by(off, hot)), np.searchsorted(off, at_cues, side="right") - 1)
        if not len(some):
            return out
        lead = np.zeros(len(text) + 1, np.int64)
        np.cumsum((text & 0xC0) != 0x80, out=lead[1:])
        cum = np.zeros(len(text) + 1, np.int64)
        np.cumsum(hot, out=cum[1:])
        hot_words = np.union1d(np.flatnonzero(cum[ends] - cum[starts]), np.searchsorted(starts, at_cues, side="right") - 1)
        chains, places = [], []
        doc = np.searchsorted(wb, hot_words, side="right") - 1
        i = 0
        while i < len(hot_words):
            j = i
            while j + 1 < len(hot_words) and doc[j + 1] == doc[i] and hot_words[j + 1] - hot_words[j] <= 2 * REACH:
                j += 1
            a, b = max(wb[doc[i]], hot_words[i] - REACH), min(wb[doc[i] + 1], hot_words[j] + REACH + 1)
            chain = [raw[starts[k] : ends[k]].decode() for k in range(a, b)]
            chains.append(chain)
            places.append((int(doc[i]), int(a)))
            i = j + 1
        added: dict[int, list] = {}
        for (d, a), chain, tags in zip(places, chains, self.field.decode([chain_features(c) for c in chains]), strict=True):
            t = 0
            while t < len(tags):
                e = t + 1
                if tags[t]:
                    while e < len(tags) and tags[e] == tags[t]:
                        e += 1
                    kind, base = TAGS[tags[t]], lead[off[d]]
                    for f, g in ((t, e), *((k, k + 1) for k in range(t, e) if e - t > 1)):  # whole, or else its words
                        first, last = chain[f], chain[g - 1]
                        skip = named(first)[2] if kind == "secret" else 0
                        first = first[skip:]
                        lo = int(lead[starts[a + f]] - base) + skip + len(first) - len(first.lstrip(_INNER))
                        hi = int(lead[ends[a + g - 1]] - base) - (len(last) - len(last.rstrip(_EDGE)))
                        if hi > lo and plausible(kind, " ".join(chain[f:g])[skip:].lstrip(_INNER).rstrip(_EDGE)):
                            added.setdefault(d, []).append((lo, hi, kind))
                            if (f, g) == (t, e):
                                break
                t = e
        for d in some.tolist():
            own = base_spans(raw[off[d] : off[d + 1]].decode())
            extra = [s for s in added.get(d, []) if all(b <= s[0] or s[1] <= a or s[0] <= a and b <= s[1] and s[2] == "secret" for a, b, _ in own)]
            out[d] = own, sorted(own + extra, key=lambda s: (s[0], ORDER[s[2]]))
        return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def personal_data(docs: DataFrame, table: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added of every row."""
    spark = docs.sparkSession
    bounded_arrow(spark)
    found = (table if table is not None else labelled_table(spark)).select("words", "tags").limit(max_rows + 1).collect()
    if len(found) > max_rows:
        raise ValueError(f"the labelled table has over {max_rows} rows; training is on the driver")
    rows = sorted((list(r[0]), list(r[1])) for r in found if r[0] and r[1])
    finder = Finder(train(rows))

    def one(piece: pa.RecordBatch) -> pa.RecordBatch:
        found = finder.find(piece.column(1))
        counts = [pa.array([sum(k == kind for _, _, k in own) for own, _ in found], pa.int64()) for kind in KINDS]
        sha = pa.array([hashlib.sha256(joined(own).encode()).hexdigest() for own, _ in found], pa.string())
        rest = [pa.array([joined(every) for _, every in found], pa.string()), pa.array([len(every) - len(own) for own, every in found], pa.int64())]
        return pa.RecordBatch.from_arrays([piece.column(0), *counts, sha, *rest], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(mapper(one), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
