"""BPE encoding and decoding through a minimal acyclic transducer lexicon.

1. Corpus pass over all texts: each task counts pre-tokens and drops, as it goes, those below half of `share` of what
   it has seen (lossy counting), so it reports at most 2/share words.  The sums are lower bounds; words whose sum is at
   least `share` of the corpus enter the lexicon, hence at most 1/share words, whatever the input.
2. The frequent words are compiled on the driver into a minimal acyclic automaton (sorted insertion, states with equal
   futures shared).  Each arc carries the number of words that its earlier siblings lead to, so the sum along a path is
   the word's rank: the output that addresses its token ids.  The file is shipped with `SparkContext.addFile`, read
   once per executor and memory-mapped by its workers.
3. Encoding: a slice's distinct pre-tokens walk the automaton together in numpy.  Words that it does not accept are
   merged exactly, all at once: in each round every word merges its pair of lowest rank, left to right.
4. Decoding concatenates the tokens' bytes.

The lexicon changes speed only, never ids.  Defined results: null counts as empty text, which has no ids; special
strings in a text become their one id, as is the library's default; very long texts are encoded in parts cut at safe
boundaries; repeated rows are encoded each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import Keys, byte_slices, classes, padded, pretokens, use_classes
from .session import bounded_arrow, stored
from .textkit import U64, cut, flat, give_back
from .token_count import byte_alphabet, default_tokenizer, special_string

SHARE = 1e-5
SLICE = 2 << 20
LONGEST_WORD = 64  # bytes of a word that may enter the lexicon


# ---- vocabulary ------------------------------------------------------------------------------------------------


class Vocabulary:
    """Tokens and merges of a byte-level BPE file in arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = special_string(path)
        back = {c: b for b, c in byte_alphabet().items()}
        vocab = spec["model"]["vocab"]
        pieces: dict[int, bytes] = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
        self.special_id = -1
        for a in spec.get("added_tokens") or []:
            pieces[a["id"]], self.special_id = a["content"].encode(), a["id"]
        size = max(pieces) + 1
        self.bytes = np.frombuffer(b"".join(pieces.get(i, b"") for i in range(size)), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(pieces.get(i, b"")) for i in range(size)])])
        letters = byte_alphabet()
        self.byte_ids = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left, right = np.array([vocab[a] for a, _ in merges]), np.array([vocab[b] for _, b in merges])
        self.result = np.array([vocab[a + b] for a, b in merges], np.int64)
        # open addressing: pair -> rank
        self.mask = (1 << 18) - 1
        pair = (left.astype(np.int64) << 32) | right
        self.table = np.full(self.mask + 1, -1, np.int64)
        self.rank = np.zeros(self.mask + 1, np.int64)
        waiting, step = np.arange(len(pair)), 0
        while len(waiting):
            slot = (self._hash(pair[waiting]) + step) & self.mask
            free = self.table[slot] == -1
            first = np.unique(np.where(free, slot, -1), return_index=True)[1]
            first = first[free[first]]
            self.table[slot[first]], self.rank[slot[first]] = pair[waiting[first]], waiting[first]
            waiting, step = np.delete(waiting, first), step + 1
        self.steps = step

    @staticmethod
    def _hash(pair: np.ndarray) -> np.ndarray:
        return ((pair.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(40)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair; NONE if the pair does not merge."""
        pair = (left << 32) | right
        out = np.full(len(pair), NONE, np.int64)
        h, open_ = self._hash(pair), np.arange(len(pair))
        for step in range(self.steps):
            slot = (h[open_] + step) & self.mask
            found = self.table[slot]
            hit = found == pair[open_]
            out[open_[hit]] = self.rank[slot[hit]]
            open_ = open_[~hit & (found != -1)]
            if not len(open_):
                break
        return out

    def merge(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact BPE of byte spans: (ids of all, number of ids of each)."""
        length = ends - starts
        counts = np.zeros(len(starts), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        order = np.argsort(length, kind="stable")
        at = 0
        while at < len(order):  # blocks of words of like length
            widest = max(8, int(length[order[at]] * 1.25))
            size = max(1, min(1 << 16, (1 << 21) // widest))
            end = min(at + size, int(np.searchsorted(length[order], widest, side="right")))
            who = order[at:end]
            ids, n = self._merge_block(buf, starts[who], length[who])
            counts[who] = n
            parts.append((who, ids))
            at = end
        place = np.concatenate([[0], np.cumsum(counts)])
        out = np.zeros(place[-1], np.int64)
        for who, ids in parts:
            out[spread(place[:-1][who], counts[who])] = ids
        return out, counts

    def _merge_block(self, buf: np.ndarray, starts: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width = max(int(length.max(initial=0)), 1)
        col = np.arange(width)
        ids = self.byte_ids[buf[np.minimum(starts[:, None] + col, len(buf) - 1)]]
        ids[col >= length[:, None]] = -1
        n, live = length.copy(), np.flatnonzero(length > 1)
        work = ids[live]
        rank = np.full(work.shape, NONE, np.int64)
        todo = np.ones(work.shape, bool)
        while len(live):
            todo[:, -1] = False
            todo[:, :-1] &= work[:, 1:] >= 0
            r, c = np.nonzero(todo)
            rank[r, c] = self.ranks(work[r, c], work[r, c + 1])
            least = rank.min(axis=1)
            going = least != NONE
            if not going.all():
                ids[live[~going], : work.shape[1]] = work[~going]
                live, work, rank, least = live[going], work[going], rank[going], least[going]
                if not len(live):
                    break
            hit = rank == least[:, None]
            for k in range(1, hit.shape[1]):  # left to right, without overlap
                np.logical_and(hit[:, k], ~hit[:, k - 1], out=hit[:, k])
            work[hit] = np.broadcast_to(self.result[least][:, None], work.shape)[hit]
            gone = np.zeros_like(hit)
            gone[:, 1:] = hit[:, :-1]
            # close the gaps: a stable order that puts removed places last
            keep = ~gone & (work >= 0)
            new_n = keep.sum(axis=1)
            width = int(new_n.max())
            place = np.cumsum(keep, axis=1) - 1
            r, c = np.nonzero(keep)
            packed = np.full((len(live), width), -1, np.int64)
            packed[r, place[r, c]] = work[r, c]
            was = np.full((len(live), width), NONE, np.int64)
            was[r, place[r, c]] = rank[r, c]
            touched = np.zeros((len(live), width), bool)
            touched[r, place[r, c]] = hit[r, c]
            todo = touched.copy()
            todo[:, :-1] |= touched[:, 1:]
            was[todo] = NONE
            was[np.arange(len(live)), new_n - 1] = NONE
            n[live] = new_n
            ids[live] = -1
            work, rank = packed, was
        mask = np.arange(ids.shape[1]) < n[:, None]
        return ids[mask], n


NONE = np.int64(1 << 40)


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0]+1, ... (count[0] of them), begin[1], ..."""
    total = int(count.sum())
    out = np.ones(total, np.int64)
    has = np.flatnonzero(count > 0)
    if not len(has):
        return out[:0]
    b, c = begin[has], count[has]
    at = np.concatenate([[0], np.cumsum(c)[:-1]])
    out[0] = b[0]
    out[at[1:]] = b[1:] - (b[:-1] + c[:-1] - 1)
    return np.cumsum(out)


# ---- lexicon ---------------------------------------------------------------------------------------------------


def build_lexicon(words: list[bytes], ids: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Minimal acyclic transducer of sorted distinct words: a sorted array of arcs, each state * 256 + byte, with
    their targets and outputs."""
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []  # (accepts, arcs) of finished states
    path: list[list] = [[False, []]]  # unfinished states of the current word: accepts, arcs
    last = b""

    def finish(node: list) -> int:
        key = (node[0], tuple(node[1]))
        found = register.get(key)
        if found is None:
            found = register[key] = len(states)
            states.append(key)
        return found

    def fold(depth: int) -> None:
        while len(path) - 1 > depth:
            node = path.pop()
            byte = last[len(path) - 1]
            path[-1][1].append((byte, finish(node)))

    for word in words:
        common = len(os.path.commonprefix([last, word]))
        fold(common)
        path.extend([False, []] for _ in word[common:])
        path[-1][0] = True
        last = word
    fold(0)
    root = finish(path[0])
    paths = np.zeros(len(states), np.int64)
    arc, to, out = [], [], []
    for s, (accepts, arcs) in enumerate(states):  # targets come before their sources
        n = int(accepts)
        for byte, target in arcs:
            arc.append(s * 256 + byte)
            to.append(target)
            out.append(n)
            n += int(paths[target])
        paths[s] = n
    order = np.argsort(np.array(arc, np.int64), kind="stable")
    place = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    return {
        "root": np.array([root], np.int64), "accepts": np.array([a for a, _ in states], np.int64),
        "arc": np.array(arc, np.int64)[order], "to": np.array(to, np.int64)[order], "out": np.array(out, np.int64)[order],
        "ids": ids.astype(np.int64), "place": place,
    }


def save_lexicon(parts: dict[str, np.ndarray], path: str) -> None:
    """One file: a line of JSON with the arrays' lengths, then their values."""
    head = json.dumps({k: len(v) for k, v in parts.items()}).encode()
    with open(path, "wb") as f:
        f.write(head + b" " * (-(len(head) + 1) % 8) + b"\n")
        for v in parts.values():
            f.write(np.ascontiguousarray(v, np.int64).tobytes())


class Lexicon:
    """A memory-mapped transducer."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            head = f.readline()
        whole = np.memmap(path, np.int64, mode="r", offset=len(head))
        at = 0
        for k, n in json.loads(head).items():
            setattr(self, k, whole[at : at + n])
            at += n

    def find(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Rank of each span among the words, -1 for others; all spans take each step together."""
        length = ends - starts
        out = np.full(len(starts), -1, np.int64)
        who = np.flatnonzero((length > 0) & (length <= LONGEST_WORD))
        if not len(who) or not len(self.arc):
            return out
        state, rank, step = np.full(len(who), self.root[0]), np.zeros(len(who), np.int64), 0
        while len(who):
            key = state * 256 + buf[starts[who] + step]
            at = np.minimum(np.searchsorted(self.arc, key), len(self.arc) - 1)
            ok = self.arc[at] == key
            who, at, rank = who[ok], at[ok], rank[ok]
            rank, state, step = rank + self.out[at], self.to[at], step + 1
            done = length[who] == step
            good = done & (self.accepts[state] == 1)
            out[who[good]] = rank[good]
            who, rank, state = who[~done], rank[~done], state[~done]
        return out


@functools.cache
def lexicon(name: str) -> Lexicon:
    return Lexicon(SparkFiles.get(name))


def frequent_words(docs: DataFrame, path: str, share: float = SHARE) -> list[bytes]:
    """Every pre-token (up to LONGEST_WORD bytes) that makes up `share` of all pre-tokens: at most 1/share of them."""
    runs, special = classes(), (special_string(path) or "\0\0none").encode()

    def count(batches):
        use_classes(runs)
        seen: dict[bytes, int] = {}
        total = 0
        for batch in batches:
            for piece in cut(batch, "text", SLICE):
                buf, off = flat(piece.column(0))
                for _, lo, hi, sub in byte_slices(buf, off, SLICE):
                    if hi == lo:
                        continue
                    part = padded(buf, lo, hi)
                    starts, ends, _ = pretokens(part, sub, special)
                    keys = Keys(part, starts, ends)
                    n = np.bincount(keys.code, minlength=len(keys.first))
                    total += len(starts)
                    which = np.flatnonzero((keys.ends - keys.starts <= LONGEST_WORD) & (n > share / 2 * len(starts)))
                    for w, k in zip(keys.bytes_of(part, which), n[which].tolist(), strict=True):
                        seen[w] = seen.get(w, 0) + k
                    if len(seen) > 4 / share:
                        seen = {w: k for w, k in seen.items() if k > share / 2 * total}
        seen = {w: k for w, k in seen.items() if k > share / 2 * total}
        yield pa.RecordBatch.from_arrays(
            [pa.array([b"", *seen], pa.binary()), pa.array([total, *seen.values()], pa.int64())], ["word", "n"]
        )

    counted = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    rows = stored(counted, "pretokens")
    total = rows.filter(F.length("word") == 0).agg(F.sum("n")).first()[0] or 0
    kept = rows.filter((F.length("word") > 0) & (F.col("n") >= share * total))
    return sorted(bytes(r[0]) for r in kept.select("word").collect())  # at most 1/share rows


def compile_lexicon(docs: DataFrame, tokenizer: str, share: float = SHARE) -> str:
    """Build the lexicon of a corpus and ship it; returns the file's name on every executor."""
    found = frequent_words(docs, tokenizer, share)
    buf = np.frombuffer(b"".join(found) + b"\0" * 8, np.uint8)
    ends = np.cumsum([len(w) for w in found]).astype(np.int64)
    starts = ends - np.array([len(w) for w in found], np.int64)
    ids, counts = vocabulary(tokenizer).merge(buf, starts, ends)
    parts = build_lexicon(found, ids, counts)
    name = f"brindle-lexicon-{uuid.uuid4().hex}.bin"  # a name can be added once in a session
    folder = tempfile.mkdtemp(prefix="brindle-")
    save_lexicon(parts, f"{folder}/{name}")
    docs.sparkSession.sparkContext.addFile(f"{folder}/{name}")
    return name


# ---- encoding and decoding ----------------------------------------------------------------------------------------


def encode(buf: np.ndarray, off: np.ndarray, vocab: Vocabulary, lex: Lexicon | None, limit: int = SLICE) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and offsets of each text's."""
    total = np.zeros(len(off) - 1, np.int64)
    pieces: list[np.ndarray] = []
    special = (vocab.special or "\0\0none").encode()
    for doc, lo, hi, sub in byte_slices(buf, off, limit):
        if hi == lo:
            continue
        part = padded(buf, lo, hi)
        starts, ends, is_special = pretokens(part, sub, special)
        keys = Keys(part, starts, ends)
        code = keys.code
        rank = lex.find(part, keys.starts, keys.ends) if lex is not None else np.full(len(keys.first), -1, np.int64)
        new = np.flatnonzero(rank < 0)
        merged, n_new = vocab.merge(part, keys.starts[new], keys.ends[new])
        known = np.flatnonzero(rank >= 0)
        count, begin = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        pool = [merged]
        count[new], begin[new] = n_new, np.cumsum(n_new) - n_new
        if len(known):
            count[known] = lex.place[rank[known] + 1] - lex.place[rank[known]]
            begin[known] = len(merged) + np.cumsum(count[known]) - count[known]
            pool.append(lex.ids[spread(lex.place[rank[known]], count[known])])
        if is_special.any():
            s = code[np.flatnonzero(is_special)[0]]
            count[s], begin[s] = 1, sum(map(len, pool))
            pool.append(np.array([vocab.special_id], np.int64))
        flat_ids = np.concatenate(pool)
        each = count[code]
        pieces.append(flat_ids[spread(begin[code], each)].astype("<u4"))
        cum = np.concatenate([[0], np.cumsum(each)])
        at = np.searchsorted(starts, sub)
        total[doc : doc + len(sub) - 1] += cum[at[1:]] - cum[at[:-1]]
    return np.concatenate(pieces) if pieces else np.zeros(0, "<u4"), np.concatenate([[0], np.cumsum(total)])


def decode(ids: np.ndarray, vocab: Vocabulary) -> bytes:
    """The tokens' bytes; replace what is not UTF-8 when reading them as text."""
    ids = ids.astype(np.int64)
    begin = vocab.offsets[ids]
    return vocab.bytes[spread(begin, vocab.offsets[ids + 1] - begin)].tobytes()


def encoded(docs: DataFrame, tokenizer: str | None = None, share: float = SHARE, digests: bool = False, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the carried columns, n_tokens, then token ids (array<int>), or the digests of ids and decoded text."""
    path, runs = tokenizer or default_tokenizer(), classes()
    bounded_arrow(docs.sparkSession)
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("doc_id"), *carry)
    name = compile_lexicon(rows, path, share)
    give_back()

    def run(batches):
        use_classes(runs)
        vocab, lex = vocabulary(path), lexicon(name)
        for batch in batches:
            for piece in cut(batch):
                buf, off = flat(piece.column(0))
                ids, at = encode(buf, off, vocab, lex)
                rest = piece.columns[1:]
                names = piece.schema.names[1:]
                n = pa.array(np.diff(at))
                if not digests:
                    yield pa.RecordBatch.from_arrays([*rest, n, pa.ListArray.from_arrays(at.astype(np.int32), ids.astype(np.int32))], [*names, "n_tokens", "ids"])
                    continue
                ids_sha, text_sha = [], []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    ids_sha.append(hashlib.sha256(ids[a:b].tobytes()).hexdigest())
                    text_sha.append(hashlib.sha256(decode(ids[a:b], vocab).decode("utf-8", "replace").encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([*rest, n, pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], [*names, "n_tokens", "ids_sha256", "decoded_sha256"])

    kinds = dict(rows.dtypes)
    head = ", ".join(f"`{c}` {kinds[c]}" for c in rows.columns[1:])
    return rows.mapInArrow(run, f"{head}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>"))


def decoded(tokens: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id and text of a table of doc_id and ids; null ids give the empty text."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            texts = [decode(np.array(x or [], np.int64), vocab).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
