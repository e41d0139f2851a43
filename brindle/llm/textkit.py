"""Vectorised text primitives shared by the corpus operators.

Every routine works on one flat UTF-8 buffer plus document offsets, the way Arrow stores
a string column, so no Python object is made per word.  Nulls are read as empty texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20  # numpy temporaries are about 60 times this
U64 = np.uint64
_IS_WS = np.zeros(256, bool)
_IS_WS[[0x20, 9, 10, 11, 12, 13]] = True
_MASK = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 8)] + [2**64 - 1], dtype=U64)
_C1, _C2, _P = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53), U64(0x9E3779B97F4A7C15)
_S33, _S29 = U64(33), U64(29)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; eight zero bytes of padding follow the last text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(8, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    lo, hi = int(off[0]), int(off[-1])
    buf = np.zeros(hi - lo + 8, np.uint8)
    if hi > lo:
        buf[:-8] = np.frombuffer(data, np.uint8)[lo:hi]
    return buf, off - lo


def cut(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` text bytes each; one longer text gets its own slice."""
    pa.set_memory_pool(pa.system_memory_pool())  # Arrow's own pool keeps what it once held
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16
    total, begin = np.cumsum(size), 0
    while begin < batch.num_rows:
        base = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def give_back() -> None:
    """Return this process's freed memory to the system, where the C library can."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mapper(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], column: str = "text", limit: int = SLICE_BYTES):
    """A mapInArrow function that applies `fn` to byte-bounded slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in cut(batch, column, limit):
                out = fn(piece)
                if out is not None and out.num_rows:
                    yield out

    return run


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> _S33)
    h *= _C1
    h ^= h >> _S29
    h *= _C2
    h ^= h >> _S33
    return h


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+`, and for each text the index of its first word (and the total)."""
    n = int(off[-1])
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    on = ~_IS_WS[buf[:n]]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    begin = on.copy()
    begin[1:] &= ~on[:-1] | edge[1:n]
    end = on.copy()
    end[:-1] &= ~on[1:] | edge[1:n]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, off)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans; the buffer must have eight bytes of padding."""
    length = ends - starts
    out = mix(length.astype(U64) * _P + U64(seed * 2 + 1))
    view = np.ndarray((len(buf) - 7,), "<u8", buffer=np.ascontiguousarray(buf), strides=(1,))
    at, left, who = starts, length, None
    while True:
        if who is None:
            if not len(at) or left.max(initial=0) <= 0:
                break
            out = mix(out ^ (view[at] & _MASK[np.clip(left, 0, 8)]))
            who = np.flatnonzero(left > 8)
        else:
            out[who] = mix(out[who] ^ (view[at] & _MASK[np.clip(left, 0, 8)]))
            who = who[left > 8]
        if not len(who):
            break
        done = 8 if at is starts else done + 8
        at, left = starts[who] + done, length[who] - done
    return out


def windows(h: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n consecutive words inside a text, and the index of each run's first word."""
    if len(h) < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        powers, have, size = h, 1, 1  # powers[i]: hash of the 2^k words from i
        acc, taken, p = None, 0, _P
        rest = n
        while rest:
            if rest & 1:
                if acc is None:
                    acc, taken = powers, have
                else:
                    m = len(h) - taken - have + 1
                    acc = acc[:m] * U64(pow(int(_P), have, 2**64)) + powers[taken : taken + m]
                    taken += have
            rest >>= 1
            if rest:
                m = len(h) - 2 * have + 1
                powers = powers[:m] * U64(pow(int(_P), have, 2**64)) + powers[have : have + m]
                have *= 2
    ok = np.ones(len(acc), bool)
    for k in range(1, n):  # a run must not cross into the next text
        b = bounds[1:-1] - k
        ok[b[(b >= 0) & (b < len(ok))]] = False
    at = np.flatnonzero(ok)
    return mix(acc[at]), at


def counts_by(bounds: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Sums of `flags` between consecutive bounds."""
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return c[bounds[1:]] - c[bounds[:-1]]


def cover(n: int, at: np.ndarray, width: int) -> np.ndarray:
    """Boolean cover of [0, n) by the runs [at, at + width)."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, at, 1)
    np.add.at(d, np.minimum(at + width, n), -1)
    return np.cumsum(d[:-1]) > 0
