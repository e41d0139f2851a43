"""Token counts: batch encoding inside Arrow functions that return lengths only.

Texts reach Python in Arrow batches; these are cut into slices balanced by bytes, and a text longer than a slice is
cut at safe boundaries (before a space between two letters, where a pre-token begins whatever surrounds it).  A slice's
distinct pre-tokens form one batch for the library's own BPE model; only the number of tokens of each is kept, and a
text's count is the sum over its pre-tokens.  A fixed-size table remembers counts by the pre-token's own bytes, so the
memory of a worker does not depend on the vocabulary of the corpus.

Defined results: a null or empty text has no bytes and no tokens; the vocabulary's special strings inside a text count
as one token, as is the library's default; repeated rows are counted each; an empty table gives an empty result; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import WIDE, Keys, byte_slices, classes, padded, pretokens, use_classes
from .session import bounded_arrow
from .textkit import U64, flat, mapper

SCHEMA = "doc_id long, n_bytes long, n_tokens long"
ENCODE_BYTES = 2 << 20
REMEMBERED = 1 << 19


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[int, str]:
    """Byte to printable character, as byte-level BPE vocabularies spell their tokens."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def special_string(path: str) -> str | None:
    """The one added token of a byte-level vocabulary; anything else is refused."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = spec.get("added_tokens") or []
    plain = spec["model"]["type"] == "BPE" and spec["pre_tokenizer"]["type"] == "ByteLevel" and not spec.get("normalizer")
    if not plain or spec["pre_tokenizer"].get("add_prefix_space") or len(added) > 1 or any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added):
        raise ValueError(f"not a plain byte-level BPE vocabulary with at most one added token: {path}")
    return added[0]["content"] if added else None


@functools.cache
def _counter(path: str) -> Counter:
    return Counter(path)


class Counter:
    """Counts tokens of texts; one per worker process."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path).model
        self.special = (special_string(path) or "\0\0none").encode()
        self.letters = {b: c for b, c in byte_alphabet().items()}
        self.keys = np.zeros((REMEMBERED, WIDE // 8), U64)
        self.lengths = np.zeros(REMEMBERED, np.int32)
        self.counts = np.zeros(REMEMBERED, np.int32)

    def distinct(self, buf: np.ndarray, keys: Keys) -> np.ndarray:
        """The number of tokens of each distinct pre-token."""
        length = (keys.ends - keys.starts).astype(np.int32)
        slot = (keys.hash & U64(REMEMBERED - 1)).astype(np.int64)
        known = (self.lengths[slot] == length) & (length <= WIDE)
        for c, part in enumerate(keys.parts):
            known &= self.keys[slot, c] == part
        out = np.where(known, self.counts[slot], 0)
        new = np.flatnonzero(~known)
        if len(new):
            spelled, tokenize = buf.tobytes().decode("latin-1").translate(self.letters), self.model.tokenize
            out[new] = [len(tokenize(spelled[a:b])) for a, b in zip(keys.starts[new].tolist(), keys.ends[new].tolist(), strict=True)]
            new = new[length[new] <= WIDE]
            new = new[np.unique(slot[new], return_index=True)[1]]
            at = slot[new]
            self.lengths[at], self.counts[at] = length[new], out[new]
            for c, part in enumerate(keys.parts):
                self.keys[at, c] = part[new]
        return out

    def count(self, buf: np.ndarray, off: np.ndarray, limit: int = ENCODE_BYTES) -> np.ndarray:
        total = np.zeros(len(off) - 1, np.int64)
        for doc, lo, hi, sub in byte_slices(buf, off, limit):
            if hi == lo:
                continue
            part = padded(buf, lo, hi)
            starts, ends, special = pretokens(part, sub, self.special)
            keys = Keys(part, starts, ends)
            each = self.distinct(part, keys)[keys.code]
            each[special] = 1
            cum = np.concatenate([[0], np.cumsum(each)])
            at = np.searchsorted(starts, sub)
            total[doc : doc + len(sub) - 1] += cum[at[1:]] - cum[at[:-1]]
        return total


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row."""
    path, runs = tokenizer or default_tokenizer(), classes()
    special_string(path)
    bounded_arrow(docs.sparkSession)

    def one(piece: pa.RecordBatch) -> pa.RecordBatch:
        use_classes(runs)
        buf, off = flat(piece.column(1))
        n = _counter(path).count(buf, off)
        return pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.diff(off)), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(mapper(one), SCHEMA).withColumn("over_limit", F.col("n_tokens") > limit)
