"""Quality classifier: supervised subword embeddings with a softmax, trained by numpy stochastic gradient descent.

Features of a text are hashed into buckets in three groups: words, pairs of neighbouring words (a word repeated at once
has a bucket of its own), and byte n-grams inside words.  A text's vector is the sum of the three groups' average
vectors.  Vectors and softmax weights are learned together.  For scoring, each bucket's vector is folded with the
softmax into one number, so a text of any length costs a gather and a sum for each feature.

Only the training rows are bounded: at most MAX_TRAIN labelled rows, chosen by a seeded hash of the id, of texts up to
MAX_TRAIN_BYTES.  Every text is scored whole.

Defined results: null and empty texts have no features and get the score of the bias; without any labelled row, or with
a single class, every score is the share of label 1 (0.5 without labels); labels of null quality are not used; repeated
rows are scored each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import bounded_arrow
from .textkit import U64, _IS_WS, _MASK, flat, give_back, hash_spans, mapper, mix, words

MAX_TRAIN, MAX_TRAIN_BYTES = 4000, 32_768
BUCKETS, DIM, EPOCHS, BATCH, RATE, SEED = 1 << 17, 8, 12, 64, 0.25, 7
NGRAMS = (3, 4, 5)


def features(buf: np.ndarray, off: np.ndarray):
    """For each group: (bucket of each feature, its text)."""
    starts, ends, wb = words(buf, off)
    n, m = int(off[-1]), U64(BUCKETS - 1)
    h = hash_spans(buf, starts, ends)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(wb))
    yield (h & m).astype(np.int64), doc
    if len(h) > 1:
        pair = mix(h[:-1] * U64(3) ^ mix(h[1:]))
        pair[h[:-1] == h[1:]] = U64(1)
        inside = doc[:-1] == doc[1:]
        yield (pair[inside] & m).astype(np.int64), doc[:-1][inside]
    else:
        yield np.zeros(0, np.int64), np.zeros(0, np.int64)
    view = np.ndarray((len(buf) - 7,), "<u8", buffer=buf, strides=(1,))
    left = np.repeat(ends, ends - starts) if len(starts) else np.zeros(0, np.int64)
    at = np.flatnonzero(~_IS_WS[buf[:n]])
    byte_doc = np.repeat(doc, ends - starts)
    buckets, docs = [], []
    for k in NGRAMS:
        ok = left - at >= k
        buckets.append((mix((view[at[ok]] & _MASK[k]) + U64(k)) & m).astype(np.int32))
        docs.append(byte_doc[ok])
    yield np.concatenate(buckets), np.concatenate(docs)


class Model:
    def __init__(self, z: np.ndarray, bias: float):
        self.z, self.bias = z, bias

    def score(self, texts: pa.Array) -> np.ndarray:
        buf, off = flat(texts)
        n = len(off) - 1
        logit = np.full(n, self.bias)
        for bucket, doc in features(buf, off):
            logit += np.bincount(doc, self.z[bucket], n) / np.maximum(np.bincount(doc, minlength=n), 1)
        return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def train(texts: list[str | None], labels: np.ndarray, seed: int = SEED) -> Model:
    labels = np.asarray(labels, np.int64)
    share = float(labels.mean()) if len(labels) else 0.5
    if len(labels) < 2 or share in (0.0, 1.0):
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    order, batches = rng.permutation(len(texts)), []
    for i in range(0, len(order), BATCH):
        who = order[i : i + BATCH]
        buf, off = flat(pa.array([texts[k] for k in who], pa.string()))
        keys, weights = [], []
        for bucket, doc in features(buf, off):
            keys.append(doc.astype(np.int64) * BUCKETS + bucket)
            weights.append(1 / np.bincount(doc, minlength=len(who))[doc])
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        weight = np.bincount(back, np.concatenate(weights))
        used, local = np.unique(key % BUCKETS, return_inverse=True)
        # nine bytes a feature: the batches are the most that the driver holds
        batches.append((used, local.astype(np.int32), (key // BUCKETS).astype(np.uint8), weight.astype(np.float32), labels[who]))
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    soft, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    grown, g_soft, g_bias = np.full(BUCKETS, 1e-6, np.float32), np.full((DIM, 2), 1e-6), np.full(2, 1e-6)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for b in rng.permutation(len(batches)):
            used, local, doc, weight, y = batches[b]
            n, v = len(y), vectors[used]
            text = np.stack([np.bincount(doc, weight * v[local, k], n) for k in range(DIM)], axis=1)
            out = text @ soft + bias
            p = np.exp(out - out.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(n), y] -= 1
            p /= n
            back = p @ soft.T
            g = np.stack([np.bincount(local, weight * back[doc, k], len(used)) for k in range(DIM)], axis=1)
            d_soft, d_bias = text.T @ p, p.sum(axis=0)
            g_soft += d_soft**2
            g_bias += d_bias**2
            soft -= (rate * d_soft / np.sqrt(g_soft)).astype(np.float32)
            bias -= (rate * d_bias / np.sqrt(g_bias)).astype(np.float32)
            grown[used] += (g**2).sum(axis=1)
            vectors[used] -= rate * g / np.sqrt(grown[used])[:, None]
    return Model((vectors @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def held_out(id_col) -> F.Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> Model:
    """A model of at most `limit` labelled rows that are not held out."""
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.select(F.col("doc_id").cast("long").alias("_id"), "quality").orderBy(F.xxhash64("_id"), "_id", "quality").limit(limit)
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = texts.filter(F.octet_length("text") <= MAX_TRAIN_BYTES).join(F.broadcast(chosen), "_id")
    got = rows.select("_id", "text", F.col("quality").cast("int").alias("y")).orderBy(F.xxhash64("_id"), "_id", "y").limit(limit).collect()
    texts, y = [r["text"] for r in got], np.array([r["y"] for r in got])
    del got
    model = train(texts, y)
    del texts
    give_back()
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    bounded_arrow(docs.sparkSession)
    model = fit(docs, labels)

    def one(piece: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(model.score(piece.column(2)))], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(mapper(one), "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that the classifier accepts, with their own columns, scored and filtered in one pass."""
    bounded_arrow(docs.sparkSession)
    model, names = fit(docs, labels), docs.columns
    at = names.index("text")

    def one(piece: pa.RecordBatch) -> pa.RecordBatch:
        return piece.filter(pa.array(model.score(piece.column(at).cast(pa.string())) >= threshold))

    return docs.mapInArrow(mapper(one), docs.schema)
