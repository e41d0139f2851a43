"""Substring dedup: words covered by a window of `width` words that also starts elsewhere are removed.

The index is log-structured.  A window's fingerprint is the least hash among the runs of `GRAM` words inside it
(winnowing), so equal windows have equal fingerprints and neighbouring windows mostly share one: about one stored hash
for every 14 words.  A batch of documents becomes an immutable run of (fingerprint, document), bucketed and sorted by
fingerprint, so that neither probes of a run nor compaction need an exchange.  Runs are compacted, size tier by size tier, so there are never
more than `FAN_IN - 1` in a tier.

1. `FingerprintIndex.add` writes the run of a batch and merge-joins it with itself and every run before it.  Documents
   of either side get the fingerprints that another place has as marks; a window whose fingerprint is nowhere else
   cannot repeat.  Fingerprints above a share of a batch (`freqItems`, at most 1/support of them, whatever the input)
   stay out of the runs: they are broadcast and count as repeated, and their rows are kept as they came.
2. Marked windows are verified by a 96-bit hash of all their words: counts with map-side combine, so a passage that a
   third of the documents share is one row for each task.  A hash seen once also tells where, and those places, not the
   repeated ones, go back to the documents.
3. Each document's marked windows without the places sent back are what repeats.

No window, partner or bucket is capped.  Defined results: null and empty texts have no words and keep none; documents
shorter than a window keep all; rows that repeat both id and text repeat each
other's windows, and rows that share only the id are told apart by their text; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import support_for
from .session import bounded_arrow, remove, shared_dir, stored
from .textkit import counts_by, cut, flat, hash_spans, mix, windows, words

WIDTH, GRAM, FAN_IN = 35, 8, 2


def _leftmost_least(g: np.ndarray, n: int) -> np.ndarray:
    """Position of the leftmost least value in each run of n."""
    v, p, have = g, np.arange(len(g)), 1
    while have < n:
        shift = min(have, n - have)
        a, b = slice(0, len(v) - shift), slice(shift, len(v))
        right = v[b] < v[a]
        v, p = np.where(right, v[b], v[a]), np.where(right, p[b], p[a])
        have += shift
    return p


class Prints:
    """Word hashes of a slice of texts and the fingerprint of every window."""

    def __init__(self, texts: pa.Array, width: int):
        self.buf, self.off = flat(texts)
        self.starts, self.ends, self.bounds = words(self.buf, self.off)
        self.h = hash_spans(self.buf, self.starts, self.ends)
        gram = min(GRAM, width)
        self.whole, self.at = windows(self.h, self.bounds, width)  # hashes of full windows and their first words
        if len(self.at):
            g, place = windows(self.h, np.array([0, len(self.h)]), gram)
            least = _leftmost_least(g, width - gram + 1)[self.at]
            self.least, self.print = place[least], g[least]
        else:
            self.least, self.print = self.at, self.whole
        self.doc = np.searchsorted(self.bounds, self.at, side="right") - 1

    def second(self, which: np.ndarray, width: int) -> np.ndarray:
        """An independent 32-bit hash of the chosen windows."""
        other, _ = windows(mix(self.h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), self.bounds, width)
        return (other[which] >> np.uint64(32)).astype(np.uint32).view(np.int32)


class FingerprintIndex:
    """Immutable runs of (print, key), bucketed and sorted by print, under a shared folder."""

    def __init__(self, spark: SparkSession, width: int = WIDTH, fan_in: int = FAN_IN):
        self.spark, self.width, self.fan_in = spark, width, fan_in
        self.path = f"{shared_dir(spark)}/brindle-index-{uuid.uuid4().hex}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[int, str]] = []  # tier, table
        self.hot: list[tuple[DataFrame, DataFrame]] = []  # of each batch, its frequent prints (at most 1/support) and their rows

    def _write(self, rows: DataFrame, tier: int) -> str:
        name = f"brindle_run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "print").sortBy("print").option("path", f"{self.path}/{name}").saveAsTable(name, format="parquet")
        self.runs.append((tier, name))
        return name

    def _remove(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, f"{self.path}/{name}")

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Append the run of a new batch (key, text) and compact full tiers; marks (key, print) of its documents and of
        earlier ones whose fingerprints are now repeated."""
        own = stored(_own_prints(_keyed(docs, id_col, text_col), self.width), "prints")
        heavy = own.freqItems(["print"], support_for(own)).select(F.explode("print_freqItems").alias("print"))
        heavy = F.broadcast(stored(heavy, "heavy"))
        before = [self.spark.table(t) for _, t in self.runs]
        new = self.spark.table(self._write(own.join(heavy, "print", "left_anti").repartition(self.buckets, "print"), 0))
        hot = stored(own.join(heavy, "print", "left_semi").select("key", "print"), "hot")
        again = new.groupBy("print").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("print")
        found = [hot, new.join(again, "print")]
        for frequent, rows in self.hot:
            here = own.select("print").join(frequent, "print", "left_semi").distinct()
            found += [new.join(frequent, "print", "left_semi"), rows.join(F.broadcast(here), "print", "left_semi")]
        for old in before:
            found += [new.join(old, "print", "left_semi"), old.join(new, "print", "left_semi"), old.join(heavy, "print", "left_semi")]
        marks = found[0].select("key", "print")
        for f in found[1:]:
            marks = marks.unionByName(f.select("key", "print"))
        marks = stored(marks, "marks")
        self.hot.append((heavy, hot))
        remove(self.spark, own.stored_at)
        tier = 0
        while len(full := [t for k, t in self.runs if k == tier]) >= self.fan_in:
            self._merge(full, tier + 1)
            tier += 1
        return marks

    def _merge(self, names: list[str], tier: int) -> None:
        merged = self.spark.table(names[0])
        for t in names[1:]:
            merged = merged.unionByName(self.spark.table(t))
        conf, name = self.spark.conf, "spark.sql.sources.bucketing.autoBucketedScan.enabled"
        was = conf.get(name)
        conf.set(name, "false")  # read by buckets, which the union and the writer then keep
        self._write(merged, tier)
        conf.set(name, was)
        self.runs = [(k, t) for k, t in self.runs if t not in names]
        for t in names:
            self._remove(t)

    def compact(self) -> None:
        if len(self.runs) > 1:
            self._merge([t for _, t in self.runs], max(k for k, _ in self.runs) + 1)

    def drop(self) -> None:
        for _, t in self.runs:
            self._remove(t)
        for _, rows in self.hot:
            remove(self.spark, rows.stored_at)
        remove(self.spark, self.path)
        self.runs, self.hot = [], []


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows that agree in key and part repeat each other, and so do their windows."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.withColumns({"key": F.xxhash64("doc_id", "text"), "part": F.hash("text", "doc_id")})


def _own_prints(docs: DataFrame, width: int) -> DataFrame:
    """(key, print): the distinct fingerprints of each document, twice those that it has at several places."""

    def run(batches):
        for batch in batches:
            for piece in cut(batch):
                x = Prints(piece.column(1), width)
                if not len(x.at):
                    continue
                _, first = np.unique(x.least, return_index=True)  # each place once; a place is in one document
                d, v = x.doc[first], x.print[first]
                order = np.lexsort((v, d))
                d, v = d[order], v[order]
                new = np.ones(len(d), bool)
                new[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
                new[1:] |= new[:-1]  # and the second
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(d[new])), pa.array(v[new].view(np.int64))], ["key", "print"])

    return docs.select("key", "text").mapInArrow(run, "key long, print long")


def _chosen(x: Prints, marks: pa.Array, k: int) -> np.ndarray:
    """Of text k, the indexes of the windows whose fingerprint is marked."""
    a, b = np.searchsorted(x.doc, k), np.searchsorted(x.doc, k, side="right")
    mine = np.asarray(marks).view(np.uint64)
    return a + np.flatnonzero(np.isin(x.print[a:b], mine))


def _candidates(joined: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for piece in cut(batch, "text"):
                x, marks = Prints(piece.column(1), width), piece.column(2)
                got = [_chosen(x, marks[k].values, k) for k in range(piece.num_rows) if marks[k].is_valid]
                which = np.concatenate(got) if got else np.zeros(0, np.int64)
                if not len(which):
                    continue
                h1, h2 = x.whole[which], x.second(which, width)
                order = np.lexsort((h2, h1))
                h1, h2, which = h1[order], h2[order], which[order]
                first = np.ones(len(h1), bool)
                first[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                at = np.flatnonzero(first)
                n = np.diff(np.append(at, len(h1)))
                w = which[at]
                row = x.doc[w]
                part = piece.column(3).to_numpy()[row].astype(np.int64)
                place = (part << 32) | (x.at[w] - x.bounds[row])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1[at].view(np.int64)), pa.array(h2[at]), pa.array(np.minimum(n, 2).astype(np.int32)), piece.column(0).take(pa.array(row)), pa.array(place)],
                    ["h1", "h2", "n", "key", "place"],
                )

    return joined.mapInArrow(run, "h1 long, h2 int, n int, key long, place long")


def _judged(joined: DataFrame, width: int, texts: bool) -> DataFrame:
    def run(batches):
        for batch in batches:
            for piece in cut(batch, "text"):
                x = Prints(piece.column(1), width)
                marks, single, part = piece.column(2), piece.column(5), piece.column(3)
                gone = np.zeros(len(x.h) + 1, np.int32)
                for k in range(piece.num_rows):
                    if not marks[k].is_valid:
                        continue
                    at = x.at[_chosen(x, marks[k].values, k)]
                    if single[k].is_valid:
                        once = np.asarray(single[k].values)
                        once = once[once >> 32 == part[k].as_py()] & 0xFFFFFFFF
                        at = at[~np.isin(at - x.bounds[k], once)]
                    gone[at] += 1
                    np.add.at(gone, at + width, -1)
                drop = np.cumsum(gone[:-1]) > 0
                raw, out = x.buf.tobytes(), []
                a, b = x.starts.tolist(), x.ends.tolist()
                for k in range(piece.num_rows):
                    lo, hi = x.bounds[k], x.bounds[k + 1]
                    keep = (lo + np.flatnonzero(~drop[lo:hi])).tolist()
                    out.append(b" ".join([raw[a[i] : b[i]] for i in keep]))
                n, m = np.diff(x.bounds), counts_by(x.bounds, drop)
                last = pa.array([t.decode() for t in out], pa.string()) if texts else pa.array([hashlib.sha256(t).hexdigest() for t in out], pa.string())
                yield pa.RecordBatch.from_arrays([piece.column(4), pa.array(n), pa.array(m), last], ["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def substring_dedup(docs: DataFrame, width: int = WIDTH, batches: int = 3, index: FingerprintIndex | None = None, history: DataFrame | None = None, texts: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, and kept_sha256 (or kept_text) of every row of `docs`.

    `batches` parts of the documents (by a hash of the id) enter the index one after the other, each probing the runs of
    those before.  For incremental use, give an `index` that holds the runs of earlier documents and these documents as
    `history`: of their texts only those that share a fingerprint with `docs` are read again, to verify, and windows
    that occur in them are removed from `docs` as well."""
    spark = docs.sparkSession
    bounded_arrow(spark)
    rows = _keyed(docs, id_col, text_col)
    own = index or FingerprintIndex(spark, width=width)
    found = None
    for b in range(batches):
        marks = own.add(docs.filter(F.pmod(F.hash(F.col(id_col).cast("long")), F.lit(batches)) == b), id_col, text_col)
        found = marks if found is None else found.unionByName(marks)
    if index is None:
        own.drop()
    marks = found.groupBy("key").agg(F.collect_set("print").alias("marks"))
    columns = ("key", "text", "marks", "part", "doc_id")  # the same in both uses, so that texts are shuffled once
    seen = rows.join(marks, "key", "left").select(*columns)
    asked = seen if history is None else seen.unionByName(_keyed(history, id_col, text_col).join(marks, "key").select(*columns))
    single = (
        _candidates(asked, width).groupBy("h1", "h2")
        .agg(F.sum("n").alias("n"), F.min("key").alias("key"), F.min("place").alias("place")).filter("n = 1")
        .groupBy("key").agg(F.collect_list("place").alias("single"))
    )
    out = _judged(seen.join(single, "key", "left").select(*columns, "single"), width, texts)
    return out.withColumnRenamed("kept", "kept_text" if texts else "kept_sha256")
