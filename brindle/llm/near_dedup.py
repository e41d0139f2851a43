"""MinHash near-dedup with SuperMinHash signatures.

1. A document's set is its distinct word shingles.  An element e visits the m signature places in the order of a
   permutation of its own, p(j) = a(e) + b(e) j mod m for a prime m, and offers rank j plus a random fraction at its
   j-th place.  All elements of a slice take step j together; a text stops as soon as the ranks of its signature are
   all below j, for most after two or three steps.
2. Documents of equal sets form classes (see exact_dedup, so one class may be a third of the rows); each class goes on
   as its smallest id.  Its bands are the LSH buckets.  Sets of up to 50 shingles, too small for places to be
   independent, have the elements of their prefix as buckets instead: in the order of rarity over the small sets, two
   sets of the asked similarity share an element of the first n - ceil(0.8 n) + 1, so none of their pairs is missed.
   Sets of up to 62 shingles, the largest that may be linked with such a set, have both.
3. Candidates pass two bounds first, which no pair of the asked similarity can fail: the ratio of sizes, and the number
   of bits in which their odd sketches (each bit the parity of the elements that hash to it) differ, which is never
   more than the number of elements that only one of the sets has.
4. Verification on full sets (compared by their 64-bit shingle hashes), in rounds.  First every member of a bucket is
   held against the bucket's leader, the member of the highest total bucket size, which is the centre of a group of near
   copies.  Links are merged by union-find.  In buckets whose members still have several components, the members outside
   the largest one are then held against all members of other components, more in each round, until all have been.  A
   pair arises only in the least of the buckets that its two members share.  Pairs inside one component need no check,
   so groups of copies never expand into all pairs, and no bucket is capped.
5. The pairs of one text are dealt out under salts, as many as they need, and its text goes once to each salt, ahead of
   the texts to hold against it.

Defined results: null, empty and blank texts have no shingles and are linked with nothing; a text with fewer words than
a shingle is one element; equal sets are linked; rows that share an id are one node with the links of each; a null id
is linked with nothing and kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exact_dedup import groups
from .grouping import components
from .session import bounded_arrow, stored
from .textkit import U64, cut, flat, hash_spans, mapper, mix, windows, words

PLACES, BANDS, ROWS = 421, 60, 7  # a pair of similarity 0.8 shares none of the bands with probability 7e-7
SHORT = 50  # sets of up to so many shingles find their pairs by prefixes, without a miss
SKETCH_WORDS = 16  # of 64 bits; a power of two
FRACTION_BITS = 23
AT_ONCE = 64  # members of a bucket, about, that the first round holds against all others
PER_SALT = 256  # pairs of one text, about, in one group of its salts
FEW_IDS = 1_000_000  # up to so many ids are broadcast to filter texts before they are shuffled
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class NearOptions:
    shingle: int = 5
    percent: int = 80
    places: int = PLACES
    bands: int = BANDS
    rows: int = ROWS


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    buf, off = flat(texts)
    buf = _LOWER[buf]
    starts, ends, wb = words(buf, off)
    h = hash_spans(buf, starts, ends)
    runs, at = windows(h, wb, n)
    bounds = np.searchsorted(at, wb)
    out = []
    for k in range(len(off) - 1):
        a, b = wb[k], wb[k + 1]
        if b - a >= n:
            s = np.sort(runs[bounds[k] : bounds[k + 1]])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            v = np.array([b - a], U64)
            for i in range(a, b):
                v = mix(v * U64(0x9E3779B97F4A7C15) ^ h[i : i + 1])
            out.append(v)
        else:
            out.append(np.zeros(0, U64))
    return out


def super_minhash(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """Signatures (texts x places); rows of empty sets mean nothing."""
    sizes = np.array([len(s) for s in sets])
    sig = np.full((len(sets), places), np.iinfo(np.uint32).max, np.uint32)
    if not sizes.sum():
        return sig
    e = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), sizes)
    g = mix(e ^ U64(0x5851F42D4C957F2D))
    a = ((g >> U64(32)) % U64(places)).astype(np.int64)
    b = ((g & U64(0xFFFFFFFF)) % U64(places - 1)).astype(np.int64) + 1
    flat_sig, place, live = sig.reshape(-1), a, np.flatnonzero(sizes)
    for j in range(places):
        fraction = (mix(e + U64((j * 0x9E3779B97F4A7C15 + 1) % 2**64)) >> U64(64 - FRACTION_BITS)).astype(np.uint32)
        np.minimum.at(flat_sig, doc * places + place, fraction + np.uint32(j << FRACTION_BITS))
        on = sig[live].max(axis=1) >= np.uint32((j + 1) << FRACTION_BITS)
        if not on.any():
            break
        if not on.all():
            going = np.zeros(len(sets), bool)
            live = live[on]
            going[live] = True
            on = going[doc]
            e, doc, b, place = e[on], doc[on], b[on], place[on]
        place = (place + b) % places
    return sig


def odd_sketch(sets: list[np.ndarray]) -> np.ndarray:
    """Bits (texts x SKETCH_WORDS words), each the parity of the elements that hash to it."""
    out = np.zeros((len(sets), SKETCH_WORDS), U64)
    if sets:
        h = mix(np.concatenate(sets) ^ U64(0xA0761D6478BD642F))
        at = np.repeat(np.arange(len(sets)) * SKETCH_WORDS, [len(s) for s in sets]) + ((h >> U64(6)) % U64(SKETCH_WORDS)).astype(np.int64)
        np.bitwise_xor.at(out.reshape(-1), at, U64(1) << (h & U64(63)))
    return out


def band_keys(sig: np.ndarray, n: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Keys of bands of scattered places: in neighbouring ones the same few elements win together."""
    out = np.empty((len(sig), n), U64)
    order = np.argsort(mix(np.arange(sig.shape[1]).astype(U64) + U64(1)), kind="stable")
    for k in range(n):
        h = np.full(len(sig), U64(k + 1))
        for c in order[k * rows : (k + 1) * rows]:
            h = mix(h * U64(0x9E3779B97F4A7C15) ^ sig[:, c].astype(U64))
        out[:, k] = h
    return out


def _sketches(rows: DataFrame, o: NearOptions) -> DataFrame:
    linked = SHORT * 100 // max(o.percent, 1)  # the largest set that may be linked with one of up to SHORT

    def one(piece: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(piece.column(1), o.shingle)
        long_ = np.flatnonzero([len(s) > SHORT for s in sets])
        keys = band_keys(super_minhash([sets[i] for i in long_], o.places), o.bands, o.rows).view(np.int64)
        bits, own = odd_sketch(sets).view(np.int64), []
        for s in sets:
            own.append(f"{int(np.bitwise_xor.reduce(mix(s + U64(1)))):016x}{int(mix(s ^ U64(77)).sum(dtype=U64)):016x}" if len(s) else "")
        n = np.zeros(len(sets), np.int32)
        n[long_] = keys.shape[1]
        bands = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), keys.reshape(-1))
        short = pa.array([s.view(np.int64) if 0 < len(s) <= linked else None for s in sets], pa.list_(pa.int64()))
        columns = [piece.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(own, pa.string()), bands, short, *(pa.array(bits[:, k]) for k in range(bits.shape[1]))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "own", "bands", "short", *(f"s{k}" for k in range(bits.shape[1]))])

    bits = "".join(f", s{k} long" for k in range(SKETCH_WORDS))
    return rows.mapInArrow(mapper(one), f"doc_id long, n_shingles long, own string, bands array<long>, short array<long>{bits}")


def _prefixes(reps: DataFrame, o: NearOptions) -> DataFrame:
    """rep, band: the rarest elements of each small set, as many as a set of the asked similarity must share one of."""
    each = reps.filter("short IS NOT NULL").select("rep", "own", "n_shingles", F.explode("short").alias("band"))
    often = each.groupBy("band").agg(F.count(F.lit(1)).alias("often"))
    ordered = each.join(often, "band").groupBy("rep", "own", "n_shingles").agg(F.sort_array(F.collect_set(F.struct("often", "band"))).alias("e"))
    first = F.expr(f"CAST(n_shingles - ({o.percent} * n_shingles + 99) DIV 100 + 1 AS INT)")
    return ordered.select("rep", F.explode(F.slice("e", F.lit(1), first)).alias("e")).select("rep", F.col("e.band").alias("band")).distinct()


def _alike(o: NearOptions):
    """Sizes and sketches of a and b allow the asked similarity; never false for a pair that has it."""
    sizes = 100 * F.least("n_a", "n_b") >= o.percent * F.greatest("n_a", "n_b")
    each = [F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in range(SKETCH_WORDS)]
    differ = sum(each[1:], each[0])
    return sizes & ((100 + o.percent) * differ <= (100 - o.percent) * (F.col("n_a") + F.col("n_b")))


def _named(side: str) -> list:
    return [F.col("n_shingles").alias(f"n_{side}"), *(F.col(f"s{k}").alias(f"{side}{k}") for k in range(SKETCH_WORDS))]


def _verified(pairs: DataFrame, rows: DataFrame, o: NearOptions) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough; a text that many pairs share is best `a`."""

    def run(batches):
        own, left = None, []
        for batch in batches:
            for piece in cut(batch):
                sets, out = shingle_sets(piece.column(3), o.shingle), []
                for a, salt, b, s in zip(*(piece.column(k).to_pylist() for k in range(3)), sets, strict=True):
                    if b is None:  # a's own text; an id may have several rows
                        left = [*left, s] if own == (a, salt) else [s]
                        own = (a, salt)
                    elif own == (a, salt) and any(_enough(x, s, o.percent) for x in left):
                        out.append((a, b))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    texts = rows.join(F.broadcast(ids), "doc_id", "left_semi") if ids.count() <= FEW_IDS else rows
    hot = stored(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > PER_SALT), "hot")
    salts = F.coalesce(F.ceil(F.col("n") / PER_SALT), F.lit(1))
    small = F.broadcast(hot) if hot.count() <= FEW_IDS else hot
    salted = pairs.join(small, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), salts).cast("int").alias("salt"))
    left = salted.select("a", "salt").distinct().join(texts.select(F.col("doc_id").alias("a"), "text"), "a")
    right = salted.join(texts.select(F.col("doc_id").alias("b"), "text"), "b")
    both = left.select("a", "salt", F.lit(None).cast("long").alias("b"), "text").unionByName(right.select("a", "salt", "b", "text"))
    both = both.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return both.mapInArrow(run, "a long, b long").distinct()


def _enough(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Two sorted sets have the asked similarity."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    common = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def near_groups(docs: DataFrame, options: NearOptions = NearOptions(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    o = options
    bounded_arrow(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch = stored(_sketches(rows, o), "sketches")
    member = sketch.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stored(groups(member.select("doc_id", "n_shingles", "own"), "doc_id", "own").select("doc_id", "n_shingles", "own", F.col("keep_id").alias("rep")), "classes")
    copies = classes.filter("doc_id <> rep").select("doc_id", "own")
    reps = member.join(copies, ["doc_id", "own"], "left_anti").withColumnRenamed("doc_id", "rep")
    # an id with rows in several classes links them
    ids = classes.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("hi")).filter("a < hi").select("doc_id", "a")
    one_id = classes.join(ids, "doc_id").filter("a < rep").select("a", F.col("rep").alias("b")).distinct()
    bands = reps.select("rep", F.explode("bands").alias("band")).unionByName(stored(_prefixes(reps, o), "prefixes"))
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi").select("band", "size")
    buckets = stored(bands.join(shared, "band").select("band", "rep", "size"), "buckets")
    nodes = buckets.groupBy("rep").agg(F.sum("size").alias("degree"), F.collect_list("band").alias("keys"))
    nodes = stored(nodes.join(reps.select("rep", "n_shingles", *(f"s{k}" for k in range(SKETCH_WORDS))), "rep"), "nodes")
    leader = buckets.join(nodes.select("rep", "degree"), "rep").groupBy("band").agg(F.max(F.struct("degree", -F.col("rep"))).alias("top")).select("band", (-F.col("top.col2")).alias("a"))
    # a leader has the higher degree in all buckets of a pair, so that no pair comes both ways
    pairs = buckets.select("band", F.col("rep").alias("b")).join(leader, "band").filter(F.col("a") != F.col("b")).select("a", "b").distinct()
    pairs = pairs.join(nodes.select(F.col("rep").alias("a"), *_named("a")), "a").join(nodes.select(F.col("rep").alias("b"), *_named("b")), "b")
    links = stored(_verified(stored(pairs.filter(_alike(o)).select("a", "b"), "pairs"), rows, o).unionByName(one_id), "links")
    labels = components(links)
    # buckets with several components: members outside the largest are held against all members of other components
    open_, at_once = buckets.filter("size > 2").select("band", "rep", F.lit(False).alias("done")), AT_ONCE
    while True:
        now = open_.select("band", "rep", "done").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        several = now.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("done")).alias("todo")).groupBy("band")
        several = several.agg(F.max(F.struct("n", "label", "todo")).alias("top"), F.count(F.lit(1)).alias("labels"), F.sum("todo").alias("todo"))
        several = several.filter("labels > 1").select("band", F.col("top.label").alias("major"), (F.col("todo") - F.col("top.todo")).alias("left"))
        waiting = (F.col("label") != F.col("major")) & ~F.col("done")
        turn = F.pmod(F.xxhash64("rep", F.lit(at_once)), F.greatest("left", F.lit(1))) < at_once
        now = stored(now.join(several.filter("left > 0"), "band").select("band", "rep", "label", "done", (waiting & turn).alias("pivot")), "open")
        if now.isEmpty():
            break
        full = now.join(nodes, "rep")
        pivots = full.filter("pivot").select("band", F.col("rep").alias("a"), F.col("label").alias("label_a"), F.col("keys").alias("keys_a"), *_named("a"))
        others = full.filter("NOT done").select("band", F.col("rep").alias("b"), "label", "pivot", "keys", *_named("b"))
        once = (F.array_min(F.array_intersect("keys_a", "keys")) == F.col("band")) & ~(F.col("pivot") & (F.col("b") < F.col("a")))
        pairs = pivots.join(others, "band").filter((F.col("label") != F.col("label_a")) & _alike(o) & once)
        new = stored(pairs.select("a", "b"), "pairs")
        open_, at_once = now.withColumn("done", F.col("done") | F.col("pivot")), 16 * at_once
        if not new.isEmpty():
            found = stored(_verified(new, rows, o), "links")
            if not found.isEmpty():
                links = stored(links.unionByName(found), "links")
                labels = components(links)
    named = classes.select("doc_id", "n_shingles", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    done = named.select("doc_id", "n_shingles", F.coalesce("label", "rep").alias("component_id"))
    rest = sketch.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return done.unionByName(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, options: NearOptions = NearOptions()) -> DataFrame:
    """One document of each group, with its own columns."""
    drop = near_groups(docs, options).filter(~F.col("kept")).select(F.col("doc_id").alias("_drop_id")).distinct()
    return docs.join(drop, docs["doc_id"] == drop["_drop_id"], "left_anti")
