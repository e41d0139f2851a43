"""Sharding by a k-d tree over metadata, with leaves of near equal bytes.

Units are groups of equal texts, so copies share a shard; only a group above `WHOLE` of a leaf is dealt by document.
Units above `LARGE` of a leaf (at most leaves/LARGE of them) are placed first, largest to the emptiest leaf; the tree
then splits all others at weighted medians, where a side's share is what its leaves still lack.  A node is split along
its widest dimension: log of the bytes, position (id), language, source (ranks; a dimension with over `FEW` values is
left out).  Medians come from histograms summed by the cluster, refined until a bin is too light to matter; the driver
sees at most leaves/2 * BINS sums.  A cut cannot halve a unit, so where units are large the leaves differ by more than
`EVEN` of a leaf; then moves and swaps of single units above `FINE` of a leaf (at most leaves/FINE of them) even them.

Defined results: a null text has size 1 and checksum 0 and equals the empty text; ties are broken by a hash of the text;
repeated rows are documents of one group; null source and language are values of their own; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import numbered
from .session import stored

LARGE, WHOLE, EVEN, FINE = 0.25, 1.0, 0.005, 0.001  # shares of a leaf
BINS, FEW = 2048, 1024
WIDE = 10_000  # groups of over 1/WIDE of all rows get their shard by a broadcast (fewer than WIDE of them)
_COORD, _TIE = 20, 42  # bits of a coordinate and of the tie-break


def _ranks(rows: DataFrame, column: str) -> dict | None:
    found = [r[0] for r in rows.select(column).distinct().limit(FEW + 1).collect()]
    return None if len(found) > FEW else {v: i for i, v in enumerate(sorted(found))}


def _chain(node, table: dict[int, object], other):
    """A CASE over the few nodes of a level."""
    out = None
    for k, v in table.items():
        out = F.when(node == k, v) if out is None else out.when(node == k, v)
    return other if out is None else out.otherwise(other)


def kd_leaves(units: DataFrame, dims: list[str], room: list[int]) -> DataFrame:
    """`units` (weight w, coordinates `dims`, tie) with `shard`, such that leaf k gets about room[k] of weight."""
    key = {d: F.shiftleft(F.col(d).cast("long"), _TIE).bitwiseOR(F.col("tie")) for d in dims}
    node, span = F.lit(0), len(room)
    while span > 1:
        cur = units.withColumn("node", node)
        stats = cur.groupBy("node").agg(F.sum("w").alias("w"), *(f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max)))).collect()
        widest = {r["node"]: max(dims, key=lambda d: r[f"hi_{d}"] - r[f"lo_{d}"]) for r in stats}
        weight = {r["node"]: r["w"] for r in stats}
        want = {}
        for k in widest:
            left, right = sum(room[k * span : k * span + span // 2]), sum(room[k * span + span // 2 : (k + 1) * span])
            want[k] = weight[k] * left / max(left + right, 1)
        low = {r["node"]: r[f"lo_{widest[r['node']]}"] << _TIE for r in stats}
        high = {r["node"]: (r[f"hi_{widest[r['node']]}"] + 1) << _TIE for r in stats}
        below, cut = dict.fromkeys(widest, 0), {}
        own = _chain(F.col("node"), {k: key[d] for k, d in widest.items()}, F.lit(0).cast("long"))
        while todo := [k for k in widest if k not in cut]:
            step = {k: max(1, -(-(high[k] - low[k]) // BINS)) for k in todo}
            at = _chain(F.col("node"), {k: F.floor((F.col("key") - F.lit(low[k])) / F.lit(step[k])) for k in todo}, F.lit(-1))
            inside = _chain(F.col("node"), {k: (F.col("key") >= low[k]) & (F.col("key") < high[k]) for k in todo}, F.lit(False))
            sums = cur.withColumn("key", own).filter(inside).withColumn("bin", at.cast("long")).groupBy("node", "bin").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n")).collect()
            for k in todo:
                total, chosen = below[k], None
                for r in sorted((r for r in sums if r["node"] == k), key=lambda r: r["bin"]):
                    if total + r["w"] >= want[k]:
                        chosen = r
                        break
                    total += r["w"]
                if chosen is None:
                    cut[k] = high[k]
                    continue
                lo = low[k] + chosen["bin"] * step[k]
                hi = min(lo + step[k], high[k])
                if chosen["n"] == 1 or hi - lo <= 1 or chosen["w"] <= 1e-4 * weight[k]:
                    cut[k] = hi if total + chosen["w"] - want[k] < want[k] - total else lo
                else:
                    low[k], high[k], below[k] = lo, hi, total
        right = own >= _chain(F.col("node"), {k: F.lit(v) for k, v in cut.items()}, F.lit(0).cast("long"))
        units = stored(cur.withColumn("node", 2 * F.col("node") + right.cast("int")), "kd")
        node, span = F.col("node"), span // 2
    return units.withColumn("shard", node.cast("int")).drop("node")


def evened(loads: list[int], units: list[tuple[str, int, int]], slack: float) -> dict[str, int]:
    """New shards of the (key, weight, shard) that leave the fullest shard for the emptiest, perhaps in exchange for one
    of its own, until all loads are within `slack` or nothing helps.  Each step cuts the gap by a tenth at least."""
    loads, moved, open_ = list(loads), {}, set(range(len(loads)))
    held = [sorted((w, key) for key, w, k in units if k == s) for s in range(len(loads))]
    while len(open_) > 1:
        a, b = max(open_, key=loads.__getitem__), min(range(len(loads)), key=loads.__getitem__)
        gap = loads[a] - loads[b]
        if gap <= slack:
            break
        others, best = [(0, ""), *held[b]], None
        for u in held[a]:
            at = bisect_left(others, (u[0] - gap / 2, ""))
            for v in others[max(0, at - 1) : at + 1]:
                off = abs(u[0] - v[0] - gap / 2)
                if best is None or off < best[0]:
                    best = off, u, v
        if best is None or best[0] > 0.45 * gap:
            open_.discard(a)  # one unit fills it, or no exchange brings it nearer
            continue
        for unit, src, dst in ((best[1], a, b), (best[2], b, a)):
            if unit[1]:
                held[src].remove(unit)
                held[dst].insert(bisect_left(held[dst], unit), unit)
                loads[src], loads[dst] = loads[src] - unit[0], loads[dst] + unit[0]
                moved[unit[1]] = dst
    return moved


def kd_shards(docs: DataFrame, shards: int = 16, large: float = LARGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row; `shards` is a power of two."""
    if shards & (shards - 1):
        raise ValueError("the number of shards must be a power of two")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = stored(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("same"),
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")),
    ), "shard-rows")
    n, total, lo, hi, longest = rows.agg(F.count(F.lit(1)), F.sum("size"), F.min("doc_id"), F.max("doc_id"), F.max("size")).first()
    if not n:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    leaf = total / shards
    groups = rows.groupBy("same").agg(
        F.sum("size").alias("w"), F.count(F.lit(1)).alias("n"), F.max("size").alias("size"), F.min("doc_id").alias("doc_id"),
        *(F.min_by(c, F.coalesce("doc_id", F.lit(0))).alias(c) for c in ("lang", "source")),
    )
    groups = stored(groups, "shard-groups")
    heavy = [r[0] for r in groups.filter((F.col("n") > 1) & (F.col("w") > WHOLE * leaf)).select("same").collect()]  # fewer than shards
    units = groups
    if heavy:
        hot = numbered(rows.filter(F.col("same").isin(heavy)), [F.col("same"), F.col("doc_id")], "copy", within="same")
        hot = stored(hot.withColumn("same", F.sha2(F.concat_ws("/", "same", F.col("copy").cast("string")), 256)).drop("copy"), "shard-hot")
        single = hot.withColumns({"w": F.col("size"), "n": F.lit(1).cast("long")}).drop("text_crc32")
        units = groups.filter(~F.col("same").isin(heavy)).unionByName(single)
        rows = rows.filter(~F.col("same").isin(heavy)).unionByName(hot.select(rows.columns))
    ranks = {c: _ranks(rows, c) for c in ("lang", "source")}
    top = (1 << _COORD) - 1
    scale = lambda x, a, b: F.floor((x - F.lit(float(a))) / F.lit(max(float(b) - a, 1e-9)) * top).cast("long")
    place = F.coalesce(F.col("doc_id"), F.lit(lo or 0)).cast("double")
    coords = {"d_bytes": scale(F.log2(F.col("size").cast("double")), 0, math.log2(longest + 1)), "d_place": scale(place, lo or 0, hi or 0)}
    for c, found in ranks.items():
        if found and len(found) > 1:
            rank = F.create_map(*(F.lit(x) for kv in found.items() for x in kv))
            coords[f"d_{c}"] = scale(F.element_at(rank, F.col(c)).cast("double"), 0, len(found) - 1)
    tie = F.shiftrightunsigned(F.xxhash64("same"), 64 - _TIE)
    units = stored(units.select("same", "w", "n", *(F.least(F.greatest(v, F.lit(0)), F.lit(top)).alias(k) for k, v in coords.items()), tie.alias("tie")), "shard-units")
    # large units first: at most shards/large of them
    heap, placed = [(0, k) for k in range(shards)], []
    for r in sorted(units.filter(F.col("w") > large * leaf).select("same", "w", "n").collect(), key=lambda r: (-r["w"], r["same"])):
        used, k = heapq.heappop(heap)
        placed.append((r["same"], r["n"], k))
        heapq.heappush(heap, (used + r["w"], k))
    loads = [w for w, _ in sorted(heap, key=lambda x: x[1])]
    tree = kd_leaves(units.filter(F.col("w") <= large * leaf), list(coords), [max(0, round(leaf - w)) for w in loads])
    for r in tree.groupBy("shard").agg(F.sum("w").alias("w")).collect():
        loads[r["shard"]] += r["w"]
    where, spark = tree.select("same", "n", "shard"), docs.sparkSession
    if max(loads) - min(loads) > EVEN * leaf:
        fine = tree.filter(F.col("w") >= FINE * leaf).select("same", "w", "shard")  # at most shards/FINE of them
        moved = evened(loads, [tuple(r) for r in fine.collect()], EVEN * leaf)
        if moved:
            new = spark.createDataFrame(list(moved.items()), "same string, other int")
            where = where.join(F.broadcast(new), "same", "left").select("same", "n", F.coalesce("other", "shard").alias("shard"))
    if placed:
        where = where.unionByName(spark.createDataFrame(placed, "same string, n long, shard int"))
    wide = F.col("n") * WIDE > n
    near = rows.join(F.broadcast(where.filter(wide).select("same", "shard")), "same", "left")
    far = near.filter("shard IS NULL").drop("shard").join(where.filter(~wide).select("same", "shard"), "same")
    dealt = near.filter("shard IS NOT NULL").unionByName(far).select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"))
    out = numbered(dealt, [F.col("shard"), F.col("doc_id"), F.col("text_crc32")], "slot", within="shard")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
