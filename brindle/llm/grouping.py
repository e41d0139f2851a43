"""Connected components of a table of links."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import stored


def _contracted(batches):
    """Union-find over one partition's links: each node and its root, the least node."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    pairs = [(x, find(x)) for x in list(parent)]
    pairs = [(x, r) for x, r in pairs if x != r]
    if pairs:
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs]), pa.array([r for _, r in pairs])], ["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of `links` (a, b): the least node that it reaches.

    Each partition contracts its links to stars by union-find; labels then spread along the stars and jump over
    pointers until none changes.  Every round is written to the shared folder; nothing is collected."""
    stars = stored(links.select("a", "b").mapInArrow(_contracted, "u long, v long"), "stars")
    edges = stored(stars.union(stars.select("v", "u")).distinct(), "edges")
    labels = stored(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels")
    while True:
        near = (
            edges.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u")
            .agg(F.min("label").alias("near")).withColumnRenamed("u", "node")
        )
        hooked = stored(labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was")), "labels")
        far = hooked.select(F.col("node").alias("label"), F.col("label").alias("far"))
        jumped = stored(hooked.join(far, "label", "left").select("node", F.least("label", "far").alias("label"), "was"), "labels")
        if jumped.filter("label <> was").isEmpty():
            return jumped.select("node", "label")
        labels = jumped.select("node", "label")
