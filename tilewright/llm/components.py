"""Connected components of a graph given as edges: union-find inside partitions, then alternating star steps between them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tilewright.llm.stages import over_batches, stage

_BATCH = 1 << 20  # edges that one union-find holds


def _stars(batches):
    """Edges of a partition replaced by (node, smallest node it reaches here)."""
    def flush(pairs):
        a, b = (np.concatenate(x) for x in zip(*pairs))
        names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = list(range(len(names)))
        for x, y in zip(at[:len(a)].tolist(), at[len(a):].tolist()):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            while root[y] != y:
                root[y] = root[root[y]]
                y = root[y]
            if x < y:
                root[y] = x
            elif y < x:
                root[x] = y
        for x in range(len(root)):  # a root is smaller than what points to it
            root[x] = root[root[x]]
        hub = names[np.array(root)]
        return [names[hub != names], hub[hub != names]]

    held, n = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n >= _BATCH:
            yield flush(held)
            held, n = [], 0
    if n:
        yield flush(held)


def components(edges: DataFrame) -> DataFrame:
    """(node long, component long) of every node in `edges` (a long, b long); the component is its smallest node.

    Rows with a null end are ignored, loops and repeated edges change nothing, an empty table gives an empty one.  Each round
    joins every node with its smallest neighbour and moves the larger neighbours there (large star, then small star) until
    no edge changes; rounds grow with the logarithm of the longest path.  A hub is summed on the map side before it is joined.
    """
    links = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    now = stage(over_batches(links, "u long, v long", _stars), "stars")  # v < u in every row
    before = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        hub = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(hub, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(hub.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = stage(small, "stars")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    hubs = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(hubs)
