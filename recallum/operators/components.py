"""Connected components of an edge table, by alternating star contraction.

Each round replaces every edge by edges to the smallest known neighbour, so long
chains shorten geometrically.  A group's minimum is a partial aggregate and the
join back is a plain equi-join, so a hub with a third of all edges never has to
sit in one task (adaptive execution splits its join partition).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from recallum.sources.shared import cut


def forest(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each index reaches by `root`, which points to smaller ones of its group, and links a-b; in one process."""
    root = root.copy()
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        low, high = np.minimum(x, y)[apart], np.maximum(x, y)[apart]
        np.minimum.at(root, high, low)
        while not np.array_equal(root, nxt := root[root]):
            root = nxt


def _star(edges: DataFrame, node: str, other: str) -> DataFrame:
    """Edges with the smallest neighbour `m` (or the node itself) beside each."""
    least = edges.groupBy(node).agg(F.least(F.min(other), F.col(node)).alias("m"))
    return edges.join(least, node)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """`edges` → one row (node, component) for each node that has an edge to another node.

    The component is its smallest node.  Null ends, self-loops and repeated edges
    have no effect; an empty table gives an empty result.
    """
    a, b = F.col(src), F.col(dst)
    e = cut(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, "u", "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _star(large, "u", "v")
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        e = cut(small.distinct())
        # Done when every node has one edge, to a node that has none of its own.
        parents = e.groupBy("u").agg(F.count("v").alias("n"))
        roots = e.select(F.col("v").alias("u")).distinct().withColumn("n", F.lit(1).cast("long"))
        if parents.unionByName(roots).groupBy("u").agg(F.sum("n").alias("n")).where("n > 1").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
