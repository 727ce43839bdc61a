"""Connected components of an edge table, by hooking to the smallest neighbour and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rankmill.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node reachable.

    Each round points every node to its smallest neighbour, follows the pointers to the root, and
    contracts the edges to edges between roots. Only aggregates by node and joins by node are used,
    so a hub's edges combine before they are shuffled, or are split by the skew join.
    """
    edges = stored(edges.filter("a != b").distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        roots = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root"))
        roots = _follow(stored(roots))
        known = roots.withColumnRenamed("root", "component")
        if labels is not None:
            moved = roots.select(F.col("node").alias("component"), F.col("root").alias("__to"))
            known = labels.join(moved, "component", "left").select("node", F.coalesce("__to", "component").alias("component"))
        labels = stored(known)
        a, b = (roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in "ab")
        edges = stored(edges.join(a, "a").join(b, "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).filter("a != b").distinct())
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels


def _follow(roots: DataFrame) -> DataFrame:
    """Pointers doubled until each leads to its root."""
    while True:
        onward = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
        doubled = stored(roots.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root"), (F.col("next") < F.col("root")).alias("moved")))
        if doubled.filter("moved").isEmpty():
            return roots
        roots = doubled.select("node", "root")
