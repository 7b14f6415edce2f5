"""Connected components of an edge table, as joins and aggregates.

Each round, every component that has a neighbour with a smaller label hooks onto the smallest one; chains of hooks are
shortened by pointer doubling, the edges are relabelled, and those inside a component fall away. A component
label is the smallest node reached. Sums over a node are minima, combined before the shuffle; the joins are plain
equi-joins whose large side adaptive execution can split when one node holds a large share of the edges.
Each round's labels and edges are written in the shared folder, so a lost executor costs no earlier round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import discard, written


def _hooks(edges: DataFrame) -> DataFrame:
    """``node, parent``: each larger end and its smallest neighbour, followed to where the chain ends."""
    parents = written(edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("parent")), "hooks")
    while True:
        above = parents.select(F.col("node").alias("up"), F.col("parent").alias("grand"))
        step = parents.join(above, F.col("parent") == F.col("up"), "left").select("node", F.coalesce("grand", "parent").alias("parent"), F.col("grand").isNotNull().alias("moved"))
        before, step = parents, written(step, "hooks")
        discard(before)
        if step.where("moved").isEmpty():
            return step
        parents = step


def _directed(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()


def connected_components(pairs: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``pairs(a, b)`` (long) that has a neighbour; the label is the smallest node."""
    edges = written(_directed(pairs), "edges")
    labels = None
    while not edges.isEmpty():
        hooks, old = _hooks(edges), (edges, labels)
        if labels is None:
            ends = edges.select(F.col("hi").alias("node")).union(edges.select("lo")).distinct()
            labels = ends.join(hooks, "node", "left").select("node", F.coalesce("parent", "node").alias("component"))
        else:
            to = hooks.select(F.col("node").alias("component"), "parent")
            labels = labels.join(to, "component", "left").select("node", F.coalesce("parent", "component").alias("component"))
        labels = written(labels, "labels")
        up = hooks.select(F.col("node").alias("hi"), F.col("parent").alias("hi_parent"))
        lo = hooks.select(F.col("node").alias("lo"), F.col("parent").alias("lo_parent"))
        moved = edges.join(up, "hi", "left").join(lo, "lo", "left")
        edges = written(_directed(moved.select(F.coalesce("hi_parent", "hi").alias("a"), F.coalesce("lo_parent", "lo").alias("b"))), "edges")
        discard(hooks, *old)
    if labels is None:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    return labels
