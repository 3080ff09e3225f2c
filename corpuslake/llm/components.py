"""Connected components over an edge table, by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.operators.skew import joined_by_key, sizes_of
from corpuslake.session import cut


def rooted(labels: DataFrame) -> DataFrame:
    """(node, component) with every label moved on to its root, for (node, component) rows, one a node, whose component is never larger than the node.

    A label is a node itself; where it has a smaller label, its nodes take that over. The number of rounds
    is logarithmic in the longest chain. A label with very many nodes is dealt out by the join.
    """
    while True:
        labels = cut(labels)
        below = labels.where("component < node")
        moved = below.select(F.col("node").alias("component"), F.col("component").alias("jump")).join(below.groupBy("component").agg(F.count(F.lit(1)).alias("copies")), "component")
        moved = cut(moved)
        sizes = sizes_of(moved)
        if not sizes.keys:
            return labels
        labels = joined_by_key(labels, moved.drop("copies"), moved.drop("jump"), ["component"], "node", "left", sizes).select("node", F.least("component", "jump").alias("component"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): for each node of ``edges`` the smallest node reachable from it.

    ``edges`` holds integer pairs, in any direction; nulls and self-loops are
    ignored, repeated edges count once, an empty table has no nodes. Each round hands every
    node its neighbours' smallest label and then moves all labels on to their roots.
    Sums are partial aggregates, and the
    joins deal out a hub's edges and a large component's nodes, so neither is a hot key.
    Rounds are cut by checkpoints; only counts reach the driver.
    """
    both = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    both = cut(both.union(both.select("b", "a")).distinct())
    ends = cut(both.groupBy("a").agg(F.count(F.lit(1)).alias("copies"), F.min("b").alias("least")))
    degrees = ends.select(F.col("a").alias("b"), "copies")
    sizes = sizes_of(degrees)
    labels = rooted(ends.select(F.col("a").alias("node"), F.least("least", "a").alias("component")))
    while True:
        near = joined_by_key(both, labels.select(F.col("node").alias("b"), "component"), degrees, ["b"], "a", sizes=sizes).groupBy("a").agg(F.min("component").alias("near"))
        step = cut(labels.join(near, labels.node == near.a, "left").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component")))
        if not step.where("component < old").limit(1).count():
            return labels
        # a root that has met a smaller label hands it to its nodes
        met = step.groupBy(F.col("old").alias("node")).agg(F.min("component").alias("component"))
        labels = rooted(step.select("node", "component").unionByName(met).groupBy("node").agg(F.min("component").alias("component")))
