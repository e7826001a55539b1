"""Connected components by spreading least labels, in joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, unstage


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of the undirected `edges` (a, b); the label is the component's least node.

    Each round gives a node the least label among its neighbours and then the label of that label, so that chains
    halve; a round moves one row per edge, reads no group whole and writes its labels to the shared folder.
    """
    both = staged(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_m")).select("node", F.least("node", "_m").alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(both.a.alias("_node")).agg(F.min("label").alias("_near"))
        stepped = labels.join(near, labels.node == near._node).select("node", F.col("label").alias("_old"), F.least("label", "_near").alias("_step"))
        jump = labels.select(F.col("node").alias("_at"), F.col("label").alias("_next"))
        after = staged(stepped.join(jump, stepped._step == jump._at, "left").select("node", "_old", F.least("_step", F.coalesce("_next", "_step")).alias("label")), "labels")
        changed = not after.where("label <> _old").isEmpty()
        unstage(labels)
        labels = after
        if not changed:
            unstage(both)
            return labels.select("node", "label")
