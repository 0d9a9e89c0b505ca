"""Connected components of large graphs as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, component)`` of the nodes in ``edges(a, b)``; a component is named after its smallest node.

    Every round takes the smallest label among a node's neighbours and then
    the label of that label (pointer jumping), so the number of rounds grows
    with the logarithm of the longest chain.  Labels are written to the shared
    folder each round; no list of neighbours is ever collected.
    """
    both = saved(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct())
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")))
    for _ in range(rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        hooked = labels.join(near, labels["node"] == near["a"]).select("node", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        root = labels.select(F.col("node").alias("root"), F.col("component").alias("above"))
        jumped = hooked.join(root, hooked["component"] == root["root"], "left").select("node", F.least("component", F.coalesce("above", "component")).alias("component"), "was")
        step = saved(jumped)
        changed = not step.where("component <> was").isEmpty()
        dropped(labels)
        labels = step.select("node", "component")
        labels._saved_at = step._saved_at
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    dropped(both)
    return labels
