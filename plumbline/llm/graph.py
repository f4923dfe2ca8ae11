"""Connected components by label propagation with pointer jumping, as grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import checkpointed


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over the edges; nodes without edges are not there.

    Each round takes the smallest label among the neighbours and then the label of the label, so
    the rounds grow with the logarithm of a component's width. Minima are taken before the
    shuffle, so a component or node with a third of all edges is one row per task.
    """
    ways = checkpointed(
        edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
        .union(edges.select(F.col(b), F.col(a)))
        .where("node <> other")
        .distinct()
    )
    labels = checkpointed(ways.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("component")))
    while True:
        near = ways.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("low"))
        nearer = labels.join(near, "node").select("node", F.least("component", "low").alias("new"), "component")
        nearer = checkpointed(nearer)
        if not nearer.where("new <> component").take(1):
            return labels
        jump = nearer.select(F.col("node").alias("new"), F.col("new").alias("far"))
        labels = checkpointed(nearer.join(jump, "new", "left").select("node", F.least("new", F.coalesce("far", "new")).alias("component")))
