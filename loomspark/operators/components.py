"""Connected components of a link table, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.sources.materialise import materialise


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, component)``, the least node that can be reached; a node without edges is its own.

    ``nodes(node)``, ``edges(a, b)`` undirected. Each round every node points to the least of its neighbours and
    itself, paths of pointers are halved until all end in a least node, and links then join those ends: what lies
    between equal ends is gone, so a round has at most half the nodes of the one before. Tables are as large as the
    graph, so joins go by shuffle and nothing of them by the driver; each step is written, so plans stay short.
    """
    ends = edges.where("a != b").select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    links = materialise(ends.distinct())
    labels = nodes.select("node", F.col("node").alias("component")).distinct()
    while links.limit(1).count():
        both = links.union(links.select("y", "x"))
        to = materialise(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("to")).select("node", F.least("node", "to").alias("to")))
        while True:
            ahead = to.select(F.col("node").alias("to"), F.col("to").alias("next"))
            step = materialise(to.join(ahead.hint("merge"), "to").select("node", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
            to = step.drop("moved")
            if not step.where("moved").limit(1).count():
                break
        of = lambda c: to.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}")).hint("merge")
        led = links.join(of("x"), "x").join(of("y"), "y").where("to_x != to_y")
        links = materialise(led.select(F.least("to_x", "to_y").alias("x"), F.greatest("to_x", "to_y").alias("y")).distinct())
        labels = materialise(labels.join(of("component"), "component", "left").select("node", F.coalesce("to_component", "component").alias("component")))
    return labels
