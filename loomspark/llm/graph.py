"""Connected components of a link table, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.scratch import durable
from loomspark.llm.skew import HOT, join_spread, spread_keys


def _hot(rows: DataFrame, key: str) -> DataFrame:
    """Values of ``key`` whose rows are spread over tasks."""
    return spread_keys(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")), [key], "n", HOT)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of an undirected link table of longs.

    ``component`` is the smallest node that can be reached. Each round every node points to the least of its
    neighbours and itself (aggregated map-side, so a node with very many links costs one row a task); paths of
    pointers are halved until each ends in a least node; then links join those ends, and what lies between
    equal ends is gone. So a round has at most half the nodes of the one before, and a link is joined once for each of its
    ends unless it still joins two groups. The rows of a node that many point to are spread over tasks. Each step is
    written to the shared folder, so the plan stays short. Null ends of a link are ignored; an empty table gives
    an empty result; repeated links and self-links change nothing but keep their nodes.
    """
    ends = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    labels = durable(ends.select(F.explode(F.array("x", "y")).alias("node")).distinct().select("node", F.col("node").alias("component")), "labels")
    left = durable(ends.where("x != y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "links")
    while left.limit(1).count():
        both = left.union(left.select("y", "x"))
        to = durable(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("x")).alias("to")), "to")
        while True:
            ahead = to.select(F.col("node").alias("to"), F.col("to").alias("next"))
            step = durable(join_spread(to, ahead, ["to"], "node", _hot(to, "to")).select("node", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), "step")
            to = step.drop("moved")
            if not step.where("moved").limit(1).count():
                break
        of = lambda c: to.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}"))
        led = join_spread(join_spread(left, of("x"), ["x"], "y", _hot(left, "x")), of("y"), ["y"], "x", _hot(left, "y")).where("to_x != to_y")
        known = labels.select("component").distinct().join(of("component"), "component", "left")
        labels = durable(join_spread(labels, known, ["component"], "node", _hot(labels, "component")).select("node", F.coalesce("to_component", "component").alias("component")), "labels")
        left = durable(led.select(F.least("to_x", "to_y").alias("x"), F.greatest("to_x", "to_y").alias("y")).distinct(), "links")
    return labels
