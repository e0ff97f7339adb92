"""Pairs of packed blocks of rows, where the pairs are many and each row should travel a few times only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.joins import if_small

#: Tasks that share the left blocks of a key, and right blocks that one of them holds at a time. Tasks of a join, at most.
LANES, SPAN, MOST_TASKS = 16, 256, 2_000


def sent(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame, int]:
    """Blocks as ``block_pairs`` sends them, one row a time a block travels, and the number of tasks."""
    lanes = left.groupBy(key).agg(F.least(F.lit(LANES), F.count(F.lit(1))).cast("int").alias("_lanes"))
    spans = right.groupBy(key).agg((F.floor(F.max("own") / SPAN) + 1).cast("int").alias("_spans"))
    plan = if_small(lanes.join(spans, key))
    tasks = min(MOST_TASKS, max(1, plan.agg(F.sum(F.col("_lanes") * F.col("_spans"))).first()[0] or 0))
    all_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    a = left.join(plan, key).withColumn("_lane", F.pmod("own", "_lanes").cast("int")).withColumn("_span", all_of("_spans")).drop("_lanes", "_spans")
    b = right.join(plan, key).withColumn("_span", F.floor(F.col("own") / SPAN).cast("int")).withColumn("_lane", all_of("_lanes")).drop("_lanes", "_spans")
    return a, b, tasks


def block_pairs(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every block of ``left`` with every block of ``right`` of the same ``key``; columns of ``right`` end in ``_b``.

    A row is a block: ``key``, its number ``own`` from 0, and what it holds. Left blocks are dealt over LANES
    tasks, each of which gets all right blocks of the key: so a right block is sent LANES times however many
    left ones there are, and a left one once for every SPAN right ones. A left block's pairs (of a span)
    mostly follow each other, but a reader must not rely on that.
    """
    a, b, tasks = sent(left, right, key)
    on = [key, "_lane", "_span"]
    named = b.select(*on, *[F.col(c).alias(f"{c}_b") for c in right.columns if c != key])
    return a.repartition(tasks, *on).hint("merge").join(named.repartition(tasks, *on), on).drop("_lane").withColumnRenamed("_span", "span")
