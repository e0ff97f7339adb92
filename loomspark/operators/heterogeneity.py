"""Heterogeneity of a region across sections.

Silhouettes need the distances of all pairs of a region's observations; no closed form of sums of euclidean
distances exists. Each pair of blocks is compared once, for all replicates of the labels: one matrix product of
distances and label memberships gives the sums that every replicate needs. The work is quadratic in the size of
a region, so regions of more than some hundred thousand observations should be sampled by the caller.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.blocks import block_pairs
from loomspark.functions.joins import if_small
from loomspark.sources.materialise import materialise

#: Rows of a block, and replicates whose sums are added up in one task.
BLOCK_ROWS, CHUNK = 1_024, 25


def _stacked(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _number_type(n_groups: int) -> type:
    return np.uint8 if n_groups <= 256 else np.int32


def _replicate_silhouettes(members: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(region, replicate, silhouette, n_obs)`` of ``members(region, obs_id, vector, groups)``.

    ``groups`` has an observation's group number in every replicate; a group of one scores 0. Group numbers
    run from 0, and a group is as large in each replicate as in the first. Rows are packed in blocks; a task adds up
    a block's sums over the blocks it meets, and only these sums go on.
    """
    members = materialise(members)
    n = members.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.max(F.get("groups", 0)).alias("last"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / block_rows)).cast("int")
    plan = if_small(n.select("region", blocks.alias("blocks"), (F.col("last") + 1).alias("n_groups")))
    dealt = members.join(plan, "region").withColumn("own", F.pmod(F.xxhash64("obs_id"), F.col("blocks")).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        n_groups, number = table["n_groups"][0].as_py(), table["own"][0].as_py()
        held = [_stacked(table["vector"]).astype(np.float64).tobytes(), _stacked(table["groups"]).astype(_number_type(n_groups)).tobytes()]
        one = [pa.array([v], k) for v, k in ((table["region"][0].as_py(), pa.string()), (number, pa.int32()), (len(table), pa.int32()), (n_groups, pa.int32()))]
        return pa.table([*one, *[pa.array([v], pa.binary()) for v in held]], names=["region", "own", "n_rows", "n_groups", "vectors", "groups"])

    packed = materialise(dealt.groupBy("region", "own").applyInArrow(pack, "region string, own int, n_rows int, n_groups int, vectors binary, groups binary"))
    pairs = block_pairs(packed, packed.drop("n_groups"), "region")
    names, kinds = ["region", "own", "chunk", "n_rows", "n_groups", "groups", "sums"], [pa.string(), *[pa.int32()] * 4, pa.binary(), pa.binary()]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, x, mine, total = None, np.zeros((0, 0)), np.zeros((0, 0)), np.zeros((0, 0, 0))

        def added() -> Iterator[pa.RecordBatch]:
            for c in range(0, mine.shape[1], CHUNK):
                row = [now[0], now[1], c // CHUNK, len(x), total.shape[2], mine[:, c : c + CHUNK].tobytes(), total[:, c : c + CHUNK].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            of = {c: batch.column(c) for c in batch.schema.names}
            for i in range(len(batch)):  # a row a pair of blocks
                at = tuple(of[c][i].as_py() for c in ("region", "own", "span"))
                read = lambda c, n, kind: np.frombuffer(of[c][i].as_buffer(), dtype=kind).reshape(n, -1)  # noqa: B023, E731
                n_groups = of["n_groups"][i].as_py()
                if at != now:
                    if now is not None:
                        yield from added()
                    n_rows = of["n_rows"][i].as_py()
                    now, x, mine = at, read("vectors", n_rows, np.float64).copy(), read("groups", n_rows, _number_type(n_groups)).copy()
                    total = np.zeros((len(x), mine.shape[1], n_groups))
                n_rows = of["n_rows_b"][i].as_py()
                y, theirs = read("vectors_b", n_rows, np.float64), read("groups_b", n_rows, _number_type(n_groups))
                d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T, 0))
                d[d < 1e-7 * (1 + np.sqrt((x**2).sum(1))[:, None])] = 0  # what rounding leaves of a distance of 0
                member = (theirs[:, :, None] == np.arange(n_groups)).reshape(len(y), -1).astype(float)
                total += (d @ member).reshape(total.shape)
        if now is not None:
            yield from added()

    parts = pairs.mapInArrow(sums, "region string, own int, chunk int, n_rows int, n_groups int, groups binary, sums binary")
    sizes = members.select("region", F.get("groups", 0).alias("g")).groupBy("region", "g").agg(F.count(F.lit(1)).alias("n"))
    sizes = if_small(sizes.groupBy("region").agg(F.transform(F.array_sort(F.collect_list(F.struct("g", "n"))), lambda v: v["n"]).alias("sizes")))

    def score(table: pa.Table) -> pa.Table:
        n_rows, n_groups = table["n_rows"][0].as_py(), table["n_groups"][0].as_py()
        total = sum(np.frombuffer(s.as_buffer()) for s in table["sums"]).reshape(n_rows, -1, n_groups)
        groups, n = np.frombuffer(table["groups"][0].as_buffer(), dtype=_number_type(n_groups)).reshape(n_rows, -1).astype(np.int64), np.array(table["sizes"][0].as_py(), dtype=float)
        inside = np.take_along_axis(total, groups[:, :, None], axis=2)[:, :, 0] / np.maximum(n[groups] - 1, 1)
        outside = total / n
        np.put_along_axis(outside, groups[:, :, None], np.inf, axis=2)
        b = outside.min(axis=2)
        s = np.where(n[groups] <= 1, 0.0, (b - inside) / np.maximum(np.maximum(inside, b), 1e-300))
        replicate = np.arange(groups.shape[1], dtype=np.int32) + CHUNK * table["chunk"][0].as_py()
        region = pa.array([table["region"][0].as_py()] * len(replicate), pa.string())
        return pa.table([region, pa.array(replicate.astype(np.int32)), pa.array(s.sum(axis=0)), pa.array(np.full(len(replicate), n_rows, dtype=np.int64))], names=["region", "replicate", "s", "n_obs"])

    scored = parts.join(sizes, "region").groupBy("region", "own", "chunk").applyInArrow(score, "region string, replicate int, s double, n_obs long")
    total = scored.groupBy("region", "replicate").agg((F.sum("s") / F.sum("n_obs")).alias("silhouette"), F.sum("n_obs").alias("n_obs"))
    return total


def _numbered(vectors: DataFrame, region: str, group: str) -> DataFrame:
    """``(region, obs_id, vector, g)`` of regions with at least two groups and more observations than groups.

    ``obs_id`` becomes a hash of section and id, where both are there: ids may be shared by sections, and of any type.
    """
    own = F.xxhash64(*[c for c in ("section", "obs_id") if c in vectors.columns]).alias("obs_id")
    named = vectors.select(F.col(region).cast("string").alias("region"), F.col(group).cast("string").alias("grp"), own, "vector")
    size = named.groupBy("region", "grp").agg(F.count(F.lit(1)).alias("n"))
    of_region = Window.partitionBy("region")  # a row a group
    numbered = size.withColumn("g", (F.row_number().over(of_region.orderBy("grp")) - 1).cast("int"))
    able = numbered.withColumn("groups", F.count(F.lit(1)).over(of_region)).withColumn("all", F.sum("n").over(of_region)).where("groups > 1 and all > groups")
    return named.join(if_small(able.select("region", "grp", "g")), ["region", "grp"]).drop("grp")


def silhouette(vectors: DataFrame, region: str = "label", group: str = "section") -> DataFrame:
    """Mean silhouette (euclidean) of the groups of each region: ``(region, silhouette, n_obs)``.

    Regions with fewer than two groups, or no more observations than groups, have none.
    """
    return _replicate_silhouettes(_numbered(vectors, region, group).withColumn("groups", F.array("g"))).drop("replicate")


def permuted_silhouette(vectors: DataFrame, n_perm: int = 200, seed: int = 0, region: str = "label", group: str = "section") -> DataFrame:
    """The silhouette against its value under permuted sections: adjusted, z, and p with one added.

    A permutation orders a region's observations by a hash and hands out the groups' places in that order, so
    every group keeps its size. Only ids go through it, and vectors once.
    """
    named = materialise(_numbered(vectors, region, group))
    size = named.groupBy("region", "g").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("region").orderBy("g"))  # a row a group
    ends = if_small(size.withColumn("upto", upto).groupBy("region").agg(F.array_sort(F.collect_list("upto")).alias("ends")))
    each = F.explode(F.sequence(F.lit(1), F.lit(n_perm))).alias("replicate")
    shuffled = named.select("region", "obs_id", each).withColumn("place", F.row_number().over(Window.partitionBy("region", "replicate").orderBy(F.xxhash64(F.lit(seed), "replicate", "obs_id"), "obs_id")))
    given = shuffled.join(ends, "region").select("region", "obs_id", "replicate", F.size(F.filter("ends", lambda e: e < F.col("place"))).alias("g"))
    lists = given.groupBy("region", "obs_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("replicate", "g"))), lambda x: x["g"]).alias("drawn"))
    members = named.join(lists, ["region", "obs_id"]).select("region", "obs_id", "vector", F.concat(F.array("g"), "drawn").alias("groups"))
    scored = materialise(_replicate_silhouettes(members))  # a row a region and replicate
    seen = scored.where("replicate = 0").select("region", F.col("silhouette").alias("observed"), "n_obs")
    wide = scored.where("replicate > 0").drop("n_obs").join(seen, "region").groupBy("region", "observed", "n_obs")
    count = lambda c: F.sum(c.cast("int"))
    both = wide.agg(F.avg("silhouette").alias("mean"), F.stddev_samp("silhouette").alias("spread"), F.count(F.lit(1)).alias("n"), count(F.col("silhouette") >= F.col("observed")).alias("above"), count(F.col("silhouette") <= F.col("observed")).alias("below"))
    one = lambda c: (F.col(c) + 1) / (F.col("n") + 1)
    gap = F.col("observed") - F.col("mean")
    return both.select(F.col("region").alias("label"), "observed", "mean", "spread", gap.alias("adjusted"), (gap / (F.col("spread") + 1e-12)).alias("z"), F.least(F.lit(1.0), 2 * F.least(one("above"), one("below"))).alias("p"), "n_obs")


def region_vectors(expr: DataFrame, genes: DataFrame) -> DataFrame:
    """Each observation's values of its region's genes, in order of name: ``(section, obs_id, label, vector)``.

    ``expr`` is dense; ``genes(label, feature)`` lists some tens to hundreds a region.
    """
    wanted = if_small(genes.select("label", "feature").distinct())
    entry = F.struct("feature", "value")
    return expr.join(wanted, ["label", "feature"]).groupBy("section", "obs_id", "label").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["value"]).alias("vector"))


def region_silhouettes(expr: DataFrame, obs: DataFrame, genes: DataFrame, n_perm: int = 200, least: int = 10) -> DataFrame:
    """A row a region; silhouette columns are null without genes, with fewer than ``least`` observations, or with one section."""
    n = obs.groupBy("label").agg(F.count(F.lit(1)).alias("n_spots"))
    n_genes = genes.groupBy("label").agg(F.countDistinct("feature").alias("n_genes"))
    able = if_small(n.where(F.col("n_spots") >= least).select("label"))
    scored = permuted_silhouette(region_vectors(expr, genes).join(able, "label", "left_semi"), n_perm).drop("n_obs")
    return n.join(n_genes, "label", "left").withColumn("n_genes", F.coalesce("n_genes", F.lit(0).cast("long"))).join(scored, "label", "left")


def heterogeneity_score(silhouettes: DataFrame, stability: DataFrame) -> DataFrame:
    """Adjusted silhouette times adjusted gene score, scaled over regions; 0 where all are equal."""
    everything = Window.partitionBy(F.lit(1))
    joined = silhouettes.select("label", F.col("adjusted").alias("adjusted_silhouette")).join(stability.select("label", F.col("adjusted").alias("adjusted_genes")), "label")
    scored = joined.withColumn("score", F.col("adjusted_silhouette") * F.col("adjusted_genes"))
    low, high = F.min("score").over(everything), F.max("score").over(everything)
    return scored.withColumn("scaled", F.when(high > low, (F.col("score") - low) / F.when(high > low, high - low)).otherwise(0.0))


def heterogeneous_regions(scores: DataFrame, threshold: float | None = None, top: int | None = None, ties: bool = True) -> DataFrame:
    """Regions at or above the threshold, or the top ones, with or without ties at the last place."""
    if threshold is not None:
        return scores.where(F.col("scaled") >= threshold)
    order = Window.orderBy(F.desc("scaled")) if ties else Window.orderBy(F.desc("scaled"), "label")
    return scores.withColumn("place", (F.rank() if ties else F.row_number()).over(order)).where(F.col("place") <= top)
