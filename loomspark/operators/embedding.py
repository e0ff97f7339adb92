"""Embeddings and clusterings of many groups at once.

A group is a section, a tree node or a modality of one: rows with the same ``key``. Principal components come
from moments that tasks sum up by group, and every step of k-means is one pass over the rows for all groups
and all seeds. What comes to the driver are moments and centroids, whose size depends on the number of groups
and features and not on the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.joins import if_small
from loomspark.sources.materialise import materialise

#: Rows of each group from which seeds are drawn, and numbers of all centroids together.
SEED_ROWS, MOST_NUMBERS = 1_000, 20_000_000
#: Steps of k-means and the relative fall in cost at which it ends.
STEPS, LEAST_FALL = 20, 1e-3


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long lists of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sum_lists(table: DataFrame, keys: list[str], **lists: str) -> DataFrame:
    """Element-wise sums of arrays by key, after ``mapInArrow`` summed them within tasks."""

    def add(group: pa.Table) -> pa.Table:
        first = {k: [group.column(k)[0].as_py()] for k in keys}
        sums = {c: [np.sum(_matrix(group.column(c).combine_chunks()), axis=0)] for c in lists}
        return pa.table({**first, **sums}, schema=pa.schema([*((k, group.schema.field(k).type) for k in keys), *((c, pa.list_(pa.float64())) for c in lists)]))

    kinds = dict(table.dtypes)
    return table.groupBy(*keys).applyInArrow(add, ", ".join([*(f"{k} {kinds[k]}" for k in keys), *(f"{c} array<double>" for c in lists)]))


def group_components(vectors: DataFrame, key: str, k: int, column: str = "vector") -> DataFrame:
    """C01 for every group: the first k centred scores as ``pca``; each component's largest loading is positive.

    ``k`` is cut to the number of features and of the group's rows less one; groups of one row have no scores.
    Rows of one group have equally many features.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            names, x = np.array(batch.column(0).to_pylist(), dtype=object), batch.column(1)
            for name in dict.fromkeys(names):
                own = _matrix(x.filter(pa.array(names == name)))
                own = np.concatenate((np.ones((len(own), 1)), own), axis=1)
                part = (own.T @ own).ravel()
                held[name] = held[name] + part if name in held else part
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.list_(pa.float64()))], ["key", "moments"])

    named = vectors.select(F.col(key).cast("string").alias("key"), F.col(column).alias("x"))
    summed = _sum_lists(named.mapInArrow(moments, "key string, moments array<double>"), ["key"], moments="array<double>").collect()  # a row a group
    models = []
    for row in summed:
        m = np.array(row.moments)
        m = m.reshape(int(np.sqrt(len(m))), -1)
        n, mean = m[0, 0], m[0, 1:] / m[0, 0]
        spread = m[1:, 1:] / n - np.outer(mean, mean)
        value, axes = np.linalg.eigh(spread)
        axes = axes[:, np.argsort(-value, kind="stable")[: max(0, min(k, len(mean), int(n) - 1))]]
        signs = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])]) if axes.size else np.zeros(0)
        models.append((row.key, mean.tolist(), (axes * np.where(signs == 0, 1, signs)).T.tolist()))
    model = vectors.sparkSession.createDataFrame(models, "_model string, _mean array<double>, _axes array<array<double>>")
    placed = vectors.join(F.broadcast(model), F.col(key).cast("string") == F.col("_model"))  # a row a group, k vectors each
    dot = lambda axis: F.aggregate(F.zip_with(axis, F.zip_with(column, "_mean", lambda a, b: a - b), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return placed.withColumn("pca", F.transform("_axes", dot)).drop("_model", "_mean", "_axes")


def principal_components(vectors: DataFrame, k: int) -> DataFrame:
    """C01 of all rows as one group."""
    return group_components(vectors.withColumn("_all", F.lit("all")), "_all", k).drop("_all")


def group_scaled(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """N05, C02 for every group: each place of the array centred and divided by its population spread."""
    places = vectors.select(F.col(key).alias("_g"), F.posexplode(column).alias("pos", "v")).groupBy("_g", "pos").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    entry = F.struct("pos", "m", F.when(F.col("s") > 0, F.col("s")).otherwise(1.0).alias("s"))
    stats = places.groupBy("_g").agg(F.array_sort(F.collect_list(entry)).alias("_stats"))
    placed = vectors.join(if_small(stats), F.col(key) == F.col("_g"))
    return placed.withColumn(column, F.zip_with(column, "_stats", lambda a, t: (a - t["m"]) / t["s"])).drop("_stats", "_g")


def scaled(vectors: DataFrame, column: str) -> DataFrame:
    """N05, C02 of all rows as one group."""
    return group_scaled(vectors.withColumn("_all", F.lit("all")), "_all", column).drop("_all")


def selected_features(expr: DataFrame, features: DataFrame) -> DataFrame:
    """The wanted features of each observation as an array in their order; absent ones count 0.

    ``features`` has ``feature`` and ``ord``, a list that one array can hold.
    """
    order = if_small(features.groupBy("feature").agg(F.min("ord").alias("ord")))
    lists = expr.join(order, "feature").groupBy("section", "obs_id").agg(F.array_sort(F.collect_list(F.struct("ord", "value"))).alias("own"))
    wanted = features.groupBy("feature").agg(F.min("ord").alias("ord")).agg(F.array_sort(F.collect_list("ord")).alias("ords"))
    filled = lambda o: F.coalesce(F.get(F.filter("own", lambda x: x["ord"] == o), 0)["value"], F.lit(0.0))
    return lists.join(F.broadcast(wanted), how="cross").select("section", "obs_id", F.transform("ords", filled).alias("vector"))  # one row


def join_modalities(parts: list[DataFrame], column: str = "vector", strict: bool = False) -> DataFrame:
    """Arrays of several modalities side by side, for observations that all of them hold.

    With ``strict`` an observation that only some hold is an error when rows are read.
    """
    named = [p.select("section", "obs_id", F.col(column).alias(f"part_{i}")) for i, p in enumerate(parts)]
    joined = reduce(lambda a, b: a.join(b, ["section", "obs_id"], "full" if strict else "inner"), named)
    if strict:
        lacking: Column = reduce(lambda a, b: a | b, [F.col(f"part_{i}").isNull() for i in range(len(parts))])
        wrong = F.raise_error(F.concat(F.lit("a modality lacks observation "), F.col("obs_id").cast("string"))).cast("boolean")
        joined = joined.where(F.when(lacking, wrong).otherwise(F.lit(True)))
    return joined.select("section", "obs_id", F.concat(*[f"part_{i}" for i in range(len(parts))]).alias(column))


def _closest(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and its squared distance."""
    d = np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ centre.T + (centre**2).sum(axis=1)[None], 0)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(x)), at]


def _seeded(x: np.ndarray, k: int, r: np.random.Generator) -> np.ndarray:
    """k centres: rows of x, each drawn by its squared distance to those before, then settled on x."""
    chosen = [int(r.integers(len(x)))]
    gap = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        total = gap.sum()
        chosen.append(int(r.choice(len(x), p=gap / total)) if total > 0 else int(np.setdiff1d(np.arange(len(x)), chosen)[0]))
        gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    centre, before = x[chosen], np.inf
    for _ in range(STEPS):
        at, d = _closest(x, centre)
        if before - d.sum() <= LEAST_FALL * d.sum():
            break
        before, n = d.sum(), np.bincount(at, minlength=k)[:, None]
        sums = np.zeros_like(centre)
        np.add.at(sums, at, x)
        centre = np.where(n > 0, sums / np.maximum(n, 1), centre)
    return centre


def group_k_means(vectors: DataFrame, key: str, k: dict[str, int], column: str = "vector", seeds: int = 10) -> DataFrame:
    """C04, C06, W08 for every group named in ``k``: ``(key, section, obs_id, cluster)`` of least cost among the seeds.

    An observation is its section and obs_id; without a column ``section``, or where that is the key, its obs_id,
    of any type. Clusters are numbered by falling size, from 0. Seeds are drawn on the driver from SEED_ROWS rows
    of each group, chosen by a hash of their ids, and settled on these; the steps after that go over all rows. A
    cluster that loses its rows keeps its place. Groups with fewer rows than clusters, or fewer than two clusters,
    are an error.
    """
    ids = [c for c in ("section", "obs_id") if c in vectors.columns and c != key]
    base = vectors.select(F.col(key).cast("string").alias("key"), *ids, F.col(column).alias("x")).where(F.col("key").isin(list(k)))
    rows = materialise(base.repartition("key", *ids))
    sizes = if_small(rows.groupBy("key").agg(F.count(F.lit(1)).alias("_size")))
    likely = (F.shiftrightunsigned(F.xxhash64(*ids), 11) / float(1 << 53)) * F.col("_size") < 4 * SEED_ROWS  # few rows are sorted
    order = Window.partitionBy("key").orderBy(F.xxhash64(*ids), *ids)
    drawn = rows.join(sizes, "key").where(likely).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= SEED_ROWS)
    sample = drawn.drop("_n", "_size").toArrow().sort_by([("key", "ascending"), *((c, "ascending") for c in ids)])
    names = np.array(sample.column("key").to_pylist(), dtype=object)
    width = len(sample.column("x")[0]) if len(sample) else 0
    if seeds * sum(k.values()) * width > MOST_NUMBERS:
        raise ValueError("too many centroids: take fewer groups at a time")
    centres: dict[str, np.ndarray] = {}
    for name, n in k.items():
        own = np.flatnonzero(names == name)
        if n < 2 or len(own) < n:
            raise ValueError(f"k-means of {name} needs two clusters and as many rows")
        x = _matrix(sample.column("x").take(pa.array(own)).combine_chunks())
        centres[name] = np.stack([_seeded(x, n, np.random.default_rng(s)) for s in range(seeds)])

    def step(now: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[str, np.ndarray] = {}
            for batch in batches:
                own_names = np.array(batch.column(0).to_pylist(), dtype=object)
                for name in dict.fromkeys(own_names):
                    x = _matrix(batch.column("x").filter(pa.array(own_names == name)))
                    n_seeds, n, w = now[name].shape
                    out = held.setdefault(name, np.zeros((n_seeds, n, w + 2)))
                    for s in range(n_seeds):
                        at, d = _closest(x, now[name][s])
                        np.add.at(out[s], at, np.concatenate((x, np.ones((len(x), 1)), d[:, None]), axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([h.ravel() for h in held.values()], pa.list_(pa.float64()))], ["key", "sums"])

        found = _sum_lists(rows.mapInArrow(sums, "key string, sums array<double>"), ["key"], sums="array<double>").collect()  # a row a group
        new, cost = dict(now), {}
        for row in found:
            out = np.array(row.sums).reshape(*now[row.key].shape[:2], -1)
            n = out[..., -2:-1]
            new[row.key] = np.where(n > 0, out[..., :-2] / np.maximum(n, 1), now[row.key])
            cost[row.key] = out[..., -1].sum(axis=1)
        return new, cost

    before: dict[str, np.ndarray] = {}
    cost: dict[str, np.ndarray] = {}
    for _ in range(STEPS):
        moved, cost = step(centres)
        if before and all((before[name] - cost[name] <= LEAST_FALL * np.maximum(before[name], 1e-12)).all() for name in cost):
            break
        centres, before = moved, cost
    best = {name: centres[name][int(np.round(c, 9).argmin())] for name, c in cost.items()}

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own_names, out = np.array(batch.column(0).to_pylist(), dtype=object), np.zeros(len(batch), dtype=np.int32)
            for name in dict.fromkeys(own_names):
                here = own_names == name
                out[here] = _closest(_matrix(batch.column("x").filter(pa.array(here))), best[name])[0]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", *ids)), pa.array(out)], ["key", *ids, "cluster"])

    found = rows.mapInArrow(label, ", ".join(["key string", *(f"{c} {dict(rows.dtypes)[c]}" for c in ids), "cluster int"]))
    return dense_by_size(found, ["key"])


def dense_by_size(clusters: DataFrame, by: list[str]) -> DataFrame:
    """Clusters numbered from 0 by falling size, on a tie by their old number."""
    size = clusters.groupBy(*by, "cluster").agg(F.count(F.lit(1)).alias("n"))
    number = size.select(*by, "cluster", (F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "cluster")) - 1).alias("_number"))  # a row a cluster
    return clusters.join(if_small(number), [*by, "cluster"]).drop("cluster").withColumnRenamed("_number", "cluster")


def k_means(vectors: DataFrame, k: int, column: str = "vector", seeds: int = 10) -> DataFrame:
    """C04, W08 of all rows as one group: every row with its ``cluster``."""
    ids = [c for c in ("section", "obs_id") if c in vectors.columns]
    found = group_k_means(vectors.withColumn("_all", F.lit("all")), "_all", {"all": k}, column, seeds)
    return vectors.join(found.select(*ids, "cluster"), ids)


def kept_clusters(clusters: DataFrame, least: int = 1, most: int | None = None, by: list[str] | None = None) -> DataFrame:
    """The largest clusters, ``(by, cluster, n)``: those of at least ``least`` rows if two are, else by size alone."""
    by = by or []
    group = Window.partitionBy(*by)
    size = clusters.groupBy(*by, "cluster").agg(F.count(F.lit(1)).alias("n"))
    n_large = F.sum((F.col("n") >= least).cast("int")).over(group)
    able = size.withColumn("n_large", n_large).where((F.col("n") >= least) | (F.col("n_large") < 2))
    place = F.row_number().over(group.orderBy(F.desc("n"), "cluster"))  # a row a cluster
    cap = F.least(F.lit(most if most is not None else 2**31 - 1), F.count(F.lit(1)).over(group))
    return able.withColumn("place", place).withColumn("cap", cap).where(F.col("place") <= F.greatest(F.lit(1), F.col("cap"))).select(*by, "cluster", "n")


def control_clusters(clusters: DataFrame, least: int = 1, most: int | None = None, column: str = "vector", by: list[str] | None = None, dense: bool = True) -> DataFrame:
    """Clusters beyond W07 go to the kept cluster with the nearest centroid, all at once; then W08.

    Where several keys are given in ``by``, each is controlled by itself.
    """
    by = by or []
    kept = kept_clusters(clusters, least, most, by).select(*by, "cluster", F.lit(True).alias("kept"))
    means = clusters.select(*by, "cluster", F.posexplode(column).alias("pos", "v")).groupBy(*by, "cluster", "pos").agg(F.avg("v").alias("m"))
    marked = means.join(if_small(kept), [*by, "cluster"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    small, large = marked.where("not kept"), marked.where("kept").withColumnRenamed("cluster", "to").withColumnRenamed("m", "to_m").drop("kept")
    gap = small.join(large, [*by, "pos"]).groupBy(*by, "cluster", "to").agg(F.round(F.sum((F.col("m") - F.col("to_m")) ** 2), 9).alias("d"))
    nearest = gap.groupBy(*by, "cluster").agg(F.min_by("to", F.struct("d", "to")).alias("to"))
    moved = clusters.join(if_small(nearest), [*by, "cluster"], "left").withColumn("cluster", F.coalesce("to", "cluster")).drop("to")
    return dense_by_size(moved, by) if dense else moved


def merge_small_clusters(clusters: DataFrame, least: int, column: str = "vector") -> DataFrame:
    """C07 without a cap."""
    return control_clusters(clusters, least, None, column)
