"""Clusters after the fact: boundary refinement, gene subtypes, components, and clustering of feature profiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.joins import if_small
from loomspark.operators.components import connected_components
from loomspark.operators.embedding import dense_by_size, group_components, group_k_means
from loomspark.operators.graph_clusters import graph_communities, neighbour_graph
from loomspark.operators.neighbours import nearest_majority, refine_labels
from loomspark.operators.raster import boundary_scores
from loomspark.sources.materialise import materialise

#: C10, fixed values: the sets of colour-like features that are looked for, in order.
BOUNDARY_SETS = (("rgb_0", "rgb_1", "rgb_2"), ("hipt_576", "hipt_577", "hipt_578"))


def resolve_features(var: DataFrame, wanted: list[str]) -> DataFrame:
    """``(asked, feature)`` for the wanted names: a feature of that name, else the only one with it as ``source_name``.

    ``var(feature, source_name)``. Names that neither finds, or several features share as their source, have no row.
    """
    asked = var.sparkSession.createDataFrame([(n, i) for i, n in enumerate(wanted)], "asked string, ord int")
    by_name = var.select(F.col("feature").alias("asked"), "feature", F.lit(0).alias("how")).distinct()
    source = var.where("source_name is not null").groupBy(F.col("source_name").alias("asked")).agg(F.min("feature").alias("feature"), F.countDistinct("feature").alias("n"))
    both = by_name.union(source.where("n = 1").select("asked", "feature", F.lit(1).alias("how")))
    best = both.join(F.broadcast(asked), "asked").groupBy("asked", "ord").agg(F.min_by("feature", "how").alias("feature"))  # the caller's list
    return best.select("asked", "feature", "ord")


def boundary_features(var: DataFrame, sets: tuple[tuple[str, ...], ...] = BOUNDARY_SETS) -> list[str]:
    """The first of the sets of names whose members are all found; empty without one."""
    found = {r.asked: r.feature for r in resolve_features(var, [n for s in sets for n in s]).collect()}  # a row a name
    return next(([found[n] for n in s] for s in sets if all(n in found for n in s)), [])


def refine_boundary(clusters: DataFrame, scores: DataFrame, k: int = 25, smooth_k: int = 15, weighted: bool = False, smooth: bool = True) -> DataFrame:
    """C11: points of a section's boundary cluster take the label of most of the k nearest other points; then L09.

    ``clusters(section, obs_id, x, y, cluster)``; ``scores(section, cluster, boundary)`` as A33 gives them.
    Returns ``(section, obs_id, cluster, reassigned, refined)``. Sections without a boundary cluster, or with
    nothing else, stay as they are and are not smoothed.
    """
    edge = scores.where("boundary").select("section", F.col("cluster").cast("string").alias("label"), F.lit(True).alias("edge"))
    named = clusters.withColumn("label", F.col("cluster").cast("string")).join(if_small(edge), ["section", "label"], "left")
    mixed = named.groupBy("section").agg(F.max(F.coalesce("edge", F.lit(False))).alias("has"), F.min(F.coalesce("edge", F.lit(False))).alias("only")).where("has and not only").select("section")
    work = materialise(named.join(if_small(mixed.withColumn("active", F.lit(True))), "section", "left"))
    active = work.where("active")
    voted = nearest_majority(active.where("edge"), active.where("edge is null"), k, weighted).withColumnRenamed("label", "voted")
    moved = materialise(work.join(voted, ["section", "obs_id"], "left").withColumn("reassigned", F.coalesce("voted", "label")))
    if not smooth:
        return moved.select("section", "obs_id", "cluster", "reassigned", F.col("reassigned").alias("refined"))
    smoothed = refine_labels(moved.where("active").select("section", "obs_id", "x", "y", F.col("reassigned").alias("label")), smooth_k).select("section", "obs_id", "refined")
    return moved.join(smoothed, ["section", "obs_id"], "left").select("section", "obs_id", "cluster", "reassigned", F.coalesce("refined", "reassigned").alias("refined"))


def _graph_parts(vectors: DataFrame, resolution: float, most: int, k: int) -> DataFrame:
    """``(key, node, part)``: graph clusters of each key at the first of the falling resolutions that gives ``most`` at most.

    The last resolution counts however many clusters it gives. The graph is built once for all.
    """
    edges = materialise(neighbour_graph(vectors, "key", k))
    steps = list(dict.fromkeys(r for r in (resolution, resolution / 2, resolution / 4, 0.05, 0.01) if r <= resolution))
    done, left = None, edges
    for step in steps:
        found = materialise(graph_communities(left, step))
        n = found.groupBy("key").agg((F.max("cluster") + 1).alias("n")).collect()  # a row a cluster of the section
        over = [r.key for r in n if r.n > most] if step != steps[-1] else []
        settled = found.where(~F.col("key").isin(over)) if over else found
        done = settled if done is None else done.union(settled)
        if not over:
            break
        left = edges.where(F.col("key").isin(over))
    return done.withColumnRenamed("cluster", "part")


def gene_subtypes(expr: DataFrame, clusters: DataFrame, features: DataFrame, n_first: int = 10, least: int = 50, least_share: float = 0.05, most: int = 3, components: int = 10, seeds: int = 10, method: str = "graph", resolution: float = 0.5, k: int = 15) -> DataFrame:
    """Clusters split further by genes: ``(section, obs_id, cluster, subtype, code)``.

    ``clusters(section, obs_id, cluster)``, ``features(direction, feature, place)``: the first ``n_first`` of
    each direction are used. A cluster is split if it has ``least`` observations and ``least_share`` of all; its
    parts are named ``cluster_part``, others ``cluster_0``. Codes number the names. All clusters are embedded and
    split together: by ``graph`` clusters at a resolution that falls until there are ``most`` at most, or by
    ``k_means`` into ``most``. Observations are told apart by section and id.
    """
    genes = features.where(F.col("place") <= n_first).select("feature").distinct()
    size = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    total = size.agg(F.sum("n")).first()[0] or 0
    able = [r.cluster for r in size.where((F.col("n") >= least) & (F.col("n") >= least_share * total)).collect()]  # a row a cluster
    name = F.col("cluster").cast("string")
    if able:
        entry = F.transform(F.array_sort(F.collect_list(F.struct("feature", "value"))), lambda x: x["value"])
        inside = clusters.where(F.col("cluster").isin(able))
        vectors = expr.join(if_small(genes), "feature").join(inside, ["section", "obs_id"]).groupBy("section", "obs_id", name.alias("key")).agg(entry.alias("vector"))
        embedded = group_components(vectors, "key", components)
        node = F.xxhash64("section", "obs_id")
        if method == "graph":
            parts = _graph_parts(embedded.select("key", node.alias("obs_id"), F.col("pca").alias("vector")), resolution, most, k).select("node", "part")
        else:
            parts = group_k_means(embedded, "key", {str(c): most for c in able}, "pca", seeds).select(node.alias("node"), F.col("cluster").alias("part"))
        placed = clusters.withColumn("node", node).join(parts, "node", "left").drop("node")
    else:
        placed = clusters.withColumn("part", F.lit(None).cast("int"))
    labelled = placed.withColumn("subtype", F.concat(name, F.lit("_"), F.coalesce(F.col("part"), F.lit(0)).cast("string")))
    codes = labelled.select("subtype").distinct().withColumn("code", F.row_number().over(Window.orderBy("subtype")) - 1)  # a row a subtype
    return labelled.join(if_small(codes), "subtype").select("section", "obs_id", "cluster", "subtype", "code")


def postprocess(expr: DataFrame, clusters: DataFrame, image: DataFrame | None, features: DataFrame | None, boundary: dict | None = None, subtypes: dict | None = None) -> DataFrame:
    """C11 where image features are given, then C12 where gene features are, with the labels of each step.

    ``clusters(section, obs_id, x, y, cluster)``; returns ``(section, obs_id, initial, refined, final)``.
    """
    out = clusters.select("section", "obs_id", "x", "y", F.col("cluster").cast("string").alias("initial"))
    if image is not None:
        options = dict(boundary or {})
        scores = boundary_scores(clusters.select("section", "obs_id", "cluster"), image, options.pop("least", 10))
        step = refine_boundary(clusters, scores, **options).select("section", "obs_id", "refined")
        out = out.join(step, ["section", "obs_id"])
    else:
        out = out.withColumn("refined", F.col("initial"))
    if features is None:
        return out.select("section", "obs_id", "initial", "refined", F.col("refined").alias("final"))
    step = gene_subtypes(expr, out.select("section", "obs_id", F.col("refined").alias("cluster")), features, **(subtypes or {}))
    return out.join(step.select("section", "obs_id", F.col("subtype").alias("final")), ["section", "obs_id"]).select("section", "obs_id", "initial", "refined", "final")


def raster_components(cells: DataFrame, diagonal: bool = True) -> DataFrame:
    """Connected cells of one label: ``(section, gx, gy, label, component, size, place)``; place 1 is a label's largest.

    ``cells(section, gx, gy, label)``; neighbours are the eight round a cell, or the four beside it. All tables are
    as long as the image, so none is broadcast.
    """
    node = F.xxhash64("section", "label", "gx", "gy")  # a cell may have several labels
    named = materialise(cells.withColumn("node", node))
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    moves = F.explode(F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in steps]))
    asked = named.select("section", "label", F.col("node").alias("a"), "gx", "gy", moves.alias("m")).select("section", "label", "a", (F.col("gx") + F.col("m.dx")).alias("gx"), (F.col("gy") + F.col("m.dy")).alias("gy"))
    edges = asked.join(named.select("section", "label", "gx", "gy", F.col("node").alias("b")).hint("merge"), ["section", "label", "gx", "gy"]).select("a", "b")
    found = named.join(connected_components(named.select("node"), edges).hint("merge"), "node")
    first = found.groupBy("section", "label", "component").agg(F.min(F.struct("gy", "gx")).alias("corner"), F.count(F.lit(1)).alias("size"))
    order = Window.partitionBy("section", "label").orderBy(F.desc("size"), "corner")  # a row a component
    ranked = first.withColumn("place", F.row_number().over(order))
    return found.join(ranked.drop("corner").hint("merge"), ["section", "label", "component"]).select("section", "gx", "gy", "label", "component", "size", "place")


def relabel_small(components: DataFrame, least: int) -> DataFrame:
    """Cells of components below ``least`` take the commonest label among their eight neighbours in larger ones.

    Ties go to the label in order of name; a cell without such a neighbour keeps its label.
    """
    around = F.explode(F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x in (-1, 0, 1) for y in (-1, 0, 1) if x or y]))
    small = components.where(F.col("size") < least).select("section", F.col("gx").alias("x"), F.col("gy").alias("y"), around.alias("m"))
    asked = small.select("section", "x", "y", (F.col("x") + F.col("m.dx")).alias("gx"), (F.col("y") + F.col("m.dy")).alias("gy"))
    large = components.where(F.col("size") >= least).select("section", "gx", "gy", "label")
    votes = asked.join(large, ["section", "gx", "gy"]).groupBy("section", "x", "y", "label").agg(F.count(F.lit(1)).alias("n"))
    best = votes.withColumn("r", F.row_number().over(Window.partitionBy("section", "x", "y").orderBy(F.desc("n"), "label"))).where("r = 1")
    new = best.select("section", F.col("x").alias("gx"), F.col("y").alias("gy"), F.col("label").alias("relabelled"))
    return components.join(new, ["section", "gx", "gy"], "left").withColumn("relabelled", F.coalesce("relabelled", "label"))


def ward_clusters(profiles: DataFrame, n_clusters: int, key: str = "label", most: int = 2_000) -> DataFrame:
    """Features of each group clustered by Ward's criterion on their profiles: ``(key, feature, cluster)``.

    ``profiles(key, feature, vector)`` has some tens to hundreds of features a group, ``most`` at most; a group
    with more is an error. Clusters are numbered by falling size.
    """

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        if len(group) > most:
            raise ValueError(f"more than {most} features to cluster")
        group = group.sort_values("feature")
        x = np.stack(group["vector"].to_numpy())
        member, size = np.arange(len(x)), np.ones(len(x))
        d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
        np.fill_diagonal(d, np.inf)
        alive = np.ones(len(x), dtype=bool)
        for _ in range(max(0, len(x) - n_clusters)):
            a, b = sorted(np.unravel_index(np.argmin(d), d.shape))
            far = ((size + size[a]) * d[a] + (size + size[b]) * d[b] - size * d[a, b]) / (size + size[a] + size[b])
            alive[b] = False
            far[~alive], far[a] = np.inf, np.inf
            d[a], d[:, a], d[b], d[:, b] = far, far, np.inf, np.inf
            size[a] += size[b]
            member[member == b] = a
        return pd.DataFrame({key: group[key], "feature": group["feature"], "cluster": member.astype("int32")})

    found = profiles.groupBy(key).applyInPandas(cluster, f"{key} string, feature string, cluster int")
    return dense_by_size(found, [key])
