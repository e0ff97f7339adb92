"""Subtypes of heterogeneous regions: within sections, shared between them, and their markers (stage X)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.joins import if_small
from loomspark.operators.embedding import group_components, group_k_means, group_scaled
from loomspark.operators.features import detected_features, scale_min_max, shared_features
from loomspark.operators.heterogeneity import heterogeneity_score, heterogeneous_regions, region_silhouettes, region_vectors, silhouette
from loomspark.operators.markers import marker_stability, marker_union, overlap_features, region_markers

_JOINT = "\u0001"


def _key(*columns: str) -> Column:
    return F.concat_ws(_JOINT, *columns)


def _parts(key: str, *names: str) -> list[Column]:
    return [F.split(key, _JOINT)[i].alias(name) for i, name in enumerate(names)]


def best_cluster_numbers(vectors: DataFrame, key: str, least: int = 2, most: int = 5, column: str = "vector", seeds: int = 10) -> DataFrame:
    """The number of k-means clusters with the largest silhouette for each group: ``(key, k, silhouette, best)``.

    k from ``least`` to ``most``, or to one less than the rows where these are fewer; the smallest of equal ones
    is best. All groups and all k are clustered in one run. A group of too few rows has no row.
    """
    n = {r["key"]: r.n for r in vectors.groupBy(F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a group
    wanted = {f"{name}{_JOINT}{k}": k for name, rows in n.items() for k in range(least, min(most, rows - 1) + 1)}
    tries = F.explode(F.sequence(F.lit(least), F.lit(most))).alias("k")
    ids = [c for c in ("section", "obs_id") if c in vectors.columns]
    many = vectors.select(F.col(key).cast("string").alias("own"), *ids, F.col(column).alias("vector"), tries).withColumn("key", _key("own", "k")).where(F.col("key").isin(list(wanted)))
    clusters = group_k_means(many, "key", wanted, "vector", seeds)
    scored = silhouette(many.join(clusters, ["key", *ids]), "key", "cluster").select(*_parts("region", "key", "k"), F.round("silhouette", 9).alias("silhouette"))
    scored = scored.withColumn("k", F.col("k").cast("int"))
    order = Window.partitionBy("key").orderBy(F.desc("silhouette"), "k")  # a row a number of clusters
    return scored.withColumn("best", F.row_number().over(order) == 1)


def section_subtypes(vectors: DataFrame, k: int = 3, components: int = 30, seeds: int = 10) -> DataFrame:
    """Clusters of each region in each section by itself: ``(label, section, obs_id, cluster)``.

    ``vectors(section, obs_id, label, vector)`` on the region's genes. Groups with fewer than ``k`` + 1
    observations are left out.
    """
    keyed = vectors.withColumn("_key", _key("label", "section"))
    n = {r["_key"]: r["count"] for r in keyed.groupBy("_key").count().collect()}  # a row a region and section
    able = {name: k for name, rows in n.items() if rows > k}
    embedded = group_scaled(group_components(keyed.where(F.col("_key").isin(list(able))), "_key", components), "_key", "pca")
    found = group_k_means(embedded, "_key", able, "pca", seeds)
    return found.select(_parts("key", "label")[0], "section", "obs_id", "cluster")


def subtype_markers(expr: DataFrame, subtypes: DataFrame, least_share: float = 0.05, by: tuple[str, ...] = ("label", "section"), **bounds: float) -> DataFrame:
    """Markers of each subtype against the other ones of its group: ``(by, subtype, feature, place, ...)``.

    Only subtypes with more than ``least_share`` of their group, and groups with more than one subtype.
    """
    group = Window.partitionBy(*by)  # a row a subtype
    size = subtypes.groupBy(*by, "cluster").agg(F.count(F.lit(1)).alias("n"))
    able = size.withColumn("share", F.col("n") / F.sum("n").over(group)).withColumn("n_clusters", F.count(F.lit(1)).over(group))
    able = able.where((F.col("share") > least_share) & (F.col("n_clusters") > 1)).select(*by, F.col("cluster").cast("string").alias("subtype"))
    own = subtypes.select(*by, "obs_id", F.col("cluster").cast("string").alias("subtype"), *[c for c in ("section",) if c not in by and c in subtypes.columns])
    where = [c for c in ("section", "obs_id") if c in own.columns]
    labelled = expr.select("section", "obs_id", "feature", "value").join(own, where)
    found = region_markers(labelled.withColumnRenamed("label", "region").withColumnRenamed("subtype", "label") if "label" in by else labelled.withColumnRenamed("subtype", "label"), by=["region" if c == "label" else c for c in by], **bounds)
    named = found.withColumnRenamed("label", "subtype")
    if "label" in by:
        named = named.withColumnRenamed("region", "label")
    return named.join(if_small(able), [*by, "subtype"], "left_semi").select(*by, "subtype", "feature", "place", "fold_change", "p_adj")


def shared_subtypes(expr: DataFrame, genes: DataFrame, most: int = 5, seeds: int = 10) -> DataFrame:
    """Subtypes of each region over all its sections, ``(label, section, obs_id, cluster, k)``.

    Values are scaled within their section; the number of clusters is that of W10.
    """
    vectors = region_vectors(scale_min_max(expr), genes)
    numbers = {r["key"]: r.k for r in best_cluster_numbers(vectors, "label", 2, most, "vector", seeds).where("best").collect()}  # a row a region
    found = group_k_means(vectors, "label", numbers, "vector", seeds).withColumnRenamed("key", "label")
    k = F.coalesce(*[F.when(F.col("label") == name, F.lit(n)) for name, n in numbers.items()], F.lit(0))
    return vectors.select("label", "section", "obs_id").join(found, ["label", "section", "obs_id"]).withColumn("k", k)


def shared_markers(expr: DataFrame, subtypes: DataFrame, cutoff: int = 2, **bounds: float) -> tuple[DataFrame, DataFrame]:
    """Markers of shared subtypes in the merged scaled matrix, and those that sections agree on (unscaled, A31)."""
    merged = subtype_markers(scale_min_max(expr), subtypes, 0.0, ("label",), **bounds)
    each = subtype_markers(expr, subtypes, 0.0, ("label", "section"), **bounds)
    named = each.select(_key("label", "subtype").alias("label"), "section", "feature")
    agreed = overlap_features(named, cutoff).select(*_parts("label", "label", "subtype"), "feature", "n_sections")
    return merged, agreed


def region_status(obs: DataFrame, genes: DataFrame, least: int = 10) -> DataFrame:
    """Whether a region's subtypes can be sought: ``(label, n_sections, n_genes, status)``.

    A section counts with at least ``least`` of the region's observations.
    """
    n = obs.groupBy("label", "section").agg(F.count(F.lit(1)).alias("n"))
    sections = n.groupBy("label").agg(F.sum((F.col("n") >= least).cast("long")).alias("n_sections"))
    n_genes = genes.groupBy("label").agg(F.countDistinct("feature").alias("n_genes"))
    both = sections.join(n_genes, "label", "left").withColumn("n_genes", F.coalesce("n_genes", F.lit(0).cast("long")))
    return both.withColumn("status", F.when(F.col("n_sections") < 2, "fewer than two sections").when(F.col("n_genes") == 0, "no genes").otherwise("success"))


def score_regions(expr: DataFrame, obs: DataFrame, n_perm: int = 200, least_detected: float = 0.05, **bounds: float) -> dict[str, DataFrame]:
    """P06, A06, A27, A26, A29, A30. A section that keeps no feature is an error."""
    shared = expr.join(if_small(shared_features(expr).select("feature")), "feature", "left_semi")
    kept = detected_features(shared, obs, least_detected).select("section", "feature")
    emptied = [r.section for r in obs.select("section").distinct().join(kept, "section", "left_anti").orderBy("section").collect()]  # a row a section
    if emptied:
        raise ValueError(f"no feature is detected often enough in {emptied}")
    filtered = shared.join(if_small(kept), ["section", "feature"], "left_semi")
    markers = region_markers(filtered, **bounds).select("section", "label", "feature")
    common = shared_features(filtered)
    genes = marker_union(markers, common)
    silhouettes = region_silhouettes(filtered, obs, genes, n_perm)
    stability = marker_stability(markers)
    return {"genes": genes, "silhouettes": silhouettes, "stability": stability, "scores": heterogeneity_score(silhouettes.where("adjusted is not null"), stability)}


def heterogeneity_pipeline(expr: DataFrame, obs: DataFrame, n_perm: int = 200, threshold: float | None = 0.5, top: int | None = None, most: int = 5, seeds: int = 10, **bounds: float) -> dict[str, DataFrame]:
    """X01, W05, and X02 to X04 for the chosen regions that X05 lets pass. Regions are few; their names are read."""
    found = score_regions(expr, obs, n_perm, **bounds)
    chosen = heterogeneous_regions(found["scores"], threshold, top).select("label")
    status = region_status(obs, found["genes"]).join(if_small(chosen), "label", "left_semi")
    names = [r.label for r in status.where("status = 'success'").collect()]
    inside = expr.where(F.col("label").isin(names))
    genes = found["genes"].where(F.col("label").isin(names))
    out = {**found, "status": status}
    if names:
        own = section_subtypes(region_vectors(inside, genes), seeds=seeds)
        joint = shared_subtypes(inside, genes, most, seeds)
        merged, agreed = shared_markers(inside, joint, **bounds)
        out |= {"section_subtypes": own, "section_markers": subtype_markers(inside, own, **bounds), "shared_subtypes": joint, "merged_markers": merged, "agreed_markers": agreed}
    return out
