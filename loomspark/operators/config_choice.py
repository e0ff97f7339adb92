"""Which modalities and which embedding to cluster by, scored against reference labels (stage 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.joins import if_small
from loomspark.operators.assignment import adjusted_rand, summarise_scores
from loomspark.operators.embedding import group_components, group_k_means, group_scaled


def clustering_scores(vectors: DataFrame, labels: DataFrame, kind: str, components: int = 30, seeds: int = 10, least_obs: int = 10, boundary: bool = False) -> DataFrame:
    """How well clusters of each (``kind``, section) find its labels: ``(kind, section, status, n_obs, n_labels, ari)``.

    ``vectors(kind, section, obs_id, vector)``, ``labels(section, obs_id, label)``; rows without a label take
    no part. All kinds and sections are embedded and clustered together, into as many clusters as a section
    has labels, one more with ``boundary``. ``status`` is ``success``, or says why there is no score.
    """
    both = vectors.join(labels.select("section", "obs_id", "label").where("label is not null"), ["section", "obs_id"])
    key = F.concat_ws("\u0001", kind, "section")
    keyed = both.withColumn("_kind_section", key)
    counted = keyed.groupBy("_kind_section", kind, "section").agg(F.count(F.lit(1)).alias("n_obs"), F.countDistinct("label").alias("n_labels"))
    status = F.when(F.col("n_labels") < 2, "fewer than two labels").when(F.col("n_obs") < least_obs, "too few observations").when(F.col("n_obs") <= F.col("n_labels") + int(boundary), "fewer observations than clusters").otherwise("success")
    counted = if_small(counted.withColumn("status", status))
    able = {r["_kind_section"]: r.n_labels + int(boundary) for r in counted.where("status = 'success'").collect()}  # a row a kind and section
    if not able:
        return counted.select(kind, "section", "status", "n_obs", "n_labels", F.lit(None).cast("double").alias("ari"))
    rows = keyed.where(F.col("_kind_section").isin(list(able)))
    embedded = group_scaled(group_components(rows.select("_kind_section", "obs_id", "vector"), "_kind_section", components), "_kind_section", "pca")
    clusters = group_k_means(embedded, "_kind_section", able, "pca", seeds).withColumnRenamed("key", "_kind_section")
    scored = adjusted_rand(rows.select("_kind_section", "obs_id", "label").join(clusters, ["_kind_section", "obs_id"]), "label", "cluster", "_kind_section")
    return counted.join(scored, "_kind_section", "left").select(kind, "section", "status", "n_obs", "n_labels", "ari")


def score_summary(scores: DataFrame, kind: str) -> DataFrame:
    """Mean, median, least and most score of each kind over its successful sections, best mean first."""
    return summarise_scores(scores.where("status = 'success'"), kind, "ari")


def select_modalities(means: DataFrame, hard: float = 0.3, alpha: float = 0.8, criterion: str = "both", order: list[str] | None = None) -> list[str]:
    """Modalities whose mean reaches ``hard``, ``alpha`` times the best, or both; Gene where none does.

    In the order given, else best first. Gene is the fallback even if it was not scored. A row a modality.
    """
    rows = means.orderBy(F.desc("mean"), "modality").collect()
    best = max((r["mean"] for r in rows), default=0.0)
    able = {r["modality"] for r in rows if (criterion == "relative" or r["mean"] >= hard) and (criterion == "hard" or r["mean"] >= alpha * best)}
    ordered = [m for m in (order or [r["modality"] for r in rows]) if m in able]
    return ordered or ["Gene"]


def best_method(summary: DataFrame, candidates: list[str], kind: str = "method") -> str:
    """The candidate with the best mean, on a tie the first named."""
    mean = {r[kind]: r["mean"] for r in summary.collect()}  # a row a method
    able = [c for c in candidates if mean.get(c) is not None]
    if not able:
        raise ValueError("no method has a score")
    return max(able, key=lambda c: (round(mean[c], 9), -candidates.index(c)))


def clustering_config(by_modality: DataFrame, by_method: DataFrame, candidates: list[str], hard: float = 0.3, alpha: float = 0.8, criterion: str = "both") -> dict[str, object]:
    """C17: the choice from the scores of C14 and C16."""
    means = score_summary(by_modality, "modality")
    methods = score_summary(by_method, "method")
    return {"modalities": select_modalities(means, hard, alpha, criterion), "dim_reduction_method": best_method(methods, candidates), "modality_scores": means, "method_scores": methods}
