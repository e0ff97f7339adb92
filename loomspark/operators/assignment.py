"""Quantile anchors, clusters assigned to branches, and agreement of labelings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.joins import if_small
from loomspark.operators.neighbours import pooled_majority


def positive_sections(expr: DataFrame, q: float = 0.5) -> DataFrame:
    """Sections and regions in which the q-quantile of a feature is above 0."""
    return expr.groupBy("section", "label", "feature").agg(F.percentile("value", F.lit(q)).alias("quantile")).where(F.col("quantile") > 0)


def quantile_thresholds(expr: DataFrame, target: str, upper: float = 0.85, lower: float = 0.15) -> DataFrame:
    """A15 for one target region against all others: ``(feature, threshold)``."""
    marked = expr.withColumn("own", F.col("label") == target)
    return side_thresholds(marked, [], upper, lower)


def side_thresholds(expr: DataFrame, by: list[str], upper: float = 0.85, lower: float = 0.15) -> DataFrame:
    """A feature's threshold for a side of a split, ``(by, feature, threshold)``.

    ``expr`` has ``by``, ``feature``, ``label``, ``value`` and ``own``, whether the region is of the side. The
    mean over the other side's regions of their ``upper`` quantiles that are above 0; where none is, over the
    side's own ``lower`` quantiles; where that is none either, the feature is dropped. Exact quantiles keep the
    different values of a region's feature in one task's memory (up to some tens of millions).
    """
    merged = expr.groupBy(*by, "feature", "label", "own").agg(F.percentile("value", F.lit(upper)).alias("upper"), F.percentile("value", F.lit(lower)).alias("lower"))
    other = F.avg(F.when(~F.col("own") & (F.col("upper") > 0), F.col("upper")))
    own = F.avg(F.when(F.col("own") & (F.col("lower") > 0), F.col("lower")))
    return merged.groupBy(*by, "feature").agg(F.coalesce(other, own).alias("threshold")).where("threshold is not null")


def feature_flags(expr: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Observations whose value is above (not at) the feature's threshold.

    Other columns of ``thresholds``, such as a split and a side, are carried along.
    """
    carried = [c for c in thresholds.columns if c not in ("feature", "threshold")]
    return expr.join(if_small(thresholds), "feature").select("section", "obs_id", *carried, "feature", (F.col("value") > F.col("threshold")).cast("int").alias("flag"))


def hierarchy_anchors(flags: DataFrame, max_p: float = 0.5, thres_q: float = 0.8, by: list[str] | None = None) -> DataFrame:
    """Observations whose number of flags reaches max(1, int(min(round(most * max_p), q-quantile))).

    The most and the quantile are those of a section, and of the keys in ``by`` where given.
    """
    keys = ["section", *(by or [])]
    s = flags.groupBy(*keys, "obs_id").agg(F.sum("flag").alias("n_flags"))
    limits = s.groupBy(*keys).agg(F.max("n_flags").alias("most"), F.percentile("n_flags", F.lit(thres_q)).alias("q"))
    limit = F.greatest(F.lit(1), F.floor(F.least(F.rint(F.col("most") * max_p), F.col("q"))).cast("int"))
    return s.join(if_small(limits.withColumn("limit", limit)), keys).select(*keys, "obs_id", "n_flags", ((F.col("most") > 0) & (F.col("n_flags") >= F.col("limit"))).cast("int").alias("anchor"))


def quantile_anchors(references: DataFrame, query: DataFrame, sides: DataFrame, features: DataFrame, upper: float = 0.85, lower: float = 0.15, max_p: float = 0.5, thres_q: float = 0.8) -> DataFrame:
    """A15 to A17 for both sides of every split at once: ``(section, parent, branch, obs_id, n_flags, anchor)``.

    ``references(label, feature, value)``, ``query(section, obs_id, feature, value)``, ``sides(parent, child,
    direction, label)`` and ``features(parent, direction, feature)``. Regions of all references are merged.
    """
    of_split = sides.select("parent", "label", F.col("child").alias("side"))
    wanted = features.select("parent", "direction", "feature").join(sides.select("parent", "direction", F.col("child").alias("branch")).distinct(), ["parent", "direction"])
    both = references.join(if_small(of_split), "label").join(if_small(wanted), ["parent", "feature"])
    marked = both.select("parent", "branch", "feature", "label", "value", (F.col("side") == F.col("branch")).alias("own"))
    return hierarchy_anchors(feature_flags(query, side_thresholds(marked, ["parent", "branch"], upper, lower)), max_p, thres_q, ["parent", "branch"])


def anchor_summary(anchors: DataFrame, total: DataFrame, by: list[str]) -> DataFrame:
    """Anchors of each key and their share of the observations asked: ``(by, n_anchors, n_obs, fraction)``.

    ``anchors`` has ``by`` and ``obs_id``; ``total(n_obs)`` one row.
    """
    n = anchors.select(*by, "obs_id").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n_anchors"))
    return n.join(F.broadcast(total.select("n_obs")), how="cross").withColumn("fraction", F.col("n_anchors") / F.col("n_obs"))  # one row


def cross_table(clusters: DataFrame, anchors: DataFrame, branches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Percent of each cluster that is an anchor of each branch, and the cluster's share of the branch's anchors.

    ``clusters(by, obs_id, cluster)``, ``anchors(by, obs_id, branch)``, ``branches(by, branch, ord)``; empty
    cells are 0. ``by`` keeps tree nodes apart.
    """
    by = by or []
    size = clusters.groupBy(*by, "cluster").agg(F.count(F.lit(1)).alias("size"))
    hit = clusters.join(anchors.select(*by, "obs_id", "branch").distinct(), [*by, "obs_id"]).groupBy(*by, "cluster", "branch").agg(F.count(F.lit(1)).alias("n"))
    grid = size.join(if_small(branches), by) if by else size.join(if_small(branches), how="cross")  # clusters by branches, both a handful
    full = grid.join(hit, [*by, "cluster", "branch"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy(*by, "branch"))
    return full.withColumn("percent", 100.0 * F.col("n") / F.col("size")).withColumn("share", F.when(total > 0, F.col("n") / F.when(total > 0, total)).otherwise(0.0))


def assign_clusters(table: DataFrame, least_size: int = 10, least_percent: float = 5.0, cutoff: float | None = None, by: list[str] | None = None) -> DataFrame:
    """The branch of each cluster, or ``novel_cluster``.

    Clusters below ``least_size`` stay unassigned. With ``cutoff`` and two branches whose percents differ by no
    more, each percent counts times its share of the branch's anchors over all clusters, small ones included.
    The first branch in order wins a tie, and its percent must be above (not at) ``least_percent``.
    """
    keys = by or []
    own = Window.partitionBy(*keys, "cluster")
    score: Column = F.col("percent")
    if cutoff is not None:
        close = (F.count(F.lit(1)).over(own) == 2) & (F.max("percent").over(own) - F.min("percent").over(own) <= cutoff)
        score = F.when(close, F.col("percent") * F.col("share")).otherwise(F.col("percent"))
    best = table.where(F.col("size") >= least_size).withColumn("score", F.round(score, 9)).withColumn("r", F.row_number().over(own.orderBy(F.desc("score"), "ord"))).where("r = 1")
    return best.select(*keys, "cluster", "size", "percent", F.when(F.col("percent") > least_percent, F.col("branch")).otherwise("novel_cluster").alias("branch"))


def adjust_one_sided(table: DataFrame, ratios: DataFrame, threshold: float = 10.0, cutoff: float | None = None, adjusted_cutoff: float = 100.0, by: list[str] | None = None, **bounds: float) -> DataFrame:
    """L05, and again with ``adjusted_cutoff`` where all its clusters went to one branch and regions are skewed.

    ``ratios(by, ratio)`` as A20 gives them; a node is adjusted where exactly one category that is not novel was
    given and its ratio is above (not at) the threshold. Columns as in L05, and ``adjusted``.
    """
    keys = by or []
    plain = assign_clusters(table, cutoff=cutoff, by=keys, **bounds)  # type: ignore[arg-type]
    again = assign_clusters(table, cutoff=adjusted_cutoff, by=keys, **bounds)  # type: ignore[arg-type]
    n = plain.groupBy(*keys).agg(F.countDistinct(F.when(F.col("branch") != "novel_cluster", F.col("branch"))).alias("n_categories"))
    verdict = n.join(ratios, keys) if keys else n.join(ratios, how="cross")  # a row a node
    verdict = if_small(verdict.select(*keys, ((F.col("n_categories") == 1) & (F.col("ratio") > threshold)).alias("adjusted")))
    joined = lambda df: df.join(verdict, keys, "left") if keys else df.join(verdict, how="left")
    marked = F.coalesce("adjusted", F.lit(False)).alias("adjusted")
    first = joined(plain).select(*keys, "cluster", "size", "percent", "branch", marked).where("not adjusted")
    return first.union(joined(again).select(*keys, "cluster", "size", "percent", "branch", marked).where("adjusted"))


def reassign_novel(obs: DataFrame, clusters: list[int], k: int = 25, novel: str = "novel_cluster") -> DataFrame:
    """Clusters called novel go to the commonest label among their points' k nearest labelled points.

    ``obs(section, obs_id, x, y, cluster, label)``. One cluster after the other, in the order given, since a
    cluster that was labelled votes on the next; a cluster without labelled points round it stays. The list of
    clusters is short, and each takes one search.
    """
    out = obs
    for cluster in clusters:
        inside = (F.col("cluster") == cluster) & (F.col("label") == novel)
        voted = pooled_majority(out.where(inside), out.where(F.col("label") != novel), k).select("section", F.col("label").alias("voted"))
        out = out.join(if_small(voted), "section", "left").withColumn("label", F.when(inside & F.col("voted").isNotNull(), F.col("voted")).otherwise(F.col("label"))).drop("voted")
    return out


def novel_clusters(assigned: DataFrame, n_obs: int, novel_allowed: bool = False, least_share: float = 0.1) -> list[int]:
    """The clusters to reassign, by number; where novel ones are allowed only those with more than ``least_share`` of all ``n_obs``. A row a cluster."""
    found = assigned.where("branch = 'novel_cluster'")
    if novel_allowed:
        found = found.where(F.col("size") > least_share * n_obs)
    return [r.cluster for r in found.select("cluster").orderBy("cluster").collect()]


def binary_ratio(labels: DataFrame, target: str) -> DataFrame:
    """A20 by section for one region against all others."""
    sided = labels.withColumn("side", F.when(F.col("label") == target, "target").otherwise("other"))
    return side_ratio(sided, "target", "other", "by_section")


def side_ratio(labels: DataFrame, target: str, other: str, mode: str = "pooled", skip_empty: bool = True, by: list[str] | None = None) -> DataFrame:
    """Larger over smaller count of two sides; infinite where one is 0.

    ``labels(by, section, side)``. ``pooled`` counts all sections together; ``max``, ``median`` and ``mean`` are
    over sections' own ratios, and ``by_section`` gives those. ``skip_empty`` leaves out sections where a side
    is missing, for the three over sections; where all are, there is no row.
    """
    keys = by or []
    n = lambda side: F.sum((F.col("side") == side).cast("long"))
    low, high = F.least("a", "b"), F.greatest("a", "b")
    ratio = F.when(low > 0, high / F.when(low > 0, low)).otherwise(F.lit(float("inf")))
    group = keys if mode == "pooled" else [*keys, "section"]
    counted = labels.groupBy(*group).agg(n(target).alias("a"), n(other).alias("b")).withColumn("ratio", ratio)
    if mode in ("pooled", "by_section"):
        return counted.select(*group, "ratio")
    over = {"max": F.max("ratio"), "median": F.percentile("ratio", F.lit(0.5)), "mean": F.avg("ratio")}[mode]
    able = counted.where("a > 0 and b > 0") if skip_empty else counted
    return able.groupBy(*keys).agg(over.alias("ratio"), F.count(F.lit(1)).alias("n")).where("n > 0").drop("n")


def scatter_labels(obs: DataFrame, final: DataFrame, default: str = "novel_cluster") -> DataFrame:
    """Final labels for every observation, the default where there is none."""
    return obs.join(final.select("obs_id", F.col("branch").alias("final")), "obs_id", "left").withColumn("final", F.coalesce("final", F.lit(default)))


def transfer_columns(source: DataFrame, target: DataFrame, columns: list[str]) -> DataFrame:
    """The columns by section and obs_id; an observation that the source lacks is an error at run time."""
    joined = target.join(source.select("section", "obs_id", *columns, F.lit(True).alias("there")), ["section", "obs_id"], "left")
    total = F.when(F.col("there"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("observation without a source: "), F.col("obs_id").cast("string"))).cast("boolean"))
    return joined.withColumn("there", total).where("there").drop("there")


def missing_observations(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """What is wanted and not there."""
    return wanted.join(present, ["section", "obs_id"], "left_anti")


def adjusted_rand(labels: DataFrame, truth: str, found: str, *by: str) -> DataFrame:
    """Adjusted Rand index of two labelings by contingency counts; 1 where both put all in one class."""
    keys = list(by)
    pairs = lambda c: c * (c - 1) / 2
    cells = labels.groupBy(*keys, truth, found).agg(F.count(F.lit(1)).alias("n"))
    both = cells.groupBy(*keys).agg(F.sum(pairs(F.col("n"))).alias("cells"), F.sum("n").alias("all"))
    rows = cells.groupBy(*keys, truth).agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(pairs(F.col("n"))).alias("rows"))
    columns = cells.groupBy(*keys, found).agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(pairs(F.col("n"))).alias("columns"))
    joined = both.join(rows, keys).join(columns, keys) if keys else both.join(rows, how="cross").join(columns, how="cross")
    expected = F.col("rows") * F.col("columns") / F.greatest(pairs(F.col("all")), F.lit(1.0))
    most = (F.col("rows") + F.col("columns")) / 2
    return joined.select(*keys, F.when(most != expected, (F.col("cells") - expected) / F.when(most != expected, most - expected)).otherwise(1.0).alias("ari"))


def summarise_scores(scores: DataFrame, group: str, value: str) -> DataFrame:
    """Mean, median, least and most by group, best mean first."""
    out = scores.groupBy(group).agg(F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"), F.count(value).alias("n"))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean"), group)))
