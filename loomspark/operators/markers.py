"""Region markers: group statistics, rank-sum tests, and their selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.columns import ratio_or_inf, two_sided_p

_KEY = ["section", "label", "feature"]


def group_statistics(expr: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean and detected share inside and outside of each region, their fold change and ratio.

    ``by`` are the keys within which labels are compared, the section if nothing else is said. The outside is
    the key's total less the region, so the matrix is aggregated once.
    """
    by = by or ["section"]
    key = [*by, "label", "feature"]
    inside = expr.groupBy(*key).agg(F.count(F.lit(1)).alias("n_in"), F.sum("value").alias("s_in"), F.sum((F.col("value") > 0).cast("long")).alias("d_in"))
    whole_key = Window.partitionBy(*by, "feature")  # a row a label
    whole = inside.select("*", *[(F.sum(c).over(whole_key) - F.col(c)).alias(c.replace("_in", "_out")) for c in ("n_in", "s_in", "d_in")]).where("n_out > 0")
    shares = whole.select(*key, "n_in", "n_out", *[(F.col(f"{c}_{side}") / F.col(f"n_{side}")).alias(f"{name}_{side}") for c, name in (("s", "mean"), ("d", "fraction")) for side in ("in", "out")])
    return shares.withColumn("fold_change", F.exp(F.col("mean_in") - F.col("mean_out"))).withColumn("ratio", ratio_or_inf(F.col("fraction_in"), F.col("fraction_out")))


def rank_sum(expr: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Wilcoxon's rank sum of each region against the rest of its section (or key), with z and two-sided p.

    Ranks of ties are averaged; the normal approximation has no correction for ties or continuity. Equal values
    of a label are counted first, and ranks come from running counts over the different values.
    """
    by = by or ["section"]
    held = expr.groupBy(*by, "feature", "value", "label").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*by, "feature").orderBy("value").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    tied = F.sum("c").over(Window.partitionBy(*by, "feature", "value"))
    ranked = held.withColumn("rank", upto - (tied - 1) / 2)
    inside = ranked.groupBy(*by, "label", "feature").agg(F.sum("c").alias("n_in"), F.sum(F.col("c") * F.col("rank")).alias("rank_sum"))
    n = F.sum("n_in").over(Window.partitionBy(*by, "feature"))
    tested = inside.withColumn("n_out", n - F.col("n_in")).where("n_out > 0")
    every = F.col("n_in") + F.col("n_out")
    z = (F.col("rank_sum") - F.col("n_in") * (every + 1) / 2) / F.sqrt(F.col("n_in") * F.col("n_out") * (every + 1) / 12)
    return tested.withColumn("z", z).withColumn("p", two_sided_p(F.col("z")))


def adjust(tests: DataFrame, *by: str) -> DataFrame:
    """Benjamini-Hochberg within each test: p * m / rank, then the running minimum from the largest p."""
    up = Window.partitionBy(*by).orderBy("p")
    scaled = tests.withColumn("scaled", F.col("p") * F.count(F.lit(1)).over(Window.partitionBy(*by)) / F.count(F.lit(1)).over(up))
    down = Window.partitionBy(*by).orderBy(F.desc("p")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return scaled.withColumn("p_adj", F.least(F.lit(1.0), F.min("scaled").over(down))).drop("scaled")


def select_markers(stats: DataFrame, most_p: float | None = None, least_ratio: float = 1.0, least_fraction: float = 0.5, least_change: float = 1.15, n: int = 10, by: list[str] | None = None) -> DataFrame:
    """The n largest fold changes among the features that pass all bounds; ties by name."""
    by = by or ["section"]
    keep = (F.col("ratio") >= least_ratio) & (F.col("fraction_in") >= least_fraction) & (F.col("fold_change") >= least_change)
    if most_p is not None:
        keep = keep & (F.col("p_adj") <= most_p)
    place = F.row_number().over(Window.partitionBy(*by, "label").orderBy(F.desc("fold_change"), "feature"))
    return stats.where(keep).withColumn("place", place).where(F.col("place") <= n)


def region_markers(expr: DataFrame, by: list[str] | None = None, **bounds: float) -> DataFrame:
    """Tests and statistics of every region of every section at once, selected by P08."""
    by = by or ["section"]
    key = [*by, "label", "feature"]
    tests = adjust(rank_sum(expr, by), *by, "label").select(*key, "z", "p", "p_adj")
    return select_markers(group_statistics(expr, by).join(tests, key), by=by, **({"most_p": 0.05} | bounds))  # type: ignore[arg-type]


def marker_union(markers: DataFrame, common: DataFrame) -> DataFrame:
    """A region's markers of all sections that are among the common features, numbered by name."""
    held = markers.select("label", "feature").distinct().join(common.select("feature").distinct(), "feature", "left_semi")
    return held.select("label", "feature", F.row_number().over(Window.partitionBy("label").orderBy("feature")).alias("place"))


def marker_stability(markers: DataFrame) -> DataFrame:
    """Mean Jaccard similarity of a region's marker sets over pairs of sections, and the gene score.

    Two empty sets would be equal; a region found in one section only has no stability.
    """
    sets = markers.groupBy("label", "section").agg(F.collect_set("feature").alias("features"))
    a, b = sets.alias("a"), sets.alias("b")
    both = a.join(b, (F.col("a.label") == F.col("b.label")) & (F.col("a.section") < F.col("b.section")))
    union = F.size(F.array_union("a.features", "b.features"))
    jaccard = both.select(F.col("a.label").alias("label"), F.when(union > 0, F.size(F.array_intersect("a.features", "b.features")) / F.when(union > 0, union)).otherwise(1.0).alias("j")).groupBy("label").agg(F.avg("j").alias("stability"))
    size = markers.groupBy("label").agg(F.countDistinct("feature").alias("union_size"))
    scored = size.join(jaccard, "label", "left").withColumn("max_size", F.max("union_size").over(Window.partitionBy(F.lit(1))))
    return scored.withColumn("gene_score", 1 - F.col("stability")).withColumn("adjusted", F.col("gene_score") * F.log1p("union_size") / F.log1p("max_size"))


def overlap_features(markers: DataFrame, cutoff: int = 2) -> DataFrame:
    """A region's markers found in at least min(largest count, cutoff) sections."""
    n = markers.groupBy("label", "feature").agg(F.countDistinct("section").alias("n_sections"))
    most = n.withColumn("most", F.max("n_sections").over(Window.partitionBy("label")))
    return most.where(F.col("n_sections") >= F.least("most", F.lit(cutoff))).drop("most")
