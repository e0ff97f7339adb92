"""Features that tell the two children of a tree node apart, per section, and their assembly (stage F).

Tables: ``splits(parent, child_1, child_2, child_1_regions, child_2_regions)`` has a row a split, regions as
arrays; ``selected(section, parent, direction, feature, place)`` the features of each direction, where a
direction is ``child_vs_other``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.joins import if_small
from loomspark.operators.features import ordered_union
from loomspark.operators.markers import region_markers


def split_sides(splits: DataFrame) -> DataFrame:
    """``(parent, child, other, direction, ord, label)``: both sides of every split, a row a region."""
    side = lambda own, other, n: F.struct(F.col(f"child_{own}").alias("child"), F.col(f"child_{other}").alias("other"), F.lit(n).alias("ord"), F.col(f"child_{own}_regions").alias("regions"))
    both = splits.select("parent", F.explode(F.array(side(1, 2, 0), side(2, 1, 1))).alias("s"))
    named = both.select("parent", "s.child", "s.other", F.concat("s.child", F.lit("_vs_"), "s.other").alias("direction"), "s.ord", F.explode("s.regions").alias("label"))
    return named


def guide_references(sections: DataFrame, splits: DataFrame, guide: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """``(parent, section)``: the sections that each split may learn from.

    ``guide(parent, sections)`` lists them as an array; an empty array leaves a split without references, and a
    split that the guide does not name takes all sections. With ``strict`` a name that is no section or no
    parent is an error when rows are read; otherwise it is ignored.
    """
    parents, known = splits.select("parent").distinct(), sections.select("section").distinct()
    if guide is None:
        return parents.join(known, how="cross")  # splits by sections, both a handful
    asked = guide.select("parent", F.explode_outer("sections").alias("section"))
    named = asked.where("section is not null").join(known.withColumn("_known", F.lit(True)), "section", "left").join(parents.withColumn("_parent", F.lit(True)), "parent", "left")
    unknown = F.col("_known").isNull() | F.col("_parent").isNull()
    if strict:
        wrong = F.raise_error(F.concat(F.lit("the guide names an unknown section or parent: "), "parent", F.lit(" / "), "section")).cast("boolean")
        named = named.where(F.when(unknown, wrong).otherwise(F.lit(True)))
    else:
        named = named.where(~unknown)
    rest = parents.join(guide.select("parent"), "parent", "left_anti").join(known, how="cross")
    return named.select("parent", "section").distinct().union(rest.select("parent", "section"))


def split_features(expr: DataFrame, splits: DataFrame, references: DataFrame | None = None, **bounds: float) -> DataFrame:
    """tests of every split in every section at once, both directions.

    Only rows of a split's own regions take part, so the rest of a child is the other child. A side without
    observations gives no rows. ``bounds`` as for markers; the fraction inside is free and ten features stay
    by default.
    """
    sides = split_sides(splits).select("parent", "child", "direction", "label")
    inside = expr.join(if_small(sides), "label")
    if references is not None:
        inside = inside.join(if_small(references.select("parent", "section")), ["parent", "section"])
    keyed = inside.select("section", "parent", F.col("direction").alias("label"), "feature", "value")
    return region_markers(keyed, by=["section", "parent"], **({"least_fraction": 0.0} | bounds)).withColumnRenamed("label", "direction")


def nearest_feature_lists(selected: DataFrame, sides: DataFrame, least: int = 1) -> DataFrame:
    """the clustering features of each split where anchors are neighbours: ``(parent, feature, n_lists, place)``.

    Each section's two directions make one list, the first direction first; features of at least ``least``
    sections stay, by how many hold them and then by where they first stand.
    """
    ords = sides.select("parent", "direction", "ord").distinct()
    placed = selected.join(if_small(ords), ["parent", "direction"])
    in_section = ordered_union(placed.select("parent", "section", F.col("ord").alias("list_id"), "feature", F.col("place").alias("ord")), 1, ["parent", "section"])
    return ordered_union(in_section.select("parent", F.col("section").alias("list_id"), "feature", F.col("place").alias("ord")), least, ["parent"])


def quantile_feature_lists(selected: DataFrame, least: int = 1) -> DataFrame:
    """anchor features of each direction over sections: ``(parent, direction, feature, n_lists, place)``."""
    return ordered_union(selected.select("parent", "direction", F.col("section").alias("list_id"), "feature", F.col("place").alias("ord")), least, ["parent", "direction"])


def quantile_clustering_features(lists: DataFrame, sides: DataFrame) -> DataFrame:
    """both directions' features one after the other, repeats included: ``(parent, feature, direction, place)``."""
    ords = sides.select("parent", "direction", "ord").distinct()
    order = Window.partitionBy("parent").orderBy("ord", "place")  # a list of features
    return lists.join(if_small(ords), ["parent", "direction"]).select("parent", "feature", "direction", F.row_number().over(order).alias("place"))


def modality_view(by_modality: dict[str, DataFrame]) -> DataFrame:
    """feature lists of several modalities in one table, told apart by ``modality``."""
    parts = [df.withColumn("modality", F.lit(name)) for name, df in by_modality.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def section_view(by_modality: DataFrame) -> DataFrame:
    """a row a section, split and direction, with each modality's features in order as a map of arrays."""
    lists = by_modality.groupBy("section", "parent", "direction", "modality").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "feature"))), lambda x: x["feature"]).alias("features"))
    return lists.groupBy("section", "parent", "direction").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("modality", "features")))).alias("features"))


def direction_features(selected: DataFrame, parent: str, direction: str, strict: bool = False) -> DataFrame:
    """one direction's features in every section that has them; with ``strict`` none at all is an error."""
    found = selected.where((F.col("parent") == parent) & (F.col("direction") == direction))
    if strict and not found.limit(1).count():
        raise KeyError(f"no features of {direction} below {parent}")
    return found.select("section", "feature", "place")


def features_across_sections(selected: DataFrame, parent: str, direction: str, least: int = 1) -> DataFrame:
    """one direction's features over sections, as A32 orders them."""
    return quantile_feature_lists(selected.where((F.col("parent") == parent) & (F.col("direction") == direction)), least)


def feature_summary(clustering: DataFrame, selected: DataFrame) -> DataFrame:
    """features of each split and the sections that gave any: ``(parent, n_clustering_features, sections)``."""
    given = selected.groupBy("parent").agg(F.array_join(F.array_sort(F.collect_set("section")), ";").alias("sections"))
    n = clustering.groupBy("parent").agg(F.count(F.lit(1)).alias("n_clustering_features"))
    return given.join(n, "parent", "left").withColumn("n_clustering_features", F.coalesce("n_clustering_features", F.lit(0).cast("long")))


def hierarchical_features(expr: DataFrame, splits: DataFrame, scenario: str = "nearest", least: int = 1, guide: DataFrame | None = None, strict: bool = True, **bounds: float) -> dict[str, DataFrame]:
    """F07, F01 and then F03 (``nearest``) or F04 (``quantile``): the selected, anchor and clustering features."""
    if scenario not in ("nearest", "quantile"):
        raise ValueError("the scenario is nearest or quantile")
    sides = split_sides(splits)
    references = guide_references(expr.select("section").distinct(), splits, guide, strict)
    selected = split_features(expr, splits, references, **({"n": 10 if scenario == "nearest" else 5} | bounds))
    selected = selected.select("section", "parent", "direction", "feature", "place", "fold_change", "p_adj")
    if scenario == "nearest":
        return {"selected": selected, "anchors": selected, "clustering": nearest_feature_lists(selected, sides, least)}
    lists = quantile_feature_lists(selected, least)
    return {"selected": selected, "anchors": lists, "clustering": quantile_clustering_features(lists, sides)}
