"""Distances between regions, the region hierarchy, and similarity between sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions.columns import min_max
from loomspark.functions.joins import if_small
from loomspark.operators.neighbours import neighbour_composition

_PAIR = ["section", "region_i", "region_j"]


def _pairs(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    a, b = left.alias("a"), right.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in on]
    condition = F.col("a.label") < F.col("b.label")
    for c in same:
        condition = condition & c
    return a.join(b, condition)


def centroids(expr: DataFrame) -> DataFrame:
    """Mean of each feature by region."""
    return expr.groupBy("section", "label", "feature").agg(F.avg("value").alias("value"))


def feature_distance(expr: DataFrame) -> DataFrame:
    """Euclidean distance of region centroids, scaled to [0, 1] over a section's pairs."""
    mean = centroids(expr)
    gap = (F.col("a.value") - F.col("b.value")) ** 2
    raw = _pairs(mean, mean, ["section", "feature"]).groupBy(F.col("a.section").alias("section"), F.col("a.label").alias("region_i"), F.col("b.label").alias("region_j")).agg(F.sqrt(F.sum(gap)).alias("raw"))
    return raw.withColumn("distance", min_max(F.col("raw"), Window.partitionBy("section")))


def spatial_distance(obs: DataFrame, radius: float) -> DataFrame:
    """ln(1 / (p_ij p_ji)) with p the share of j among the neighbours of i in other regions, scaled like H01."""
    n = neighbour_composition(obs, radius).where("label_i != label_j")
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("section", "label_i")))
    a, b = p.alias("a"), p.alias("b")
    both = a.join(b, (F.col("a.section") == F.col("b.section")) & (F.col("a.label_i") == F.col("b.label_j")) & (F.col("a.label_j") == F.col("b.label_i")) & (F.col("a.label_i") < F.col("a.label_j")))
    raw = both.select(F.col("a.section").alias("section"), F.col("a.label_i").alias("region_i"), F.col("a.label_j").alias("region_j"), (-F.ln(F.col("a.p") * F.col("b.p"))).alias("raw"))
    return raw.withColumn("distance", min_max(F.col("raw"), Window.partitionBy("section")))


def combine_distances(components: DataFrame, weights: dict[str, float], by_section: bool = False) -> DataFrame:
    """Weighted sum of stored components ``(section, component, region_i, region_j, distance)``.

    Weights are not negative, not all 0, and each positive one needs its component: in every section, or with
    ``by_section`` in those that hold it, a component counting 0 where a section lacks it altogether.
    """
    if any(w < 0 for w in weights.values()) or not any(weights.values()):
        raise ValueError("weights must not be negative, and one must be positive")
    used = {k: w for k, w in weights.items() if w}
    weight = F.coalesce(*[F.when(F.col("component") == k, F.lit(float(w))) for k, w in used.items()])
    chosen = components.where(F.col("component").isin(list(used)))
    summed = chosen.groupBy(*_PAIR).agg(F.sum(weight * F.col("distance")).alias("distance"), F.count(F.lit(1)).alias("n"))
    if not by_section:
        return summed.where(F.col("n") == len(used)).drop("n")
    held = if_small(chosen.groupBy("section").agg(F.countDistinct("component").alias("held")))
    return summed.join(held, "section").where(F.col("n") == F.col("held")).drop("n", "held")


def integrate_sections(distances: DataFrame, obs: DataFrame) -> DataFrame:
    """Mean over sections weighted by their observations, then average ranks of the pairs."""
    size = obs.groupBy("section").agg(F.count(F.lit(1)).alias("n_obs"))
    mean = distances.join(if_small(size), "section").groupBy("region_i", "region_j").agg((F.sum(F.col("n_obs") * F.col("distance")) / F.sum("n_obs")).alias("distance"))
    near = mean.withColumn("near", F.round("distance", 9))
    ordered = Window.orderBy("near")  # a row a pair of regions
    return near.withColumn("rank", F.rank().over(ordered) + (F.count(F.lit(1)).over(Window.partitionBy("near")) - 1) / 2).drop("near")


def build_tree(pairs: list[tuple[str, str, float]]) -> list[tuple[str, str, str, list[str]]]:
    """Merge the nodes that hold the two regions, nearest pair first, as ``(node, child_1, child_2, regions)``.

    Works on region pairs, of which there are a few hundred at most. A tie keeps the order of the names; a
    leaf is named by its region. One region alone gives no merge.
    """
    holder: dict[str, tuple[str, list[str]]] = {}
    for a, b, _ in pairs:
        holder.setdefault(a, (a, [a]))
        holder.setdefault(b, (b, [b]))
    merges: list[tuple[str, str, str, list[str]]] = []
    for a, b, _ in sorted(pairs, key=lambda p: (p[2], p[0], p[1])):
        (left, left_regions), (right, right_regions) = holder[a], holder[b]
        if left == right:
            continue
        node, regions = f"node_{len(merges) + 1}", sorted(left_regions + right_regions)
        merges.append((node, left, right, regions))
        for r in regions:
            holder[r] = (node, regions)
    return merges


def tree_table(spark: SparkSession, ranked: DataFrame, most_pairs: int = 100_000) -> DataFrame:
    """The split table ``(parent, child_1, child_2, regions, level)`` of ranked pairs; level 0 is the root.

    The pairs of regions, checked to be at most ``most_pairs``, are brought to the driver.
    """
    rows = ranked.select("region_i", "region_j", "rank").limit(most_pairs + 1).collect()
    if len(rows) > most_pairs:
        raise ValueError(f"more than {most_pairs} pairs of regions")
    merges = build_tree([(r.region_i, r.region_j, r.rank) for r in rows])
    level = {merges[-1][0]: 0} if merges else {}
    for node, left, right, _ in reversed(merges):
        level[left] = level[right] = level[node] + 1
    table = [(node, left, right, ";".join(regions), level[node]) for node, left, right, regions in merges]
    return spark.createDataFrame(table, "parent string, child_1 string, child_2 string, regions string, level int")


def tree_paths(splits: DataFrame) -> DataFrame:
    """Every node with its ancestors' number and the root-to-node path, by repeated joins down the tree."""
    edges = if_small(splits.select("parent", F.explode(F.array("child_1", "child_2")).alias("node")))
    root = edges.select(F.col("parent").alias("node")).distinct().join(edges.select("node"), "node", "left_anti")
    layer = root.select("node", F.col("node").alias("path"), F.lit(0).alias("depth"))
    found = layer
    depth = splits.agg(F.max("level")).first()[0]
    for _ in range((depth or 0) + 1 if depth is not None else 0):
        above = layer.select(F.col("node").alias("parent"), "path", "depth")
        layer = edges.join(above, "parent").select("node", F.concat("path", F.lit("/"), "node").alias("path"), (F.col("depth") + 1).alias("depth"))
        found = found.union(layer)
    return found


def ks_similarity(expr: DataFrame, query: str) -> DataFrame:
    """1 less the two-sample Kolmogorov-Smirnov statistic of each feature, every other section against ``query``.

    Values of both samples are merged in order with steps of their empirical distributions; the gap is read
    at the last of equal values. The query's distribution is not copied by section: at each value the gaps of
    all sections to it are taken at once, from their running sums as an array.
    """
    counted = expr.groupBy("section", "feature", "value").agg(F.count(F.lit(1)).alias("c"))
    total = if_small(counted.groupBy("section", "feature").agg(F.sum("c").alias("n")))
    steps = counted.join(total, ["section", "feature"]).select("section", "feature", "value", (F.col("c") / F.col("n")).alias("step"))
    names = [r.section for r in total.select("section").distinct().orderBy("section").collect()]  # a row a section
    others = [n for n in names if n != query]
    of = lambda name: F.sum(F.when(F.col("section") == name, F.col("step")).otherwise(0.0))
    wide = steps.groupBy("feature", "value").agg(*[of(n).alias(f"s{i}") for i, n in enumerate([query, *others])])
    running = Window.partitionBy("feature").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = wide.select("feature", *[F.sum(f"s{i}").over(running).alias(f"f{i}") for i in range(len(others) + 1)])
    gaps = upto.groupBy("feature").agg(*[F.max(F.abs(F.col(f"f{i}") - F.col("f0"))).alias(f"g{i}") for i in range(1, len(others) + 1)])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("section"), (1 - F.col(f"g{i}")).alias("similarity")) for i, n in enumerate(others, 1)]))
    found = gaps.select("feature", rows.alias("x")).select("x.section", "feature", "x.similarity") if others else gaps.select(F.lit(query).alias("section"), "feature", F.lit(None).cast("double").alias("similarity")).limit(0)
    held = total.select("section", "feature")
    return found.join(if_small(held), ["section", "feature"], "left_semi").join(if_small(held.where(F.col("section") == query).select("feature")), "feature", "left_semi")


def select_references(similarity: DataFrame, valid: DataFrame, alpha: float = 0.9, least: float = 0.7) -> DataFrame:
    """Sections by similarity times the root of their share of valid regions, and the choice.

    Chosen are scores of at least ``alpha`` times the best with a similarity of at least ``least``; where none
    reaches it the best alone, flagged; where only others do, the best of those.
    """
    everything = Window.partitionBy(F.lit(1))
    weight = valid.groupBy("section").agg(F.countDistinct("label").alias("n_valid"))
    mean = similarity.groupBy("section").agg(F.avg("similarity").alias("similarity"))
    w = mean.join(weight, "section", "left").withColumn("n_valid", F.coalesce("n_valid", F.lit(0))).withColumn("most", F.max("n_valid").over(everything))
    scored = w.withColumn("weight", F.when(F.col("most") > 0, F.sqrt(F.col("n_valid") / F.when(F.col("most") > 0, F.col("most")))).otherwise(1.0)).withColumn("score", F.col("similarity") * F.col("weight"))
    ruled = scored.withColumn("above", F.col("similarity") >= least).withColumn("by_rule", F.col("score") >= alpha * F.max("score").over(everything))
    both = ruled.withColumn("both", F.col("above") & F.col("by_rule")).withColumn("any_above", F.max("above").over(everything)).withColumn("any_both", F.max("both").over(everything))
    best = F.row_number().over(everything.orderBy(F.desc("score"), "section"))
    best_above = F.row_number().over(everything.orderBy(F.desc("above"), F.desc("score"), "section"))
    chosen = F.when(~F.col("any_above"), F.col("first") == 1).when(F.col("any_both"), F.col("both")).otherwise(F.col("first_above") == 1)
    return both.withColumn("first", best).withColumn("first_above", best_above).select("section", "similarity", "weight", "score", "above", "by_rule", chosen.alias("chosen"), (~F.col("any_above")).alias("none_above"))


def first_split(splits: DataFrame) -> DataFrame:
    """The root's two children with their regions: ``(parent, child, regions)``.

    ``splits`` as the tree's table gives it; a leaf's region is its own name.
    """
    root = splits.where("level = 0")
    regions = splits.select(F.col("parent").alias("child"), "regions")
    children = root.select("parent", F.explode(F.array("child_1", "child_2")).alias("child"))
    return children.join(regions, "child", "left").select("parent", "child", F.coalesce("regions", "child").alias("regions"))


def split_order(splits: DataFrame, largest_first: bool = True) -> DataFrame:
    """Splits by their number of regions, in the order of levels and names where equal: ``(parent, n_regions, place)``."""
    n = splits.withColumn("n_regions", F.size(F.split("regions", ";")))
    order = Window.orderBy(F.desc("n_regions") if largest_first else F.asc("n_regions"), "level", "parent")  # a row a split
    return n.select("parent", "n_regions", F.row_number().over(order).alias("place"))


def tree_nodes(splits: DataFrame) -> DataFrame:
    """Every node with its kind, parent and regions: ``(node, kind, parent, regions)``; the root has no parent."""
    edges = splits.select("parent", F.explode(F.array("child_1", "child_2")).alias("node"))
    inner = splits.select(F.col("parent").alias("node"), "regions")
    every = edges.select("node").union(splits.select(F.col("parent"))).distinct()
    kind = F.when(F.col("regions").isNull(), "leaf").when(F.col("parent").isNull(), "root").otherwise("internal")
    return every.join(edges, "node", "left").join(inner, "node", "left").select("node", kind.alias("kind"), "parent", F.coalesce("regions", "node").alias("regions"))


def store_components(parts: dict[str, DataFrame]) -> DataFrame:
    """Component distances of all sections in one table, to be written once and weighed again at will."""
    named = [df.select(*_PAIR, "distance").withColumn("component", F.lit(name)) for name, df in parts.items()]
    out = named[0]
    for df in named[1:]:
        out = out.unionByName(df)
    return out


def reweight(components: DataFrame, obs: DataFrame, weights: dict[str, float], sections: list[str] | None = None) -> DataFrame:
    """Ranks of region pairs from stored components with other weights, and of some sections only.

    A component with a weight that no section has is an error, as is a section that is not stored.
    """
    held = {(r.section, r.component) for r in components.select("section", "component").distinct().collect()}  # a row a section and component
    known, have = {s for s, _ in held}, {c for _, c in held}
    lacking = [k for k, w in weights.items() if w and k not in have] + [s for s in sections or [] if s not in known]
    if lacking:
        raise ValueError(f"not stored: {', '.join(lacking)}")
    chosen = components if sections is None else components.where(F.col("section").isin(sections))
    return integrate_sections(combine_distances(chosen, weights), obs)


def tree_features(markers: dict[str, DataFrame]) -> DataFrame:
    """The features that distances are taken over, ``(section, modality, feature)``, from markers of each modality.

    ``markers`` are region markers by modality, gene and image chosen by their own bounds.
    """
    named = [df.select("section", "feature").distinct().withColumn("modality", F.lit(name)) for name, df in markers.items()]
    out = named[0]
    for df in named[1:]:
        out = out.unionByName(df)
    return out


def infer_tree(expr: DataFrame, obs: DataFrame, features: DataFrame, weights: dict[str, float], radius: float, most_pairs: int = 100_000) -> dict[str, DataFrame]:
    """H11's features, distances by section and modality, the neighbourhood's, their mean over sections, and the tree.

    ``expr(section, obs_id, label, modality, feature, value)``. A modality without features has weight 0, and so it
    has in a section where it has none.
    """
    have = {r.modality for r in features.select("modality").distinct().collect()}  # a row a modality
    parts = {}
    for name in sorted(have):
        wanted = if_small(features.where(F.col("modality") == name).select("section", "feature"))
        parts[name] = feature_distance(expr.where(F.col("modality") == name).join(wanted, ["section", "feature"], "left_semi"))
    parts["Spatial"] = spatial_distance(obs, radius)
    used = {k: (w if k in parts else 0.0) for k, w in weights.items()}
    components = store_components(parts)
    ranked = integrate_sections(combine_distances(components, used, by_section=True), obs)
    return {"components": components, "ranked": ranked, "splits": tree_table(expr.sparkSession, ranked, most_pairs)}
