"""Feature and observation selection, scaling, and set operations over the long matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.columns import between, hashed_uniform
from loomspark.functions.joins import if_small

_FEATURE = ["section", "feature"]


def _with_statistics(expr: DataFrame, keys: list[str], *statistics: Column) -> DataFrame:
    """Each row with statistics of its key, from one aggregation with partial sums and a join with its small result."""
    return expr.join(if_small(expr.groupBy(*keys).agg(*statistics)), keys)


def project_features(expr: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the wanted features with ``ord``, their first place in the list; features absent from the matrix are dropped."""
    order = wanted.groupBy("feature").agg(F.min("ord").alias("ord"))
    return expr.join(if_small(order), "feature")


def exclude_labels(obs: DataFrame, labels: list[str], match: str = "exact") -> DataFrame:
    """``exact`` compares as is; ``contains`` drops labels that hold one of the texts, whatever the case."""
    label = F.col("label")
    if match == "exact":
        return obs.where(~label.isin(labels))
    held: Column = F.lit(False)
    for part in labels:
        held = held | F.lower(label).contains(part.lower())
    return obs.where(~held)


def region_shares(obs: DataFrame) -> DataFrame:
    """Observations and share of each region in its section."""
    n = obs.groupBy("section", "label").agg(F.count(F.lit(1)).alias("n_obs"))
    return n.withColumn("share", F.col("n_obs") / F.sum("n_obs").over(Window.partitionBy("section")))


def valid_regions(obs: DataFrame, least_share: float = 0.05, excluded: tuple[str, ...] = ("nan", "unknown")) -> DataFrame:
    """Regions with a share above (not at) ``least_share``; exclusion looks at the lower-cased label."""
    return region_shares(obs).where((F.col("share") > least_share) & ~F.lower("label").isin(*excluded))


def regions_by_count(obs: DataFrame, part: str) -> DataFrame:
    """Regions whose label does not hold ``part``, numbered by falling count, then label."""
    n = obs.where(~F.lower("label").contains(part.lower())).groupBy("section", "label").agg(F.count(F.lit(1)).alias("n_obs"))
    return n.withColumn("ord", F.row_number().over(Window.partitionBy("section").orderBy(F.desc("n_obs"), "label")))


def detected_features(expr: DataFrame, obs: DataFrame, least: float = 0.05) -> DataFrame:
    """Features found (value above 0) in at least this share of a section's observations.

    Absent rows are zeros, so the share is over all observations of ``obs``.
    """
    total = obs.groupBy("section").agg(F.countDistinct("obs_id").alias("n_obs"))
    found = expr.groupBy("section", "feature").agg(F.sum((F.col("value") > 0).cast("long")).alias("n_found"))
    return found.join(if_small(total), "section").withColumn("fraction", F.col("n_found") / F.col("n_obs")).where(F.col("fraction") >= least)


def sections_with_region(obs: DataFrame, label: str, least: int) -> DataFrame:
    """The region's observations in sections that hold at least ``least`` of them."""
    inside = obs.where(F.col("label") == label)
    enough = inside.groupBy("section").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return inside.join(enough.select("section"), "section", "left_semi")


def split_modality(expr: DataFrame, key: str) -> DataFrame:
    """P10: a feature is of the image if its name holds ``key``, whatever the case."""
    return expr.withColumn("modality", F.when(F.lower("feature").contains(key.lower()), "Image").otherwise("Gene"))


def shared_features(expr: DataFrame) -> DataFrame:
    """Features found in every section, in order of name."""
    n = expr.select("section").distinct()
    seen = expr.groupBy("feature").agg(F.countDistinct("section").alias("n_sections"))
    return seen.join(n.agg(F.count(F.lit(1)).alias("n")), F.col("n_sections") == F.col("n")).select("feature", "n_sections")


def shift_to_zero(expr: DataFrame) -> DataFrame:
    """Less the feature's least value in its section."""
    return _with_statistics(expr, _FEATURE, F.min("value").alias("low")).withColumn("value", F.col("value") - F.col("low")).select(expr.columns)


def scale_min_max(expr: DataFrame) -> DataFrame:
    """To [0, 1] within a section's feature; a constant one becomes 0."""
    known = _with_statistics(expr, _FEATURE, F.min("value").alias("low"), F.max("value").alias("high"))
    return known.withColumn("value", between(F.col("value"), F.col("low"), F.col("high"))).select(expr.columns)


def standardise(expr: DataFrame) -> DataFrame:
    """Centred and divided by the population standard deviation; a constant feature becomes 0."""
    known = _with_statistics(expr, _FEATURE, F.avg("value").alias("mean"), F.stddev_pop("value").alias("spread"))
    return known.withColumn("value", (F.col("value") - F.col("mean")) / F.when(F.col("spread") > 0, F.col("spread")).otherwise(1.0)).select(expr.columns)


def normalise_counts(expr: DataFrame, target: float = 1e4) -> DataFrame:
    """Every observation scaled to ``target`` in all, then ln(1 + x); an all-zero observation stays 0."""
    total = F.sum("value").over(Window.partitionBy("section", "obs_id"))  # an observation's features
    return expr.withColumn("value", F.log1p(F.when(total > 0, F.col("value") * target / F.when(total > 0, total)).otherwise(0.0)))


def replace_zeros(expr: DataFrame, scale: float = 1.0, seed: int = 0) -> DataFrame:
    """Zeros become a number between 0 and the feature's least positive value, fixed by a hash of the row."""
    known = _with_statistics(expr, _FEATURE, F.min(F.when(F.col("value") > 0, F.col("value"))).alias("least"))
    u = hashed_uniform(F.lit(seed), "section", "obs_id", "feature")
    return known.withColumn("value", F.when(F.col("value") == 0, F.coalesce(F.col("least") * scale * u, F.lit(0.0))).otherwise(F.col("value"))).select(expr.columns)


def filter_and_scale(expr: DataFrame, obs: DataFrame, least: float = 0.05) -> DataFrame:
    """P05 within each section, then N01."""
    return scale_min_max(expr.join(if_small(detected_features(expr, obs, least).select(*_FEATURE)), _FEATURE))


def molecular_chain(expr: DataFrame, target: float = 1e4, fill_zeros: bool = False, seed: int = 0) -> DataFrame:
    """N02, then N03 if asked for, then the names of N06 in the order of the features' names."""
    scaled = normalise_counts(expr, target)
    if fill_zeros:
        scaled = replace_zeros(scaled, seed=seed)
    order = F.row_number().over(Window.partitionBy("section").orderBy("feature"))  # a row a feature
    names = unique_names(expr.select(*_FEATURE).distinct().withColumn("ord", order)).select(*_FEATURE, "name")
    return scaled.join(if_small(names), _FEATURE).drop("feature").withColumnRenamed("name", "feature")


def unique_names(features: DataFrame) -> DataFrame:
    """Upper-cased names; a repeat gets -1, -2, ... in order."""
    upper = features.withColumn("name", F.upper("feature"))
    n = F.row_number().over(Window.partitionBy("section", "name").orderBy("ord")) - 1
    return upper.withColumn("name", F.when(n > 0, F.concat("name", F.lit("-"), n.cast("string"))).otherwise(F.col("name")))


#: The eight ways to read a pair of coordinates: swapped or not, and each axis flipped or not.
TRANSFORMS = [(swap, flip_x, flip_y) for swap in (False, True) for flip_x in (False, True) for flip_y in (False, True)]


def transform_coordinates(obs: DataFrame, width: int, height: int) -> DataFrame:
    """All eight transforms, rounded half to even, and whether the point lies in the image."""
    ways = []
    for swap, flip_x, flip_y in TRANSFORMS:
        x, y = (F.col("y"), F.col("x")) if swap else (F.col("x"), F.col("y"))
        name = ("yx" if swap else "xy") + ("_fx" if flip_x else "") + ("_fy" if flip_y else "")
        ways.append(F.struct(F.lit(name).alias("way"), F.rint(width - 1 - x if flip_x else x).alias("px"), F.rint(height - 1 - y if flip_y else y).alias("py")))
    every = obs.select("section", "obs_id", F.explode(F.array(*ways)).alias("t")).select("section", "obs_id", "t.way", "t.px", "t.py")
    return every.withColumn("inside", F.col("px").between(0, width - 1) & F.col("py").between(0, height - 1))


def signature(vectors: DataFrame) -> DataFrame:
    """Channels averaged with their variances as weights; equal weights where nothing varies."""
    long = vectors.select("section", "obs_id", F.posexplode("vector").alias("channel", "value"))
    spread = _with_statistics(long, ["section", "channel"], F.var_pop("value").alias("w"))
    some = F.sum("w")
    return spread.groupBy("section", "obs_id").agg(F.when(some > 1e-12, F.sum(F.col("value") * F.col("w")) / F.when(some > 1e-12, some)).otherwise(F.avg("value")).alias("signature"))


def histology_depth(obs_signature: DataFrame, scale: float = 1.0) -> DataFrame:
    """The signature's z-score stretched to the larger spread of the coordinates; 0 where it doesn't vary."""
    wide = F.greatest(F.stddev_pop("x"), F.stddev_pop("y")).alias("_wide")
    known = _with_statistics(obs_signature, ["section"], F.avg("signature").alias("_mean"), F.stddev_pop("signature").alias("_spread"), wide)
    z = (F.col("signature") - F.col("_mean")) / F.when(F.col("_spread") > 1e-12, F.col("_spread")) * F.col("_wide") * scale
    return known.withColumn("z", F.coalesce(z, F.lit(0.0))).drop("_mean", "_spread", "_wide")


def ordered_union(lists: DataFrame, least: int = 1, by: list[str] | None = None) -> DataFrame:
    """Features of many lists by how many lists hold them, then by where they first stand.

    ``lists`` has ``list_id`` (its order is the order of the lists), ``feature`` and ``ord``; ``by`` names keys
    under which unions are taken apart.
    """
    keys = by or []
    once = lists.groupBy(*keys, "list_id", "feature").agg(F.min("ord").alias("ord"))
    n = once.groupBy(*keys, "feature").agg(F.count(F.lit(1)).alias("n_lists"), F.min(F.struct("list_id", "ord")).alias("first")).where(F.col("n_lists") >= least)
    order = Window.partitionBy(*keys).orderBy(F.desc("n_lists"), "first", "feature")  # a row a feature
    return n.select(*keys, "feature", "n_lists", F.row_number().over(order).alias("place"))


def features_in_first_order(expr: DataFrame, order: DataFrame) -> DataFrame:
    """Features found in every section, in the first section's order: ``(feature, place)``.

    ``order(section, feature, ord)``; the first section is the least by name.
    """
    first = order.join(order.agg(F.min("section").alias("section")), "section", "left_semi").select("feature", "ord")
    place = F.row_number().over(Window.orderBy("ord"))  # a row a feature
    return shared_features(expr).join(first, "feature").select("feature", place.alias("place"))


def concat_sections(expr: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """Sections one below the other on shared features; ids carry their section, ``id-section``.

    ``features`` (with ``feature``) replaces the features that all sections share.
    """
    wanted = (features if features is not None else shared_features(expr)).select("feature").distinct()
    name = F.concat_ws("-", F.col("obs_id").cast("string"), "section")
    return expr.join(if_small(wanted), "feature").select(F.col("section").alias("sample"), name.alias("obs_name"), "feature", "value")


def merged_matrix(expr: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """Each section scaled by itself (N01), then U03."""
    return concat_sections(scale_min_max(expr), features)


def tree_input(gene: DataFrame, image: DataFrame) -> DataFrame:
    """Gene and image features of the observations that both hold, image values shifted to zero.

    Labels are the gene table's.
    """
    key = ["section", "obs_id"]
    both = gene.select(*key).distinct().join(image.select(*key).distinct(), key, "left_semi")
    labels = gene.select(*key, "label").distinct()
    shifted = shift_to_zero(image.join(both, key, "left_semi")).select(*key, "feature", "value").join(labels, key)
    own = gene.join(both, key, "left_semi").withColumn("modality", F.lit("Gene"))
    return own.unionByName(shifted.withColumn("modality", F.lit("Image")))


def drop_columns_by_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """P11."""
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


def restrict_selections(selections: DataFrame, allowed: DataFrame, *levels: str) -> DataFrame:
    """Stored selections without features outside an allow-list, with the count left at each level's key.

    A key with nothing left keeps a row with a null feature and a count of 0.
    """
    inside = selections.join(allowed.select("feature").distinct(), "feature", "left_semi")
    left = inside.withColumn("n_features", F.count(F.lit(1)).over(Window.partitionBy(*levels)))  # a list of features
    keys = selections.select(*levels).distinct()
    return keys.join(left, list(levels), "left").withColumn("n_features", F.coalesce("n_features", F.lit(0).cast("long")))


def outside_image(obs: DataFrame, width: int, height: int) -> DataFrame:
    """By section, points that are not finite, outside 0 <= x < width, 0 <= y < height, or inside with axes swapped only."""
    finite = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y") & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    inside = lambda x, y: finite & (F.col(x) >= 0) & (F.col(x) < width) & (F.col(y) >= 0) & (F.col(y) < height)
    n = lambda c: F.sum(c.cast("long"))
    own, swapped = inside("x", "y"), inside("y", "x")
    return obs.groupBy("section").agg(n(~finite).alias("n_not_finite"), n(finite & ~own).alias("n_outside"), n(~own & swapped).alias("n_swapped"), F.count(F.lit(1)).alias("n_obs"))
