"""Values between observations: a grid inside the tissue, histology as depth, weights and sums (stage 1).

Places and observations are points of the image, in pixels. The colour round a point becomes a third coordinate, so
that a place takes its values from observations that are near and look alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.joins import if_small
from loomspark.operators.contours import fill_contour, scale_contour
from loomspark.operators.features import histology_depth, signature
from loomspark.operators.neighbours import plane_neighbours
from loomspark.sources.materialise import materialise

#: Added to a distance before its power is taken, and the least scale of exponential weights.
EPSILON = 0.1


def extents(pixels: DataFrame) -> DataFrame:
    """Width and height of each section's image: ``(section, width, height)``."""
    return pixels.groupBy("section").agg((F.max("gx") + 1).alias("width"), (F.max("gy") + 1).alias("height"))


def tissue_grid(inside: DataFrame, extent: DataFrame, step: float, most: int = 250_000) -> DataFrame:
    """Places ``step`` pixels apart among the cells ``inside(section, gx, gy)``: ``(section, obs_id, x, y)``.

    Lines of the grid are half a step from the image's edge, a step apart, rounded (half to even). Ids number the
    image's cells by row. A section of more than ``most`` places is an error when rows are read; one in which no
    place falls inside has none.
    """
    n = lambda size: F.ceil((F.col(size) - step / 2) / step).cast("int")
    at = lambda size: F.transform(F.sequence(F.lit(0), n(size) - 1), lambda i: F.least(F.rint(step / 2 + i * step), F.col(size) - 1).cast("int"))
    lines = lambda size, c: if_small(extent.where(n(size) > 0).select("section", F.explode(F.array_distinct(at(size))).alias(c)))
    found = inside.select("section", "gx", "gy").join(lines("width", "gx"), ["section", "gx"]).join(lines("height", "gy"), ["section", "gy"])
    sized = found.groupBy("section").agg(F.count(F.lit(1)).alias("n_places"))
    able = F.when(F.col("n_places") > most, F.raise_error("too many places: choose a larger step").cast("boolean")).otherwise(F.lit(True))
    placed = found.join(if_small(sized), "section").where(able).join(if_small(extent), "section")
    return placed.select("section", (F.col("gy").cast("long") * F.col("width") + F.col("gx")).alias("obs_id"), F.col("gx").cast("double").alias("x"), F.col("gy").cast("double").alias("y"))


def channel_means(points: DataFrame, pixels: DataFrame, patch: int, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Mean of each channel over the square of ``patch`` pixels round a point, as ``vector`` beside its columns.

    A square that would leave the image is moved inside it. ``pixels`` has every cell of its image; points of a
    section without an image are left out. Sums come from two window passes over the image, whatever the
    patch's size; a pass's partition is one line.
    """
    along = Window.partitionBy("section", "gy").orderBy("gx").rangeBetween(0, patch - 1)
    down = Window.partitionBy("section", "gx").orderBy("gy").rangeBetween(0, patch - 1)
    sums = {c: F.sum(F.col(c).cast("double")) for c in channels} | {"_n": F.count(F.lit(1))}
    rows = pixels.select("section", "gx", "gy", *[v.over(along).alias(c) for c, v in sums.items()])
    boxes = rows.select("section", F.col("gx").alias("_x"), F.col("gy").alias("_y"), *[F.sum(c).over(down).alias(f"_sum_{c}") for c in sums])

    def first(c: str, size: str) -> F.Column:
        start = F.greatest(F.lit(0), F.least(F.rint(c).cast("int") - patch // 2, F.col(size)))
        return F.greatest(F.lit(0), F.least(start + patch, F.col(size)) - patch).cast("int")

    placed = points.join(if_small(extents(pixels)), "section").withColumn("_x", first("x", "width")).withColumn("_y", first("y", "height"))
    mean = F.array(*[F.col(f"_sum_{c}") / F.col("_sum__n") for c in channels])
    return placed.join(boxes, ["section", "_x", "_y"]).select(*points.columns, mean.alias("vector"))


def with_depth(places: DataFrame, obs: DataFrame, pixels: DataFrame, patch: int, scale: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Both tables as ``(section, obs_id, x, y, signature, z)``.

    Signature and depth of a section are taken over places and observations together. Where the colour doesn't
    vary, or ``scale`` is 0, the depth is 0.
    """
    marks = {"p": places, "o": obs}  # ids of the two tables may be of different types, or the same
    at = lambda c: F.col(c).cast("double").alias(c)
    both = [t.select("section", F.concat(F.lit(mark), F.col("obs_id").cast("string")).alias("obs_id"), at("x"), at("y")) for mark, t in marks.items()]
    coloured = materialise(channel_means(both[0].unionByName(both[1]), pixels, patch))
    signed = signature(coloured).join(coloured.select("section", "obs_id", "x", "y"), ["section", "obs_id"])
    deep = materialise(histology_depth(signed, scale).select("section", "obs_id", "x", "y", "signature", "z"))

    def of(mark: str) -> DataFrame:
        own = F.substring("obs_id", 2, 2**31 - 1).cast(dict(marks[mark].dtypes)["obs_id"])
        return deep.where(F.col("obs_id").startswith(mark)).withColumn("obs_id", own)

    return of("p"), of("o")


def neighbour_weights(near: DataFrame, how: str = "inverse", power: float = 2.0, quantile: float | None = None, most: float | None = None) -> DataFrame:
    """Weights of a place's neighbours that add up to 1: ``(section, obs_id, other_id, w)``.

    ``near`` is the result of a neighbour search. Weights are ``inverse`` powers of the distance and EPSILON,
    ``exponential`` over the median of the section's distances above 0, or ``uniform``. Neighbours beyond a limit
    don't count: the distance ``most``, else the section's ``quantile`` of the distances to the last
    neighbours. A place without neighbours inside the limit has no rows.
    """
    known = near.withColumn("d", F.sqrt("d2"))
    whole = known
    if how == "exponential":
        scale = known.groupBy("section").agg(F.percentile(F.when(F.col("d") > 0, F.col("d")), F.lit(0.5)).alias("scale"))
        whole = whole.join(if_small(scale), "section")
    if most is not None:
        if most <= 0:
            raise ValueError("the largest distance must be above 0")
        whole = whole.where(F.col("d") <= most)
    elif quantile is not None:
        last = known.groupBy("section", "obs_id").agg(F.max("d").alias("last"))
        far = last.groupBy("section").agg(F.percentile("last", F.lit(quantile)).alias("far"))
        whole = whole.join(if_small(far), "section").where(F.col("d") <= F.col("far"))
    shifted = F.col("d") + EPSILON
    w = {
        "inverse": lambda: 1 / (shifted * shifted if power == 2 else F.pow(shifted, F.lit(power))),
        "exponential": lambda: F.exp(-F.col("d") / F.greatest(F.coalesce("scale", F.lit(1.0)), F.lit(EPSILON))),
        "uniform": lambda: F.lit(1.0),
    }[how]()
    share = F.col("w") / F.sum("w").over(Window.partitionBy("section", "obs_id"))
    return whole.withColumn("w", w).select("section", "obs_id", "other_id", share.alias("w"))


def impute(weights: DataFrame, known: DataFrame) -> DataFrame:
    """Values at places as weighted sums of known ones: ``(section, obs_id, feature, value)``."""
    values = known.select("section", F.col("obs_id").alias("other_id"), "feature", "value")
    return weights.join(values, ["section", "other_id"]).groupBy("section", "obs_id", "feature").agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def enhance(places: DataFrame, obs: DataFrame, expr: DataFrame, k: int = 10, quantile: float | None = 0.95, how: str = "inverse", power: float = 2.0, most: float | None = None, cell: float = 1.0) -> DataFrame:
    """Values at ``places`` from the k nearest observations: ``(section, obs_id, feature, value)``.

    If both tables have ``z``, it is the third coordinate of the search.
    """
    return impute(neighbour_weights(plane_neighbours(places, obs, k, cell), how, power, quantile, most), expr)


def enhance_tissue(obs: DataFrame, expr: DataFrame, pixels: DataFrame, contours: DataFrame, step: float, k: int = 10, depth_scale: float = 1.0, contour_scale: float = 1.05, patch: int | None = None, most_places: int = 250_000, **weights: object) -> tuple[DataFrame, DataFrame]:
    """I04 as a whole: values on a grid inside the enlarged contour, by place and by histology.

    Returns ``(section, obs_id, feature, value)`` and the places: ``(section, obs_id, x, y, signature, z, nearest,
    n_neighbours)``, of which those with 0 neighbours inside the limit have no values. ``contours`` has one
    contour a section; ``weights`` are those of ``neighbour_weights``, by default a quantile of 0.95.
    """
    extent = extents(pixels)
    grid = tissue_grid(fill_contour(scale_contour(contours, contour_scale, extent)), extent, step, most_places)
    places, known = with_depth(grid, obs, pixels, patch or max(1, round(step)), depth_scale)
    near = plane_neighbours(places, known, k, step)
    w = neighbour_weights(near, **({"quantile": 0.95} | weights))
    first = near.where("place = 1").select("section", "obs_id", F.sqrt("d2").alias("nearest"))
    counted = w.groupBy("section", "obs_id").agg(F.count(F.lit(1)).alias("n_neighbours"))
    described = places.join(first, ["section", "obs_id"], "left").join(counted, ["section", "obs_id"], "left").fillna(0, ["n_neighbours"])
    return impute(w, expr), described
