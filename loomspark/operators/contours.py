"""Contours of tissue: candidates from masks and spots, their areas, and how well each agrees (stage 1).

A contour is a closed polygon of whole-number points, a row a point: ``(section, method, place, x, y)``. What grows
with an image are its cells; contours are as long as lines of it, so one contour may be put in order by one task.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.joins import if_small
from loomspark.operators.postprocess import raster_components
from loomspark.operators.raster import scan_extremes
from loomspark.sources.materialise import materialise

CELL = ["section", "gx", "gy"]
OF = ["section", "method"]
CONTOUR = "section string, method string, place int, x int, y int"


def scan_contour(obs: DataFrame, axis: str = "x") -> DataFrame:
    """lines' least ends in order of the lines, then their greatest ends backwards, without repeated points.

    ``obs`` as in ``scan_extremes``. Sections with fewer than three different points have none.
    """
    lines = scan_extremes(obs, axis)
    point = (lambda end: F.struct(F.rint("median").cast("int").alias("x"), F.rint(end).cast("int").alias("y"))) if axis == "x" else (lambda end: F.struct(F.rint(end).cast("int").alias("x"), F.rint("median").cast("int").alias("y")))
    entry = lambda name, end: F.array_sort(F.collect_list(F.struct(F.col("line"), point(end).alias("p")))).alias(name)
    sides = lines.groupBy("section").agg(entry("first", "least"), entry("second", "most"))
    points = F.array_distinct(F.concat(F.transform("first", lambda v: v["p"]), F.reverse(F.transform("second", lambda v: v["p"]))))
    kept = sides.select("section", F.lit(f"scan_{axis}").alias("method"), points.alias("points")).where(F.size("points") >= 3)
    return kept.select("section", "method", F.posexplode("points").alias("place", "p")).select("section", "method", "place", "p.x", "p.y")


def _chain(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The lower hull of sorted points, its last point left out."""
    hull: list[tuple[int, int]] = []
    for p in points:
        while len(hull) > 1 and (hull[-1][0] - hull[-2][0]) * (p[1] - hull[-2][1]) <= (hull[-1][1] - hull[-2][1]) * (p[0] - hull[-2][0]):
            hull.pop()
        hull.append(p)
    return hull[:-1]


def convex_hull(points: DataFrame, method: str = "spot_hull") -> DataFrame:
    """The convex hull of each section's points, rounded to whole numbers.

    ``points(section, x, y)``. Only the two ends of each column of points can be corners, which aggregates
    find; a task then sees two points a column. Points on one line have no hull.
    """
    whole = points.where("x is not null and y is not null and not isnan(x) and not isnan(y)").select("section", F.rint("x").cast("int").alias("x"), F.rint("y").cast("int").alias("y"))
    ends = whole.groupBy("section", "x").agg(F.min("y").alias("low"), F.max("y").alias("high"))

    def hull(group: pd.DataFrame) -> pd.DataFrame:
        corners = sorted({(int(x), int(y)) for side in ("low", "high") for x, y in zip(group["x"], group[side], strict=True)})
        found = _chain(corners) + _chain(corners[::-1])
        if len(found) < 3:
            found = []
        return pd.DataFrame({"section": group["section"].iloc[0], "method": method, "place": range(len(found)), "x": [p[0] for p in found], "y": [p[1] for p in found]})

    return ends.groupBy("section").applyInPandas(hull, CONTOUR)


def _walk(cells: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """The outer border of one component, from its first cell in reading order round all of it."""
    turn = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]
    start = min(cells, key=lambda c: (c[1], c[0]))

    def step(at: tuple[int, int], came: int) -> tuple[tuple[int, int], int] | None:
        for k in range(8):
            way = (came + 6 + k) % 8  # from the cell that lies to the left behind
            to = (at[0] + turn[way][0], at[1] + turn[way][1])
            if to in cells:
                return to, way
        return None

    first = step(start, 0)
    if first is None:
        return [start]
    border, (at, way) = [start], first
    while True:
        to, ahead = step(at, way)
        if at == start and (to, ahead) == first:
            return border
        border.append(at)
        at, way = to, ahead


def mask_contour(mask: DataFrame, strategy: str = "largest", method: str = "color") -> DataFrame:
    """The outer border of a mask's largest component, or (``convex_hull``) the hull of all of it.

    Aggregates find the component and keep the cells that have a free neighbour; a task walks along these.
    """
    if strategy == "convex_hull":
        return convex_hull(mask.select("section", F.col("gx").alias("x"), F.col("gy").alias("y")), method)
    parts = materialise(raster_components(mask.select(*CELL).distinct().withColumn("label", F.lit("mask"))).where("place = 1").select(*CELL))
    around = F.explode(F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x in (-1, 0, 1) for y in (-1, 0, 1)]))
    shifted = parts.select(*CELL, around.alias("o")).select("section", (F.col("gx") + F.col("o.dx")).alias("gx"), (F.col("gy") + F.col("o.dy")).alias("gy"))
    inner = shifted.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n")).where("n = 9")
    edge = parts.join(inner.hint("merge"), CELL, "left_anti")

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        found = _walk({(int(x), int(y)) for x, y in zip(group["gx"], group["gy"], strict=True)})
        if len(set(found)) < 3:
            found = []
        return pd.DataFrame({"section": group["section"].iloc[0], "method": method, "place": range(len(found)), "x": [p[0] for p in found], "y": [p[1] for p in found]})

    return edge.groupBy("section").applyInPandas(walk, CONTOUR)


def _edges(contours: DataFrame) -> DataFrame:
    """Each point with the next one of its contour, the last with the first: ``(section, method, place, x, y, x2, y2)``."""
    by = Window.partitionBy(*OF)
    after = by.orderBy("place")
    follow = lambda c: F.coalesce(F.lead(c, 1).over(after), F.first(c).over(after.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return contours.select(*OF, "place", "x", "y", follow("x").alias("x2"), follow("y").alias("y2"))


def fill_contour(contours: DataFrame) -> DataFrame:
    """The cells inside each contour or on it, by even-odd scan lines: ``(section, method, gx, gy)``."""
    edges = _edges(contours)
    row = F.explode(F.sequence(F.least("y", "y2"), F.greatest("y", "y2") - 1)).alias("gy")
    crossed = edges.where("y != y2").select(*OF, "x", "y", "x2", "y2", row)
    at = F.col("x") + (F.col("gy") - F.col("y")) * (F.col("x2") - F.col("x")) / (F.col("y2") - F.col("y"))
    lines = crossed.groupBy(*OF, "gy").agg(F.array_sort(F.collect_list(at)).alias("ends"))
    pair = F.transform(F.sequence(F.lit(0), F.size("ends") - 2, F.lit(2)), lambda i: F.struct(F.ceil(F.get("ends", i) - 1e-9).cast("int").alias("a"), F.floor(F.get("ends", i + 1) + 1e-9).cast("int").alias("b")))
    inside = lines.where(F.size("ends") > 1).select(*OF, "gy", F.explode(pair).alias("s")).select(*OF, "gy", "s.a", "s.b")
    # rows that the half-open edges leave out: level edges, and points at the far end of an edge
    level = edges.where("y = y2").select(*OF, F.col("y").alias("gy"), F.least("x", "x2").alias("a"), F.greatest("x", "x2").alias("b"))
    corner = edges.select(*OF, F.col("y").alias("gy"), F.col("x").alias("a"), F.col("x").alias("b"))
    spans = inside.union(level).union(corner).where("a <= b")
    return spans.select(*OF, F.explode(F.sequence("a", "b")).alias("gx"), "gy").distinct()


def scale_contour(contours: DataFrame, scale: float = 1.05, extent: DataFrame | None = None) -> DataFrame:
    """Contours scaled about the centroid of their area, clipped to ``extent(section, width, height)`` and rounded.

    Where the area is 0 the centre is the mean of the points.
    """
    cross = F.col("x") * F.col("y2") - F.col("x2") * F.col("y")
    sums = _edges(contours).groupBy(*OF).agg(F.sum(cross).alias("a"), F.sum((F.col("x") + F.col("x2")) * cross).alias("mx"), F.sum((F.col("y") + F.col("y2")) * cross).alias("my"), F.avg("x").alias("ax"), F.avg("y").alias("ay"))
    centre = lambda m, mean: F.when(F.col("a") != 0, F.col(m) / (3 * F.when(F.col("a") != 0, F.col("a")))).otherwise(F.col(mean))
    known = contours.join(if_small(sums.select(*OF, centre("mx", "ax").alias("cx"), centre("my", "ay").alias("cy"))), OF)
    moved = known.withColumn("x", (F.col("x") - F.col("cx")) * scale + F.col("cx")).withColumn("y", (F.col("y") - F.col("cy")) * scale + F.col("cy"))
    if extent is not None:
        clip = lambda c, n: F.greatest(F.lit(0.0), F.least(F.col(c), F.col(n) - 1))
        moved = moved.join(if_small(extent), "section").withColumn("x", clip("x", "width")).withColumn("y", clip("y", "height"))
    return moved.select(*OF, "place", F.rint("x").cast("int").alias("x"), F.rint("y").cast("int").alias("y"))


def contour_scores(contours: DataFrame, image_mask: DataFrame, extent: DataFrame, spots: DataFrame | None = None) -> DataFrame:
    """How each candidate agrees with the image's mask and the spots.

    ``(section, method, score, spot_coverage, image_iou, image_precision, image_recall, area_fraction, compactness)``.
    Coverage counts spots inside the image, by rounded coordinates; sections without spots have none and are
    scored by the image alone.
    """
    cells = fill_contour(contours).join(if_small(extent), "section").where("gx >= 0 and gy >= 0 and gx < width and gy < height").select(*OF, "gx", "gy")
    image = image_mask.select(*CELL).distinct().withColumn("hit", F.lit(1))
    areas = cells.join(image, CELL, "left").groupBy(*OF).agg(F.count(F.lit(1)).alias("area"), F.count("hit").alias("both"))
    sizes = image.groupBy("section").agg(F.count(F.lit(1)).alias("image_area"))
    length = _edges(contours).groupBy(*OF).agg(F.sum(F.sqrt((F.col("x2") - F.col("x")) ** 2 + (F.col("y2") - F.col("y")) ** 2)).alias("perimeter"))
    known = length.join(areas, OF, "left").fillna(0, ["area", "both"]).join(if_small(sizes), "section", "left").fillna(0, ["image_area"]).join(if_small(extent), "section")
    if spots is not None:
        placed = spots.select("section", F.rint("x").cast("int").alias("gx"), F.rint("y").cast("int").alias("gy")).join(if_small(extent), "section")
        valid = placed.where("gx >= 0 and gy >= 0 and gx < width and gy < height").select(*CELL)
        n = spots.groupBy("section").agg(F.count(F.lit(1)).alias("n_spots")).join(valid.groupBy("section").agg(F.count(F.lit(1)).alias("n_valid")), "section", "left")
        held = valid.join(cells, CELL).groupBy(*OF).agg(F.count(F.lit(1)).alias("held"))
        known = known.join(if_small(n), "section", "left").join(held, OF, "left")
        coverage = F.when(F.col("n_spots").isNotNull(), F.when(F.col("n_valid") > 0, F.coalesce("held", F.lit(0)) / F.col("n_valid")).otherwise(0.0))
    else:
        coverage = F.lit(None).cast("double")
    share = lambda top, bottom: F.col(top) / F.greatest(bottom, F.lit(1))
    out = known.withColumn("spot_coverage", coverage).withColumn("image_iou", share("both", F.col("area") + F.col("image_area") - F.col("both"))).withColumn("image_precision", share("both", F.col("area"))).withColumn("image_recall", share("both", F.col("image_area")))
    out = out.withColumn("area_fraction", F.col("area") / (F.col("width") * F.col("height"))).withColumn("compactness", F.least(F.lit(1.0), 4 * math.pi * F.col("area") / F.greatest(F.col("perimeter") * F.col("perimeter"), F.lit(1.0))))
    with_spots = 0.45 * F.col("spot_coverage") + 0.25 * F.col("image_iou") + 0.15 * F.col("image_precision") + 0.10 * F.col("image_recall") + 0.05 * F.col("compactness")
    alone = 0.60 * F.col("image_iou") + 0.25 * F.col("image_precision") + 0.15 * F.col("compactness")
    return out.select(*OF, F.coalesce(with_spots, alone).alias("score"), "spot_coverage", "image_iou", "image_precision", "image_recall", "area_fraction", "compactness")


def best_contour(contours: DataFrame, scores: DataFrame) -> DataFrame:
    """Each section's candidate of the best score, on a tie the first by name."""
    best = scores.groupBy("section").agg(F.min_by("method", F.struct(-F.round("score", 9), F.col("method"))).alias("method"))
    return contours.join(if_small(best), OF, "left_semi")


def keep_tissue(cells: DataFrame, mask: DataFrame, background: float = 0.0) -> DataFrame:
    """The image with ``background`` for the value of every cell outside the mask."""
    inside = mask.select(*CELL).distinct().withColumn("_in", F.lit(True))
    return cells.join(inside, CELL, "left").withColumn("value", F.when(F.col("_in"), F.col("value")).otherwise(F.lit(background))).drop("_in")
