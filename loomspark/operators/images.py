"""Images as long tables of cells.

A mask is a row a foreground cell, ``(section, gx, gy)``; an image is a row a cell with its values. ``extent`` is a
row a section: ``width`` and ``height``, cells run from 0. Morphology, smoothing and filling are aggregates over
shifted cells and windows along one line of the grid, so no image has to fit in a task.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.joins import if_small
from loomspark.operators.postprocess import raster_components
from loomspark.operators.raster import with_gaps
from loomspark.sources.materialise import materialise

CELL = ["section", "gx", "gy"]
Offsets = list[tuple[int, int]]


def extent_of(cells: DataFrame) -> DataFrame:
    """``(section, width, height)`` of a dense image."""
    return cells.groupBy("section").agg((F.max("gx") + 1).cast("int").alias("width"), (F.max("gy") + 1).cast("int").alias("height"))


def _offsets(shifts: Offsets) -> Column:
    return F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in shifts])


def disc(radius: int) -> Offsets:
    """Cells within ``radius`` of the centre, as shifts."""
    reach = range(-radius, radius + 1)
    return [(x, y) for y in reach for x in reach if x * x + y * y <= radius * radius]


def ellipse(size: int) -> Offsets:
    """An ellipse in a square of odd ``size``: each row as wide as the rounded chord."""
    r = size // 2
    return [(x, y) for y in range(-r, r + 1) for w in [round(r * math.sqrt(1 - y * y / (r * r))) if r else 0] for x in range(-w, w + 1)]


def dilate(mask: DataFrame, extent: DataFrame, shifts: Offsets) -> DataFrame:
    """Cells that a shifted element round some foreground cell covers."""
    moved = mask.select("section", "gx", "gy", F.explode(_offsets(shifts)).alias("o")).select("section", (F.col("gx") + F.col("o.dx")).alias("gx"), (F.col("gy") + F.col("o.dy")).alias("gy"))
    return moved.distinct().join(if_small(extent), "section").where("gx >= 0 and gy >= 0 and gx < width and gy < height").select(*CELL)


def erode(mask: DataFrame, extent: DataFrame, shifts: Offsets) -> DataFrame:
    """Cells whose whole element is foreground; what lies outside the image counts as foreground."""
    moved = mask.select("section", "gx", "gy", F.explode(_offsets(shifts)).alias("o")).select("section", (F.col("gx") - F.col("o.dx")).alias("gx"), (F.col("gy") - F.col("o.dy")).alias("gy"))
    found = moved.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n")).join(if_small(extent), "section").where("gx >= 0 and gy >= 0 and gx < width and gy < height")
    inside = lambda o: (F.col("gx") + o["dx"] >= 0) & (F.col("gx") + o["dx"] < F.col("width")) & (F.col("gy") + o["dy"] >= 0) & (F.col("gy") + o["dy"] < F.col("height"))
    return found.where(F.col("n") == F.size(F.filter(_offsets(shifts), inside))).select(*CELL)


def opened(mask: DataFrame, extent: DataFrame, shifts: Offsets) -> DataFrame:
    """Eroded, then dilated: specks go."""
    return dilate(erode(mask, extent, shifts), extent, shifts)


def closed(mask: DataFrame, extent: DataFrame, shifts: Offsets) -> DataFrame:
    """Dilated, then eroded: gaps close."""
    return erode(dilate(mask, extent, shifts), extent, shifts)


def all_cells(extent: DataFrame) -> DataFrame:
    """Every cell of each section."""
    line = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    return extent.where("width > 0 and height > 0").select("section", "width", "height", line("height").alias("gy")).select("section", "gy", line("width").alias("gx")).select(*CELL)


def fill_holes(mask: DataFrame, extent: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """The mask and the background that its four-neighbour paths can't lead out of the image.

    ``cells`` are those the image has, where it lacks some of its extent; only they are background or mask.
    """
    there = all_cells(extent) if cells is None else cells.select(*CELL)
    outside = there.join(mask.hint("merge"), CELL, "left_anti").withColumn("label", F.lit("background"))
    parts = materialise(raster_components(outside, diagonal=False).select(*CELL, "component"))
    on_edge = (F.col("gx") == 0) | (F.col("gy") == 0) | (F.col("gx") == F.col("width") - 1) | (F.col("gy") == F.col("height") - 1)
    open_ = parts.join(if_small(extent), "section").groupBy("section", "component").agg(F.max(on_edge).alias("open")).where("open")
    return there.join(parts.join(open_, ["section", "component"], "left_semi").select(*CELL).hint("merge"), CELL, "left_anti")


def drop_small(mask: DataFrame, extent: DataFrame, fraction: float = 0.001) -> DataFrame:
    """Components (eight neighbours) of at least ``fraction`` of the image; the largest where none is."""
    parts = materialise(raster_components(mask.withColumn("label", F.lit("mask"))).select(*CELL, "size", "place")).join(if_small(extent), "section")
    least = F.greatest(F.lit(1), F.rint(F.col("width") * F.col("height") * fraction))
    return parts.where((F.col("size") >= least) | (F.col("place") == 1)).select(*CELL)


def pad_mirror(cells: DataFrame, extent: DataFrame, r: int) -> DataFrame:
    """``cells(section, gx, gy, ...)`` with ``r`` mirrored lines on each side; the edge itself is not repeated.

    An image narrower than r + 1 has fewer lines to mirror and gets these.
    """

    def spread(df: DataFrame, c: str, n: str) -> DataFrame:
        own = F.struct(F.col(c).alias("at"))
        low = F.when((F.col(c) > 0) & (F.col(c) <= r), F.struct((-F.col(c)).alias("at")))
        high = F.when((F.col(c) < F.col(n) - 1) & (F.col(c) >= F.col(n) - 1 - r), F.struct((2 * (F.col(n) - 1) - F.col(c)).alias("at")))
        return df.withColumn("_to", F.explode(F.filter(F.array(own, low, high), lambda x: x.isNotNull()))).withColumn(c, F.col("_to.at")).drop("_to")

    known = cells.join(if_small(extent), "section")
    return spread(spread(known, "gx", "width"), "gy", "height").drop("width", "height")


def smooth(cells: DataFrame, extent: DataFrame, weights: list[float], column: str = "value") -> DataFrame:
    """An image weighed along x, then along y, by ``weights`` (an odd number), edges mirrored.

    Sums are not divided by the weights' sum; a cell that the image lacks counts 0. A pass's partition is one line of the grid.
    """
    r = len(weights) // 2
    kept = cells.select(*CELL, F.col(column).cast("double").alias("value"))

    def along(df: DataFrame, line: str, at: str) -> DataFrame:
        near = Window.partitionBy("section", line).orderBy(at)
        value = lambda d: F.coalesce(F.sum("value").over(near.rangeBetween(d, d)), F.lit(0.0))
        return df.withColumn("value", reduce(Column.__add__, [value(i - r) * w for i, w in enumerate(map(float, weights))], F.lit(0.0)))

    passed = along(along(with_gaps(pad_mirror(kept, extent, r), ["section"], r), "gy", "gx"), "gx", "gy").where("own")
    return passed.join(if_small(extent), "section").where("gx >= 0 and gy >= 0 and gx < width and gy < height").select(*CELL, "value")


def gaussian(sigma: float, truncate: float = 4.0) -> list[float]:
    """Weights of a normal curve that add up to 1."""
    r = max(1, int(truncate * sigma + 0.5))
    w = [math.exp(-i * i / (2 * sigma * sigma)) for i in range(-r, r + 1)]
    return [x / sum(w) for x in w]


#: The smoothing of I01, to be divided by 16 a pass.
BLUR = [1.0, 4.0, 6.0, 4.0, 1.0]


def tissue_evidence(pixels: DataFrame) -> DataFrame:
    """The larger of 255 less the grey value and the saturation, smoothed: ``(section, gx, gy, value)``.

    ``pixels(section, gx, gy, r, g, b)`` are whole numbers from 0 to 255.
    """
    most, least = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    grey = F.floor((299 * F.col("r") + 587 * F.col("g") + 114 * F.col("b") + 500) / 1000)
    saturation = F.when(most > 0, F.floor((510 * (most - least) + most) / (2 * most))).otherwise(0)
    raw = materialise(pixels.select(*CELL, F.greatest(255 - grey, saturation).alias("value")))
    return smooth(raw, extent_of(raw), BLUR).select(*CELL, F.floor(F.col("value") / 256 + 0.5).cast("int").alias("value"))


def otsu(cells: DataFrame) -> DataFrame:
    """``(section, threshold)``: the first value up to which and beyond which cells differ most between them.

    From a histogram of whole numbers; a section of one value has that value.
    """
    counts = cells.groupBy("section", "value").agg(F.count(F.lit(1)).alias("n"))
    upto, whole = Window.partitionBy("section").orderBy("value"), Window.partitionBy("section")  # a row a value
    sums = counts.withColumn("w", F.sum("n").over(upto)).withColumn("s", F.sum(F.col("n") * F.col("value")).over(upto)).withColumn("all_w", F.sum("n").over(whole)).withColumn("all_s", F.sum(F.col("n") * F.col("value")).over(whole))
    rest = F.col("all_w") - F.col("w")
    gap = (F.col("all_s") * F.col("w") - F.col("all_w") * F.col("s")).cast("double")
    spread = F.when(rest > 0, gap * gap / (F.col("w") * rest).cast("double")).otherwise(0.0)
    return sums.withColumn("spread", spread).groupBy("section").agg(F.min_by("value", F.struct(-F.col("spread"), F.col("value"))).alias("threshold"))


def tissue_mask(pixels: DataFrame, fraction: float = 0.001, kernel: int | None = None) -> DataFrame:
    """The cells of tissue. Evidence above Otsu's threshold, opened, closed, holes filled, small components dropped.

    ``kernel`` is the size of the elliptic element; by default half a percent of the shorter side, 3 at least,
    and odd. Sections of one kernel size are done together.
    """
    evidence = materialise(tissue_evidence(pixels))
    extent = if_small(extent_of(evidence))
    raw = materialise(evidence.join(if_small(otsu(evidence)), "section").where("value > threshold").select(*CELL))
    own = F.lit(kernel) if kernel else F.greatest(F.lit(3), F.rint(F.least("width", "height") * 0.005).cast("int"))
    sized = if_small(extent.withColumn("kernel", own + (1 - own % 2)))
    done = None
    for size in sorted({r.kernel for r in sized.select("kernel").distinct().collect()}):  # a row a size
        here = sized.where(F.col("kernel") == size).drop("kernel")
        part = closed(opened(raw.join(here.select("section"), "section", "left_semi"), here, ellipse(size)), here, ellipse(size))
        done = part if done is None else done.union(part)
    if done is None:
        return raw
    clean = materialise(done)
    return drop_small(materialise(fill_holes(clean, extent, evidence)), extent, fraction)


# --- density, ratio and texture -----------------------------------------------------------------------------


def point_density(points: DataFrame, cell: float, sigma: float = 1.0) -> DataFrame:
    """Points a cell, smoothed by a normal curve: ``(section, gx, gy, value)`` for every cell up to the farthest."""
    counts = points.groupBy("section", F.floor(F.col("x") / cell).cast("int").alias("gx"), F.floor(F.col("y") / cell).cast("int").alias("gy")).agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts.where("gx >= 0 and gy >= 0"))
    extent = if_small(extent_of(counts))
    dense = all_cells(extent).join(counts, CELL, "left").select(*CELL, F.coalesce("n", F.lit(0)).alias("value"))
    return smooth(dense, extent, gaussian(sigma))


def above_quantile(cells: DataFrame, q: float = 0.9) -> DataFrame:
    """Cells at or above the section's quantile, linearly interpolated."""
    cut = cells.groupBy("section").agg(F.percentile("value", F.lit(q)).alias("cut"))
    return cells.join(if_small(cut), "section").where("value >= cut").select(*CELL)


#: Shifts whose pairs of cells a texture counts, each both ways.
PAIRS: Offsets = [(1, 0), (0, 1), (1, 1), (1, -1)]


def texture(cells: DataFrame, size: int, levels: int = 8, pairs: Offsets = PAIRS) -> DataFrame:
    """By tile of ``size`` cells, ``(section, tx, ty, energy, homogeneity, entropy)`` of the pairs of levels in it.

    Values are cut into ``levels`` equal steps between the section's ends. A pair counts in both orders and
    belongs to the tile of its first cell, as long as its second lies in it too. Tiles of one cell have no row.
    """
    ends = if_small(cells.groupBy("section").agg(F.min("value").alias("low"), F.max("value").alias("high")))
    step = F.when(F.col("high") > F.col("low"), F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * levels)).otherwise(0)
    tile = lambda c: F.floor(F.col(c) / size).cast("int")
    cut = cells.join(ends, "section").select(*CELL, F.least(step, F.lit(levels - 1)).cast("int").alias("level"), tile("gx").alias("tx"), tile("gy").alias("ty"))
    asked = cut.select("section", "tx", "ty", F.col("level").alias("i"), "gx", "gy", F.explode(_offsets(pairs)).alias("o")).select("section", "tx", "ty", "i", (F.col("gx") + F.col("o.dx")).alias("gx"), (F.col("gy") + F.col("o.dy")).alias("gy"))
    met = asked.join(cut.withColumnRenamed("level", "j"), ["section", "tx", "ty", "gx", "gy"])
    both = met.select("section", "tx", "ty", "i", "j").union(met.select("section", "tx", "ty", F.col("j").alias("i"), F.col("i").alias("j")))
    counts = both.groupBy("section", "tx", "ty", "i", "j").agg(F.count(F.lit(1)).alias("n"))
    n = F.sum("n")
    far = (F.col("i") - F.col("j")) * (F.col("i") - F.col("j"))
    # sum p log p = sum n log n / N - log N
    entropy = F.log2(n.cast("double")) - F.sum(F.col("n") * F.log2(F.col("n").cast("double"))) / n
    return counts.groupBy("section", "tx", "ty").agg(
        (F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")) / n).alias("energy"), (F.sum(F.col("n") / (1 + far)) / n).alias("homogeneity"), entropy.alias("entropy")
    )


# --- windows, scribbles, resampling --------------------------------------------------------------------------


def fuse_windows(windows: DataFrame, size: int, sigma: float | None = None) -> DataFrame:
    """Overlapping windows laid over each other: ``(section, gx, gy, vector)``.

    ``windows(section, x0, y0, vector)`` cover ``size`` cells a side from (x0, y0). A cell's vector is the mean of
    those of the windows over it, weighed by a normal curve of the cell's distance from the window's centre,
    with a spread of a quarter of the size unless given.
    """
    s = sigma if sigma is not None else size / 4
    near = lambda c, g: (F.col(g) + 0.5 - F.col(c) - size / 2) ** 2
    line = lambda c: F.explode(F.sequence(F.col(c), F.col(c) + (size - 1)))
    under = windows.select("section", "x0", "y0", "vector", line("x0").alias("gx")).withColumn("gy", line("y0"))
    weighed = under.withColumn("w", F.exp(-(near("x0", "gx") + near("y0", "gy")) / (2 * s * s)))
    sums = weighed.select(*CELL, "w", F.posexplode("vector").alias("pos", "v")).groupBy(*CELL, "pos").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))
    return sums.groupBy(*CELL).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("vector"))


def scribble_regions(pixels: DataFrame, colours: DataFrame, least: int = 0) -> DataFrame:
    """Cells drawn in a label's colour: ``(section, gx, gy, label)``.

    ``colours(label, ord, r, g, b, tolerance)`` has a row a label: a cell matches if every channel is nearer than
    the tolerance. Of each label, components (eight neighbours) of more than ``least`` cells count; where labels
    meet, the one of greatest ``ord`` lies on top.
    """
    near = lambda c: F.abs(F.col(f"p.{c}") - F.col(f"k.{c}")) < F.col("k.tolerance")
    met = pixels.alias("p").join(F.broadcast(colours.alias("k")), near("r") & near("g") & near("b")).select("p.section", "p.gx", "p.gy", "k.label")  # a row a label
    parts = raster_components(met).where(F.col("size") > least)
    ranked = parts.join(F.broadcast(colours.select("label", "ord")), "label")
    return ranked.groupBy(*CELL).agg(F.max_by("label", "ord").alias("label"))


def upscale_nearest(cells: DataFrame, extent: DataFrame, factor: int) -> DataFrame:
    """Each cell as a square of ``factor`` cells, other columns kept; ``extent`` bounds the result."""
    line = lambda c: F.explode(F.sequence(F.col(c) * factor, F.col(c) * factor + (factor - 1)))
    spread = cells.withColumn("gx", line("gx")).withColumn("gy", line("gy"))
    return spread.join(if_small(extent), "section").where("gx < width and gy < height").drop("width", "height")


def shrink(cells: DataFrame, factor: int) -> DataFrame:
    """Means of squares of ``factor`` cells, those at the edge of what there is: ``(section, gx, gy, value)``."""
    at = lambda c: F.floor(F.col(c) / factor).cast("int").alias(c)
    return cells.groupBy("section", at("gx"), at("gy")).agg(F.avg("value").alias("value"))


def crop(cells: DataFrame, x0: int, y0: int, width: int, height: int) -> DataFrame:
    """A rectangle of the image, its corner the new origin."""
    inside = cells.where((F.col("gx") >= x0) & (F.col("gx") < x0 + width) & (F.col("gy") >= y0) & (F.col("gy") < y0 + height))
    return inside.withColumn("gx", F.col("gx") - x0).withColumn("gy", F.col("gy") - y0)


def inpaint(cells: DataFrame, holes: DataFrame, rounds: int = 200, settle: float = 1e-6) -> DataFrame:
    """Values for the cells of ``holes`` from those round them: ``(section, gx, gy, value)`` of the whole image.

    Values grow inward from the border, a cell taking the mean of its four neighbours that have one, and then
    relax: in every round each hole cell takes the mean of its four neighbours, until no cell moves by ``settle``
    or after ``rounds``. A hole without any border keeps no row.
    """
    around = _offsets([(1, 0), (-1, 0), (0, 1), (0, -1)])
    known = materialise(cells.select(*CELL, F.col("value").cast("double").alias("value")).join(holes.select(*CELL), CELL, "left_anti"))
    todo = materialise(holes.select(*CELL).distinct())
    asked = todo.select(*CELL, F.explode(around).alias("o")).select(*CELL, (F.col("gx") + F.col("o.dx")).alias("nx"), (F.col("gy") + F.col("o.dy")).alias("ny"))
    fixed = materialise(asked.join(known.select("section", F.col("gx").alias("nx"), F.col("gy").alias("ny"), "value"), ["section", "nx", "ny"]).groupBy(*CELL).agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n")))
    inner = materialise(asked.join(todo.select("section", F.col("gx").alias("nx"), F.col("gy").alias("ny")), ["section", "nx", "ny"]))
    now, filled, moved = fixed.select(*CELL, (F.col("s") / F.col("n")).alias("value")), 0, math.inf
    for _ in range(rounds):
        near = inner.join(now.select("section", F.col("gx").alias("nx"), F.col("gy").alias("ny"), "value"), ["section", "nx", "ny"]).groupBy(*CELL).agg(F.sum("value").alias("ts"), F.count(F.lit(1)).alias("tn"))
        both = todo.join(fixed, CELL, "left").join(near, CELL, "left").join(now.select(*CELL, F.col("value").alias("was")), CELL, "left")
        n = F.coalesce("n", F.lit(0)) + F.coalesce("tn", F.lit(0))
        value = (F.coalesce("s", F.lit(0.0)) + F.coalesce("ts", F.lit(0.0))) / n
        step = materialise(both.where(n > 0).select(*CELL, value.alias("value"), F.abs(value - F.col("was")).alias("by")))
        count, moved = step.agg(F.count(F.lit(1)), F.max(F.coalesce("by", F.lit(math.inf)))).first()
        now = step.drop("by")
        if count == filled and (moved or 0.0) <= settle:
            break
        filled = count
    return known.union(now)
