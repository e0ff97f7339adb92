"""Spots over grids, masks and windows of a raster."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.columns import between
from loomspark.functions.joins import if_small


def mask_labels(obs: DataFrame, mask: DataFrame, rounded: bool = False, scale: float = 1.0, background: str = "nan") -> DataFrame:
    """The mask's label at each observation, by truncated or (half to even) rounded coordinates; outside is background."""
    at = (lambda c: F.rint(F.col(c) * scale).cast("int")) if rounded else (lambda c: F.col(c).cast("int"))
    placed = obs.withColumn("mx", at("x")).withColumn("my", at("y"))
    named = mask.select("section", F.col("x").alias("mx"), F.col("y").alias("my"), F.col("label").alias("mask_label"))
    return placed.join(named, ["section", "mx", "my"], "left").select("section", "obs_id", F.coalesce("mask_label", F.lit(background)).alias("mask_label"))


def grid_to_spots(spots: DataFrame, grid: DataFrame, size: float, cell: float, by: str = "overlap", skip_zero: bool = False, statistic: str = "weighted") -> DataFrame:
    """Cells under each spot's square, averaged with the overlapping area as weight.

    ``spots(section, obs_id, x, y)``, ``grid(section, gx, gy, value)``, with ``feature`` if it has several. ``by``:
    divide by the area found (``overlap``) or by the whole spot's (``spot``), which counts what lies off the grid
    as 0. ``statistic`` may be the plain ``mean`` or ``median`` instead; ``skip_zero`` leaves out cells that are 0.
    """
    half = size / 2
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - half) / cell).cast("int"), (F.ceil((F.col(c) + half) / cell) - 1).cast("int")))
    under = spots.withColumn("gx", span("x")).withColumn("gy", span("y"))
    cover = lambda c, g: F.least(F.col(c) + half, (F.col(g) + 1) * cell) - F.greatest(F.col(c) - half, F.col(g) * cell)
    cells = grid.where("value != 0") if skip_zero else grid
    weighed = under.withColumn("area", cover("x", "gx") * cover("y", "gy")).where("area > 0").join(cells, ["section", "gx", "gy"])
    whole = F.sum("area") if by == "overlap" else F.lit(size * size)
    value = {"weighted": F.sum(F.col("value") * F.col("area")) / whole, "mean": F.avg("value"), "median": F.percentile("value", F.lit(0.5))}[statistic]
    key = ["section", "obs_id", *(["feature"] if "feature" in grid.columns else [])]
    return weighed.groupBy(*key).agg(value.alias("value"), F.count(F.lit(1)).alias("n_cells"))


def with_gaps(cells: DataFrame, key: list[str], r: int) -> DataFrame:
    """``cells`` and the free places of each column within ``r`` of a cell, marked by ``own``; these have a null ``value``.

    Two passes over lines, along gx and then along gy, then miss no neighbour: a cell's column passes through free
    places whose lines hold cells. A full image gets the places beyond its columns' ends only. A partition is one
    column of the grid.
    """
    down = Window.partitionBy(*key, "gx").orderBy("gy")
    near = cells.withColumn("_before", F.lag("gy").over(down)).withColumn("_after", F.lead("gy").over(down))
    free = lambda o: (o == 0) | ((o > 0) & (F.col("_after").isNull() | (F.col("gy") + o < F.col("_after")))) | ((o < 0) & (F.col("_before").isNull() | (F.col("gy") + o > F.col("_before") + r)))
    spread = near.withColumn("_o", F.explode(F.filter(F.array(*[F.lit(o) for o in range(-r, r + 1)]), free))).withColumn("own", F.col("_o") == 0)
    return spread.withColumn("gy", F.col("gy") + F.col("_o")).withColumn("value", F.when(F.col("own"), F.col("value"))).drop("_before", "_after", "_o")


def window_means(grid: DataFrame, radius: int) -> DataFrame:
    """Mean over the cells in the square window round each cell, from two passes of running sums.

    Places without a cell, off the grid or in it, don't count. With a ``feature`` column each feature by itself. A
    pass's partition is one line of the grid.
    """
    key = ["section", *(["feature"] if "feature" in grid.columns else [])]
    rows = Window.partitionBy(*key, "gy").orderBy("gx").rangeBetween(-radius, radius)
    columns = Window.partitionBy(*key, "gx").orderBy("gy").rangeBetween(-radius, radius)
    whole = with_gaps(grid.select(*key, "gx", "gy", "value"), key, radius)
    along = whole.withColumn("s", F.sum("value").over(rows)).withColumn("n", F.count("value").over(rows))
    summed = along.withColumn("s", F.sum("s").over(columns)).withColumn("n", F.sum("n").over(columns))
    return summed.where("own").select(*key, "gx", "gy", (F.col("s") / F.nullif("n", F.lit(0))).alias("mean"))


def scan_extremes(obs: DataFrame, axis: str = "x") -> DataFrame:
    """By line of the array, the median pixel along the axis and the least and greatest pixel across it.

    ``obs(section, array_x, array_y, x, y)``. ``axis`` x scans lines of equal ``array_x``: the median of x and
    the ends of y; y the other way round. Points with a missing or infinite coordinate don't count.
    """
    along, across, line = ("x", "y", "array_x") if axis == "x" else ("y", "x", "array_y")
    finite = F.col(line).isNotNull()
    for c in ("x", "y"):
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return obs.where(finite).groupBy("section", F.col(line).alias("line")).agg(F.percentile(along, F.lit(0.5)).alias("median"), F.min(across).alias("least"), F.max(across).alias("most"))


def tile_statistics(pixels: DataFrame, size: int) -> DataFrame:
    """Colours by tile: ``(section, tx, ty, spread, mean, spread_scaled, mean_scaled, ratio)``.

    ``pixels(section, gx, gy, channel, value)``. ``spread`` is the population deviation of all values of a tile;
    ``mean`` weighs the channels' means by their variance over the section's tiles (equally where nothing
    varies). Both scaled to [1, 2] over the section, their ratio to [0, 1]; what is constant scales to the low end.
    """
    tile = ["section", "tx", "ty"]
    cut = pixels.withColumn("tx", F.floor(F.col("gx") / size)).withColumn("ty", F.floor(F.col("gy") / size))
    sums = cut.groupBy(*tile, "channel").agg(F.avg("value").alias("m"), F.count("value").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    weights = if_small(sums.groupBy("section", "channel").agg(F.var_pop("m").alias("w")))
    w = F.sum("w")
    mean = F.when(w > 1e-12, F.sum(F.col("m") * F.col("w")) / F.when(w > 1e-12, w)).otherwise(F.avg("m"))
    n, s = F.sum("n"), F.sum("s")
    tiles = sums.join(weights, ["section", "channel"]).groupBy(*tile).agg(F.sqrt(F.greatest(F.sum("q") / n - (s / n) ** 2, F.lit(0.0))).alias("spread"), mean.alias("mean"))
    ends = lambda c: [F.min(c).alias(f"low_{c}"), F.max(c).alias(f"high_{c}")]
    known = tiles.join(if_small(tiles.groupBy("section").agg(*ends("spread"), *ends("mean"))), "section")
    scaled = known.withColumn("spread_scaled", between(F.col("spread"), F.col("low_spread"), F.col("high_spread")) + 1).withColumn("mean_scaled", between(F.col("mean"), F.col("low_mean"), F.col("high_mean")) + 1)
    raw = scaled.withColumn("raw", F.col("spread_scaled") / F.col("mean_scaled"))
    whole = raw.join(if_small(raw.groupBy("section").agg(*ends("raw"))), "section")
    return whole.select(*tile, "spread", "mean", "spread_scaled", "mean_scaled", between(F.col("raw"), F.col("low_raw"), F.col("high_raw")).alias("ratio"))


def pseudo_grid(obs: DataFrame, step: float, most: int = 250_000) -> DataFrame:
    """Places ``step`` apart over each section's bounds: ``(section, obs_id, x, y)``, ids by row and column.

    A section of more than ``most`` places is an error when rows are read.
    """
    ends = [f(c).alias(f"{n}_{c}") for c in ("x", "y") for f, n in ((F.min, "low"), (F.max, "high"))]
    box = obs.groupBy("section").agg(*ends)
    n = lambda c: F.floor((F.col(f"high_{c}") - F.col(f"low_{c}")) / step + 1e-9).cast("long")
    sized = box.withColumn("nx", n("x")).withColumn("ny", n("y"))
    able = F.when((F.col("nx") + 1) * (F.col("ny") + 1) > most, F.raise_error("too many places: choose a larger step").cast("boolean")).otherwise(F.lit(True))
    rows = sized.where(able).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ny"))))
    cells = rows.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nx"))))
    return cells.select("section", (F.col("i") * (F.col("nx") + 1) + F.col("j")).alias("obs_id"), (F.col("low_x") + F.col("j") * step).alias("x"), (F.col("low_y") + F.col("i") * step).alias("y"))


def boundary_scores(clusters: DataFrame, features: DataFrame, least: int = 10, veto: float = 0.8) -> DataFrame:
    """The sum of a cluster's absolute feature means; the least is the boundary, unless near the others' median."""
    mean = clusters.join(features, ["section", "obs_id"]).groupBy("section", "cluster", "feature").agg(F.avg("value").alias("m"), F.count(F.lit(1)).alias("n"))
    score = mean.groupBy("section", "cluster").agg(F.sum(F.abs("m")).alias("score"), F.max("n").alias("size")).where(F.col("size") >= least)
    place = F.row_number().over(Window.partitionBy("section").orderBy("score", "cluster"))
    ranked = score.withColumn("place", place)
    others = ranked.where("place > 1").groupBy("section").agg(F.percentile("score", F.lit(0.5)).alias("median"))
    return ranked.join(others, "section", "left").select("section", "cluster", "score", "size", ((F.col("place") == 1) & ~(F.coalesce(F.col("score") > veto * F.col("median"), F.lit(False)))).alias("boundary"))
