"""Registered queries of image masks, contours, textures and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.joins import if_small
from loomspark.operators import contours as ct
from loomspark.operators import enhancement as en
from loomspark.operators import images as im
from loomspark.operators import mixtures as mx
from loomspark.plans.catalog import _EXPR, _GRID, _expr, _grid, _r, query
from loomspark.plans.transfer_catalog import _WEIGHED
from loomspark.sources import tables as s

_CELL = "'s' || (vec_id % 4) AS section, ((vec_id // 4) % 25)::INT AS gx, ((vec_id // 4) // 25)::INT AS gy"
_LEVEL = "greatest(0, least(255, floor(128 + 500 * embedding[{}]::DOUBLE)))::INT"

#: Pixels, the evidence of tissue before and after smoothing, and Otsu's threshold.
_PIXELS = f"px AS (SELECT {_CELL}, {_LEVEL.format(1)} AS r, {_LEVEL.format(2)} AS g, {_LEVEL.format(3)} AS b FROM embeddings), ex AS (SELECT section, max(gx) + 1 AS w, max(gy) + 1 AS h FROM px GROUP BY section)"
_MIRRORED = "CASE WHEN {0} < 0 THEN -({0}) WHEN {0} >= {1} THEN 2 * ({1} - 1) - ({0}) ELSE {0} END"
_EVIDENCE = f"""{_PIXELS},
ev AS (
  SELECT section, gx, gy, greatest(255 - ((299 * r + 587 * g + 114 * b + 500) // 1000),
         CASE WHEN greatest(r, g, b) > 0 THEN (510 * (greatest(r, g, b) - least(r, g, b)) + greatest(r, g, b)) // (2 * greatest(r, g, b)) ELSE 0 END) AS v
  FROM px),
kn(d, wt) AS (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)),
bl AS (
  SELECT e.section, e.gx, e.gy, ((sum(kx.wt * ky.wt * o.v) + 128) // 256)::INT AS value
  FROM ev e JOIN ex USING (section), kn kx, kn ky, ev o
  WHERE o.section = e.section AND o.gx = {_MIRRORED.format("e.gx + kx.d", "w")} AND o.gy = {_MIRRORED.format("e.gy + ky.d", "h")}
  GROUP BY ALL)"""
_OTSU = f"""{_EVIDENCE},
hi AS (SELECT section, value, count(*) AS n FROM bl GROUP BY ALL),
cu AS (
  SELECT section, value, sum(n) OVER w AS c, sum(n * value) OVER w AS m, sum(n) OVER a AS all_c, sum(n * value) OVER a AS all_m
  FROM hi WINDOW w AS (PARTITION BY section ORDER BY value), a AS (PARTITION BY section)),
sp AS (
  SELECT section, value, CASE WHEN all_c > c THEN (all_m * c - all_c * m)::DOUBLE * (all_m * c - all_c * m)::DOUBLE / (c * (all_c - c))::DOUBLE ELSE 0 END AS spread FROM cu),
th AS (SELECT section, value AS threshold FROM sp QUALIFY row_number() OVER (PARTITION BY section ORDER BY spread DESC, value) = 1)"""
#: The mask, opened and closed with a cross, its holes filled, small components dropped.
_INSIDE = "gx >= 0 AND gy >= 0 AND gx < w AND gy < h"


def _eroded(name: str, of: str) -> str:
    return f"""{name} AS (
  SELECT c.section, c.gx, c.gy FROM {of} c JOIN ex USING (section), cr LEFT JOIN {of} o ON o.section = c.section AND o.gx = c.gx + cr.dx AND o.gy = c.gy + cr.dy
  GROUP BY c.section, c.gx, c.gy, w, h
  HAVING bool_and(o.gx IS NOT NULL OR c.gx + cr.dx < 0 OR c.gy + cr.dy < 0 OR c.gx + cr.dx >= w OR c.gy + cr.dy >= h))"""


def _dilated(name: str, of: str) -> str:
    return f"{name} AS (SELECT section, gx, gy FROM (SELECT DISTINCT section, gx + dx AS gx, gy + dy AS gy FROM {of}, cr) JOIN ex USING (section) WHERE {_INSIDE})"


_MASK = f"""{_OTSU},
cr(dx, dy) AS (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)),
m0 AS (SELECT section, gx, gy FROM bl JOIN th USING (section) WHERE value > threshold),
{_eroded("m1", "m0")}, {_dilated("m2", "m1")}, {_dilated("m3", "m2")}, {_eroded("m4", "m3")},
bg AS (SELECT section, gx, gy FROM px ANTI JOIN m4 USING (section, gx, gy)),
ou(section, gx, gy) AS (
  SELECT section, gx, gy FROM bg JOIN ex USING (section) WHERE gx = 0 OR gy = 0 OR gx = w - 1 OR gy = h - 1
  UNION SELECT bg.section, bg.gx, bg.gy FROM ou JOIN bg ON bg.section = ou.section AND abs(bg.gx - ou.gx) + abs(bg.gy - ou.gy) = 1),
m5 AS (SELECT section, gx, gy FROM px ANTI JOIN ou USING (section, gx, gy)),
rc(section, gx, gy, tx, ty) AS (
  SELECT section, gx, gy, gx, gy FROM m5
  UNION SELECT rc.section, rc.gx, rc.gy, o.gx, o.gy FROM rc JOIN m5 o ON o.section = rc.section AND abs(o.gx - rc.tx) <= 1 AND abs(o.gy - rc.ty) <= 1),
cs AS (SELECT section, gx, gy, count(*) AS size, min((ty, tx)) AS corner FROM rc GROUP BY section, gx, gy),
tm AS (
  SELECT section, gx, gy FROM cs JOIN ex USING (section)
  QUALIFY size >= greatest(1, round_even(w * h * 0.05, 0)) OR dense_rank() OVER (PARTITION BY section ORDER BY size DESC, corner) = 1)"""


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    level = lambda i: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 500 * F.get("vector", i)))).cast("int")
    cell = s.vectors(spark, d)
    return cell.select("section", F.expr("int((obs_id div 4) % 25)").alias("gx"), F.expr("int((obs_id div 4) div 25)").alias("gy"), level(0).alias("r"), level(1).alias("g"), level(2).alias("b"))


@query("i01_tissue_evidence", f"WITH {_EVIDENCE} SELECT section, gx, gy, value FROM bl")
def tissue_evidence(spark: SparkSession, d: str) -> DataFrame:
    return im.tissue_evidence(_pixels(spark, d))


@query("i01_otsu_threshold", f"WITH {_OTSU} SELECT section, threshold FROM th")
def otsu_threshold(spark: SparkSession, d: str) -> DataFrame:
    return im.otsu(im.tissue_evidence(_pixels(spark, d)))


@query("i01_tissue_mask", f"WITH RECURSIVE {_MASK} SELECT section, gx, gy FROM tm")
def tissue_mask(spark: SparkSession, d: str) -> DataFrame:
    return im.tissue_mask(_pixels(spark, d), 0.05, 3)


# --- contours ----------------------------------------------------------------------------------------------

_SPOTS = "sc AS (SELECT 's' || (vec_id % 4) AS section, (vec_id // 4) % 25 AS array_x, (vec_id // 4) // 25 AS array_y, 2 * ((vec_id // 4) % 25) + 9 * embedding[1]::DOUBLE AS x, 2 * ((vec_id // 4) // 25) + 9 * embedding[2]::DOUBLE AS y FROM embeddings)"
_HULL = f"""{_SPOTS},
pt AS (SELECT DISTINCT section, round_even(x, 0)::INT AS x, round_even(y, 0)::INT AS y FROM sc),
en AS (SELECT section, x, min(y) AS y FROM pt GROUP BY ALL UNION SELECT section, x, max(y) FROM pt GROUP BY ALL),
eg AS (
  SELECT p.section, p.x, p.y, q.x AS x2, q.y AS y2 FROM en p JOIN en q ON p.section = q.section AND (p.x, p.y) != (q.x, q.y)
  WHERE NOT EXISTS (
    SELECT 1 FROM en r WHERE r.section = p.section
    AND ((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) < 0
         OR ((q.x - p.x) * (r.y - p.y) = (q.y - p.y) * (r.x - p.x) AND ((r.x - p.x) * (r.x - q.x) + (r.y - p.y) * (r.y - q.y) > 0)))))"""
_LINES = """ln AS (SELECT section, array_x AS line, round_even(quantile_cont(x, 0.5), 0)::INT AS x, round_even(min(y), 0)::INT AS low, round_even(max(y), 0)::INT AS high FROM sc GROUP BY section, array_x),
sd AS (
  SELECT section, x, min(ord) AS ord, y
  FROM (SELECT section, x, low AS y, line AS ord FROM ln UNION ALL SELECT section, x, high, 100000 - line FROM ln) GROUP BY section, x, y),
cn AS (SELECT section, (row_number() OVER (PARTITION BY section ORDER BY ord) - 1)::INT AS place, x, y, count(*) OVER (PARTITION BY section) AS n FROM sd QUALIFY n >= 3)"""
_SCANNED = f"{_SPOTS},\n{_LINES}"


def _edges(name: str = "eg", of: str = "cn") -> str:
    follow = "coalesce(lead({0}) OVER w, first({0}) OVER w) AS {0}2"
    return (
        f"{name} AS (SELECT section, place, x, y, {follow.format('x')}, {follow.format('y')} FROM {of} "
        "WINDOW w AS (PARTITION BY section ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
    )


_EDGES = _edges()
_FILLED = """bx AS (SELECT section, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM eg GROUP BY section),
ce AS (SELECT section, unnest(range(x0, x1 + 1)) AS gx, y0, y1 FROM bx),
cl AS (SELECT section, gx::INT AS gx, unnest(range(y0, y1 + 1))::INT AS gy FROM ce),
fl AS (
  SELECT cl.section, gx, gy FROM cl JOIN eg USING (section) GROUP BY cl.section, gx, gy
  HAVING bool_or((x2 - x) * (gy - y) = (y2 - y) * (gx - x) AND gx BETWEEN least(x, x2) AND greatest(x, x2) AND gy BETWEEN least(y, y2) AND greatest(y, y2))
      OR count(*) FILTER (WHERE (y > gy) != (y2 > gy) AND CASE WHEN y2 > y THEN (gx - x) * (y2 - y) < (gy - y) * (x2 - x) ELSE (gx - x) * (y2 - y) > (gy - y) * (x2 - x) END) % 2 = 1)"""


def _spots(spark: SparkSession, d: str) -> DataFrame:
    column, line = F.expr("(obs_id div 4) % 25"), F.expr("(obs_id div 4) div 25")
    at = lambda c, i: (2 * c + 9 * F.get("vector", i)).alias("xy"[i])
    return s.vectors(spark, d).select("section", column.alias("array_x"), line.alias("array_y"), at(column, 0), at(line, 1))


@query("i02_convex_hull", f"WITH {_HULL} SELECT DISTINCT section, x, y FROM eg")
def convex_hull(spark: SparkSession, d: str) -> DataFrame:
    return ct.convex_hull(_spots(spark, d)).select("section", "x", "y")


@query("i02_scan_contour", f"WITH {_SCANNED} SELECT section, place, x, y FROM cn")
def scan_contour(spark: SparkSession, d: str) -> DataFrame:
    return ct.scan_contour(_spots(spark, d), "x").select("section", "place", "x", "y")


@query("i02_mask_contour")
def mask_contour(spark: SparkSession, d: str) -> DataFrame:
    return ct.mask_contour(im.tissue_mask(_pixels(spark, d), 0.05, 3))


@query("i03_fill_contour", f"WITH {_SCANNED}, {_EDGES}, {_FILLED} SELECT section, gx, gy FROM fl")
def fill_contour(spark: SparkSession, d: str) -> DataFrame:
    return ct.fill_contour(ct.scan_contour(_spots(spark, d), "x")).select("section", "gx", "gy")


#: The centroid of each contour's area.
_CENTRE = """mo AS (SELECT section, sum(x * y2 - x2 * y) AS a, sum((x + x2) * (x * y2 - x2 * y)) AS mx, sum((y + y2) * (x * y2 - x2 * y)) AS my, avg(x) AS ax, avg(y) AS ay FROM {} GROUP BY section),
cc AS (SELECT section, CASE WHEN a != 0 THEN mx / (3 * a) ELSE ax END AS cx, CASE WHEN a != 0 THEN my / (3 * a) ELSE ay END AS cy FROM mo)"""


@query("i03_scale_contour", f"""WITH {_SCANNED}, {_EDGES}, {_CENTRE.format("eg")}
SELECT section, place, round_even((x - cx) * 1.3 + cx, 0)::INT AS x, round_even((y - cy) * 1.3 + cy, 0)::INT AS y FROM cn JOIN cc USING (section)""")
def scale_contour(spark: SparkSession, d: str) -> DataFrame:
    return ct.scale_contour(ct.scan_contour(_spots(spark, d), "x"), 1.3).select("section", "place", "x", "y")


@query("a39_contour_scores", f"""WITH {_SCANNED}, {_EDGES}, {_FILLED},
im AS (SELECT DISTINCT section, 2 * gx AS gx, 2 * gy AS gy FROM (SELECT {_CELL}, embedding[3] AS v FROM embeddings) WHERE v > 0),
ex AS (SELECT section, (max(array_x) * 2 + 1)::INT AS w, (max(array_y) * 2 + 1)::INT AS h FROM sc GROUP BY section),
ci AS (SELECT section, gx, gy FROM fl JOIN ex USING (section) WHERE {_INSIDE}),
ar AS (SELECT section, count(*) AS area, count(im.gx) AS met FROM ci LEFT JOIN im USING (section, gx, gy) GROUP BY section),
ia AS (SELECT section, count(*) AS image_area FROM im GROUP BY section),
pe AS (SELECT section, sum(sqrt((x2 - x) ** 2 + (y2 - y) ** 2)) AS p FROM eg GROUP BY section),
vs AS (SELECT section, round_even(x, 0)::INT AS gx, round_even(y, 0)::INT AS gy FROM sc),
va AS (SELECT section, count(*) AS valid, count(ci.gx) AS held FROM (SELECT vs.* FROM vs JOIN ex USING (section) WHERE {_INSIDE}) LEFT JOIN ci USING (section, gx, gy) GROUP BY section),
z AS (
  SELECT section, held / valid AS spot_coverage, met / (area + image_area - met) AS image_iou, met / area AS image_precision, met / image_area AS image_recall,
         area / (w * h) AS area_fraction, least(1, 4 * pi() * area / greatest(p * p, 1)) AS compactness
  FROM ar JOIN ia USING (section) JOIN pe USING (section) JOIN va USING (section) JOIN ex USING (section))
SELECT section, round(0.45 * spot_coverage + 0.25 * image_iou + 0.15 * image_precision + 0.10 * image_recall + 0.05 * compactness, 6) AS score, round(spot_coverage, 6) AS spot_coverage,
       round(image_iou, 6) AS image_iou, round(image_precision, 6) AS image_precision, round(image_recall, 6) AS image_recall, round(area_fraction, 6) AS area_fraction, round(compactness, 6) AS compactness
FROM z""")
def contour_scores(spark: SparkSession, d: str) -> DataFrame:
    spots = _spots(spark, d)
    cell = s.vectors(spark, d).where(F.get("vector", 2) > 0).select("section", (2 * F.expr("(obs_id div 4) % 25")).cast("int").alias("gx"), (2 * F.expr("(obs_id div 4) div 25")).cast("int").alias("gy"))
    extent = if_small(spots.groupBy("section").agg((F.max("array_x") * 2 + 1).cast("int").alias("width"), (F.max("array_y") * 2 + 1).cast("int").alias("height")))
    scored = ct.contour_scores(ct.scan_contour(spots, "x"), cell, extent, spots)
    return scored.select("section", *[_r(c) for c in scored.columns if c not in ("section", "method")])


# --- density, texture, windows, scribbles --------------------------------------------------------------------


@query("i10_point_density", f"""WITH {_SPOTS},
ct AS (SELECT section, floor(x / 4)::INT AS gx, floor(y / 4)::INT AS gy, count(*) AS n FROM sc WHERE x >= 0 AND y >= 0 GROUP BY ALL),
ex AS (SELECT section, max(gx) + 1 AS w, max(gy) + 1 AS h FROM ct GROUP BY section),
ax AS (SELECT section, w, h, unnest(range(w)) AS gx FROM ex), al AS (SELECT section, w, h, gx, unnest(range(h)) AS gy FROM ax),
wt AS (SELECT d, exp(-d * d / 0.5) / sum(exp(-d * d / 0.5)) OVER () AS u FROM (SELECT unnest([-2, -1, 0, 1, 2]) AS d))
SELECT a.section, a.gx::INT AS gx, a.gy::INT AS gy, round(sum(kx.u * ky.u * coalesce(n, 0)), 6) AS value
FROM al a, wt kx, wt ky LEFT JOIN ct ON ct.section = a.section AND ct.gx = {_MIRRORED.format("a.gx + kx.d", "a.w")} AND ct.gy = {_MIRRORED.format("a.gy + ky.d", "a.h")}
GROUP BY a.section, a.gx, a.gy""")
def point_density(spark: SparkSession, d: str) -> DataFrame:
    return im.point_density(_spots(spark, d), 4.0, 0.5).select("section", "gx", "gy", _r("value"))


@query("i10_texture", f"""WITH {_GRID},
en AS (SELECT section, min(value) AS low, max(value) AS high FROM gr WHERE feature = 'f0' GROUP BY section),
lv AS (SELECT gr.section, gx, gy, gx // 5 AS tx, gy // 5 AS ty, least(floor((value - low) / (high - low) * 8), 7)::INT AS l FROM gr JOIN en USING (section) WHERE feature = 'f0'),
sh(dx, dy) AS (VALUES (1, 0), (0, 1), (1, 1), (1, -1)),
pa AS (SELECT a.section, a.tx, a.ty, a.l AS i, b.l AS j FROM lv a, sh JOIN lv b ON b.section = a.section AND b.tx = a.tx AND b.ty = a.ty AND b.gx = a.gx + dx AND b.gy = a.gy + dy),
bo AS (SELECT * FROM pa UNION ALL SELECT section, tx, ty, j, i FROM pa),
nr AS (SELECT section, tx, ty, i, j, count(*) AS n FROM bo GROUP BY section, tx, ty, i, j),
pr AS (SELECT section, tx, ty, i, j, n / sum(n) OVER (PARTITION BY section, tx, ty) AS p FROM nr)
SELECT section, tx, ty, round(sqrt(sum(p * p)), 6) AS energy, round(sum(p / (1 + (i - j) ** 2)), 6) AS homogeneity, round(-sum(p * log2(p)), 6) + 0 AS entropy FROM pr GROUP BY section, tx, ty""")
def texture(spark: SparkSession, d: str) -> DataFrame:
    one = _grid(spark, d).where("feature = 'f0'").drop("feature")
    return im.texture(one, 5).select("section", "tx", "ty", _r("energy"), _r("homogeneity"), (F.round("entropy", 6) + 0.0).alias("entropy"))


@query("c18_texture_classes")
def texture_classes(spark: SparkSession, d: str) -> DataFrame:
    tiles = [im.texture(_grid(spark, d).where(F.col("feature") == name).drop("feature"), 3).withColumn("section", F.concat("section", F.lit(f":{name}"))) for name in ("f0", "f1")]
    return mx.tissue_textures(tiles[0].union(tiles[1]))


@query("i07_fused_windows", f"""WITH wn AS (SELECT 's' || (vec_id % 4) AS section, 2 * ((vec_id // 4) % 25) AS x0, 2 * ((vec_id // 4) // 25) AS y0, embedding[1:4]::DOUBLE[] AS v FROM embeddings),
wx AS (SELECT *, unnest(range(x0, x0 + 4)) AS gx FROM wn), wy AS (SELECT *, unnest(range(y0, y0 + 4)) AS gy FROM wx),
wg AS (SELECT *, exp(-((gx + 0.5 - x0 - 2) ** 2 + (gy + 0.5 - y0 - 2) ** 2) / 2) AS w FROM wy)
SELECT section, gx::INT AS gx, gy::INT AS gy, round(sum(w * v[1]) / sum(w), 6) + 0 AS v1, round(sum(w * v[4]) / sum(w), 6) + 0 AS v4 FROM wg GROUP BY ALL""")
def fused_windows(spark: SparkSession, d: str) -> DataFrame:
    corner = lambda e: (2 * F.expr(e)).cast("int")
    windows = s.vectors(spark, d).select("section", corner("(obs_id div 4) % 25").alias("x0"), corner("(obs_id div 4) div 25").alias("y0"), F.slice("vector", 1, 4).alias("vector"))
    value = lambda i: (F.round(F.get("vector", i), 6) + 0.0).alias(f"v{i + 1}")
    return im.fuse_windows(windows, 4).select("section", "gx", "gy", value(0), value(3))


_COLOURS = [("dark", 0, 90, 100, 110, 70), ("light", 1, 170, 150, 140, 70), ("mid", 2, 120, 130, 140, 45)]


@query("i05_scribble_regions", f"""WITH RECURSIVE {_PIXELS},
co(label, ord, cr, cg, cb, tol) AS (VALUES {", ".join(str(c) for c in _COLOURS)}),
mt AS (SELECT section, gx, gy, label, ord FROM px, co WHERE abs(r - cr) < tol AND abs(g - cg) < tol AND abs(b - cb) < tol),
rc(section, label, gx, gy, tx, ty) AS (
  SELECT section, label, gx, gy, gx, gy FROM mt
  UNION SELECT rc.section, rc.label, rc.gx, rc.gy, o.gx, o.gy FROM rc JOIN mt o ON o.section = rc.section AND o.label = rc.label AND abs(o.gx - rc.tx) <= 1 AND abs(o.gy - rc.ty) <= 1),
sz AS (SELECT section, label, gx, gy FROM rc GROUP BY ALL HAVING count(*) > 3)
SELECT section, gx, gy, max_by(label, ord) AS label FROM sz JOIN co USING (label) GROUP BY section, gx, gy""")
def scribble_regions(spark: SparkSession, d: str) -> DataFrame:
    colours = spark.createDataFrame(_COLOURS, "label string, ord int, r int, g int, b int, tolerance int")
    return im.scribble_regions(_pixels(spark, d), colours, 3)


@query("i11_shrink_mirrored", f"""WITH {_GRID}, on_f AS (SELECT section, gx, gy, value FROM gr WHERE feature = 'f5'),
ex AS (SELECT section, max(gx) + 1 AS w, max(gy) + 1 AS h FROM on_f GROUP BY section),
ax AS (SELECT section, w, h, unnest(range(-3, w + 3)) AS gx FROM ex), al AS (SELECT section, w, h, gx, unnest(range(-3, h + 3)) AS gy FROM ax),
pd AS (SELECT al.section, al.gx, al.gy, value FROM al JOIN on_f o ON o.section = al.section AND o.gx = {_MIRRORED.format("al.gx", "w")} AND o.gy = {_MIRRORED.format("al.gy", "h")})
SELECT section, floor((gx + 3) / 4)::INT AS gx, floor((gy + 3) / 4)::INT AS gy, round(avg(value), 6) + 0 AS value FROM pd GROUP BY ALL""")
def shrink_mirrored(spark: SparkSession, d: str) -> DataFrame:
    one = _grid(spark, d).where("feature = 'f5'").drop("feature")
    padded = im.pad_mirror(one, im.extent_of(one), 3).withColumn("gx", F.col("gx") + 3).withColumn("gy", F.col("gy") + 3)
    return im.shrink(padded, 4).select("section", "gx", "gy", (F.round("value", 6) + 0.0).alias("value"))


@query("i11_inpainted")
def inpainted(spark: SparkSession, d: str) -> DataFrame:
    """Cells of one label's observations, from what lies round them."""
    holes = s.obs(spark, d).where("label = 'r1'").select("section", F.expr("int((obs_id div 4) % 25)").alias("gx"), F.expr("int((obs_id div 4) div 25)").alias("gy"))
    return im.inpaint(_grid(spark, d).where("feature = 'f5'").drop("feature"), holes, 20)


# --- enhancement -------------------------------------------------------------------------------------------

#: Observations beside their own cells, with whole features.
_PLACED = f"sc AS (SELECT {_CELL}, vec_id AS obs_id, (vec_id // 4) % 25 AS array_x, (vec_id // 4) % 25 + 0.25 + embedding[4]::DOUBLE AS x, (vec_id // 4) // 25 + 0.25 + embedding[5]::DOUBLE AS y FROM embeddings)"
#: The enlarged contour's cells, places among them, colour round all points, and its depth.
_DEPTHS = f"""{_PIXELS}, {_PLACED},
{_LINES}, {_edges("e1")}, {_CENTRE.format("e1")},
c2 AS (
  SELECT section, place, round_even(greatest(0, least((x - cx) * 1.05 + cx, w - 1)), 0)::INT AS x, round_even(greatest(0, least((y - cy) * 1.05 + cy, h - 1)), 0)::INT AS y
  FROM cn JOIN cc USING (section) JOIN ex USING (section)),
{_edges("eg", "c2")}, {_FILLED},
al AS (
  SELECT 0 AS known, section, (gy * w + gx)::BIGINT AS obs_id, gx::DOUBLE AS x, gy::DOUBLE AS y FROM fl JOIN ex USING (section) WHERE gx % 2 = 1 AND gy % 2 = 1
  UNION ALL SELECT 1, section, obs_id, x, y FROM sc),
s0 AS (SELECT al.*, w, h, least(greatest(0, least(round_even(x, 0) - 1, w)) + 2, w) AS x1, least(greatest(0, least(round_even(y, 0) - 1, h)) + 2, h) AS y1 FROM al JOIN ex USING (section)),
me AS (
  SELECT known, s0.section, obs_id, x, y, avg(r) AS r, avg(g) AS g, avg(b) AS b
  FROM s0 JOIN px ON px.section = s0.section AND gx >= greatest(0, x1 - 2) AND gx < x1 AND gy >= greatest(0, y1 - 2) AND gy < y1 GROUP BY ALL),
va AS (SELECT *, var_pop(r) OVER w AS vr, var_pop(g) OVER w AS vg, var_pop(b) OVER w AS vb FROM me WINDOW w AS (PARTITION BY section)),
sg AS (SELECT *, (r * vr + g * vg + b * vb) / (vr + vg + vb) AS signature FROM va),
de AS (SELECT *, (signature - avg(signature) OVER w) / stddev_pop(signature) OVER w * greatest(stddev_pop(x) OVER w, stddev_pop(y) OVER w) AS z FROM sg WINDOW w AS (PARTITION BY section))"""
_IN_SPACE = "(a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2"
_NEAR = f"""ne AS (
  SELECT a.section, a.obs_id, b.obs_id AS other_id, {_IN_SPACE} AS d2 FROM de a JOIN de b ON a.section = b.section AND a.known = 0 AND b.known = 1
  QUALIFY row_number() OVER (PARTITION BY a.section, a.obs_id ORDER BY {_IN_SPACE}, b.obs_id) <= 6)"""


def _placed(spark: SparkSession, d: str) -> DataFrame:
    column, line = F.expr("(obs_id div 4) % 25"), F.expr("(obs_id div 4) div 25")
    at = lambda c, i: c + F.lit(0.25) + F.get("vector", i)
    return s.vectors(spark, d).select("section", "obs_id", column.alias("array_x"), line.alias("array_y"), at(column, 3).alias("x"), at(line, 4).alias("y"))


def _enhanced(spark: SparkSession, d: str, **weights: object) -> tuple[DataFrame, DataFrame]:
    known = _placed(spark, d)
    return en.enhance_tissue(known, _expr(spark, d), _pixels(spark, d), ct.scan_contour(known, "x"), 2.0, 6, **weights)


@query("i04_histology_places", f"""WITH {_DEPTHS}, {_NEAR},
la AS (SELECT section, obs_id, sqrt(max(d2)) AS d, sqrt(min(d2)) AS nearest FROM ne GROUP BY ALL),
fa AS (SELECT section, quantile_cont(d, 0.95) AS far FROM la GROUP BY section),
co AS (SELECT section, obs_id, count(*) AS n_neighbours FROM ne JOIN fa USING (section) WHERE sqrt(d2) <= far GROUP BY ALL)
SELECT section, obs_id, de.x, de.y, round(signature, 6) AS signature, round(z, 6) AS z, round(nearest, 6) AS nearest, coalesce(n_neighbours, 0) AS n_neighbours
FROM de LEFT JOIN la USING (section, obs_id) LEFT JOIN co USING (section, obs_id) WHERE known = 0""")
def histology_places(spark: SparkSession, d: str) -> DataFrame:
    _, places = _enhanced(spark, d)
    return places.select("section", "obs_id", "x", "y", _r("signature"), _r("z"), _r("nearest"), "n_neighbours")


@query("i04_histology_enhance", f"WITH {_EXPR}, {_DEPTHS}, {_NEAR}, {_WEIGHED.format('1 / (sqrt(d2) + 0.1) ** 2')}")
def histology_enhance(spark: SparkSession, d: str) -> DataFrame:
    values, _ = _enhanced(spark, d)
    return values.select("section", "obs_id", "feature", _r("value"))


@query("i04_exponential_weights", f"""WITH {_EXPR}, {_DEPTHS}, {_NEAR},
md AS (SELECT section, greatest(quantile_cont(sqrt(d2), 0.5), 0.1) AS scale FROM ne WHERE d2 > 0 GROUP BY section),
{_WEIGHED.format("exp(-sqrt(d2) / (SELECT scale FROM md WHERE md.section = ne.section))")}""")
def exponential_weights(spark: SparkSession, d: str) -> DataFrame:
    values, _ = _enhanced(spark, d, how="exponential")
    return values.select("section", "obs_id", "feature", _r("value"))
