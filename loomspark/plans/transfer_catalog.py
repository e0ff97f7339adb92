"""Registered queries of label transfer, of the choice of clustering, and of subtypes."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions.joins import if_small
from loomspark.operators import assignment as a
from loomspark.operators import config_choice as cc
from loomspark.operators import embedding as e
from loomspark.operators import enhancement as en
from loomspark.operators import features as f
from loomspark.operators import hierarchy_features as hf
from loomspark.operators import markers as m
from loomspark.operators import neighbours as n
from loomspark.operators import postprocess as pp
from loomspark.operators import raster as g
from loomspark.operators import regions as r
from loomspark.operators import subtypes as st
from loomspark.operators import graph_clusters as gc
from loomspark.operators import transfer as t
from loomspark.plans.catalog import _CROSS, _EXPR, _LOOSE, _MARKED, _OBS, _RAW, _axis_clusters, _combined, _cross, _expr, _markers, _r, largest_axis, query
from loomspark.plans.hierarchy_catalog import _BOUNDS, _NEAREST, _QUANTILE, selected, splits
from loomspark.sources import tables as s
from loomspark.sources.materialise import materialise

# --- radius joins ------------------------------------------------------------------------------------------


_RADII = """ds AS (
  SELECT a.section, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d,
         row_number() OVER (PARTITION BY a.section ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) - 1 AS place
  FROM obs a JOIN obs b ON a.section = b.section),
pt AS (SELECT section, (count(*) * count(*) - 1) * least(1, 10 / count(*)) AS pt FROM obs GROUP BY section),
ra AS (
  SELECT section, low + (high - low) * (pt - floor(pt)) AS radius
  FROM (SELECT section, pt, max(d) FILTER (WHERE place = floor(pt)) AS low, max(d) FILTER (WHERE place = ceil(pt)) AS high
        FROM ds JOIN pt USING (section) GROUP BY section, pt))"""


@query("j10_radius_quantile", f"""WITH {_OBS}, {_RADII}
SELECT a.section, a.obs_id, count(*) AS n_near, round(any_value(radius), 6) AS radius
FROM obs a JOIN obs b ON a.section = b.section JOIN ra ON ra.section = a.section
WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= radius GROUP BY ALL""")
def radius_quantile(spark: SparkSession, d: str) -> DataFrame:
    o = s.obs(spark, d)
    radii = n.distance_quantile(o, o, k=10)
    near = n.within_radius(o, o, radii).groupBy("section", "obs_id").agg(F.count(F.lit(1)).alias("n_near"))
    return near.join(if_small(radii), "section").select("section", "obs_id", "n_near", _r("radius"))


@query("j11_neighbour_radius", f"WITH {_OBS}, ra AS (SELECT a.section, quantile_cont(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 0.05) AS radius FROM obs a JOIN obs b ON a.section = b.section AND a.obs_id < b.obs_id GROUP BY a.section) SELECT section, round(radius, 6) AS radius FROM ra")
def neighbour_radius(spark: SparkSession, d: str) -> DataFrame:
    o = s.obs(spark, d)
    return n.distance_quantile(o, o, q=0.05, own=True).select("section", _r("radius"))


# --- assignment --------------------------------------------------------------------------------------------


@query("l03_quantile_anchors", f"""WITH {_QUANTILE}, rf AS (SELECT label, feature, value FROM expr WHERE section != 's3'), dr AS (SELECT DISTINCT parent, direction, child AS branch FROM sides), wt AS (SELECT qf.parent, branch, feature FROM qf JOIN dr USING (parent, direction)),
bo AS (SELECT s2.parent, wt.branch, wt.feature, rf.label, s2.child = wt.branch AS own, quantile_cont(value, 0.85) AS up, quantile_cont(value, 0.15) AS lo FROM rf JOIN sides s2 USING (label) JOIN wt ON wt.parent = s2.parent AND wt.feature = rf.feature GROUP BY ALL),
th AS (SELECT parent, branch, feature, coalesce(avg(CASE WHEN NOT own AND up > 0 THEN up END), avg(CASE WHEN own AND lo > 0 THEN lo END)) AS t FROM bo GROUP BY ALL),
fl AS (SELECT section, obs_id, parent, branch, sum((value > t)::INT)::BIGINT AS n_flags FROM expr JOIN th USING (feature) WHERE section = 's3' GROUP BY ALL),
li AS (SELECT section, parent, branch, max(n_flags) AS most, greatest(1, floor(least(round_even(max(n_flags) * 0.5, 0), quantile_cont(n_flags, 0.8)))) AS lim FROM fl GROUP BY ALL)
SELECT section, parent, branch, obs_id, n_flags, (most > 0 AND n_flags >= lim)::INT AS anchor FROM fl JOIN li USING (section, parent, branch)""")
def quantile_anchors(spark: SparkSession, d: str) -> DataFrame:
    expr, sides = _expr(spark, d), hf.split_sides(splits(spark))
    lists = hf.quantile_feature_lists(selected(spark, d))
    return a.quantile_anchors(expr.where("section != 's3'"), expr.where("section = 's3'"), sides, lists)


@query("a20_ratio_modes", f"WITH {_OBS}, q AS (SELECT section, sum((label IN ('r0', 'r1', 'r2'))::INT) AS a, sum((label NOT IN ('r0', 'r1', 'r2'))::INT) AS b FROM obs GROUP BY section), rr AS (SELECT greatest(a, b) / least(a, b) AS ratio FROM q), po AS (SELECT sum(a) AS a, sum(b) AS b FROM q) SELECT 'pooled' AS mode, round(greatest(a, b) / least(a, b), 6) AS ratio FROM po UNION ALL SELECT 'max', round(max(ratio), 6) FROM rr UNION ALL SELECT 'median', round(quantile_cont(ratio, 0.5), 6) FROM rr UNION ALL SELECT 'mean', round(avg(ratio), 6) FROM rr")
def ratio_modes(spark: SparkSession, d: str) -> DataFrame:
    sided = s.obs(spark, d).withColumn("side", F.when(F.col("label").isin("r0", "r1", "r2"), "first").otherwise("second"))
    out = None
    for mode in ("pooled", "max", "median", "mean"):
        one = a.side_ratio(sided, "first", "second", mode).select(F.lit(mode).alias("mode"), _r("ratio"))
        out = one if out is None else out.union(one)
    return out


_BEST = "pl AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round({score}, 9) DESC, ord) AS r FROM (SELECT *, max(percent) OVER w - min(percent) OVER w AS gap FROM cx WHERE size >= 10 WINDOW w AS (PARTITION BY cluster)))"
_PLAIN = _BEST.format(score="percent")
_AGAIN = _BEST.format(score="CASE WHEN gap <= 100 THEN percent * share ELSE percent END").replace("pl AS", "ag AS")


@query("l07_one_sided", f"WITH {_CROSS}, {_PLAIN}, {_AGAIN}, ca AS (SELECT count(DISTINCT branch) AS n FROM pl WHERE r = 1 AND percent > 1), ra AS (SELECT greatest(x, y) / least(x, y) AS ratio FROM (SELECT sum((label IN ('r0', 'r1', 'r2', 'r3', 'r4'))::INT) AS x, sum((label NOT IN ('r0', 'r1', 'r2', 'r3', 'r4'))::INT) AS y FROM ve WHERE section != 's3')), vd AS (SELECT n = 1 AND ratio > 1.0 AS adjusted FROM ca, ra) SELECT cluster, size, round(percent, 6) AS percent, CASE WHEN percent > 1 THEN branch ELSE 'novel_cluster' END AS branch, adjusted FROM pl, vd WHERE r = 1 AND NOT adjusted UNION ALL SELECT cluster, size, round(percent, 6), CASE WHEN percent > 1 THEN branch ELSE 'novel_cluster' END, adjusted FROM ag, vd WHERE r = 1 AND adjusted")
def one_sided(spark: SparkSession, d: str) -> DataFrame:
    sided = s.obs(spark, d).where("section != 's3'").withColumn("side", F.when(F.col("label").isin("r0", "r1", "r2", "r3", "r4"), "left").otherwise("right"))
    return a.adjust_one_sided(_cross(spark, d), a.side_ratio(sided, "left", "right"), 1.0, least_percent=1.0).select("cluster", "size", _r("percent"), "branch", "adjusted")


def _novel_step(no: int, cluster: int) -> str:
    was, now = f"s{no}", f"s{no + 1}"
    return f"""v{no} AS (SELECT vote, count(*) AS c FROM (SELECT b.label AS vote, row_number() OVER (PARTITION BY a.obs_id ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.obs_id) AS place FROM {was} a JOIN {was} b ON a.cluster = {cluster} AND a.label = 'novel_cluster' AND b.label != 'novel_cluster') WHERE place <= 25 GROUP BY vote),
w{no} AS (SELECT first(vote ORDER BY c DESC, vote) AS vote FROM v{no}), {now} AS (SELECT obs_id, x, y, cluster, CASE WHEN cluster = {cluster} AND label = 'novel_cluster' AND vote IS NOT NULL THEN vote ELSE label END AS label FROM {was}, w{no})"""


@query("l06_reassign_novel", f"WITH {_CROSS}, {_OBS}, {_PLAIN}, s0 AS (SELECT obs.obs_id, obs.x, obs.y, cu.cluster, CASE WHEN percent > 55 THEN branch ELSE 'novel_cluster' END AS label FROM obs JOIN cu USING (obs_id) JOIN pl ON pl.cluster = cu.cluster AND r = 1), {', '.join(_novel_step(i, i) for i in range(7))} SELECT obs_id, cluster, label FROM s7")
def reassign_novel(spark: SparkSession, d: str) -> DataFrame:
    given = materialise(a.assign_clusters(_cross(spark, d), least_percent=55.0))  # a row a cluster
    placed = materialise(_axis_clusters(spark, d).join(given.select("cluster", F.col("branch").alias("label")), "cluster"))
    again = a.novel_clusters(given, placed.count())
    return a.reassign_novel(placed, again).select("obs_id", "cluster", "label")


_SPOTS = f"{_OBS}, bx AS (SELECT section, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM obs GROUP BY section), sp AS (SELECT section, i * (floor((hx - lx) / 2) + 1)::BIGINT + j AS obs_id, lx + j * 2 AS x, ly + i * 2 AS y FROM bx, unnest(generate_series(0, floor((hy - ly) / 2)::BIGINT)) AS a(i), unnest(generate_series(0, floor((hx - lx) / 2)::BIGINT)) AS b(j))"
_SPOT_VOTES = "vo AS (SELECT section, obs_id, label, count(*) AS c, count(*) / sum(count(*)) OVER (PARTITION BY section, obs_id) AS share, row_number() OVER (PARTITION BY section, obs_id ORDER BY count(*) DESC, label) AS place FROM ne GROUP BY section, obs_id, label), pt AS (SELECT section, label, count(*) / sum(count(*)) OVER (PARTITION BY section) AS part FROM obs GROUP BY section, label), rr AS (SELECT section, label FROM (SELECT *, max(part) OVER (PARTITION BY section) AS top FROM pt) WHERE top >= 0.1 AND part < 0.11), fi AS (SELECT section, obs_id, max(label) FILTER (WHERE place = 1) AS l1, max(share) FILTER (WHERE place = 1) AS p1, max(label) FILTER (WHERE place = 2) AS l2, max(share) FILTER (WHERE place = 2) AS p2 FROM vo GROUP BY ALL), ch AS (SELECT fi.*, coalesce(l2 IS NOT NULL AND (section, l1) NOT IN (SELECT (section, label) FROM rr) AND (section, l2) IN (SELECT (section, label) FROM rr) AND p2 > 0.11, false) AS second FROM fi)"


@query("l10_annotate_spots", f"WITH {_SPOTS}, ne AS (SELECT a.section, a.obs_id, b.label FROM sp a JOIN obs b USING (section) QUALIFY row_number() OVER (PARTITION BY a.section, a.obs_id ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.obs_id) <= 6), {_SPOT_VOTES} SELECT section, obs_id, CASE WHEN second THEN l2 ELSE l1 END AS label, round(CASE WHEN second THEN p2 ELSE p1 END, 6) AS share FROM ch")
def annotate_spots(spark: SparkSession, d: str) -> DataFrame:
    o = s.obs(spark, d)
    return n.annotate_spots(g.pseudo_grid(o, 2.0), o, 6, "knn", True, 0.1, 0.11).select("section", "obs_id", "label", _r("share"))


_WEIGHED = """la AS (SELECT section, obs_id, sqrt(max(d2)) AS d FROM ne GROUP BY ALL),
fa AS (SELECT section, quantile_cont(d, 0.95) AS far FROM la GROUP BY section),
w AS (SELECT ne.section, ne.obs_id, other_id, {} AS w FROM ne JOIN fa USING (section) WHERE sqrt(d2) <= far),
ww AS (SELECT *, w / sum(w) OVER (PARTITION BY section, obs_id) AS nw FROM w)
SELECT ww.section, ww.obs_id, feature, round(sum(nw * value), 6) AS value FROM ww JOIN expr ON expr.section = ww.section AND expr.obs_id = other_id GROUP BY ALL"""


@query("i04_enhance", f"""WITH {_SPOTS}, {_EXPR},
ne AS (
  SELECT a.section, a.obs_id, b.obs_id AS other_id, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS d2 FROM sp a JOIN obs b USING (section)
  QUALIFY row_number() OVER (PARTITION BY a.section, a.obs_id ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.obs_id) <= 4),
{_WEIGHED.format("1 / (sqrt(d2) + 0.1) ** 2")}""")
def enhance(spark: SparkSession, d: str) -> DataFrame:
    o = s.obs(spark, d)
    return en.enhance(g.pseudo_grid(o, 2.0), o, _expr(spark, d), 4).select("section", "obs_id", "feature", _r("value"))


# --- boundaries, components ----------------------------------------------------------------------------------

_EDGE = f"""{_RAW}, {_OBS}, cl AS (SELECT 's' || (vec_id % 4) AS section, vec_id AS obs_id, list_position(embedding[1:5], list_max(embedding[1:5])) - 1 AS cluster FROM embeddings),
mn AS (SELECT section, cluster, feature, avg(value) AS m, count(*) AS n FROM raw JOIN cl USING (section, obs_id) WHERE feature IN ('f0', 'f1', 'f2') GROUP BY ALL), sc AS (SELECT section, cluster, sum(abs(m)) AS score FROM mn GROUP BY ALL HAVING max(n) >= 5),
rk AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY score, cluster) AS place FROM sc), ot AS (SELECT section, quantile_cont(score, 0.5) AS med FROM rk WHERE place > 1 GROUP BY section), bd AS (SELECT section, cluster FROM rk LEFT JOIN ot USING (section) WHERE place = 1 AND NOT coalesce(score > 0.9 * med, false)),
po AS (SELECT obs.section, obs.obs_id, x, y, cl.cluster::VARCHAR AS label, bd.cluster IS NOT NULL AS edge, (cl.section IN (SELECT section FROM bd)) AS active FROM obs JOIN cl USING (section, obs_id) LEFT JOIN bd ON bd.section = cl.section AND bd.cluster = cl.cluster),
nb AS (SELECT a.section, a.obs_id, b.label, row_number() OVER (PARTITION BY a.obs_id ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.obs_id) AS place FROM po a JOIN po b ON a.section = b.section AND a.edge AND NOT b.edge QUALIFY place <= 9),
vt AS (SELECT section, obs_id, label FROM nb GROUP BY section, obs_id, label QUALIFY row_number() OVER (PARTITION BY section, obs_id ORDER BY count(*) DESC, min(place)) = 1),
mv AS (SELECT po.*, coalesce(vt.label, po.label) AS reassigned FROM po LEFT JOIN vt USING (section, obs_id)),
n2 AS (SELECT a.section, a.obs_id, b.reassigned AS vote, row_number() OVER (PARTITION BY a.obs_id ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.obs_id) AS place FROM mv a JOIN mv b ON a.section = b.section AND a.active QUALIFY place <= 7),
v2 AS (SELECT section, obs_id, vote, count(*) AS c, sum(count(*)) OVER (PARTITION BY section, obs_id) AS al FROM n2 GROUP BY section, obs_id, vote QUALIFY row_number() OVER (PARTITION BY section, obs_id ORDER BY count(*) DESC, vote) = 1)"""


@query("c11_boundary_refinement", f"WITH {_EDGE} SELECT mv.section, mv.obs_id, label::INT AS cluster, reassigned, CASE WHEN c * 2 > al THEN vote ELSE reassigned END AS refined FROM mv LEFT JOIN v2 USING (section, obs_id)")
def boundary_refinement(spark: SparkSession, d: str) -> DataFrame:
    clusters = s.vectors(spark, d).select("section", "obs_id", "x", "y", largest_axis("vector", 5).alias("cluster"))
    rgb = s.raw_expr(spark, d).where("feature in ('f0', 'f1', 'f2')").select("section", "obs_id", "feature", "value")
    scores = g.boundary_scores(clusters.select("section", "obs_id", "cluster"), rgb, 5, 0.9)
    return pp.refine_boundary(clusters, scores, 9, 6)


@query("c10_resolve_features", "WITH v AS (SELECT DISTINCT p_brand AS feature, p_type AS source_name FROM part), aa AS (SELECT DISTINCT feature AS asked FROM v UNION SELECT DISTINCT source_name FROM v), so AS (SELECT source_name AS asked, min(feature) AS feature FROM v GROUP BY source_name HAVING count(DISTINCT feature) = 1) SELECT aa.asked, coalesce(CASE WHEN aa.asked IN (SELECT feature FROM v) THEN aa.asked END, so.feature) AS feature FROM aa LEFT JOIN so USING (asked) WHERE aa.asked IN (SELECT feature FROM v) OR so.feature IS NOT NULL")
def resolve_features(spark: SparkSession, d: str) -> DataFrame:
    var = s.read(spark, d, "part").select(F.col("p_brand").alias("feature"), F.col("p_type").alias("source_name")).distinct()
    names = [x.asked for x in var.select(F.explode(F.array("feature", "source_name")).alias("asked")).distinct().collect()]  # some brands and types
    return pp.resolve_features(var, sorted(names)).select("asked", "feature")


@query("h13_connected_components", f"WITH RECURSIVE {_OBS}, nn AS (SELECT a.obs_id, b.obs_id AS other_id FROM obs a JOIN obs b ON a.section = b.section AND a.label = b.label AND a.obs_id != b.obs_id QUALIFY row_number() OVER (PARTITION BY a.obs_id ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.obs_id) <= 1), ed AS (SELECT obs_id AS a, other_id AS b FROM nn UNION SELECT other_id, obs_id FROM nn), rc(node, reach) AS (SELECT obs_id, obs_id FROM obs UNION SELECT rc.node, ed.b FROM rc JOIN ed ON ed.a = rc.reach) SELECT node, min(reach) AS component FROM rc GROUP BY node")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    o = s.obs(spark, d).withColumn("section", F.concat_ws("/", "section", "label"))
    near = n.plane_neighbours(o, o, 2).where("obs_id != other_id")
    first = near.groupBy("obs_id").agg(F.min_by("other_id", F.struct("d2", "other_id")).alias("other_id"))
    return pp.connected_components(o.select(F.col("obs_id").alias("node")), first.select(F.col("obs_id").alias("a"), F.col("other_id").alias("b")))


_CELLS = "ce AS (SELECT 's' || (vec_id % 4) AS section, ((vec_id // 4) % 12)::INT AS gx, ((vec_id // 4) // 12)::INT AS gy, CASE WHEN label < 5 THEN 'a' ELSE 'b' END AS label FROM embeddings), ra AS (SELECT section, gx, gy, label FROM ce)"
_RASTER = f"{_CELLS}, rc(section, label, gx, gy, tx, ty) AS (SELECT section, label, gx, gy, gx, gy FROM ra UNION SELECT rc.section, rc.label, rc.gx, rc.gy, b.gx, b.gy FROM rc JOIN ra b ON b.section = rc.section AND b.label = rc.label AND abs(b.gx - rc.tx) <= 1 AND abs(b.gy - rc.ty) <= 1), co AS (SELECT section, label, gx, gy, min((ty, tx)) AS corner, count(*) AS size FROM rc GROUP BY ALL)"


def _cells(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("label").isin("r0", "r1", "r2", "r3", "r4"), "a").otherwise("b")
    return s.obs(spark, d).select("section", F.expr("int((obs_id div 4) % 12)").alias("gx"), F.expr("int((obs_id div 4) div 12)").alias("gy"), label.alias("label"))


@query("h14_raster_components", f"WITH RECURSIVE {_RASTER}, pl AS (SELECT section, label, corner, size, row_number() OVER (PARTITION BY section, label ORDER BY size DESC, corner) AS place FROM (SELECT DISTINCT section, label, corner, size FROM co)), bg AS (SELECT * FROM co WHERE size >= 4), vt AS (SELECT s.section, s.gx, s.gy, b.label FROM co s JOIN bg b ON s.size < 4 AND b.section = s.section AND abs(b.gx - s.gx) <= 1 AND abs(b.gy - s.gy) <= 1 GROUP BY s.section, s.gx, s.gy, b.label QUALIFY row_number() OVER (PARTITION BY s.section, s.gx, s.gy ORDER BY count(*) DESC, b.label) = 1) SELECT co.section, co.gx, co.gy, co.label, co.size, place, coalesce(vt.label, co.label) AS relabelled FROM co JOIN pl USING (section, label, corner) LEFT JOIN vt ON vt.section = co.section AND vt.gx = co.gx AND vt.gy = co.gy")
def raster_components(spark: SparkSession, d: str) -> DataFrame:
    return pp.relabel_small(pp.raster_components(_cells(spark, d)), 4).drop("component")


@query("h15_ward_clusters")
def ward_clusters(spark: SparkSession, d: str) -> DataFrame:
    means = r.centroids(_expr(spark, d)).groupBy("section", "feature").agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "value"))), lambda x: x["value"]).alias("vector"))
    return pp.ward_clusters(means, 6, "section")


# --- choice of clustering ------------------------------------------------------------------------------------


def _modalities(spark: SparkSession, d: str) -> DataFrame:
    v = s.vectors(spark, d)
    part = lambda name, at: F.struct(F.lit(name).alias("modality"), F.slice("vector", at, 32).alias("vector"))
    return v.select("section", "obs_id", F.explode(F.array(part("Gene", 1), part("Image", 33))).alias("m")).select("section", "obs_id", "m.modality", "m.vector")


@query("c14_modality_scores")
def modality_scores(spark: SparkSession, d: str) -> DataFrame:
    return cc.clustering_scores(_modalities(spark, d), s.obs(spark, d), "modality", 10)


@query("c16_reduction_scores")
def reduction_scores(spark: SparkSession, d: str) -> DataFrame:
    wanted = _markers(spark, d).groupBy("feature").agg(F.min(F.substring("feature", 2, 3).cast("int")).alias("ord"))
    chosen = e.selected_features(_expr(spark, d), wanted).withColumn("method", F.lit("selected_features"))
    both = s.vectors(spark, d).select("section", "obs_id", "vector").withColumn("method", F.lit("pca")).unionByName(chosen)
    return cc.clustering_scores(both, s.obs(spark, d), "method", 10)


@query("c08_query_clusters")
def query_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Two modalities side by side, each embedded and scaled by section, clustered by section."""
    parts = [e.group_scaled(e.group_components(_modalities(spark, d).where(F.col("modality") == name), "section", 8), "section", "pca").select("section", "obs_id", F.col("pca").alias("vector")) for name in ("Gene", "Image")]
    joined = e.join_modalities(parts, strict=True)
    sections = {x.section: 6 for x in joined.select("section").distinct().collect()}  # a row a section
    return e.group_k_means(joined, "section", sections).withColumnRenamed("key", "section")


@query("c05_graph_clusters")
def graph_clusters(spark: SparkSession, d: str) -> DataFrame:
    """The graph of each section's observations, clustered at once."""
    v = e.group_components(s.vectors(spark, d), "section", 10)
    return gc.graph_clusters(v, "section", 0.5, 10, "pca").withColumnRenamed("key", "section")


_NEAR = """pr AS (
  SELECT a.section, a.obs_id AS a, b.obs_id AS b, round(sqrt(list_sum(list_transform(a.v, lambda x, i: (x - b.v[i]) ** 2))), 9) AS d
  FROM vc a JOIN vc b ON a.section = b.section),
rk AS (SELECT *, row_number() OVER (PARTITION BY section, a ORDER BY d, b) AS place FROM pr),
nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY section, a ORDER BY d, b) AS no FROM rk WHERE place <= 10 AND a != b) WHERE no <= 9)"""


@query("c05_neighbour_graph", f"""WITH {_OBS}, vc AS (SELECT 's' || (vec_id % 4) AS section, vec_id AS obs_id, embedding::DOUBLE[] AS v FROM embeddings), {_NEAR},
e AS (SELECT section, least(a, b) AS a, greatest(a, b) AS b, count(*) AS n_given, max(d) AS d FROM nb GROUP BY ALL)
SELECT section, a, b, n_given, round(max(d), 6) AS distance FROM e GROUP BY ALL""")
def neighbour_graph(spark: SparkSession, d: str) -> DataFrame:
    """Who is linked with whom, and how many of the two chose the other."""
    v = s.vectors(spark, d)
    found = materialise(n.feature_neighbours(v, v, 10, "section"))
    edges = gc.neighbour_graph(v, "section", 10, found=found).where("a < b").select("key", "a", "b")
    near = found.where("query_id != ref_id").withColumn("no", F.row_number().over(Window.partitionBy("key", "query_id").orderBy("place"))).where("no <= 9")
    given = near.groupBy("key", F.least("query_id", "ref_id").alias("a"), F.greatest("query_id", "ref_id").alias("b")).agg(F.count(F.lit(1)).alias("n_given"), F.max("distance").alias("distance"))
    return edges.join(given, ["key", "a", "b"], "left").select(F.col("key").alias("section"), "a", "b", "n_given", _r("distance"))


@query("c12_gene_subtypes")
def gene_subtypes(spark: SparkSession, d: str) -> DataFrame:
    features = selected(spark, d).where("parent = 'root'").groupBy("direction", "feature").agg(F.min("place").alias("place"))
    clusters = s.vectors(spark, d).select("section", "obs_id", largest_axis("vector", 4).alias("cluster"))
    return pp.gene_subtypes(_expr(spark, d), clusters, features, n_first=8, least=50)


@query("c13_postprocess")
def postprocess(spark: SparkSession, d: str) -> DataFrame:
    clusters = s.vectors(spark, d).select("section", "obs_id", "x", "y", largest_axis("vector", 5).alias("cluster"))
    rgb = s.raw_expr(spark, d).where("feature in ('f0', 'f1', 'f2')").select("section", "obs_id", "feature", "value")
    features = selected(spark, d).where("parent = 'root'").groupBy("direction", "feature").agg(F.min("place").alias("place"))
    return pp.postprocess(_expr(spark, d), clusters, rgb, features, {"k": 9, "smooth_k": 6}, {"n_first": 8})


# --- transfer ------------------------------------------------------------------------------------------------


def _built(spark: SparkSession, d: str) -> list[t.Split]:
    table = r.tree_table(spark, r.integrate_sections(_combined(spark, d), s.obs(spark, d)))  # checked to be small
    rows = table.orderBy("level", "parent").collect()
    regions = {x.parent: x.regions.split(";") for x in rows}
    return [(x.parent, x.child_1, x.child_2, regions.get(x.child_1, [x.child_1]), regions.get(x.child_2, [x.child_2])) for x in rows]


def _fixed_tree(spark: SparkSession) -> list[t.Split]:
    return [(x.parent, x.child_1, x.child_2, x.child_1_regions, x.child_2_regions) for x in splits(spark).collect()]  # four splits


_SETTINGS = t.TransferSettings(least_cluster=5, least_percent=5.0, seeds=10)


@query("l14_label_transfer")
def label_transfer(spark: SparkSession, d: str) -> DataFrame:
    v = s.vectors(spark, d)
    done = t.transfer_single(v.where("section = 's0'"), v.where("section = 's3'"), _built(spark, d), _SETTINGS).run_auto()
    return done.labels()


@query("l15_multi_reference")
def multi_reference(spark: SparkSession, d: str) -> DataFrame:
    v = s.vectors(spark, d)
    return t.transfer_multi(v.where("section != 's3'"), v.where("section = 's3'"), _fixed_tree(spark), _SETTINGS).run_auto().summary()


@query("l13_node_features", f"""WITH {_NEAREST}, {_OBS},
mb AS (SELECT parent AS node, obs.section, obs_id FROM obs JOIN sides USING (label) WHERE obs.section = 's3')
SELECT mb.node, mb.section, mb.obs_id, round(sum(value), 5) AS total, round(max(value) FILTER (WHERE nf.place = 1), 6) AS first, count(*) AS width
FROM mb JOIN nf ON nf.parent = mb.node JOIN expr ON expr.section = mb.section AND expr.obs_id = mb.obs_id AND expr.feature = nf.feature GROUP BY ALL""")
def node_features(spark: SparkSession, d: str) -> DataFrame:
    """Each observation below a split in the split's own features."""
    sides = hf.split_sides(splits(spark))
    lists = hf.nearest_feature_lists(selected(spark, d), sides, 2)
    members = s.obs(spark, d).where("section = 's3'").join(F.broadcast(sides.select(F.col("parent").alias("node"), "label")), "label").select("node", "section", "obs_id")
    rows = t.node_vectors(members, _expr(spark, d), lists)
    total = F.aggregate("vector", F.lit(0.0), lambda x, v: x + v)
    return rows.select("node", "section", "obs_id", F.round(total, 5).alias("total"), F.round(F.get("vector", F.lit(0)), 6).alias("first"), F.size("vector").cast("long").alias("width"))


@query("l15_guided_rounds")
def guided_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Rounds in the nodes' own features, with a guide, novel clusters reassigned."""
    sides = hf.split_sides(splits(spark))
    lists = materialise(hf.nearest_feature_lists(selected(spark, d), sides))
    o = s.obs(spark, d)
    references, query_ = o.where("section != 's3'"), o.where("section = 's3'")
    guide = hf.guide_references(references.select("section").distinct(), splits(spark), spark.createDataFrame([("root", ["s0", "s1"])], "parent string, sections array<string>"))
    settings = replace(_SETTINGS, reassign=True)
    return t.transfer_multi(references, query_, _fixed_tree(spark), settings, _expr(spark, d), lists, guide).run_auto().labels()


@query("l16_quantile_session")
def quantile_session(spark: SparkSession, d: str) -> DataFrame:
    v = s.vectors(spark, d)
    lists = hf.quantile_feature_lists(selected(spark, d))
    return t.transfer_quantile(v.where("section != 's3'"), v.where("section = 's3'"), _expr(spark, d), lists, _fixed_tree(spark), _SETTINGS).run_auto().labels()


# --- subtypes ------------------------------------------------------------------------------------------------


def _all_genes(spark: SparkSession, d: str) -> DataFrame:
    markers = _markers(spark, d)
    return m.marker_union(markers, f.shared_features(markers))


def _genes(spark: SparkSession, d: str) -> DataFrame:
    """Those of some regions, so that others have none."""
    return _all_genes(spark, d).where("label in ('r0', 'r1', 'r2', 'r3')")


@query("x02_section_subtypes")
def section_subtypes(spark: SparkSession, d: str) -> DataFrame:
    from loomspark.operators.heterogeneity import region_vectors

    return st.section_subtypes(region_vectors(_expr(spark, d), _all_genes(spark, d)), 2, 5)


@query("x03_shared_subtypes")
def shared_subtypes(spark: SparkSession, d: str) -> DataFrame:
    return st.shared_subtypes(_expr(spark, d), _all_genes(spark, d), 4)


@query("x04_agreed_markers", f"WITH {_EXPR}, sb AS (SELECT 's' || (vec_id % 4) AS section, vec_id AS obs_id, 'r' || label AS region, CASE WHEN embedding[1] > 0 THEN '1' ELSE '0' END AS subtype FROM embeddings), kx AS (SELECT expr.section, region, subtype, feature, value FROM expr JOIN sb USING (section, obs_id)), sh AS (SELECT section, region, subtype FROM kx GROUP BY ALL HAVING count(*) > 0), nc AS (SELECT section, region FROM sh GROUP BY ALL HAVING count(*) > 1), i AS (SELECT section, region, subtype, feature, count(*) AS n_in, sum(value) AS s_in, sum((value > 0)::INT) AS d_in FROM kx GROUP BY ALL), o AS (SELECT *, sum(n_in) OVER w - n_in AS n_out, sum(s_in) OVER w - s_in AS s_out, sum(d_in) OVER w - d_in AS d_out FROM i WINDOW w AS (PARTITION BY section, region, feature)), st AS (SELECT section, region, subtype, feature, d_in / n_in AS fi, exp(s_in / n_in - s_out / n_out) AS fc, CASE WHEN d_out > 0 THEN (d_in / n_in) / (d_out / n_out) WHEN d_in > 0 THEN 'inf'::DOUBLE END AS ratio FROM o WHERE n_out > 0), mk AS (SELECT section, region, subtype, feature FROM st SEMI JOIN nc USING (section, region) WHERE ratio >= 0.9 AND fi >= 0.5 AND fc >= 1.0 QUALIFY row_number() OVER (PARTITION BY section, region, subtype ORDER BY fc DESC, feature) <= 20), c AS (SELECT region, subtype, feature, count(DISTINCT section) AS n_sections FROM mk GROUP BY ALL) SELECT region AS label, subtype, feature, n_sections FROM (SELECT *, max(n_sections) OVER (PARTITION BY region, subtype) AS most FROM c) WHERE n_sections >= least(most, 2)")
def agreed_markers(spark: SparkSession, d: str) -> DataFrame:
    given = s.vectors(spark, d).select("label", "section", "obs_id", (F.get("vector", 0) > 0).cast("int").alias("cluster"))
    return st.shared_markers(_expr(spark, d), given, 2, **_LOOSE)[1]


@query("x05_region_status", f"WITH {_OBS}, {_MARKED}, n AS (SELECT label, section, count(*) AS n FROM obs GROUP BY ALL), sc AS (SELECT label, sum((n >= 14)::INT)::BIGINT AS n_sections FROM n GROUP BY label), cm AS (SELECT feature FROM mk GROUP BY feature HAVING count(DISTINCT section) = (SELECT count(DISTINCT section) FROM mk)), ge AS (SELECT label, count(DISTINCT feature) AS n_genes FROM mk WHERE feature IN (SELECT feature FROM cm) AND label IN ('r0', 'r1', 'r2', 'r3') GROUP BY label) SELECT label, n_sections, coalesce(n_genes, 0) AS n_genes, CASE WHEN n_sections < 2 THEN 'fewer than two sections' WHEN coalesce(n_genes, 0) = 0 THEN 'no genes' ELSE 'success' END AS status FROM sc LEFT JOIN ge USING (label)")
def region_status(spark: SparkSession, d: str) -> DataFrame:
    return st.region_status(s.obs(spark, d), _genes(spark, d), 14)


@query("x06_pipeline")
def heterogeneity_pipeline(spark: SparkSession, d: str) -> DataFrame:
    found = st.heterogeneity_pipeline(_expr(spark, d), s.obs(spark, d), 200, None, 2, 4, 10, **_LOOSE)
    return found["merged_markers"]


@query("w10_cluster_numbers")
def cluster_numbers(spark: SparkSession, d: str) -> DataFrame:
    return st.best_cluster_numbers(e.group_components(s.vectors(spark, d), "section", 5), "section", 2, 5, "pca")
