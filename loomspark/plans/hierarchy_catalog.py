"""Registered queries of the tree and of the features that tell its branches apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import features as f
from loomspark.operators import hierarchy_features as hf
from loomspark.operators import markers as m
from loomspark.operators import regions as r
from loomspark.plans.catalog import _EXPR, _MARKED, _OBS, _P, _RAW, _SPATIAL, _expr, _markers, _r, query
from loomspark.sources import tables as s

#: A tree over the ten regions: fixed values.
TREE = [
    ("root", "low", "high", ["r0", "r1", "r2", "r3", "r4"], ["r5", "r6", "r7", "r8", "r9"]),
    ("low", "low_a", "low_b", ["r0", "r1"], ["r2", "r3", "r4"]),
    ("high", "high_a", "high_b", ["r5", "r6", "r7"], ["r8", "r9"]),
    ("low_a", "r0", "r1", ["r0"], ["r1"]),
]


def splits(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(p).alias("parent"), F.lit(a).alias("child_1"), F.lit(b).alias("child_2"), F.array(*map(F.lit, x)).alias("child_1_regions"), F.array(*map(F.lit, y)).alias("child_2_regions")) for p, a, b, x, y in TREE]
    return spark.range(1).select(F.inline(F.array(*rows)))


_SIDES_VALUES = ", ".join(f"('{p}', '{c}', '{o}', '{c}_vs_{o}', {n}, '{label}')" for p, a, b, x, y in TREE for c, o, n, labels in ((a, b, 0, x), (b, a, 1, y)) for label in labels)
_SIDES = f"sides(parent, child, other, direction, ord, label) AS (VALUES {_SIDES_VALUES})"
_BOUNDS = {"most_p": 0.9, "least_ratio": 0.9, "least_change": 1.01, "n": 8}

_SPLIT_TESTS = f"""{_EXPR}, {_SIDES}, kx AS (SELECT section, parent, direction AS label, feature, value FROM expr JOIN sides USING (label)),
i AS (SELECT section, parent, label, feature, count(*) AS n_in, sum(value) AS s_in, sum((value > 0)::INT) AS d_in FROM kx GROUP BY ALL),
o AS (SELECT *, sum(n_in) OVER w - n_in AS n_out, sum(s_in) OVER w - s_in AS s_out, sum(d_in) OVER w - d_in AS d_out FROM i WINDOW w AS (PARTITION BY section, parent, feature)),
st AS (SELECT section, parent, label, feature, d_in / n_in AS fraction_in, exp(s_in / n_in - s_out / n_out) AS fold_change, CASE WHEN d_out > 0 THEN (d_in / n_in) / (d_out / n_out) WHEN d_in > 0 THEN 'inf'::DOUBLE END AS ratio FROM o WHERE n_out > 0),
k AS (SELECT *, rank() OVER (PARTITION BY section, parent, feature ORDER BY value) + (count(*) OVER (PARTITION BY section, parent, feature, value) - 1) / 2 AS rk FROM kx),
ri AS (SELECT section, parent, label, feature, count(*) AS n_in, sum(rk)::DOUBLE AS rank_sum FROM k GROUP BY ALL),
ro AS (SELECT *, (sum(n_in) OVER (PARTITION BY section, parent, feature) - n_in)::BIGINT AS n_out FROM ri),
zz AS (SELECT *, (rank_sum - n_in * (n_in + n_out + 1) / 2) / sqrt(n_in * n_out * (n_in + n_out + 1) / 12) AS z FROM ro WHERE n_out > 0),
tt AS (SELECT section, parent, label, feature, z, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) AS t FROM zz), pp AS (SELECT section, parent, label, feature, {_P} AS p FROM tt),
sc AS (SELECT *, p * count(*) OVER (PARTITION BY section, parent, label) / count(*) OVER (PARTITION BY section, parent, label ORDER BY p) AS sc FROM pp),
pa AS (SELECT section, parent, label, feature, least(1, min(sc) OVER (PARTITION BY section, parent, label ORDER BY p DESC RANGE UNBOUNDED PRECEDING)) AS p_adj FROM sc),
sel AS (SELECT section, parent, label AS direction, feature, fold_change, p_adj, row_number() OVER (PARTITION BY section, parent, label ORDER BY fold_change DESC, feature) AS place FROM st JOIN pa USING (section, parent, label, feature)
        WHERE p_adj <= 0.9 AND ratio >= 0.9 AND fold_change >= 1.01 QUALIFY row_number() OVER (PARTITION BY section, parent, label ORDER BY fold_change DESC, feature) <= 8)"""


def selected(spark: SparkSession, d: str) -> DataFrame:
    return hf.split_features(_expr(spark, d), splits(spark), **_BOUNDS)


@query("f01_split_features", f"WITH {_SPLIT_TESTS} SELECT section, parent, direction, feature, place, round(fold_change, 6) AS fold_change, round(p_adj, 5) AS p_adj FROM sel")
def split_features(spark: SparkSession, d: str) -> DataFrame:
    return selected(spark, d).select("section", "parent", "direction", "feature", "place", _r("fold_change"), _r("p_adj", places=5))


@query("f02_split_sides", f"WITH {_SIDES}, {_OBS} SELECT parent, child, other, direction, ord, count(*) AS n_obs FROM sides JOIN obs USING (label) GROUP BY ALL")
def split_sides(spark: SparkSession, d: str) -> DataFrame:
    sides = hf.split_sides(splits(spark))
    return s.obs(spark, d).join(F.broadcast(sides), "label").groupBy("parent", "child", "other", "direction", "ord").agg(F.count(F.lit(1)).alias("n_obs"))


_NEAREST = f"""{_SPLIT_TESTS}, od AS (SELECT DISTINCT parent, direction, ord FROM sides),
se AS (SELECT section, parent, feature, count(*) AS n, min((ord, place)) AS fst FROM sel JOIN od USING (parent, direction) GROUP BY ALL),
so AS (SELECT section, parent, feature, row_number() OVER (PARTITION BY section, parent ORDER BY n DESC, fst, feature) AS place FROM se),
nl AS (SELECT parent, feature, count(*) AS n_lists, min((section, place)) AS fst FROM so GROUP BY ALL HAVING count(*) >= 2),
nf AS (SELECT parent, feature, n_lists, row_number() OVER (PARTITION BY parent ORDER BY n_lists DESC, fst, feature) AS place FROM nl)"""


@query("f03_nearest_feature_lists", f"WITH {_NEAREST} SELECT * FROM nf")
def nearest_feature_lists(spark: SparkSession, d: str) -> DataFrame:
    return hf.nearest_feature_lists(selected(spark, d), hf.split_sides(splits(spark)), 2)


_QUANTILE = f"""{_SPLIT_TESTS}, ql AS (SELECT parent, direction, feature, count(DISTINCT section) AS n_lists, min((section, place)) AS fst FROM sel GROUP BY ALL),
qf AS (SELECT parent, direction, feature, n_lists, row_number() OVER (PARTITION BY parent, direction ORDER BY n_lists DESC, fst, feature) AS place FROM ql),
od AS (SELECT DISTINCT parent, direction, ord FROM sides)"""


@query("f04_quantile_features", f"WITH {_QUANTILE} SELECT parent, feature, direction, row_number() OVER (PARTITION BY parent ORDER BY ord, place) AS place FROM qf JOIN od USING (parent, direction)")
def quantile_features(spark: SparkSession, d: str) -> DataFrame:
    return hf.quantile_clustering_features(hf.quantile_feature_lists(selected(spark, d)), hf.split_sides(splits(spark)))


@query("f05_modalities", f"WITH {_SPLIT_TESTS}, md AS (SELECT *, CASE WHEN contains(feature, 'f6') THEN 'Image' ELSE 'Gene' END AS modality FROM sel), l AS (SELECT section, parent, direction, modality, string_agg(feature, ';' ORDER BY place) AS features FROM md GROUP BY ALL) SELECT section, parent, direction, max(features) FILTER (WHERE modality = 'Gene') AS gene, max(features) FILTER (WHERE modality = 'Image') AS image FROM l GROUP BY ALL")
def modalities(spark: SparkSession, d: str) -> DataFrame:
    both = f.split_modality(selected(spark, d), "f6")
    view = hf.modality_view({name: both.where(F.col("modality") == name).drop("modality") for name in ("Gene", "Image")})
    wide = hf.section_view(view)
    of = lambda name: F.array_join(F.try_element_at("features", F.lit(name)), ";").alias(name.lower())
    return wide.select("section", "parent", "direction", of("Gene"), of("Image"))


@query("f06_across_sections", f"WITH {_QUANTILE} SELECT parent, direction, feature, n_lists, place FROM qf WHERE parent = 'root' AND direction = 'low_vs_high'")
def across_sections(spark: SparkSession, d: str) -> DataFrame:
    return hf.features_across_sections(selected(spark, d), "root", "low_vs_high")


@query("f07_guided_references", f"WITH {_OBS}, g(parent, section) AS (VALUES ('root', 's0'), ('root', 's2')), p(parent) AS (VALUES ('low_a'), ('high')) SELECT parent, section FROM g UNION ALL SELECT DISTINCT parent, section FROM obs, p")
def guided_references(spark: SparkSession, d: str) -> DataFrame:
    rows = F.array(F.struct(F.lit("root").alias("parent"), F.array(F.lit("s2"), F.lit("s0")).alias("sections")), F.struct(F.lit("low").alias("parent"), F.array().cast("array<string>").alias("sections")))
    return hf.guide_references(s.obs(spark, d), splits(spark), spark.range(1).select(F.inline(rows)))


@query("f08_feature_summary", f"WITH {_NEAREST}, gs AS (SELECT parent, string_agg(DISTINCT section, ';' ORDER BY section) AS sections FROM sel GROUP BY parent) SELECT parent, sections, (SELECT count(*) FROM nf WHERE nf.parent = gs.parent) AS n_clustering_features FROM gs")
def feature_summary(spark: SparkSession, d: str) -> DataFrame:
    found = hf.hierarchical_features(_expr(spark, d), splits(spark), "nearest", 2, **_BOUNDS)
    return hf.feature_summary(found["clustering"], found["selected"])


# --- merged matrices and selections ------------------------------------------------------------------------


@query("u02_first_order", f"WITH {_MARKED}, sh AS (SELECT feature FROM mk GROUP BY feature HAVING count(DISTINCT section) = (SELECT count(DISTINCT section) FROM mk)), od AS (SELECT DISTINCT feature, substr(feature, 2)::INT AS ord FROM mk) SELECT feature, row_number() OVER (ORDER BY ord DESC) AS place FROM sh JOIN od USING (feature)")
def first_order(spark: SparkSession, d: str) -> DataFrame:
    order = s.raw_expr(spark, d).select("section", "feature", (-F.substring("feature", 2, 3).cast("int")).alias("ord")).distinct()
    return f.features_in_first_order(_markers(spark, d), order)


@query("u03_concat_sections", f"WITH {_RAW} SELECT section AS sample, obs_id || '-' || section AS obs_name, feature, value FROM raw")
def concat_sections(spark: SparkSession, d: str) -> DataFrame:
    return f.concat_sections(s.raw_expr(spark, d))


@query("u04_merged_matrix", f"WITH {_MARKED}, z AS (SELECT section, obs_id, feature, value, min(value) OVER w AS lo, max(value) OVER w AS hi FROM raw WINDOW w AS (PARTITION BY section, feature)), sc AS (SELECT section, obs_id, feature, CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0 END AS value FROM z) SELECT section AS sample, obs_id || '-' || section AS obs_name, feature, round(value, 6) AS value FROM sc WHERE feature IN (SELECT feature FROM mk WHERE label = 'r1')")
def merged_matrix(spark: SparkSession, d: str) -> DataFrame:
    wanted = _markers(spark, d).where("label = 'r1'")
    return f.merged_matrix(s.raw_expr(spark, d), wanted).select("sample", "obs_name", "feature", _r("value"))


@query("a27_marker_union", f"WITH {_MARKED}, cm AS (SELECT feature FROM mk GROUP BY feature HAVING count(DISTINCT section) = (SELECT count(DISTINCT section) FROM mk)) SELECT label, feature, row_number() OVER (PARTITION BY label ORDER BY feature) AS place FROM (SELECT DISTINCT label, feature FROM mk WHERE feature IN (SELECT feature FROM cm))")
def marker_union(spark: SparkSession, d: str) -> DataFrame:
    markers = _markers(spark, d)
    return m.marker_union(markers, f.shared_features(markers))


@query("n07_molecular_chain", "WITH counts AS (SELECT c_mktsegment AS section, l_orderkey AS obs_id, p_brand AS feature, sum(l_quantity)::DOUBLE AS value FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL) SELECT section, obs_id, upper(feature) AS feature, round(ln(1 + value * 10000 / sum(value) OVER (PARTITION BY section, obs_id)), 6) AS value FROM counts")
def molecular_chain(spark: SparkSession, d: str) -> DataFrame:
    return f.molecular_chain(s.counts(spark, d)).select("section", "obs_id", "feature", _r("value"))


@query("n08_filter_and_scale", f"WITH {_RAW}, k AS (SELECT section, feature FROM raw GROUP BY ALL HAVING avg((value > 0)::INT) >= 0.5), z AS (SELECT section, obs_id, feature, value, min(value) OVER w AS lo, max(value) OVER w AS hi FROM raw JOIN k USING (section, feature) WINDOW w AS (PARTITION BY section, feature)) SELECT section, obs_id, feature, round(CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0 END, 6) AS value FROM z")
def filter_and_scale(spark: SparkSession, d: str) -> DataFrame:
    return f.filter_and_scale(s.raw_expr(spark, d), s.obs(spark, d), 0.5).select("section", "obs_id", "feature", _r("value"))


@query("j03_tree_input", f"WITH {_EXPR}, im AS (SELECT section, obs_id, feature, value FROM raw WHERE contains(feature, 'f6') AND section != 's3'), sh AS (SELECT section, obs_id, 'image_' || feature AS feature, value - min(value) OVER (PARTITION BY section, feature) AS value FROM im), lb AS (SELECT DISTINCT section, obs_id, label FROM raw) SELECT section, obs_id, label, feature, round(value, 6) AS value, 'Gene' AS modality FROM expr WHERE section != 's3' AND NOT contains(feature, 'f6') UNION ALL SELECT section, obs_id, label, feature, round(value, 6), 'Image' FROM sh JOIN lb USING (section, obs_id)")
def tree_input(spark: SparkSession, d: str) -> DataFrame:
    gene = _expr(spark, d).where("not contains(feature, 'f6')")
    image = s.raw_expr(spark, d).where("contains(feature, 'f6') and section != 's3'").withColumn("feature", F.concat(F.lit("image_"), "feature"))
    return f.tree_input(gene, image).select("section", "obs_id", "label", "feature", _r("value"), "modality")


@query("p12_restrict_selections", f"WITH {_SPLIT_TESTS}, al AS (SELECT DISTINCT feature FROM sel WHERE parent = 'root'), ky AS (SELECT DISTINCT parent, direction FROM sel), ins AS (SELECT DISTINCT parent, direction, feature FROM sel WHERE feature IN (SELECT feature FROM al)) SELECT parent, direction, feature, CASE WHEN feature IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY parent, direction) END AS n_features FROM ky LEFT JOIN ins USING (parent, direction)")
def restrict_selections(spark: SparkSession, d: str) -> DataFrame:
    found = selected(spark, d)
    return f.restrict_selections(found.select("parent", "direction", "feature").distinct(), found.where("parent = 'root'"), "parent", "direction")


@query("p13_outside_image", f"WITH {_OBS} SELECT section, 0::BIGINT AS n_not_finite, sum((NOT (x < 20 AND y < 15))::INT)::BIGINT AS n_outside, sum((NOT (x < 20 AND y < 15) AND y < 20 AND x < 15)::INT)::BIGINT AS n_swapped, count(*) AS n_obs FROM obs GROUP BY section")
def outside_image(spark: SparkSession, d: str) -> DataFrame:
    return f.outside_image(s.obs(spark, d), 20, 15)


@query("p11_drop_by_prefix", "SELECT o_orderkey AS orderkey, o_custkey AS custkey FROM orders")
def drop_by_prefix(spark: SparkSession, d: str) -> DataFrame:
    orders = s.read(spark, d, "orders").select(F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("custkey"), F.col("o_orderstatus").alias("kmeans_1"), F.col("o_orderdate").alias("kmeans_2"))
    return f.drop_columns_by_prefix(orders, "kmeans_")


@query("s06_align_features", f"WITH {_RAW}, {_OBS} SELECT raw.section, raw.obs_id, feature, round(value, 6) AS value, x, y FROM raw JOIN obs USING (section, obs_id) WHERE obs.section IN ('s1', 's2')")
def align_features(spark: SparkSession, d: str) -> DataFrame:
    stored = s.raw_expr(spark, d).drop("label").withColumn("kmeans_10", F.lit(0))
    return s.align_features(stored, s.obs(spark, d).where("section in ('s1', 's2')")).select("section", "obs_id", "feature", _r("value"), "x", "y")


@query("p16_active_observations", f"WITH {_RAW}, {_SIDES} SELECT section, obs_id, feature, round(value, 6) AS value FROM raw WHERE label IN (SELECT label FROM sides WHERE child = 'low_b')")
def active_observations(spark: SparkSession, d: str) -> DataFrame:
    inside = hf.split_sides(splits(spark)).where("child = 'low_b'").select("label")
    members = s.obs(spark, d).join(F.broadcast(inside), "label", "left_semi")
    return s.active_observations(s.raw_expr(spark, d), members).select("section", "obs_id", "feature", _r("value"))


_CHOSEN = {"gene": {"least_ratio": 0.9, "least_change": 1.02, "least_fraction": 0.0, "n": 10}, "image": {"least_ratio": 0.9, "least_change": 1.02, "least_fraction": 0.0, "n": 5}}
_TREE_MARKS = f"{_EXPR}, px AS (SELECT *, CASE WHEN contains(feature, 'f6') THEN 'image' ELSE 'gene' END AS modality FROM expr), gi AS (SELECT section, modality, label, feature, count(*) AS n_in, sum(value) AS s_in, sum((value > 0)::INT) AS d_in FROM px GROUP BY ALL), go AS (SELECT *, sum(n_in) OVER w - n_in AS n_out, sum(s_in) OVER w - s_in AS s_out, sum(d_in) OVER w - d_in AS d_out FROM gi WINDOW w AS (PARTITION BY section, feature)), gs AS (SELECT section, modality, label, feature, exp(s_in / n_in - s_out / n_out) AS fc, CASE WHEN d_out > 0 THEN (d_in / n_in) / (d_out / n_out) WHEN d_in > 0 THEN 'inf'::DOUBLE END AS ratio FROM go WHERE n_out > 0), gm AS (SELECT section, modality, label, feature FROM gs WHERE ratio >= 0.9 AND fc >= 1.02 QUALIFY row_number() OVER (PARTITION BY section, modality, label ORDER BY fc DESC, feature) <= CASE modality WHEN 'gene' THEN 10 ELSE 5 END), tf AS (SELECT DISTINCT section, modality, feature FROM gm)"


def _tree_features(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    both = f.split_modality(_expr(spark, d), "f6").withColumn("modality", F.lower("modality"))
    marks = {name: m.select_markers(m.group_statistics(both.where(F.col("modality") == name)), None, **bounds) for name, bounds in _CHOSEN.items()}  # type: ignore[arg-type]
    return both, r.tree_features(marks)


@query("h11_tree_features", f"WITH {_TREE_MARKS} SELECT * FROM tf")
def tree_features(spark: SparkSession, d: str) -> DataFrame:
    return _tree_features(spark, d)[1]


_SPATIAL_PART = _SPATIAL.replace("pr AS", "spr AS").replace("FROM pr ", "FROM spr ")


@query("h12_tree_ranks", f"WITH {_TREE_MARKS}, {_SPATIAL_PART}, ce AS (SELECT section, modality, label, feature, avg(value) AS v FROM px JOIN tf USING (section, modality, feature) GROUP BY ALL), rw AS (SELECT a.section, a.modality, a.label AS region_i, b.label AS region_j, sqrt(sum((a.v - b.v) ** 2)) AS raw FROM ce a JOIN ce b ON a.section = b.section AND a.modality = b.modality AND a.feature = b.feature AND a.label < b.label GROUP BY ALL), fd AS (SELECT *, CASE WHEN max(raw) OVER w > min(raw) OVER w THEN (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) ELSE 0 END AS distance FROM rw WINDOW w AS (PARTITION BY section, modality)), al AS (SELECT section, region_i, region_j, distance * CASE modality WHEN 'gene' THEN 1.0 ELSE 0.5 END AS wd FROM fd UNION ALL SELECT section, region_i, region_j, distance FROM sd), cb AS (SELECT section, region_i, region_j, sum(wd) AS distance FROM al GROUP BY ALL), sz AS (SELECT section, count(*) AS n FROM obs GROUP BY section), mn AS (SELECT region_i, region_j, sum(n * distance) / sum(n) AS distance FROM cb JOIN sz USING (section) GROUP BY ALL), rd AS (SELECT *, round(distance, 9) AS nr FROM mn) SELECT region_i, region_j, round(distance, 6) AS distance, rank() OVER (ORDER BY nr) + (count(*) OVER (PARTITION BY nr) - 1) / 2 AS rank FROM rd")
def tree_ranks(spark: SparkSession, d: str) -> DataFrame:
    both, wanted = _tree_features(spark, d)
    done = r.infer_tree(both, s.obs(spark, d), wanted, {"gene": 1.0, "image": 0.5, "Spatial": 1.0}, 3.0)
    return done["ranked"].select("region_i", "region_j", _r("distance"), "rank")
