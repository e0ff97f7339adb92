"""Registered queries over the given tables, each with the SQL that gives the same rows.

Sums of doubles are rounded on both sides, since engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.joins import if_small
from loomspark.operators import assignment as a
from loomspark.operators import config_choice as cc
from loomspark.operators import embedding as e
from loomspark.operators import enhancement as en
from loomspark.operators import feature_index as fi
from loomspark.operators import features as f
from loomspark.operators import heterogeneity as h
from loomspark.operators import markers as m
from loomspark.operators import neighbours as n
from loomspark.operators import raster as g
from loomspark.operators import regions as r
from loomspark.operators import subtypes as st
from loomspark.sources import tables as s

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_OBS = "obs AS (SELECT 's' || (vec_id % 4) AS section, vec_id AS obs_id, 'r' || label AS label, (vec_id % 25)::DOUBLE AS x, floor(vec_id / 25)::DOUBLE AS y FROM embeddings)"
_RAW = "raw AS (SELECT 's' || (vec_id % 4) AS section, vec_id AS obs_id, 'r' || label AS label, 'f' || (i - 1) AS feature, embedding[i]::DOUBLE AS value FROM embeddings, unnest(generate_series(1, 64)) AS u(i))"
_EXPR = _RAW + ", expr AS (SELECT section, obs_id, label, feature, value - min(value) OVER (PARTITION BY section, feature) AS value FROM raw)"
_COUNTS = "counts AS (SELECT c_mktsegment AS section, l_orderkey AS obs_id, o_orderpriority AS label, p_brand AS feature, sum(l_quantity)::DOUBLE AS value FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return register


def _r(column: str | Column, name: str | None = None, places: int = 6) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, places).alias(name or str(column))


def _expr(spark: SparkSession, d: str) -> DataFrame:
    return f.shift_to_zero(s.raw_expr(spark, d))


# --- selection -------------------------------------------------------------------------------------------


@query("s01_section_scan", f"WITH {_OBS} SELECT section, obs_id, label, x, y FROM obs")
def section_scan(spark: SparkSession, d: str) -> DataFrame:
    return s.obs(spark, d)


@query("s02_reference_scan", f"WITH {_EXPR}, k AS (SELECT feature FROM expr GROUP BY feature, section HAVING avg((value > 0.5)::INT) >= 0.05), ok AS (SELECT feature FROM k GROUP BY feature HAVING count(*) = 4), z AS (SELECT section, obs_id, feature, value, min(value) OVER w AS lo, max(value) OVER w AS hi FROM expr WHERE feature IN (SELECT feature FROM ok) WINDOW w AS (PARTITION BY section, feature)) SELECT section, feature, count(*) AS n_obs, round(avg(CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0 END), 6) AS mean FROM z GROUP BY section, feature")
def reference_scan(spark: SparkSession, d: str) -> DataFrame:
    expr = _expr(spark, d)
    ok = f.shared_features(f.detected_features(expr.withColumn("value", F.when(F.col("value") > 0.5, F.col("value")).otherwise(0.0)), s.obs(spark, d)))
    return f.scale_min_max(expr.join(if_small(ok.select("feature")), "feature", "left_semi")).groupBy("section", "feature").agg(F.count(F.lit(1)).alias("n_obs"), _r(F.avg("value"), "mean"))


@query("p01_project_features", f"WITH {_RAW} SELECT section, obs_id, feature, value, ord FROM raw JOIN (VALUES ('f5', 0), ('f1', 1), ('f63', 3)) AS w(feature, ord) USING (feature)")
def project_features(spark: SparkSession, d: str) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(x).alias("feature"), F.lit(i).alias("ord")) for i, x in enumerate(["f5", "f1", "f5", "f63", "none"])])
    return f.project_features(s.raw_expr(spark, d), spark.range(1).select(F.inline(rows))).select("section", "obs_id", "feature", "value", "ord")


@query("p02_single_feature", f"WITH {_RAW} SELECT section, obs_id, value FROM raw WHERE feature = 'f7'")
def single_feature(spark: SparkSession, d: str) -> DataFrame:
    return s.raw_expr(spark, d).where(F.col("feature") == "f7").select("section", "obs_id", "value")


@query("p03_exclude_labels", f"WITH {_OBS} SELECT section, obs_id, label FROM obs WHERE label NOT IN ('r1', 'R2') AND NOT contains(lower(label), 'r3')")
def exclude_labels(spark: SparkSession, d: str) -> DataFrame:
    return f.exclude_labels(f.exclude_labels(s.obs(spark, d), ["r1", "R2"]), ["R3"], "contains").select("section", "obs_id", "label")


@query("p04_valid_regions", f"WITH {_OBS}, c AS (SELECT section, label, count(*) AS n_obs FROM obs GROUP BY ALL), q AS (SELECT *, n_obs / sum(n_obs) OVER (PARTITION BY section) AS share FROM c) SELECT section, label, n_obs, round(share, 6) AS share FROM q WHERE share > 0.1")
def valid_regions(spark: SparkSession, d: str) -> DataFrame:
    return f.valid_regions(s.obs(spark, d), 0.1).select("section", "label", "n_obs", _r("share"))


@query("p05_detected_features", f"WITH {_COUNTS}, n AS (SELECT section, count(DISTINCT obs_id) AS n_obs FROM counts GROUP BY section), q AS (SELECT section, feature, sum((value > 0)::INT)::BIGINT AS n_found FROM counts GROUP BY ALL) SELECT section, feature, n_found, n_obs, round(n_found / n_obs, 6) AS fraction FROM q JOIN n USING (section) WHERE n_found / n_obs >= 0.15")
def detected_features(spark: SparkSession, d: str) -> DataFrame:
    counts = s.counts(spark, d)
    return f.detected_features(counts, counts, 0.15).select("section", "feature", "n_found", "n_obs", _r("fraction"))


@query("p07_sections_with_region", f"WITH {_OBS} SELECT section, obs_id, label, x, y FROM obs WHERE label = 'r1' AND section IN (SELECT section FROM obs WHERE label = 'r1' GROUP BY section HAVING count(*) >= 10)")
def sections_with_region(spark: SparkSession, d: str) -> DataFrame:
    return f.sections_with_region(s.obs(spark, d), "r1", 10)


@query("p09_regions_by_count", f"WITH {_OBS}, c AS (SELECT section, label, count(*) AS n_obs FROM obs WHERE NOT contains(lower(label), 'r9') GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY section ORDER BY n_obs DESC, label) AS ord FROM c")
def regions_by_count(spark: SparkSession, d: str) -> DataFrame:
    return f.regions_by_count(s.obs(spark, d), "R9")


@query("p10_split_modality", f"WITH {_RAW} SELECT CASE WHEN contains(lower(feature), 'f6') THEN 'Image' ELSE 'Gene' END AS modality, count(DISTINCT feature) AS n_features, count(*) AS n_rows FROM raw GROUP BY ALL")
def split_modality(spark: SparkSession, d: str) -> DataFrame:
    return f.split_modality(s.raw_expr(spark, d), "F6").groupBy("modality").agg(F.countDistinct("feature").alias("n_features"), F.count(F.lit(1)).alias("n_rows"))


@query("p15_common_observations", f"WITH {_RAW}, hi AS (SELECT DISTINCT section, obs_id FROM raw WHERE feature IN ('f0', 'f1') AND value > 0.2), lo AS (SELECT DISTINCT section, obs_id FROM raw WHERE feature IN ('f2', 'f3') AND value < -0.2) SELECT section, obs_id FROM hi SEMI JOIN lo USING (section, obs_id)")
def common_observations(spark: SparkSession, d: str) -> DataFrame:
    raw = s.raw_expr(spark, d)
    key = ["section", "obs_id"]
    high = raw.where("feature in ('f0', 'f1') and value > 0.2").select(*key).distinct()
    return high.join(raw.where("feature in ('f2', 'f3') and value < -0.2").select(*key).distinct(), key, "left_semi")


# --- scaling ---------------------------------------------------------------------------------------------


@query("n01_min_max", f"WITH {_RAW}, q AS (SELECT section, obs_id, feature, value, min(value) OVER w AS lo, max(value) OVER w AS hi FROM raw WINDOW w AS (PARTITION BY section, feature)) SELECT section, obs_id, feature, round(CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0 END, 6) AS value FROM q")
def min_max(spark: SparkSession, d: str) -> DataFrame:
    return f.scale_min_max(s.raw_expr(spark, d)).select("section", "obs_id", "feature", _r("value"))


@query("n02_normalise_counts", f"WITH {_COUNTS} SELECT section, obs_id, feature, round(ln(1 + value * 10000 / sum(value) OVER (PARTITION BY section, obs_id)), 6) AS value FROM counts")
def normalise_counts(spark: SparkSession, d: str) -> DataFrame:
    return f.normalise_counts(s.counts(spark, d)).select("section", "obs_id", "feature", _r("value"))


@query("n03_replace_zeros")
def replace_zeros(spark: SparkSession, d: str) -> DataFrame:
    return f.replace_zeros(_expr(spark, d)).groupBy("section", "feature").agg(F.min("value").alias("least"), F.count(F.lit(1)).alias("n"))


@query("n04_shift_to_zero", f"WITH {_EXPR} SELECT section, obs_id, feature, value FROM expr")
def shift_to_zero(spark: SparkSession, d: str) -> DataFrame:
    return _expr(spark, d).select("section", "obs_id", "feature", "value")


@query("n05_standardise", f"WITH {_RAW}, q AS (SELECT section, obs_id, feature, value, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd FROM raw WINDOW w AS (PARTITION BY section, feature)) SELECT section, obs_id, feature, round((value - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 6) AS value FROM q")
def standardise(spark: SparkSession, d: str) -> DataFrame:
    return f.standardise(s.raw_expr(spark, d)).select("section", "obs_id", "feature", _r("value"))


@query("n06_unique_names", "WITH q AS (SELECT c_mktsegment AS section, c_custkey AS ord, upper(substr(c_name, 1, 10)) AS base FROM customer), k AS (SELECT section, ord, base, row_number() OVER (PARTITION BY section, base ORDER BY ord) - 1 AS i FROM q) SELECT section, ord, CASE WHEN i > 0 THEN base || '-' || i ELSE base END AS name FROM k")
def unique_names(spark: SparkSession, d: str) -> DataFrame:
    named = s.read(spark, d, "customer").select(F.col("c_mktsegment").alias("section"), F.col("c_custkey").alias("ord"), F.substring("c_name", 1, 10).alias("feature"))
    return f.unique_names(named).select("section", "ord", "name")


@query("n09_transform_coordinates", f"WITH {_OBS}, w AS (SELECT section, obs_id, u.* FROM obs, LATERAL (VALUES ('xy', x, y), ('xy_fy', x, 19 - y), ('xy_fx', 24 - x, y), ('xy_fx_fy', 24 - x, 19 - y), ('yx', y, x), ('yx_fy', y, 19 - x), ('yx_fx', 24 - y, x), ('yx_fx_fy', 24 - y, 19 - x)) AS u(way, px, py)) SELECT *, px BETWEEN 0 AND 24 AND py BETWEEN 0 AND 19 AS inside FROM w")
def transform_coordinates(spark: SparkSession, d: str) -> DataFrame:
    return f.transform_coordinates(s.obs(spark, d), 25, 20)


_SIGNATURE = f"{_RAW}, w AS (SELECT section, obs_id, value, var_pop(value) OVER (PARTITION BY section, feature) AS w FROM raw), sig AS (SELECT section, obs_id, sum(value * w) / sum(w) AS signature FROM w GROUP BY ALL)"


@query("n10_signature", f"WITH {_SIGNATURE} SELECT section, obs_id, round(signature, 6) AS signature FROM sig")
def signature(spark: SparkSession, d: str) -> DataFrame:
    return f.signature(s.vectors(spark, d)).select("section", "obs_id", _r("signature"))


@query("n11_histology_depth", f"WITH {_SIGNATURE}, {_OBS}, q AS (SELECT section, obs_id, signature, avg(signature) OVER w AS m, stddev_pop(signature) OVER w AS sd, greatest(stddev_pop(x) OVER w, stddev_pop(y) OVER w) AS wide FROM sig JOIN obs USING (section, obs_id) WINDOW w AS (PARTITION BY section)) SELECT section, obs_id, round((signature - m) / sd * wide, 6) AS z FROM q")
def histology_depth(spark: SparkSession, d: str) -> DataFrame:
    return f.histology_depth(f.signature(s.vectors(spark, d)).join(s.obs(spark, d), ["section", "obs_id"])).select("section", "obs_id", _r("z"))


# --- markers ---------------------------------------------------------------------------------------------

_STATS = f"""{_EXPR}, i AS (SELECT section, label, feature, count(*) AS n_in, sum(value) AS s_in, sum((value > 1)::INT) AS d_in FROM expr GROUP BY ALL),
o AS (SELECT *, sum(n_in) OVER w - n_in AS n_out, sum(s_in) OVER w - s_in AS s_out, sum(d_in) OVER w - d_in AS d_out FROM i WINDOW w AS (PARTITION BY section, feature)),
st AS (SELECT section, label, feature, s_in / n_in AS mean_in, s_out / n_out AS mean_out, d_in / n_in AS fraction_in, d_out / n_out AS fraction_out, exp(s_in / n_in - s_out / n_out) AS fold_change,
CASE WHEN d_out > 0 THEN (d_in / n_in) / (d_out / n_out) WHEN d_in > 0 THEN 'inf'::DOUBLE END AS ratio FROM o WHERE n_out > 0)"""


def _detected(spark: SparkSession, d: str) -> DataFrame:
    """The shifted matrix; a value counts as found above 1, which the statistics see as above 0."""
    return _expr(spark, d)


@query("m0_region_markers", f"WITH {_STATS.replace('value > 1', 'value > 0')}, k AS (SELECT *, row_number() OVER (PARTITION BY section, label ORDER BY fold_change DESC, feature) AS place FROM st WHERE ratio >= 0.9 AND fraction_in >= 0.5 AND fold_change >= 1.05) SELECT section, label, feature, place, round(fold_change, 6) AS fold_change, round(ratio, 6) AS ratio FROM k WHERE place <= 10")
def marker_slice(spark: SparkSession, d: str) -> DataFrame:
    stats = m.group_statistics(_expr(spark, d))
    return m.select_markers(stats, least_ratio=0.9, least_change=1.05).select("section", "label", "feature", "place", _r("fold_change"), _r("ratio"))


@query("a01_group_statistics", f"WITH {_STATS.replace('value > 1', 'value > 0')} SELECT section, label, feature, round(mean_in, 6) AS mean_in, round(mean_out, 6) AS mean_out, round(fraction_in, 6) AS fraction_in, round(fraction_out, 6) AS fraction_out, round(fold_change, 6) AS fold_change, round(ratio, 6) AS ratio FROM st")
def group_statistics(spark: SparkSession, d: str) -> DataFrame:
    return m.group_statistics(_expr(spark, d)).select("section", "label", "feature", *[_r(c) for c in ("mean_in", "mean_out", "fraction_in", "fraction_out", "fold_change", "ratio")])


_RANKS = f"""{_EXPR}, k AS (SELECT *, rank() OVER (PARTITION BY section, feature ORDER BY value) + (count(*) OVER (PARTITION BY section, feature, value) - 1) / 2 AS rk FROM expr),
i AS (SELECT section, label, feature, count(*) AS n_in, sum(rk)::DOUBLE AS rank_sum FROM k GROUP BY ALL), o AS (SELECT *, (sum(n_in) OVER (PARTITION BY section, feature) - n_in)::BIGINT AS n_out FROM i),
z AS (SELECT *, (rank_sum - n_in * (n_in + n_out + 1) / 2) / sqrt(n_in * n_out * (n_in + n_out + 1) / 12) AS z FROM o WHERE n_out > 0)"""


@query("a04_rank_sum", f"WITH {_RANKS} SELECT section, label, feature, n_in, n_out, round(rank_sum, 6) AS rank_sum, round(z, 6) AS z FROM z")
def rank_sum(spark: SparkSession, d: str) -> DataFrame:
    return m.rank_sum(_expr(spark, d)).select("section", "label", "feature", "n_in", "n_out", _r("rank_sum"), _r("z"))


_P = "least(1, greatest(0, t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-z * z / 2)))"


@query("a04_adjusted_p", f"WITH {_RANKS}, tt AS (SELECT section, label, feature, z, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) AS t FROM z), p AS (SELECT section, label, feature, {_P} AS p FROM tt), c AS (SELECT *, p * count(*) OVER (PARTITION BY section, label) / count(*) OVER (PARTITION BY section, label ORDER BY p) AS sc FROM p) SELECT section, label, feature, round(p, 5) AS p, round(least(1, min(sc) OVER (PARTITION BY section, label ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 5) AS p_adj FROM c")
def adjusted_p(spark: SparkSession, d: str) -> DataFrame:
    return m.adjust(m.rank_sum(_expr(spark, d)), "section", "label").select("section", "label", "feature", _r("p", places=5), _r("p_adj", places=5))


_TESTS = f"""k AS (SELECT *, rank() OVER (PARTITION BY section, feature ORDER BY value) + (count(*) OVER (PARTITION BY section, feature, value) - 1) / 2 AS rk FROM expr),
ri AS (SELECT section, label, feature, count(*) AS n_in, sum(rk)::DOUBLE AS rank_sum FROM k GROUP BY ALL), ro AS (SELECT *, (sum(n_in) OVER (PARTITION BY section, feature) - n_in)::BIGINT AS n_out FROM ri),
zz AS (SELECT *, (rank_sum - n_in * (n_in + n_out + 1) / 2) / sqrt(n_in * n_out * (n_in + n_out + 1) / 12) AS z FROM ro WHERE n_out > 0),
tt AS (SELECT section, label, feature, z, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) AS t FROM zz), pp AS (SELECT section, label, feature, {_P} AS p FROM tt),
sc AS (SELECT *, p * count(*) OVER (PARTITION BY section, label) / count(*) OVER (PARTITION BY section, label ORDER BY p) AS sc FROM pp),
pa AS (SELECT section, label, feature, least(1, min(sc) OVER (PARTITION BY section, label ORDER BY p DESC RANGE UNBOUNDED PRECEDING)) AS p_adj FROM sc)"""


@query("a06_markers_tested", f"WITH {_STATS.replace('value > 1', 'value > 0')}, {_TESTS}, mt AS (SELECT section, label, feature, fold_change, p_adj, row_number() OVER (PARTITION BY section, label ORDER BY fold_change DESC, feature) AS place FROM st JOIN pa USING (section, label, feature) WHERE p_adj <= 0.5 AND ratio >= 1 AND fraction_in >= 0.5 AND fold_change >= 1.02) SELECT section, label, feature, place, round(fold_change, 6) AS fold_change, round(p_adj, 5) AS p_adj FROM mt WHERE place <= 10")
def markers_tested(spark: SparkSession, d: str) -> DataFrame:
    return m.region_markers(_expr(spark, d), most_p=0.5, least_change=1.02).select("section", "label", "feature", "place", _r("fold_change"), _r("p_adj", places=5))


_MARKED = f"{_STATS.replace('value > 1', 'value > 0')}, mk AS (SELECT section, label, feature FROM (SELECT *, row_number() OVER (PARTITION BY section, label ORDER BY fold_change DESC, feature) AS place FROM st WHERE ratio >= 0.9 AND fraction_in >= 0.5 AND fold_change >= 1.0) WHERE place <= 20)"


def _markers(spark: SparkSession, d: str) -> DataFrame:
    return m.select_markers(m.group_statistics(_expr(spark, d)), least_ratio=0.9, least_change=1.0, n=20).select("section", "label", "feature")


@query("a25_marker_stability", f"WITH {_MARKED}, pr AS (SELECT a.label, a.section AS sa, b.section AS sb, count(*) AS i FROM mk a JOIN mk b ON a.label = b.label AND a.feature = b.feature AND a.section < b.section GROUP BY ALL), sz AS (SELECT label, section, count(*) AS n FROM mk GROUP BY ALL), j AS (SELECT a.label, coalesce(i, 0) / (a.n + b.n - coalesce(i, 0)) AS j FROM sz a JOIN sz b ON a.label = b.label AND a.section < b.section LEFT JOIN pr ON pr.label = a.label AND sa = a.section AND sb = b.section), u AS (SELECT label, count(DISTINCT feature) AS union_size FROM mk GROUP BY label), q AS (SELECT label, union_size, avg(j) AS stability FROM u LEFT JOIN j USING (label) GROUP BY ALL) SELECT label, union_size, round(stability, 6) AS stability, round((1 - stability) * ln(1 + union_size) / ln(1 + max(union_size) OVER ()), 6) AS adjusted FROM q")
def marker_stability(spark: SparkSession, d: str) -> DataFrame:
    return m.marker_stability(_markers(spark, d)).select("label", "union_size", _r("stability"), _r("adjusted"))


@query("a31_overlap_features", f"WITH {_MARKED}, c AS (SELECT label, feature, count(DISTINCT section) AS n_sections FROM mk GROUP BY ALL) SELECT * FROM (SELECT *, max(n_sections) OVER (PARTITION BY label) AS most FROM c) WHERE n_sections >= least(most, 2)".replace("SELECT * FROM (SELECT *, max", "SELECT label, feature, n_sections FROM (SELECT *, max"))
def overlap_features(spark: SparkSession, d: str) -> DataFrame:
    return m.overlap_features(_markers(spark, d)).select("label", "feature", "n_sections")


@query("a32_ordered_union", f"WITH {_MARKED}, ol AS (SELECT section || label AS list_id, feature, row_number() OVER (PARTITION BY section, label ORDER BY feature) AS ord FROM mk), c AS (SELECT feature, count(DISTINCT list_id) AS n_lists, min((list_id, ord)) AS fst FROM ol GROUP BY feature HAVING count(DISTINCT list_id) >= 2) SELECT feature, n_lists, row_number() OVER (ORDER BY n_lists DESC, fst, feature) AS place FROM c")
def ordered_union(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    lists = _markers(spark, d).select(F.concat("section", "label").alias("list_id"), "feature", F.row_number().over(Window.partitionBy("section", "label").orderBy("feature")).alias("ord"))
    return f.ordered_union(lists, 2)


@query("u01_shared_features", f"WITH {_MARKED} SELECT feature, count(DISTINCT section) AS n_sections FROM mk GROUP BY feature HAVING count(DISTINCT section) = (SELECT count(DISTINCT section) FROM mk)")
def shared_features(spark: SparkSession, d: str) -> DataFrame:
    return f.shared_features(_markers(spark, d))


# --- regions ---------------------------------------------------------------------------------------------

_FEATURE_DISTANCE = f"{_EXPR}, ce AS (SELECT section, label, feature, avg(value) AS v FROM expr GROUP BY ALL), rw AS (SELECT a.section, a.label AS region_i, b.label AS region_j, sqrt(sum((a.v - b.v) ** 2)) AS raw FROM ce a JOIN ce b ON a.section = b.section AND a.feature = b.feature AND a.label < b.label GROUP BY ALL), fd AS (SELECT *, CASE WHEN max(raw) OVER w > min(raw) OVER w THEN (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) ELSE 0 END AS distance FROM rw WINDOW w AS (PARTITION BY section))"


@query("a09_centroids", f"WITH {_EXPR} SELECT section, label, feature, round(avg(value), 6) AS value FROM expr GROUP BY ALL")
def centroids(spark: SparkSession, d: str) -> DataFrame:
    return r.centroids(_expr(spark, d)).select("section", "label", "feature", _r("value"))


@query("h01_feature_distance", f"WITH {_FEATURE_DISTANCE} SELECT section, region_i, region_j, round(raw, 6) AS raw, round(distance, 6) AS distance FROM fd")
def feature_distance(spark: SparkSession, d: str) -> DataFrame:
    return r.feature_distance(_expr(spark, d)).select("section", "region_i", "region_j", _r("raw"), _r("distance"))


_COMPOSITION = f"{_OBS}, pr AS (SELECT a.section, a.label AS label_i, b.label AS label_j, b.obs_id AS j FROM obs a JOIN obs b ON a.section = b.section AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 9), nc AS (SELECT section, label_i, label_j, count(DISTINCT j) AS n FROM pr GROUP BY ALL), lb AS (SELECT DISTINCT section, label FROM obs), gr AS (SELECT a.section, a.label AS label_i, b.label AS label_j FROM lb a JOIN lb b ON a.section = b.section), fu AS (SELECT gr.*, coalesce(n, 0) AS n FROM gr LEFT JOIN nc USING (section, label_i, label_j)), co AS (SELECT section, label_i, label_j, n + CASE WHEN min(n) OVER (PARTITION BY section) = 0 THEN 1 ELSE 0 END AS n FROM fu)"
_SPATIAL = f"{_COMPOSITION}, pp AS (SELECT *, n / sum(n) OVER (PARTITION BY section, label_i) AS p FROM co WHERE label_i != label_j), sr AS (SELECT a.section, a.label_i AS region_i, a.label_j AS region_j, -ln(a.p * b.p) AS raw FROM pp a JOIN pp b ON a.section = b.section AND a.label_i = b.label_j AND a.label_j = b.label_i AND a.label_i < a.label_j), sd AS (SELECT *, CASE WHEN max(raw) OVER w > min(raw) OVER w THEN (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) ELSE 0 END AS distance FROM sr WINDOW w AS (PARTITION BY section))"


@query("a10_neighbour_composition", f"WITH {_COMPOSITION} SELECT * FROM co")
def neighbour_composition(spark: SparkSession, d: str) -> DataFrame:
    return n.neighbour_composition(s.obs(spark, d), 3.0)


@query("h02_spatial_distance", f"WITH {_SPATIAL} SELECT section, region_i, region_j, round(raw, 6) AS raw, round(distance, 6) AS distance FROM sd")
def spatial_distance(spark: SparkSession, d: str) -> DataFrame:
    return r.spatial_distance(s.obs(spark, d), 3.0).select("section", "region_i", "region_j", _r("raw"), _r("distance"))


_COMBINED = f"{_FEATURE_DISTANCE}, {_SPATIAL.replace('pr AS', 'sp AS').replace('FROM pr ', 'FROM sp ')}, cb AS (SELECT section, region_i, region_j, 1.0 * fd.distance + 0.5 * sd.distance AS distance FROM fd JOIN sd USING (section, region_i, region_j))"


def _combined(spark: SparkSession, d: str) -> DataFrame:
    parts = r.feature_distance(_expr(spark, d)).withColumn("component", F.lit("gene")).unionByName(r.spatial_distance(s.obs(spark, d), 3.0).withColumn("component", F.lit("spatial")))
    return r.combine_distances(parts, {"gene": 1.0, "spatial": 0.5, "image": 0.0})


@query("h03_combined_distance", f"WITH {_COMBINED} SELECT section, region_i, region_j, round(distance, 6) AS distance FROM cb")
def combined_distance(spark: SparkSession, d: str) -> DataFrame:
    return _combined(spark, d).select("section", "region_i", "region_j", _r("distance"))


@query("h04_integrated_ranks", f"WITH {_COMBINED}, sz AS (SELECT section, count(*) AS n FROM obs GROUP BY section), mn AS (SELECT region_i, region_j, sum(n * distance) / sum(n) AS distance FROM cb JOIN sz USING (section) GROUP BY ALL), rd AS (SELECT *, round(distance, 9) AS nr FROM mn) SELECT region_i, region_j, round(distance, 6) AS distance, rank() OVER (ORDER BY nr) + (count(*) OVER (PARTITION BY nr) - 1) / 2 AS rank FROM rd")
def integrated_ranks(spark: SparkSession, d: str) -> DataFrame:
    return r.integrate_sections(_combined(spark, d), s.obs(spark, d)).select("region_i", "region_j", _r("distance"), "rank")


_RANKED = f"{_COMBINED}, sz AS (SELECT section, count(*) AS n FROM obs GROUP BY section), mn AS (SELECT region_i, region_j, sum(n * distance) / sum(n) AS distance FROM cb JOIN sz USING (section) GROUP BY ALL), rd AS (SELECT *, round(distance, 9) AS nr FROM mn), rk AS (SELECT region_i, region_j, row_number() OVER (ORDER BY nr, region_i, region_j) AS i FROM rd)"
#: One region pair after the other, with the node that holds each region as a map.
_TREE = f"""{_RANKED}, t(i, held, n, parent, child_1, child_2, regions) AS (
  SELECT 0::BIGINT, (SELECT map(list(r), list(r)) FROM (SELECT region_i AS r FROM rd UNION SELECT region_j FROM rd)), 0, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR
  UNION ALL
  SELECT i, CASE WHEN a = b THEN held ELSE map(map_keys(held), list_transform(map_values(held), lambda v: CASE WHEN v = a OR v = b THEN 'node_' || (n + 1) ELSE v END)) END, n + (a != b)::INT,
         CASE WHEN a != b THEN 'node_' || (n + 1) END, CASE WHEN a != b THEN a END, CASE WHEN a != b THEN b END,
         CASE WHEN a != b THEN array_to_string(list_sort(list_transform(list_filter(map_entries(held), lambda e: e.value = a OR e.value = b), lambda e: e.key)), ';') END
  FROM (SELECT rk.i, held, n, held[region_i] AS a, held[region_j] AS b FROM t JOIN rk ON rk.i = t.i + 1)),
me AS (SELECT parent, child_1, child_2, regions, n FROM t WHERE parent IS NOT NULL),
lv(node, level) AS (SELECT parent, 0 FROM me WHERE n = (SELECT max(n) FROM me) UNION ALL SELECT unnest([child_1, child_2]), level + 1 FROM lv JOIN me ON me.parent = lv.node),
spl AS (SELECT parent, child_1, child_2, regions, level FROM me JOIN lv ON lv.node = me.parent)"""


@query("h05_region_tree", f"WITH RECURSIVE {_TREE} SELECT * FROM spl")
def region_tree(spark: SparkSession, d: str) -> DataFrame:
    return r.tree_table(spark, r.integrate_sections(_combined(spark, d), s.obs(spark, d)))


@query("h06_tree_paths", f"WITH RECURSIVE {_TREE}, ph(node, path, depth) AS (SELECT parent, parent, 0 FROM spl WHERE level = 0 UNION ALL SELECT c, path || '/' || c, depth + 1 FROM (SELECT unnest([child_1, child_2]) AS c, path, depth FROM ph JOIN spl ON spl.parent = ph.node)) SELECT * FROM ph")
def tree_paths(spark: SparkSession, d: str) -> DataFrame:
    return r.tree_paths(region_tree(spark, d))


@query("h08_tree_nodes", f"WITH RECURSIVE {_TREE}, ed AS (SELECT unnest([child_1, child_2]) AS node, parent FROM spl) SELECT node, CASE WHEN spl.parent IS NULL THEN 'leaf' ELSE 'internal' END AS kind, ed.parent, coalesce(spl.regions, node) AS regions FROM ed LEFT JOIN spl ON spl.parent = node UNION ALL SELECT parent, 'root', NULL, regions FROM spl WHERE level = 0")
def tree_nodes(spark: SparkSession, d: str) -> DataFrame:
    return r.tree_nodes(region_tree(spark, d))


@query("h09_first_split", f"WITH RECURSIVE {_TREE}, ch AS (SELECT parent, unnest([child_1, child_2]) AS child FROM spl WHERE level = 0) SELECT ch.parent, child, coalesce(spl.regions, child) AS regions FROM ch LEFT JOIN spl ON spl.parent = child")
def first_split(spark: SparkSession, d: str) -> DataFrame:
    return r.first_split(region_tree(spark, d))


@query("w11_split_order", f"WITH RECURSIVE {_TREE} SELECT parent, len(string_split(regions, ';')) AS n_regions, row_number() OVER (ORDER BY len(string_split(regions, ';')) DESC, level, parent) AS place FROM spl")
def split_order(spark: SparkSession, d: str) -> DataFrame:
    return r.split_order(region_tree(spark, d))


@query("h10_reweight", f"WITH {_COMBINED.rpartition(', cb AS')[0]}, cb AS (SELECT section, region_i, region_j, 2.0 * fd.distance + 1.0 * sd.distance AS distance FROM fd JOIN sd USING (section, region_i, region_j) WHERE section IN ('s0', 's2')), sz AS (SELECT section, count(*) AS n FROM obs GROUP BY section), mn AS (SELECT region_i, region_j, sum(n * distance) / sum(n) AS distance FROM cb JOIN sz USING (section) GROUP BY ALL), rd AS (SELECT *, round(distance, 9) AS nr FROM mn) SELECT region_i, region_j, round(distance, 6) AS distance, rank() OVER (ORDER BY nr) + (count(*) OVER (PARTITION BY nr) - 1) / 2 AS rank FROM rd")
def reweight(spark: SparkSession, d: str) -> DataFrame:
    stored = r.store_components({"gene": r.feature_distance(_expr(spark, d)), "spatial": r.spatial_distance(s.obs(spark, d), 3.0)})
    return r.reweight(stored, s.obs(spark, d), {"gene": 2.0, "spatial": 1.0}, ["s0", "s2"]).select("region_i", "region_j", _r("distance"), "rank")


_KS = f"{_EXPR}, qn AS (SELECT count(DISTINCT obs_id)::DOUBLE AS n FROM expr WHERE section = 's3'), rn AS (SELECT section, count(DISTINCT obs_id)::DOUBLE AS n FROM expr GROUP BY section), al AS (SELECT section, feature, value, 1 / n AS st FROM expr JOIN rn USING (section) WHERE section != 's3' UNION ALL SELECT rn.section, feature, value, -1 / qn.n FROM expr, qn, rn WHERE expr.section = 's3' AND rn.section != 's3'), cl AS (SELECT section, feature, value, sum(st) AS st FROM al GROUP BY ALL), rs AS (SELECT section, feature, abs(sum(st) OVER (PARTITION BY section, feature ORDER BY value ROWS UNBOUNDED PRECEDING)) AS gap FROM cl), ks AS (SELECT section, feature, 1 - max(gap) AS similarity FROM rs GROUP BY ALL)"


@query("a23_ks_similarity", f"WITH {_KS} SELECT section, feature, round(similarity, 6) AS similarity FROM ks")
def ks_similarity(spark: SparkSession, d: str) -> DataFrame:
    return r.ks_similarity(_expr(spark, d), "s3").select("section", "feature", _r("similarity"))


@query("w04_select_references", f"WITH {_KS}, {_OBS}, c AS (SELECT section, label, count(*) AS n FROM obs GROUP BY ALL), vr AS (SELECT section, count(*) AS n_valid FROM (SELECT *, n / sum(n) OVER (PARTITION BY section) AS sh FROM c) WHERE sh > 0.1 GROUP BY section), mm AS (SELECT section, avg(similarity) AS similarity FROM ks GROUP BY section), w AS (SELECT section, similarity, sqrt(coalesce(n_valid, 0) / max(coalesce(n_valid, 0)) OVER ()) AS weight FROM mm LEFT JOIN vr USING (section)), sc AS (SELECT *, similarity * weight AS score, similarity >= 0.7 AS above FROM w), fl AS (SELECT *, score >= 0.9 * max(score) OVER () AS by_rule FROM sc) SELECT section, round(similarity, 6) AS similarity, round(weight, 6) AS weight, round(score, 6) AS score, above, by_rule, CASE WHEN NOT bool_or(above) OVER () THEN row_number() OVER (ORDER BY score DESC, section) = 1 WHEN bool_or(above AND by_rule) OVER () THEN above AND by_rule ELSE row_number() OVER (ORDER BY above DESC, score DESC, section) = 1 END AS chosen, NOT bool_or(above) OVER () AS none_above FROM fl")
def select_references(spark: SparkSession, d: str) -> DataFrame:
    chosen = r.select_references(r.ks_similarity(_expr(spark, d), "s3"), f.valid_regions(s.obs(spark, d), 0.1))
    return chosen.select("section", _r("similarity"), _r("weight"), _r("score"), "above", "by_rule", "chosen", "none_above")


# --- neighbours ------------------------------------------------------------------------------------------

_SELF = f"{_OBS}, nn AS (SELECT a.section, a.obs_id, a.label, b.obs_id AS other_id, b.label AS vote, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS d2, row_number() OVER (PARTITION BY a.obs_id ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.obs_id) AS place FROM obs a JOIN obs b ON a.section = b.section)"


@query("j08_plane_neighbours", f"WITH {_SELF} SELECT section, obs_id, other_id, d2, place FROM nn WHERE place <= 7")
def plane_neighbours(spark: SparkSession, d: str) -> DataFrame:
    o = s.obs(spark, d)
    return n.plane_neighbours(o, o, 7)


#: The query section's places looked up in each reference section, all of them.
_ACROSS = f"{_OBS}, cr AS (SELECT b.section, a.obs_id, b.obs_id AS other_id, b.label, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS d2, row_number() OVER (PARTITION BY a.obs_id, b.section ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.obs_id) AS place FROM obs a JOIN obs b ON a.section = 's3' AND b.section != 's3')"


def _across(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = s.obs(spark, d)
    others = o.where("section != 's3'")
    asked = o.where("section = 's3'").select("obs_id", "x", "y").join(if_small(others.select("section").distinct()), how="cross")  # a copy a section
    return asked, others


@query("j05_nearest_label", f"WITH {_ACROSS} SELECT section, obs_id, label FROM cr WHERE place = 1")
def nearest_label(spark: SparkSession, d: str) -> DataFrame:
    asked, others = _across(spark, d)
    near = n.plane_neighbours(asked, others, 1)
    return near.join(others.select("section", F.col("obs_id").alias("other_id"), "label"), ["section", "other_id"]).select("section", "obs_id", "label")


@query("l09_refine_labels", f"WITH {_SELF}, v AS (SELECT section, obs_id, label, vote, count(*) AS n, sum(count(*)) OVER (PARTITION BY obs_id) AS al FROM nn WHERE place <= 9 GROUP BY section, obs_id, label, vote), w AS (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY n DESC, vote) AS r FROM v) SELECT section, obs_id, label, CASE WHEN n * 2 > al THEN vote ELSE label END AS refined FROM w WHERE r = 1")
def refine_labels(spark: SparkSession, d: str) -> DataFrame:
    return n.refine_labels(s.obs(spark, d), 8)


@query("a35_label_shares", f"WITH {_SELF}, v AS (SELECT section, obs_id, vote AS label, count(*) AS n FROM nn WHERE place <= 6 GROUP BY section, obs_id, vote) SELECT section, obs_id, label, n, round(n / sum(n) OVER (PARTITION BY obs_id), 6) AS share, row_number() OVER (PARTITION BY obs_id ORDER BY n DESC, label) AS place FROM v")
def label_shares(spark: SparkSession, d: str) -> DataFrame:
    return n.label_shares(s.obs(spark, d), 6).select("section", "obs_id", "label", "n", _r("share"), "place")


_ANCHORS = f"ve AS (SELECT vec_id AS obs_id, 's' || (vec_id % 4) AS section, 'r' || label AS label, embedding::DOUBLE[] AS v FROM embeddings), nb AS (SELECT a.obs_id AS query_id, a.label, b.obs_id, row_number() OVER (PARTITION BY a.obs_id ORDER BY round(list_distance(a.v, b.v), 9), b.obs_id) AS place FROM ve a, ve b WHERE a.section != 's3' AND b.section = 's3'), an AS (SELECT label, obs_id, count(*) AS n_votes FROM nb WHERE place <= 5 GROUP BY ALL)"


def _anchors(spark: SparkSession, d: str) -> DataFrame:
    v = s.vectors(spark, d)
    return n.anchors(v.where("section != 's3'"), v.where("section = 's3'"), 5)


@query("j06_feature_anchors", f"WITH {_ANCHORS} SELECT label, obs_id, n_votes FROM an")
def feature_anchors(spark: SparkSession, d: str) -> DataFrame:
    return _anchors(spark, d)


@query("j06_indexed_neighbours")
def indexed_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Every observation whose id 20 divides asks all observations."""
    v = s.vectors(spark, d)
    return fi.indexed_neighbours(v.where("obs_id % 20 = 0"), v, 10).select("query_id", "ref_id", "distance", "place")


@query("j06_indexed_anchors")
def indexed_anchors(spark: SparkSession, d: str) -> DataFrame:
    v = s.vectors(spark, d)
    return n.anchors(v.where("section != 's3'"), v.where("section = 's3'"), 5, search=fi.indexed_neighbours)


@query("j17_impute", f"""WITH {_EXPR}, {_ACROSS},
w AS (SELECT *, 1 / (sqrt(d2) + 0.1) ** 2 AS w FROM cr WHERE place <= 4),
ww AS (SELECT section, obs_id, other_id, w / sum(w) OVER (PARTITION BY section, obs_id) AS w FROM w)
SELECT ww.section, ww.obs_id, feature, round(sum(w * value), 6) AS value FROM ww JOIN expr ON ww.section = expr.section AND other_id = expr.obs_id GROUP BY ALL""")
def impute(spark: SparkSession, d: str) -> DataFrame:
    asked, others = _across(spark, d)
    weights = en.neighbour_weights(n.plane_neighbours(asked, others, 4))
    return en.impute(weights, _expr(spark, d)).select("section", "obs_id", "feature", _r("value"))


# --- assignment ------------------------------------------------------------------------------------------


@query("a15_quantile_thresholds", f"WITH {_EXPR}, q AS (SELECT label, feature, quantile_cont(value, 0.85) AS up, quantile_cont(value, 0.15) AS lo FROM expr GROUP BY ALL) SELECT feature, round(coalesce(avg(CASE WHEN label != 'r1' AND up > 0 THEN up END), avg(CASE WHEN label = 'r1' AND lo > 0 THEN lo END)), 6) AS threshold FROM q GROUP BY feature")
def quantile_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return a.quantile_thresholds(_expr(spark, d), "r1").select("feature", _r("threshold"))


@query("a14_positive_sections", f"WITH {_RAW}, q AS (SELECT section, label, feature, quantile_cont(value, 0.5) AS quantile FROM raw GROUP BY ALL) SELECT section, label, feature, round(quantile, 6) AS quantile FROM q WHERE quantile > 0")
def positive_sections(spark: SparkSession, d: str) -> DataFrame:
    return a.positive_sections(s.raw_expr(spark, d)).select("section", "label", "feature", _r("quantile"))


@query("a17_hierarchy_anchors", f"WITH {_EXPR}, q AS (SELECT label, feature, quantile_cont(value, 0.85) AS up, quantile_cont(value, 0.15) AS lo FROM expr GROUP BY ALL), th AS (SELECT feature, coalesce(avg(CASE WHEN label != 'r1' AND up > 0 THEN up END), avg(CASE WHEN label = 'r1' AND lo > 0 THEN lo END)) AS t FROM q GROUP BY feature), fl AS (SELECT section, obs_id, sum((value > t)::INT)::BIGINT AS n_flags FROM expr JOIN th USING (feature) GROUP BY ALL), li AS (SELECT section, max(n_flags) AS most, greatest(1, floor(least(round_even(max(n_flags) * 0.5, 0), quantile_cont(n_flags, 0.8)))) AS lim FROM fl GROUP BY section) SELECT section, obs_id, n_flags, (most > 0 AND n_flags >= lim)::INT AS anchor FROM fl JOIN li USING (section)")
def hierarchy_anchors(spark: SparkSession, d: str) -> DataFrame:
    expr = _expr(spark, d)
    return a.hierarchy_anchors(a.feature_flags(expr, a.quantile_thresholds(expr, "r1")))


_CROSS = f"{_ANCHORS}, bw AS (SELECT obs_id, CASE WHEN label IN ('r0', 'r1', 'r2', 'r3', 'r4') THEN 'left' ELSE 'right' END AS branch FROM an GROUP BY ALL), cu AS (SELECT obs_id, list_position(v[1:7], list_max(v[1:7])) - 1 AS cluster FROM ve WHERE section = 's3'), sz AS (SELECT cluster, count(*) AS size FROM cu GROUP BY cluster), ht AS (SELECT cluster, branch, count(*) AS n FROM cu JOIN bw USING (obs_id) GROUP BY ALL), ct AS (SELECT sz.cluster, size, b.branch, b.ord, coalesce(n, 0) AS n, 100.0::DOUBLE * coalesce(n, 0) / size AS percent FROM sz CROSS JOIN (VALUES ('left', 0), ('right', 1)) AS b(branch, ord) LEFT JOIN ht ON ht.cluster = sz.cluster AND ht.branch = b.branch), cx AS (SELECT *, n / nullif(sum(n) OVER (PARTITION BY branch), 0) AS share FROM ct)"


def largest_axis(column: str, n: int) -> Column:
    """The number of the largest of the first n features: a clustering that SQL can repeat."""
    return (F.array_position(F.slice(column, 1, n), F.array_max(F.slice(column, 1, n))) - 1).cast("int")


def _axis_clusters(spark: SparkSession, d: str) -> DataFrame:
    return s.vectors(spark, d).where("section = 's3'").select("section", "obs_id", "x", "y", largest_axis("vector", 7).alias("cluster"))


def _cross(spark: SparkSession, d: str) -> DataFrame:
    left = F.col("label").isin("r0", "r1", "r2", "r3", "r4")
    hits = _anchors(spark, d).select("obs_id", F.when(left, "left").otherwise("right").alias("branch"))
    clusters = _axis_clusters(spark, d).select("obs_id", "cluster")
    branches = spark.range(1).select(F.inline(F.array(F.struct(F.lit("left").alias("branch"), F.lit(0).alias("ord")), F.struct(F.lit("right").alias("branch"), F.lit(1).alias("ord")))))
    return a.cross_table(clusters, hits, branches)


@query("a18_cross_table", f"WITH {_CROSS} SELECT cluster, size, branch, ord, n, round(percent, 6) AS percent, round(share, 6) AS share FROM cx")
def cross_table(spark: SparkSession, d: str) -> DataFrame:
    return _cross(spark, d).select("cluster", "size", "branch", "ord", "n", _r("percent"), _r("share"))


@query("l05_assign_clusters", f"WITH {_CROSS}, cc AS (SELECT *, CASE WHEN max(percent) OVER w - min(percent) OVER w <= 3 THEN percent * share ELSE percent END AS score FROM cx WHERE size >= 10 WINDOW w AS (PARTITION BY cluster)), b AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(score, 9) DESC, ord) AS r FROM cc) SELECT cluster, size, round(percent, 6) AS percent, CASE WHEN percent > 5 THEN branch ELSE 'novel_cluster' END AS branch FROM b WHERE r = 1")
def assign_clusters(spark: SparkSession, d: str) -> DataFrame:
    return a.assign_clusters(_cross(spark, d), cutoff=3.0).select("cluster", "size", _r("percent"), "branch")


@query("j16_scatter_labels", f"WITH {_CROSS}, b AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY percent DESC, ord) AS r FROM cx WHERE size >= 10), fi AS (SELECT obs_id, CASE WHEN percent > 5 THEN branch ELSE 'novel_cluster' END AS branch FROM b JOIN cu USING (cluster) WHERE r = 1), {_OBS} SELECT obs.obs_id, section, label, coalesce(branch, 'novel_cluster') AS final FROM obs LEFT JOIN fi USING (obs_id)")
def scatter_labels(spark: SparkSession, d: str) -> DataFrame:
    clusters = _axis_clusters(spark, d).select("obs_id", "cluster")
    final = clusters.join(a.assign_clusters(_cross(spark, d)), "cluster").select("obs_id", "branch")
    return a.scatter_labels(s.obs(spark, d), final).select("obs_id", "section", "label", "final")


@query("a20_binary_ratio", f"WITH {_OBS}, q AS (SELECT section, sum((label = 'r1')::INT) AS a, sum((label != 'r1')::INT) AS b FROM obs GROUP BY section) SELECT section, round(CASE WHEN least(a, b) > 0 THEN greatest(a, b) / least(a, b) ELSE 'inf'::DOUBLE END, 6) AS ratio FROM q")
def binary_ratio(spark: SparkSession, d: str) -> DataFrame:
    return a.binary_ratio(s.obs(spark, d), "r1").select("section", _r("ratio"))


_ARI = f"q AS (SELECT 's' || (vec_id % 4) AS section, 'r' || label AS label, list_position(embedding[1:5], list_max(embedding[1:5])) AS cl, count(*) AS n FROM embeddings GROUP BY ALL), ce AS (SELECT section, sum(n * (n - 1) / 2) AS ce, sum(n) AS al FROM q GROUP BY section), ro AS (SELECT section, sum(n * (n - 1) / 2) AS ro FROM (SELECT section, label, sum(n) AS n FROM q GROUP BY ALL) GROUP BY section), co AS (SELECT section, sum(n * (n - 1) / 2) AS co FROM (SELECT section, cl, sum(n) AS n FROM q GROUP BY ALL) GROUP BY section), ri AS (SELECT section, (ce - ro * co / (al * (al - 1) / 2)) / ((ro + co) / 2 - ro * co / (al * (al - 1) / 2)) AS ari FROM ce JOIN ro USING (section) JOIN co USING (section))"


@query("a22_adjusted_rand", f"WITH {_ARI} SELECT section, round(ari, 6) AS ari FROM ri")
def adjusted_rand(spark: SparkSession, d: str) -> DataFrame:
    return a.adjusted_rand(s.vectors(spark, d).withColumn("cl", largest_axis("vector", 5)), "label", "cl", "section").select("section", _r("ari"))


_ARIS = "aq AS (SELECT k, 's' || (vec_id % 4) AS section, 'r' || label AS label, list_position(embedding[1:k], list_max(embedding[1:k])) AS cl, count(*) AS n FROM embeddings, (VALUES (3), (5), (8)) AS u(k) GROUP BY ALL), ace AS (SELECT k, section, sum(n * (n - 1) / 2) AS ce, sum(n) AS al FROM aq GROUP BY ALL), aro AS (SELECT k, section, sum(n * (n - 1) / 2) AS ro FROM (SELECT k, section, label, sum(n) AS n FROM aq GROUP BY ALL) GROUP BY ALL), aco AS (SELECT k, section, sum(n * (n - 1) / 2) AS co FROM (SELECT k, section, cl, sum(n) AS n FROM aq GROUP BY ALL) GROUP BY ALL), ari AS (SELECT k, section, (ce - ro * co / (al * (al - 1) / 2)) / ((ro + co) / 2 - ro * co / (al * (al - 1) / 2)) AS ari FROM ace JOIN aro USING (k, section) JOIN aco USING (k, section))"


@query("a21_score_summary", f"WITH {_ARIS} SELECT 'axes_' || k AS kind, round(avg(ari), 6) AS mean, round(quantile_cont(ari, 0.5), 6) AS median, round(min(ari), 6) AS least, round(max(ari), 6) AS most, count(ari) AS n, row_number() OVER (ORDER BY avg(ari) DESC, k) AS place FROM ari GROUP BY k")
def score_summary(spark: SparkSession, d: str) -> DataFrame:
    return cc.score_summary(_axis_scores(spark, d), "kind").select("kind", _r("mean"), _r("median"), _r("least"), _r("most"), "n", "place")


def _axis_scores(spark: SparkSession, d: str) -> DataFrame:
    v = s.vectors(spark, d)
    scores = None
    for k in (3, 5, 8):
        one = a.adjusted_rand(v.withColumn("cl", largest_axis("vector", k)), "label", "cl", "section").withColumn("kind", F.lit(f"axes_{k}")).withColumn("status", F.lit("success"))
        scores = one if scores is None else scores.unionByName(one)
    return scores


@query("a34_weighted_vote", f"""WITH {_ACROSS},
v AS (
  SELECT section, obs_id, label, round(sum(1 / (sqrt(d2) + 1e-8)), 6) AS w, min(place) AS first
  FROM cr WHERE place <= 7 GROUP BY ALL)
SELECT section, obs_id, label FROM v QUALIFY row_number() OVER (PARTITION BY section, obs_id ORDER BY w DESC, first) = 1""")
def weighted_vote(spark: SparkSession, d: str) -> DataFrame:
    asked, others = _across(spark, d)
    return n.nearest_majority(asked, others, 7, weighted=True)


@query("a34_plurality_vote", f"""WITH {_ACROSS},
v AS (SELECT section, obs_id, label, count(*) AS w, min(place) AS first FROM cr WHERE place <= 7 GROUP BY ALL)
SELECT section, obs_id, label FROM v QUALIFY row_number() OVER (PARTITION BY section, obs_id ORDER BY w DESC, first) = 1""")
def plurality_vote(spark: SparkSession, d: str) -> DataFrame:
    asked, others = _across(spark, d)
    return n.nearest_majority(asked, others, 7)


@query("j02_join_modalities", """WITH ge AS (SELECT 's' || (vec_id % 4) AS section, vec_id AS obs_id, embedding[1:40]::DOUBLE[] AS v FROM embeddings WHERE label != 9),
im AS (SELECT 's' || (vec_id % 4) AS section, vec_id AS obs_id, embedding[41:64]::DOUBLE[] AS v FROM embeddings WHERE label != 4),
jo AS (SELECT section, obs_id, list_concat(ge.v, im.v) AS v FROM ge JOIN im USING (section, obs_id))
SELECT section, obs_id, i - 1 AS pos, round(v[i], 6) AS value FROM jo, unnest(generate_series(1, 64)) AS u(i)""")
def join_modalities(spark: SparkSession, d: str) -> DataFrame:
    """Two modalities, each without the observations of one region."""
    v = s.vectors(spark, d)
    gene = f.exclude_labels(v, ["r9"]).withColumn("vector", F.slice("vector", 1, 40))
    image = f.exclude_labels(v, ["r4"]).withColumn("vector", F.slice("vector", 41, 24))
    joined = e.join_modalities([gene, image])
    return joined.select("section", "obs_id", F.posexplode("vector").alias("pos", "value")).select("section", "obs_id", F.col("pos").cast("long").alias("pos"), _r("value"))


@query("c15_select_modalities", f"""WITH {_ARIS},
me AS (SELECT 'axes_' || k AS modality, avg(ari) AS mean FROM ari GROUP BY k),
ab AS (SELECT modality, mean FROM me WHERE mean >= 0.01 AND mean >= 0.6 * (SELECT max(mean) FROM me))
SELECT (row_number() OVER (ORDER BY mean DESC, modality) - 1)::INT AS ord, modality FROM ab
UNION ALL SELECT 0, 'Gene' WHERE NOT EXISTS (SELECT 1 FROM ab)""")
def select_modalities(spark: SparkSession, d: str) -> DataFrame:
    means = cc.score_summary(_axis_scores(spark, d), "kind").select(F.col("kind").alias("modality"), "mean")
    return spark.createDataFrame(list(enumerate(cc.select_modalities(means, 0.01, 0.6))), "ord int, modality string")


@query("j04_transfer_columns", f"WITH {_SELF} SELECT nn.section, nn.obs_id AS asked_by, other_id AS obs_id, vote AS label, b.x FROM nn JOIN obs b ON b.section = nn.section AND b.obs_id = other_id WHERE place <= 2")
def transfer_columns(spark: SparkSession, d: str) -> DataFrame:
    o = s.obs(spark, d)
    target = n.plane_neighbours(o, o, 2).select("section", F.col("obs_id").alias("asked_by"), F.col("other_id").alias("obs_id"))
    return a.transfer_columns(o, target, ["label", "x"]).select("section", "asked_by", "obs_id", "label", "x")


@query("j15_missing_observations", f"WITH {_ANCHORS} SELECT section, obs_id FROM ve WHERE section = 's3' AND obs_id NOT IN (SELECT obs_id FROM an WHERE n_votes > 1)")
def missing_observations(spark: SparkSession, d: str) -> DataFrame:
    found = _anchors(spark, d).where("n_votes > 1").select(F.lit("s3").alias("section"), "obs_id")
    return a.missing_observations(s.obs(spark, d).where("section = 's3'").select("section", "obs_id"), found)


_HITS = f"{_ANCHORS}, nbs AS (SELECT a.section, a.label, b.obs_id, row_number() OVER (PARTITION BY a.obs_id ORDER BY round(list_distance(a.v, b.v), 9), b.obs_id) AS place FROM ve a, ve b WHERE a.section != 's3' AND b.section = 's3'), hs AS (SELECT DISTINCT section, label, obs_id FROM nbs WHERE place <= 5)"


def _section_hits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = s.vectors(spark, d)
    refs = v.where("section != 's3'")
    sections = refs.select("section").distinct()
    copies = v.where("section = 's3'").select("obs_id", "vector").join(if_small(sections), how="cross")  # a copy a section
    return n.anchors(refs, copies, 5, ["section"]), sections


@query("a12_vote_anchors", f"WITH {_HITS} SELECT label, obs_id, count(*) AS n_votes FROM hs GROUP BY ALL HAVING count(*) >= 2")
def vote_anchors(spark: SparkSession, d: str) -> DataFrame:
    return n.vote_anchors(_section_hits(spark, d)[0], 3, "min_count", 2)


@query("l02_reference_votes", f"WITH {_HITS} SELECT label, obs_id, count(*) AS n_votes FROM hs GROUP BY ALL HAVING count(*) >= 3")
def reference_votes(spark: SparkSession, d: str) -> DataFrame:
    hits, sections = _section_hits(spark, d)
    return n.vote_references(hits, sections, 0)


@query("l01_two_sided_anchors", f"WITH {_HITS}, sd AS (SELECT *, CASE WHEN label IN ('r0', 'r1', 'r2', 'r3', 'r4') THEN 'left' ELSE 'right' END AS side FROM nbs) SELECT side AS label, obs_id, count(*) AS n_votes FROM sd WHERE place <= CASE WHEN side = 'left' THEN 5 ELSE 3 END GROUP BY ALL")
def two_sided_anchors(spark: SparkSession, d: str) -> DataFrame:
    v = s.vectors(spark, d)
    sided = v.where("section != 's3'").withColumn("label", F.when(F.col("label").isin("r0", "r1", "r2", "r3", "r4"), "left").otherwise("right"))
    return n.anchors(sided, v.where("section = 's3'"), {"left": 5, "right": 3})


@query("l01_shared_modalities", f"WITH {_ANCHORS}, mo AS (SELECT *, CASE m WHEN 0 THEN v[1:32] ELSE v[33:64] END AS w, m FROM ve, (VALUES (0), (1)) AS u(m)), nm AS (SELECT a.m, a.label, b.obs_id, row_number() OVER (PARTITION BY a.m, a.obs_id ORDER BY round(list_distance(a.w, b.w), 9), b.obs_id) AS place FROM mo a JOIN mo b ON a.m = b.m WHERE a.section != 's3' AND b.section = 's3') SELECT label, obs_id FROM nm WHERE place <= 5 GROUP BY ALL HAVING count(DISTINCT m) = 2")
def shared_modalities(spark: SparkSession, d: str) -> DataFrame:
    v = s.vectors(spark, d)
    both = F.explode(F.array(F.struct(F.lit("Gene").alias("modality"), F.slice("vector", 1, 32).alias("vector")), F.struct(F.lit("Image").alias("modality"), F.slice("vector", 33, 32).alias("vector"))))
    parts = v.select("section", "obs_id", "label", both.alias("m")).select("section", "obs_id", "label", "m.modality", "m.vector")
    return n.combine_modalities(n.anchors(parts.where("section != 's3'"), parts.where("section = 's3'"), 5, ["modality"]), "shared", 2)


@query("l04_anchor_summary", f"WITH {_ANCHORS} SELECT label, count(DISTINCT obs_id) AS n_anchors, (SELECT count(*) FROM ve WHERE section = 's3') AS n_obs, round(count(DISTINCT obs_id) / (SELECT count(*) FROM ve WHERE section = 's3'), 6) AS fraction FROM an GROUP BY label")
def anchor_summary(spark: SparkSession, d: str) -> DataFrame:
    total = s.obs(spark, d).where("section = 's3'").agg(F.count(F.lit(1)).alias("n_obs"))
    return a.anchor_summary(_anchors(spark, d), total, ["label"]).select("label", "n_anchors", "n_obs", _r("fraction"))


# --- raster ----------------------------------------------------------------------------------------------

_GRID = "gr AS (SELECT 's' || (vec_id % 4) AS section, 'f' || (i - 1) AS feature, ((vec_id // 4) % 25)::INT AS gx, ((vec_id // 4) // 25)::INT AS gy, embedding[i]::DOUBLE AS value FROM embeddings, unnest(generate_series(1, 64)) AS u(i))"


def _grid(spark: SparkSession, d: str) -> DataFrame:
    cell = s.raw_expr(spark, d)
    return cell.select("section", "feature", F.expr("int((obs_id div 4) % 25)").alias("gx"), F.expr("int((obs_id div 4) div 25)").alias("gy"), "value")


@query("a36_grid_to_spots", f"WITH {_GRID}, {_OBS}, o AS (SELECT a.section, a.obs_id, feature, value, (least(a.x * 3 + 2.5, (gx + 1) * 2) - greatest(a.x * 3 - 2.5, gx * 2)) AS w, (least(a.y * 3 + 2.5, (gy + 1) * 2) - greatest(a.y * 3 - 2.5, gy * 2)) AS hh FROM obs a JOIN gr ON a.section = gr.section) SELECT section, obs_id, feature, round(sum(value * w * hh) / sum(w * hh), 6) AS value, count(*) AS n_cells FROM o WHERE w > 0 AND hh > 0 GROUP BY ALL")
def grid_to_spots(spark: SparkSession, d: str) -> DataFrame:
    spots = s.obs(spark, d).withColumn("x", F.col("x") * 3).withColumn("y", F.col("y") * 3)
    return g.grid_to_spots(spots, _grid(spark, d), 5.0, 2.0).select("section", "obs_id", "feature", _r("value"), "n_cells")


@query("a37_window_means", f"WITH {_GRID} SELECT a.section, a.feature, a.gx, a.gy, round(avg(b.value), 6) + 0 AS mean FROM gr a JOIN gr b ON a.section = b.section AND a.feature = b.feature AND abs(a.gx - b.gx) <= 2 AND abs(a.gy - b.gy) <= 2 GROUP BY ALL")
def window_means(spark: SparkSession, d: str) -> DataFrame:
    return g.window_means(_grid(spark, d), 2).select("section", "feature", "gx", "gy", (F.round("mean", 6) + 0.0).alias("mean"))  # no negative zero


_SCAN = "sc AS (SELECT 's' || (vec_id % 4) AS section, vec_id % 25 AS array_x, vec_id // 25 AS array_y, embedding[1]::DOUBLE + 3 * (vec_id % 25) AS x, embedding[2]::DOUBLE + 3 * (vec_id // 25) AS y FROM embeddings)"


@query("a38_scan_extremes", f"WITH {_SCAN} SELECT 'x' AS axis, section, array_x AS line, quantile_cont(x, 0.5) AS median, min(y) AS least, max(y) AS most FROM sc GROUP BY ALL UNION ALL SELECT 'y', section, array_y, quantile_cont(y, 0.5), min(x), max(x) FROM sc GROUP BY ALL")
def scan_extremes(spark: SparkSession, d: str) -> DataFrame:
    at = lambda i: F.get("vector", i)
    lines = s.vectors(spark, d).select("section", (F.col("obs_id") % 25).alias("array_x"), F.expr("obs_id div 25").alias("array_y"), (at(0) + 3 * (F.col("obs_id") % 25)).alias("x"), (at(1) + 3 * F.expr("obs_id div 25")).alias("y"))
    return g.scan_extremes(lines, "x").withColumn("axis", F.lit("x")).unionByName(g.scan_extremes(lines, "y").withColumn("axis", F.lit("y")))


@query("a40_tile_statistics", f"""WITH {_GRID}, ti AS (SELECT section, gx // 2 AS tx, gy // 2 AS ty, feature, value FROM gr), mc AS (SELECT section, tx, ty, feature, avg(value) AS m FROM ti GROUP BY ALL), sd AS (SELECT section, tx, ty, stddev_pop(value) AS spread FROM ti GROUP BY ALL),
w AS (SELECT section, feature, var_pop(m) AS w FROM mc GROUP BY ALL), z AS (SELECT section, tx, ty, sum(m * w) / sum(w) AS mean FROM mc JOIN w USING (section, feature) GROUP BY ALL),
n AS (SELECT *, (spread - min(spread) OVER v) / (max(spread) OVER v - min(spread) OVER v) + 1 AS ss, (mean - min(mean) OVER v) / (max(mean) OVER v - min(mean) OVER v) + 1 AS ms FROM sd JOIN z USING (section, tx, ty) WINDOW v AS (PARTITION BY section))
SELECT section, tx, ty, round(spread, 6) AS spread, round(mean, 6) AS mean, round(ss, 6) AS spread_scaled, round(ms, 6) AS mean_scaled, round((ss / ms - min(ss / ms) OVER v) / (max(ss / ms) OVER v - min(ss / ms) OVER v), 6) AS ratio FROM n WINDOW v AS (PARTITION BY section)""")
def tile_statistics(spark: SparkSession, d: str) -> DataFrame:
    pixels = _grid(spark, d).withColumnRenamed("feature", "channel")
    return g.tile_statistics(pixels, 2).select("section", "tx", "ty", *[_r(c) for c in ("spread", "mean", "spread_scaled", "mean_scaled", "ratio")])


@query("j12_mask_labels", f"WITH {_OBS}, mk AS (SELECT x::INT AS x, y::INT AS y, 'm' || label AS ml FROM obs WHERE section = 's0') SELECT o.section, o.obs_id, coalesce(ml, 'nan') AS mask_label FROM obs o LEFT JOIN mk ON o.x::INT = mk.x AND o.y::INT = mk.y")
def mask_labels(spark: SparkSession, d: str) -> DataFrame:
    o = s.obs(spark, d)
    one = o.where("section = 's0'").select(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.concat(F.lit("m"), "label").alias("label"))
    return g.mask_labels(o, one.join(if_small(o.select("section").distinct()), how="cross"))  # a copy a section


@query("a33_boundary_scores", f"WITH {_RAW}, mn AS (SELECT section, label AS cluster, feature, avg(value) AS m, count(*) AS n FROM raw GROUP BY ALL), sc AS (SELECT section, cluster, sum(abs(m)) AS score, max(n) AS size FROM mn GROUP BY ALL HAVING max(n) >= 5), rk AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY score, cluster) AS place FROM sc), ot AS (SELECT section, quantile_cont(score, 0.5) AS med FROM rk WHERE place > 1 GROUP BY section) SELECT section, cluster, round(score, 6) AS score, size, place = 1 AND NOT coalesce(score > 0.8 * med, false) AS boundary FROM rk LEFT JOIN ot USING (section)")
def boundary_scores(spark: SparkSession, d: str) -> DataFrame:
    o = s.obs(spark, d).select("section", "obs_id", F.col("label").alias("cluster"))
    rgb = s.raw_expr(spark, d).select("section", "obs_id", "feature", "value")
    return g.boundary_scores(o, rgb, 5).select("section", "cluster", _r("score"), "size", "boundary")


# --- embedding, clustering, heterogeneity, transfer --------------------------------------------------------


@query("c01_principal_components")
def principal_components(spark: SparkSession, d: str) -> DataFrame:
    return e.principal_components(s.vectors(spark, d), 10).select("section", "obs_id", "pca")


@query("c04_k_means")
def k_means(spark: SparkSession, d: str) -> DataFrame:
    return e.k_means(e.scaled(e.principal_components(s.vectors(spark, d), 10), "pca"), 5, "pca").select("section", "obs_id", "cluster")


@query("c02_selected_features", f"WITH {_RAW}, l AS (SELECT section, obs_id, feature, value, CASE feature WHEN 'f9' THEN 0 WHEN 'f3' THEN 1 ELSE 2 END AS ord FROM raw WHERE feature IN ('f9', 'f3', 'f40')) SELECT section, obs_id, round(max(value) FILTER (WHERE ord = 0), 6) AS first, round(max(value) FILTER (WHERE ord = 1), 6) AS second, round(max(value) FILTER (WHERE ord = 2), 6) AS third FROM l GROUP BY ALL")
def selected_features(spark: SparkSession, d: str) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(x).alias("feature"), F.lit(i).alias("ord")) for i, x in enumerate(["f9", "f3", "f40", "f9"])])
    found = e.selected_features(s.raw_expr(spark, d), spark.range(1).select(F.inline(rows)))
    return found.select("section", "obs_id", *[_r(F.get("vector", i), name) for i, name in enumerate(("first", "second", "third"))])


_MANY = "mc AS (SELECT 's' || (vec_id % 4) AS section, vec_id AS obs_id, embedding::DOUBLE[] AS v, list_position(embedding, list_max(embedding)) - 1 AS cluster FROM embeddings), sz AS (SELECT cluster, count(*) AS n FROM mc GROUP BY cluster), kp AS (SELECT cluster FROM sz WHERE n >= 8 ORDER BY n DESC, cluster LIMIT 10)"


@query("w07_kept_clusters", f"WITH {_MANY} SELECT cluster, n FROM sz WHERE cluster IN (SELECT cluster FROM kp)")
def kept_clusters(spark: SparkSession, d: str) -> DataFrame:
    return e.kept_clusters(s.vectors(spark, d).withColumn("cluster", largest_axis("vector", 64)), 8, 10)


@query("c07_control_clusters", f"""WITH {_MANY}, ce AS (SELECT cluster, i, avg(v[i]) AS m FROM mc, unnest(generate_series(1, 64)) AS u(i) GROUP BY ALL), ds AS (SELECT a.cluster, b.cluster AS to_c, round(sum((a.m - b.m) ** 2), 9) AS d FROM ce a JOIN ce b USING (i) WHERE a.cluster NOT IN (SELECT cluster FROM kp) AND b.cluster IN (SELECT cluster FROM kp) GROUP BY ALL),
ne AS (SELECT cluster, first(to_c ORDER BY d, to_c) AS to_c FROM ds GROUP BY cluster), mv AS (SELECT section, obs_id, coalesce(to_c, mc.cluster) AS c FROM mc LEFT JOIN ne USING (cluster)), rn AS (SELECT c, row_number() OVER (ORDER BY count(*) DESC, c) - 1 AS no FROM mv GROUP BY c) SELECT section, obs_id, no AS cluster FROM mv JOIN rn USING (c)""")
def control_clusters(spark: SparkSession, d: str) -> DataFrame:
    v = s.vectors(spark, d).withColumn("cluster", largest_axis("vector", 64))
    return e.control_clusters(v, 8, 10).select("section", "obs_id", "cluster")


_SILHOUETTE = "ve AS (SELECT 's' || (vec_id % 4) AS section, vec_id AS obs_id, 'r' || label AS label, embedding::DOUBLE[] AS v FROM embeddings), ds AS (SELECT a.label, a.obs_id, a.section, b.section AS os, sum(list_distance(a.v, b.v)) AS d, count(*) AS n FROM ve a JOIN ve b ON a.label = b.label GROUP BY ALL), ab AS (SELECT label, obs_id, max(CASE WHEN section = os THEN d / greatest(n - 1, 1) END) AS a, min(CASE WHEN section != os THEN d / n END) AS b, max(CASE WHEN section = os THEN n END) AS own FROM ds GROUP BY ALL), si AS (SELECT label AS region, avg(CASE WHEN own <= 1 THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette, count(*) AS n_obs FROM ab WHERE b IS NOT NULL GROUP BY label)"


@query("a28_silhouette", f"WITH {_SILHOUETTE} SELECT region, round(silhouette, 6) AS silhouette, n_obs FROM si")
def silhouette(spark: SparkSession, d: str) -> DataFrame:
    return h.silhouette(s.vectors(spark, d)).select("region", _r("silhouette"), "n_obs")


@query("x01_heterogeneity_score")
def heterogeneity_score(spark: SparkSession, d: str) -> DataFrame:
    found = st.score_regions(_expr(spark, d), s.obs(spark, d), 200, **_LOOSE)
    return found["scores"].select("label", _r("adjusted_silhouette"), _r("adjusted_genes"), _r("score"), _r("scaled"))


@query("a29_region_silhouettes")
def region_silhouettes(spark: SparkSession, d: str) -> DataFrame:
    markers = _markers(spark, d)
    return h.region_silhouettes(_expr(spark, d), s.obs(spark, d), m.marker_union(markers, f.shared_features(markers)), 200)


_STABLE = f"{_MARKED}, prs AS (SELECT a.label, a.section AS sa, b.section AS sb, count(*) AS i FROM mk a JOIN mk b ON a.label = b.label AND a.feature = b.feature AND a.section < b.section GROUP BY ALL), szs AS (SELECT label, section, count(*) AS n FROM mk GROUP BY ALL), js AS (SELECT a.label, coalesce(i, 0) / (a.n + b.n - coalesce(i, 0)) AS j FROM szs a JOIN szs b ON a.label = b.label AND a.section < b.section LEFT JOIN prs ON prs.label = a.label AND sa = a.section AND sb = b.section), us AS (SELECT label, count(DISTINCT feature) AS union_size FROM mk GROUP BY label), sb AS (SELECT label, (1 - avg(j)) * ln(1 + union_size) / ln(1 + max(union_size) OVER ()) AS adjusted FROM us LEFT JOIN js USING (label) GROUP BY label, union_size)"
_SCORED = f"{_STABLE}, {_SILHOUETTE}, hs AS (SELECT sb.label, silhouette * adjusted AS score FROM si JOIN sb ON sb.label = si.region), hz AS (SELECT label, score, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS scaled FROM hs)"


def _observed_scores(spark: SparkSession, d: str) -> DataFrame:
    """A30 on silhouettes as they are, not held against permuted ones: what SQL can repeat."""
    seen = h.silhouette(s.vectors(spark, d)).select(F.col("region").alias("label"), F.col("silhouette").alias("adjusted"))
    return h.heterogeneity_score(seen, m.marker_stability(_markers(spark, d)))


@query("a30_observed_scores", f"WITH {_SCORED} SELECT label, round(score, 6) AS score, round(scaled, 6) AS scaled FROM hz")
def observed_scores(spark: SparkSession, d: str) -> DataFrame:
    return _observed_scores(spark, d).select("label", _r("score"), _r("scaled"))


@query("w05_heterogeneous_regions", f"WITH {_SCORED} SELECT label, round(scaled, 6) AS scaled, rank() OVER (ORDER BY scaled DESC) AS place FROM hz QUALIFY rank() OVER (ORDER BY scaled DESC) <= 3")
def heterogeneous_regions(spark: SparkSession, d: str) -> DataFrame:
    return h.heterogeneous_regions(_observed_scores(spark, d), top=3).select("label", _r("scaled"), "place")


#: Bounds under which the given vectors, which hold little structure, have markers.
_LOOSE: dict[str, float] = {"most_p": 1.0, "least_ratio": 0.9, "least_change": 1.0, "n": 20}
