"""Tree building and selection on small fixtures with known answers."""

import pytest
from pyspark.sql import functions as F

from loomspark.operators import assignment as a
from loomspark.operators import features as f
from loomspark.operators import heterogeneity as h
from loomspark.operators import markers as m
from loomspark.operators import raster as g
from loomspark.operators import regions as r


def test_tree_merges_latest_nodes():
    pairs = [("a", "b", 1.0), ("c", "d", 2.0), ("b", "c", 3.0), ("a", "c", 4.0), ("a", "d", 5.0), ("b", "d", 6.0)]
    merges = r.build_tree(pairs)
    assert [(x[1], x[2], x[3]) for x in merges] == [("a", "b", ["a", "b"]), ("c", "d", ["c", "d"]), ("node_1", "node_2", ["a", "b", "c", "d"])]
    assert r.build_tree([]) == []


def test_tree_has_2n_minus_1_nodes(spark):
    names = [f"r{i}" for i in range(6)]
    pairs = [(x, y, float((i * 7 + j * 3) % 15)) for i, x in enumerate(names) for j, y in enumerate(names) if x < y]
    table = r.tree_table(spark, spark.createDataFrame(pairs, "region_i string, region_j string, rank double"))
    paths = r.tree_paths(table).collect()
    assert len({p.node for p in paths}) == 2 * 6 - 1
    assert {p.node for p in paths if p.node.startswith("r")} == set(names)


def test_mid_ranks_share_ties(spark):
    from loomspark.operators.markers import rank_sum

    rows = [("s", f"l{i}", "f", float(v)) for i, v in enumerate((0, 1, 1, 3, 7, 7, 9))]
    got = {r.label: r.rank_sum for r in rank_sum(spark.createDataFrame(rows, "section string, label string, feature string, value double")).collect()}
    assert [got[f"l{i}"] for i in range(7)] == [1, 2.5, 2.5, 4, 5.5, 5.5, 7]


def test_ratio_of_zero_parts(spark):
    rows = [("s", i, "in" if i < 3 else "out", "only_in", 1.0 if i < 3 else 0.0) for i in range(6)]
    rows += [("s", i, "in" if i < 3 else "out", "never", 0.0) for i in range(6)]
    rows += [("s", i, "in" if i < 3 else "out", "always", 2.0) for i in range(6)]
    stats = m.group_statistics(spark.createDataFrame(rows, "section string, obs_id int, label string, feature string, value double"))
    ratio = {x.feature: x.ratio for x in stats.where("label = 'in'").collect()}
    assert ratio == {"only_in": float("inf"), "never": None, "always": 1.0}
    kept = {x.feature for x in m.select_markers(stats.where("label = 'in'"), least_ratio=1.0, least_change=0.0).collect()}
    assert kept == {"only_in", "always"}


def test_adjusted_p_is_monotone(spark):
    df = spark.createDataFrame([("t", float(p)) for p in (0.01, 0.04, 0.03, 0.005, 0.5)], "t string, p double")
    got = {x.p: x.p_adj for x in m.adjust(df, "t").collect()}
    assert got == pytest.approx({0.005: 0.025, 0.01: 0.025, 0.03: 0.05, 0.04: 0.05, 0.5: 0.5})


def test_ks_of_equal_and_disjoint_samples(spark):
    rows = [(s, i, "x", "same", float(i)) for s in ("a", "q") for i in range(5)]
    rows += [("a", i, "x", "apart", float(i)) for i in range(5)] + [("q", i, "x", "apart", float(i + 10)) for i in range(5)]
    got = {x.feature: x.similarity for x in r.ks_similarity(spark.createDataFrame(rows, "section string, obs_id int, label string, feature string, value double"), "q").collect()}
    assert got["same"] == pytest.approx(1) and got["apart"] == pytest.approx(0)


def test_constant_features_scale_to_zero(spark):
    df = spark.createDataFrame([("s", i, "x", "c", 4.0) for i in range(3)], "section string, obs_id int, label string, feature string, value double")
    assert {x.value for x in f.scale_min_max(df).collect()} == {0.0}
    assert {x.value for x in f.standardise(df).collect()} == {0.0}


def test_clusters_below_size_and_at_bound_stay_out(spark):
    table = spark.createDataFrame([(0, 20, "l", 0, 1, 5.0, 0.1), (0, 20, "r", 1, 1, 5.0, 0.9), (1, 5, "l", 0, 5, 100.0, 0.5), (1, 5, "r", 1, 0, 0.0, 0.0), (2, 20, "l", 0, 4, 20.0, 0.4), (2, 20, "r", 1, 4, 20.0, 0.1)], "cluster int, size int, branch string, ord int, n int, percent double, share double")
    assert {x.cluster: x.branch for x in a.assign_clusters(table).collect()} == {0: "novel_cluster", 2: "l"}
    assert {x.cluster: x.branch for x in a.assign_clusters(table, cutoff=5.0).collect()} == {0: "novel_cluster", 2: "l"}


def test_rand_index_of_equal_and_single_classes(spark):
    df = spark.createDataFrame([("s", i % 3, i % 3, 0) for i in range(30)], "section string, a int, b int, c int")
    assert a.adjusted_rand(df, "a", "b", "section").first().ari == pytest.approx(1)
    assert a.adjusted_rand(df, "a", "c", "section").first().ari == pytest.approx(0)
    assert a.adjusted_rand(df, "c", "c", "section").first().ari == 1


def test_transfer_of_unknown_observations_fails(spark):
    have = spark.createDataFrame([("s", 1, "x")], "section string, obs_id int, label string")
    want = spark.createDataFrame([("s", 1), ("s", 2)], "section string, obs_id int")
    with pytest.raises(Exception, match="without a source"):
        a.transfer_columns(have, want, ["label"]).collect()
    assert [x.obs_id for x in a.missing_observations(want, have).collect()] == [2]


def test_spot_half_off_the_grid(spark):
    grid = spark.createDataFrame([("s", x, y, 1.0) for x in range(4) for y in range(4)], "section string, gx int, gy int, value double")
    spot = spark.createDataFrame([("s", 1, 0.0, 2.0)], "section string, obs_id int, x double, y double")
    assert g.grid_to_spots(spot, grid, 2.0, 1.0, "overlap").first().value == pytest.approx(1)
    assert g.grid_to_spots(spot, grid, 2.0, 1.0, "spot").first().value == pytest.approx(0.5)


def test_marker_sets_equal_disjoint_and_single(spark):
    rows = [("same", s, x) for s in "ab" for x in "xy"] + [("apart", "a", "x"), ("apart", "b", "y"), ("once", "a", "x")]
    got = {x.label: x.stability for x in m.marker_stability(spark.createDataFrame(rows, "label string, section string, feature string")).collect()}
    assert got == {"same": 1.0, "apart": 0.0, "once": None}


def test_weights_of_components(spark):
    parts = spark.createDataFrame([("s", "gene", "a", "b", 0.5), ("s", "spatial", "a", "b", 1.0)], "section string, component string, region_i string, region_j string, distance double")
    assert r.combine_distances(parts, {"gene": 2.0, "spatial": 1.0}).first().distance == pytest.approx(2)
    assert r.combine_distances(parts, {"gene": 1.0, "image": 1.0}).count() == 0
    with pytest.raises(ValueError):
        r.combine_distances(parts, {"gene": 0.0})


def test_scores_scale_and_ties(spark):
    sil = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", 0.1)], "label string, adjusted double")
    scored = h.heterogeneity_score(sil, sil)
    assert {x.label: round(x.scaled, 6) for x in scored.collect()} == {"a": 1.0, "b": 1.0, "c": 0.0}
    assert h.heterogeneous_regions(scored, top=1).count() == 2 and h.heterogeneous_regions(scored, top=1, ties=False).count() == 1
    flat = h.heterogeneity_score(sil.where("label != 'c'"), sil)
    assert {x.scaled for x in flat.select(F.col("scaled")).collect()} == {0.0}


def test_a_section_without_a_modality_counts_by_the_others(spark):
    places = [("a", 0.0), ("b", 1.0), ("c", 2.0)]
    obs = spark.createDataFrame([(s, i, label, x, 0.0) for s in ("s0", "s1") for i, (label, x) in enumerate(places)], "section string, obs_id long, label string, x double, y double")
    values = {"g": {"a": 0.0, "b": 1.0, "c": 4.0}, "f6": {"a": 0.0, "b": 3.0, "c": 1.0}}
    expr = obs.crossJoin(spark.createDataFrame([(m, f, label, v) for m, f in (("gene", "g"), ("image", "f6")) for label, v in values[f].items()], "modality string, feature string, l string, value double")).where("l = label").drop("l")
    features = spark.createDataFrame([("s0", "gene", "g"), ("s1", "gene", "g"), ("s0", "image", "f6")], "section string, modality string, feature string")
    ranked = r.infer_tree(expr, obs, features, {"gene": 1.0, "image": 0.5, "Spatial": 0.0}, 3.0)["ranked"]
    got = {(x.region_i, x.region_j): x.distance for x in ranked.collect()}
    gene, image = {"ab": 0.0, "ac": 1.0, "bc": 2 / 3}, {"ab": 1.0, "ac": 0.0, "bc": 0.5}
    assert got == pytest.approx({tuple(k): gene[k] + 0.25 * image[k] for k in gene})
