"""Sessions of label transfer, features of splits, and what the stages write."""

import pytest
from pyspark.sql import functions as F

from loomspark.operators import assignment as a
from loomspark.operators import config_choice as cc
from loomspark.operators import hierarchy_features as hf
from loomspark.operators import transfer as t
from loomspark.sources import sinks, tables

TREE = [("root", "low", "c", ["a", "b"], ["c"]), ("low", "a", "b", ["a"], ["b"])]
CENTRES = {"a": [0.0, 0.0, 5.0], "b": [0.0, 5.0, 0.0], "c": [9.0, 0.0, 0.0]}


@pytest.fixture(scope="module")
def sides(spark):
    rows = []
    for i in range(240):
        label = "abc"[i % 3]
        wiggle = [((i * 37 + k * 11) % 17) / 10 for k in range(3)]
        rows.append((f"s{i % 4}", i, label, [c + w for c, w in zip(CENTRES[label], wiggle, strict=True)]))
    df = spark.createDataFrame(rows, "section string, obs_id long, label string, vector array<double>")
    return df.where("section != 's3'"), df.where("section = 's3'")


@pytest.mark.parametrize("start", [t.transfer_single, t.transfer_multi])
def test_labels_reach_the_leaves(sides, start):
    reference, query = sides
    session = start(reference, query, TREE, t.TransferSettings(least_cluster=3, seeds=3, components=3)).run_auto()
    truth = {r.obs_id: r.label for r in query.collect()}
    found = {r.obs_id: r.label for r in session.labels().collect()}
    assert set(found) == set(truth) and sum(found[i] == truth[i] for i in truth) > 0.9 * len(truth)
    assert session.ended == {"a": "leaf", "b": "leaf", "c": "leaf"}
    rounds = {r.node: r for r in session.summary().collect()}
    assert rounds["root"].n_obs == len(truth) and rounds["low"].n_obs == rounds["root"].n_child_1


def test_a_second_commit_takes_the_subtree_back(sides):
    reference, query = sides
    session = t.transfer_single(reference, query, TREE, t.TransferSettings(least_cluster=3, seeds=2, components=3)).run_auto()
    given = query.select(F.lit("root").alias("node"), "section", "obs_id", F.when(F.col("label") == "c", "c").otherwise("low").alias("branch"))
    before = session.preview(["root"]) if session.membership.where("node = 'root'").count() > 5 else None
    assert before is None or before.count()
    session.run_round(["root"], given)
    assert [r["node"] for r in session.rounds] == ["root"] and session.pending() == ["low"]
    sizes = {r.node: r["count"] for r in session.membership.groupBy("node").count().collect()}
    assert sizes == {"c": query.where("label = 'c'").count(), "low": query.where("label != 'c'").count()}


@pytest.mark.parametrize("node", ["root", "low"])
def test_a_node_without_features_is_not_split(spark, sides, node):
    reference, query = sides
    long = lambda df: df.select("section", "obs_id", "label", F.posexplode("vector").alias("p", "value")).withColumn("feature", F.concat(F.lit("f"), F.col("p").cast("string"))).drop("p")
    features = spark.createDataFrame([(n, f"f{i}", i + 1) for n in ("root", "low") if n != node for i in range(3)], "parent string, feature string, place int")
    session = t.transfer_multi(reference, query, TREE, t.TransferSettings(least_cluster=3, seeds=3, components=3), long(reference).union(long(query)), features).run_auto()
    assert session.ended[node] == "no features" and [r["node"] for r in session.rounds] == ([] if node == "root" else ["root"])
    held = {r.label for r in session.labels().collect()}
    assert session.labels().count() == query.count() and held == {"root"} if node == "root" else {"low", "c"} <= held


def test_quantile_session(spark, sides):
    reference, query = sides
    long = lambda df: df.select("section", "obs_id", "label", F.posexplode("vector").alias("p", "value")).withColumn("feature", F.concat(F.lit("f"), F.col("p").cast("string"))).drop("p")
    expr = long(reference).union(long(query))
    rows = [("root", "low_vs_c", "f1"), ("root", "low_vs_c", "f2"), ("root", "c_vs_low", "f0"), ("low", "a_vs_b", "f2"), ("low", "b_vs_a", "f1")]
    features = spark.createDataFrame(rows, "parent string, direction string, feature string")
    session = t.transfer_quantile(reference, query, expr, features, TREE, t.TransferSettings(least_cluster=3, seeds=3, components=3)).run_auto()
    truth = {r.obs_id: r.label for r in query.collect()}
    found = {r.obs_id: r.label for r in session.labels().collect()}
    assert sum(found[i] == truth[i] for i in truth) > 0.9 * len(truth)


def test_cluster_counts_and_novel_policy():
    s = t.TransferSettings
    assert [t.cluster_count(n, 100, s()) for n in (1, 2, 5)] == [2, 3, 6]
    assert t.cluster_count(3, 4, s()) == 4 and t.cluster_count(3, 100, s(clusters="legacy", boundary_cluster=True)) == 7
    assert t.cluster_count(9, 100, s(clusters=1)) == 2 and t.cluster_count(1, 100, s(least_clusters=5)) == 5
    assert t.novel_allowed((["a"], ["b", "c"])) and not t.novel_allowed((["a", "d"], ["b", "c"])) and not t.novel_allowed((["a"], ["b"]), False)


def test_one_sided_assignments_are_adjusted(spark):
    table = spark.createDataFrame([(0, 50, "x", 0, 40, 80.0, 0.5), (0, 50, "y", 1, 30, 60.0, 1.0), (1, 50, "x", 0, 40, 80.0, 0.5), (1, 50, "y", 1, 0, 0.0, 0.0)], "cluster int, size int, branch string, ord int, n int, percent double, share double")
    for ratio, wanted in ((5.0, {0: ("x", False), 1: ("x", False)}), (20.0, {0: ("y", True), 1: ("x", True)})):
        ratios = spark.createDataFrame([(ratio,)], "ratio double")
        assert {r.cluster: (r.branch, r.adjusted) for r in a.adjust_one_sided(table, ratios, 10.0).collect()} == wanted


def test_ratios_skip_empty_sections(spark):
    rows = [("p", "t")] * 4 + [("p", "o")] * 2 + [("q", "t")] * 3 + [("r", "o")] * 3 + [("r", "t")]
    df = spark.createDataFrame(rows, "section string, side string")
    one = lambda mode, skip=True: a.side_ratio(df, "t", "o", mode, skip).first().ratio
    assert (one("pooled"), one("max"), one("mean")) == (8 / 5, 3.0, 2.5) and one("max", False) == float("inf")


def test_guides(spark):
    splits = spark.createDataFrame([(p, x, y, i, j) for p, x, y, i, j in TREE], "parent string, child_1 string, child_2 string, child_1_regions array<string>, child_2_regions array<string>")
    sections = spark.createDataFrame([("s0",), ("s1",)], "section string")
    guide = spark.createDataFrame([("root", ["s1"]), ("low", [])], "parent string, sections array<string>")
    assert [tuple(r) for r in hf.guide_references(sections, splits, guide).collect()] == [("root", "s1")]
    assert hf.guide_references(sections, splits).count() == 4
    wrong = spark.createDataFrame([("root", ["s9"])], "parent string, sections array<string>")
    with pytest.raises(Exception, match="unknown section"):
        hf.guide_references(sections, splits, wrong).collect()
    assert {tuple(r) for r in hf.guide_references(sections, splits, wrong, strict=False).collect()} == {("low", "s0"), ("low", "s1")}
    sides = hf.split_sides(splits)
    assert {r.direction for r in sides.collect()} == {"low_vs_c", "c_vs_low", "a_vs_b", "b_vs_a"}
    with pytest.raises(KeyError):
        hf.direction_features(spark.createDataFrame([], "section string, parent string, direction string, feature string, place int"), "root", "low_vs_c", strict=True)


def test_choice_of_modalities_and_methods(spark):
    means = spark.createDataFrame([("Image", 0.5), ("Gene", 0.41), ("Protein", 0.2)], "modality string, mean double")
    assert cc.select_modalities(means) == ["Image", "Gene"] and cc.select_modalities(means, order=["Gene", "Image"]) == ["Gene", "Image"]
    assert cc.select_modalities(means, hard=0.9) == ["Gene"] and cc.select_modalities(means, 0.1, criterion="hard") == ["Image", "Gene", "Protein"]
    methods = spark.createDataFrame([("pca", 0.2), ("selected_features", 0.2)], "method string, mean double")
    assert cc.best_method(methods, ["selected_features", "pca"]) == "selected_features"


def test_what_is_written_comes_back(spark, sides, tmp_path):
    reference, query = sides
    session = t.transfer_single(reference, query, TREE, t.TransferSettings(least_cluster=3, seeds=1, components=3)).run_auto()
    sinks.write_transfer(session, f"{tmp_path}/transfer")
    back = spark.read.parquet(f"{tmp_path}/transfer/final_labels")
    assert {tuple(r) for r in back.select("obs_id", "label").collect()} == {tuple(r) for r in session.labels().select("obs_id", "label").collect()}
    assert spark.read.parquet(f"{tmp_path}/transfer/round_summary").count() == 2
    (tmp_path / "img").mkdir()
    for name in ("s0.png", "s1.tif"):
        (tmp_path / "img" / name).write_bytes(b"x")
    files = {r.section: r.path.rpartition("/")[2] for r in tables.section_files(spark, f"{tmp_path}/img/{{section}}.{{ext}}", ["s0", "s1"]).collect()}
    assert files == {"s0": "s0.png", "s1": "s1.tif"}
    with pytest.raises(FileNotFoundError):
        tables.section_files(spark, f"{tmp_path}/img/{{section}}.{{ext}}", ["s0", "s7"])


def test_features_must_cover_the_observations(spark):
    obs = spark.createDataFrame([("s", 1, 0.0, 0.0), ("s", 2, 1.0, 0.0)], "section string, obs_id int, x double, y double")
    stored = spark.createDataFrame([("s", 1, "f", 3.0, 7), ("s", 9, "f", 4.0, 7)], "section string, obs_id int, feature string, value double, kmeans_5 int")
    assert [r.value for r in tables.align_features(stored, obs.where("obs_id = 1")).collect()] == [3.0]
    with pytest.raises(Exception, match="no features for observation 2"):
        tables.align_features(stored, obs).collect()
    with pytest.raises(Exception, match="a member has no row"):
        tables.active_observations(stored, obs).collect()


@pytest.fixture(scope="module")
def noisy(spark):
    """Observations on a plane whose classes stand out in a few features of their own, and not in the others."""
    own = {"a": ["f2"], "b": ["f3"], "c": ["f0", "f1"]}
    cells, values = [], []
    for i in range(480):
        section, label = f"s{i % 4}", "abc"[(i // 4) % 40 // 14 % 3]
        cells.append((section, i // 4, label, float((i // 4) % 12), float((i // 4) // 12), [0.0]))
        for k in range(8):
            noise = ((i * 7919 + k * 104729) % 1009) / 1009
            values.append((section, i // 4, label, f"f{k}", (6.0 if f"f{k}" in own[label] else 0.0) + noise * (1.0 if k < 4 else 9.0)))
    obs = spark.createDataFrame(cells, "section string, obs_id long, label string, x double, y double, vector array<double>")
    expr = spark.createDataFrame(values, "section string, obs_id long, label string, feature string, value double")
    return obs, expr


def test_rounds_embed_a_nodes_own_features(spark, noisy):
    obs, expr = noisy
    splits = spark.createDataFrame([(p, x, y, i, j) for p, x, y, i, j in TREE], "parent string, child_1 string, child_2 string, child_1_regions array<string>, child_2_regions array<string>")
    known = expr.where("section != 's3'")
    found = hf.hierarchical_features(known, splits, most_p=0.05, least_ratio=1.0, least_change=1.5, n=3)
    lists = {p: sorted(r.feature for r in found["clustering"].collect() if r.parent == p) for p in ("root", "low")}
    assert lists["low"] == ["f2", "f3"] and {"f0", "f1"} <= set(lists["root"])
    reference, query = obs.where("section != 's3'"), obs.where("section = 's3'")
    guide = hf.guide_references(reference.select("section").distinct(), splits, spark.createDataFrame([("low", ["s1"])], "parent string, sections array<string>"))
    settings = t.TransferSettings(least_cluster=3, seeds=3, components=3, reassign=True)
    session = t.transfer_multi(reference, query, TREE, settings, expr, found["clustering"], guide).run_auto()
    truth = {r.obs_id: r.label for r in query.collect()}
    got = {r.obs_id: r.label for r in session.labels().collect()}
    assert set(got) == set(truth) and sum(got[i] == truth[i] for i in truth) > 0.9 * len(truth)
    rounds = {r.node: r for r in session.summary().collect()}
    assert rounds["root"].n_obs == len(truth) and all(r.n_obs == r.n_child_1 + r.n_child_2 + r.n_unresolved for r in rounds.values())
    members = reference.where("section = 's0' and obs_id < 3").select(F.lit("low").alias("node"), "section", "obs_id").union(query.where("obs_id = 1").select(F.lit("nowhere"), "section", "obs_id"))
    sparse = expr.where("feature != 'f3' or obs_id > 0")
    rows = {r.obs_id: r.vector for r in t.node_vectors(members, sparse, found["clustering"]).collect()}
    assert set(rows) == {0, 1, 2} and {len(v) for v in rows.values()} == {2} and 0.0 in rows[0]


def test_novel_clusters_go_to_their_neighbours(spark, noisy):
    obs, expr = noisy
    reference, query = obs.where("section = 's0'"), obs.where("section = 's3'")
    lone = expr.withColumn("value", F.when((F.col("section") == "s3") & (F.col("obs_id") >= 100), F.lit(60.0)).otherwise(F.col("value")))
    lists = spark.createDataFrame([(n, f, i) for n, fs in (("root", ["f0", "f1", "f2", "f3"]), ("low", ["f2", "f3"])) for i, f in enumerate(fs)], "parent string, feature string, place int")
    odd = query.where("obs_id >= 100").count()
    kept = {}
    for reassign in (False, True):
        settings = t.TransferSettings(neighbours=2, least_cluster=3, seeds=3, components=3, clusters=4, novel=False, reassign=reassign, reassign_neighbours=9, one_sided_ratio=None)
        moved = t.transfer_single(reference, query, TREE, settings, lone, lists).preview(["root"])
        kept[reassign] = {r.obs_id: r.branch for r in moved.collect()}
        assert len(kept[reassign]) == query.count()
    free = {i for i, b in kept[False].items() if b is None}
    assert len(free) == odd and all(i >= 100 for i in free)
    assert None not in kept[True].values() and all(kept[True][i] == b for i, b in kept[False].items() if b is not None)


def test_a_rounds_boundary_cluster_is_dealt_to_the_others(spark, noisy):
    obs, _ = noisy
    query = obs.where("section = 's3'")
    image = query.select("section", "obs_id", F.lit("rgb").alias("feature"), F.when(F.col("label") == "b", 0.01).otherwise(F.col("obs_id") % 3 + 5.0).alias("value"))
    session = t.Session(query, obs.where("section = 's0'"), TREE, lambda active, sides: active, t.TransferSettings(boundary={"least": 5, "k": 9, "smooth": False}), image=image)
    clusters = query.select(F.lit("root").alias("node"), "section", "obs_id", F.expr("int(ascii(label)) - 97").alias("cluster"))
    found = {r.obs_id: r.cluster for r in session._refined(clusters).collect()}
    truth = {r.obs_id: r.label for r in query.collect()}
    assert set(found) == set(truth) and set(found.values()) == {0, 2} and all(found[i] == ord(x) - 97 for i, x in truth.items() if x != "b")
