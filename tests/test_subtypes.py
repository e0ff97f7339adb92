"""Heterogeneity, subtypes, choices of clustering and post-processing on planted groups, and the sinks of their stages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.functions import blocks
from loomspark.operators import config_choice as cc
from loomspark.operators import embedding as e
from loomspark.operators import heterogeneity as h
from loomspark.operators import neighbours as n
from loomspark.operators import postprocess as pp
from loomspark.operators import subtypes as st
from loomspark.sources import sinks

GENES = [f"g{i}" for i in range(8)]


@pytest.fixture(scope="module")
def planted(spark):
    """Two sections that share ids. Region "mix" has two subtypes and differs by section, region "same" does neither."""
    rng, rows, cells = np.random.default_rng(9), [], []
    for s in (0, 1):
        for i in range(80):
            label, part = ("mix", i % 2) if i < 40 else ("same", 0)
            value = rng.gamma(2.0, 0.2, 8)
            value[0 if label == "mix" else 1] += 5
            if label == "mix":
                value[2 + part] += 6
                value[4] += 5 * s
            cells.append((f"s{s}", i, label, float(i % 10), float(i // 10)))
            rows += [(f"s{s}", i, label, g, float(v)) for g, v in zip(GENES, value, strict=True)]
    expr = spark.createDataFrame(rows, "section string, obs_id long, label string, feature string, value double")
    return spark.createDataFrame(cells, "section string, obs_id long, label string, x double, y double"), expr


BOUNDS = {"most_p": 0.05, "least_ratio": 1.0, "least_change": 1.2, "n": 6}


def test_scores_tell_mixed_regions_from_even_ones(spark, planted):
    obs, expr = planted
    found = st.score_regions(expr, obs, 60, **BOUNDS)
    genes = {(r.label, r.feature) for r in found["genes"].collect()}
    assert {("mix", "g0"), ("mix", "g2"), ("mix", "g3"), ("same", "g1")} <= genes
    vectors = {label: sorted(f for x, f in genes if x == label) for label in ("mix", "same")}
    wide = {}
    for r in expr.collect():
        wide.setdefault((r.label, r.section, r.obs_id), {})[r.feature] = r.value
    for r in found["silhouettes"].collect():
        keys = [k for k in wide if k[0] == r.label]
        x = np.array([[wide[k][f] for f in vectors[r.label]] for k in keys])
        own = np.array([k[1] == "s0" for k in keys])
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        same = own[:, None] == own[None]
        inside, outside = (d * same).sum(axis=1) / (same.sum(axis=1) - 1), (d * ~same).sum(axis=1) / (~same).sum(axis=1)
        assert r.n_spots == len(keys) and r.n_genes == len(vectors[r.label])
        assert abs(r.observed - ((outside - inside) / np.maximum(inside, outside)).mean()) < 1e-9
    by = {r.label: r for r in found["silhouettes"].collect()}
    assert by["same"].p > 0.05 and abs(by["same"].adjusted) < 0.05
    few = h.region_silhouettes(expr, obs, found["genes"], 5, least=1_000)
    assert all(r.observed is None and r.n_spots == 80 for r in few.where("label = 'mix'").collect())
    with pytest.raises(ValueError, match="s1"):
        st.score_regions(expr.withColumn("value", F.when(F.col("section") == "s1", 0.0).otherwise(F.col("value"))), obs, 5, **BOUNDS)


def truth(r):
    return r.obs_id % 2


def agrees(rows):
    pairs = {(truth(r), r.cluster) for r in rows}
    return len(pairs) == 2 and len({c for _, c in pairs}) == 2


def test_subtypes_of_the_mixed_region(spark, planted):
    obs, expr = planted
    genes = spark.createDataFrame([("mix", g) for g in ("g0", "g2", "g3")], "label string, feature string")
    own = st.section_subtypes(h.region_vectors(expr, genes), 2, 1, seeds=3)
    rows = own.collect()
    assert len(rows) == 80 and all(agrees([r for r in rows if r.section == s]) for s in ("s0", "s1"))
    marks = {(r.section, r.subtype, r.feature) for r in st.subtype_markers(expr, own, **BOUNDS).collect()}
    assert {(s, f) for s, _, f in marks} >= {(s, g) for s in ("s0", "s1") for g in ("g2", "g3")}
    joint = st.shared_subtypes(expr, genes, 4, seeds=3)
    rows = joint.collect()
    assert len(rows) == 80 and {r.k for r in rows} == {2} and agrees(rows)
    merged, agreed = st.shared_markers(expr, joint, 2, **BOUNDS)
    assert {r.feature for r in agreed.collect()} >= {"g2", "g3"} and {r.feature for r in merged.collect()} >= {"g2", "g3"}


def test_whole_pipeline(spark, planted, tmp_path):
    obs, expr = planted
    found = st.heterogeneity_pipeline(expr, obs, 20, None, 1, 3, 2, **BOUNDS)
    status = {r.label: r.status for r in found["status"].collect()}
    assert len(status) == 1 and set(status.values()) == {"success"}
    assert found["shared_subtypes"].count() == 80 and {r.label for r in found["section_subtypes"].collect()} == set(status)
    sinks.write_heterogeneity({name: found[name] for name in ("scores", "status", "shared_subtypes")}, f"{tmp_path}/h")
    back = spark.read.parquet(*[str(p) for p in (tmp_path / "h").iterdir() if p.name == "shared_subtypes"])
    assert {tuple(r) for r in back.select("section", "obs_id", "cluster").collect()} == {tuple(r) for r in found["shared_subtypes"].select("section", "obs_id", "cluster").collect()}


def test_clusterings_are_scored_and_chosen(spark, planted):
    obs, expr = planted
    good = expr.where("feature in ('g0', 'g1')").groupBy("section", "obs_id").agg(F.array(F.sum(F.when(F.col("feature") == "g0", F.col("value"))), F.sum(F.when(F.col("feature") == "g1", F.col("value")))).alias("vector"))
    poor = obs.select("section", "obs_id", F.array((F.col("obs_id") * 7 % 5).cast("double"), (F.col("obs_id") * 3 % 4).cast("double")).alias("vector"))
    both = good.withColumn("modality", F.lit("Gene")).unionByName(poor.withColumn("modality", F.lit("Image")))
    scores = cc.clustering_scores(both, obs, "modality", 2, seeds=3)
    by = {(r.modality, r.section): r for r in scores.collect()}
    assert len(by) == 4 and all(by["Gene", s].ari > 0.95 and abs(by["Image", s].ari) < 0.3 and by["Gene", s].n_obs == 80 for s in ("s0", "s1"))
    few = cc.clustering_scores(both, obs.where("obs_id < 3"), "modality", 2)
    assert {r.status for r in few.collect()} == {"fewer than two labels"}
    chosen = cc.clustering_config(scores, scores.withColumnRenamed("modality", "method"), ["Image", "Gene"])
    assert chosen["modalities"] == ["Gene"] and chosen["dim_reduction_method"] == "Gene"


def test_modalities_side_by_side(spark):
    one = spark.createDataFrame([("s", 1, [1.0]), ("s", 2, [2.0]), ("t", 1, [3.0])], "section string, obs_id long, vector array<double>")
    two = spark.createDataFrame([("s", 1, [7.0, 8.0]), ("t", 1, [9.0, 0.0])], "section string, obs_id long, vector array<double>")
    assert sorted((r.section, r.obs_id, r.vector) for r in e.join_modalities([one, two]).collect()) == [("s", 1, [1.0, 7.0, 8.0]), ("t", 1, [3.0, 9.0, 0.0])]
    with pytest.raises(Exception, match="lacks observation 2"):
        e.join_modalities([one, two], strict=True).collect()


def test_postprocess_and_weighted_votes(spark, planted):
    obs, expr = planted
    clusters = obs.withColumn("cluster", F.when(F.col("label") == "mix", 0).otherwise(F.when(F.col("obs_id") == 55, 2).otherwise(1)))
    image = clusters.select("section", "obs_id", F.lit("rgb").alias("feature"), F.when(F.col("cluster") == 2, 0.0).otherwise(4.0).alias("value"))
    features = spark.createDataFrame([("up", "g2", 0), ("down", "g3", 0)], "direction string, feature string, place int")
    options = {"least": 1, "k": 5, "smooth": False}
    for _ in range(2):  # the caller's options stay as they are
        found = pp.postprocess(expr, clusters, image, features, options, {"n_first": 2, "least": 20, "components": 2, "seeds": 2, "most": 2, "method": "k_means"}).collect()
    assert options == {"least": 1, "k": 5, "smooth": False}
    by = {(r.section, r.obs_id): r for r in found}
    assert len(by) == 160 and by["s0", 55].initial == "2" and by["s0", 55].refined == "1"
    parts = {(i % 2, by[s, i].final) for s in ("s0", "s1") for i in range(40)}
    assert len(parts) == 2 and {f for _, f in parts} == {"0_0", "0_1"}
    points = spark.createDataFrame([("s", 0, 0.0, 0.0)], "section string, obs_id long, x double, y double")
    around = spark.createDataFrame([("s", 1, 0.1, 0.0, "near"), ("s", 2, 2.0, 0.0, "far"), ("s", 3, 0.0, 2.0, "far")], "section string, obs_id long, x double, y double, label string")
    assert [n.nearest_majority(points, around, 3, w).first().label for w in (False, True)] == ["far", "near"]


def test_trees_refined_labels_and_choices_come_back(spark, planted, tmp_path):
    obs, _ = planted
    table = lambda name: spark.createDataFrame([("s0", name, 1.5), ("s1", name, 2.5)], "section string, name string, value double")
    sinks.write_tree({name: table(name) for name in ("components", "ranked", "splits")}, obs, f"{tmp_path}/tree")
    assert {r.section: r.n_obs for r in spark.read.parquet(f"{tmp_path}/tree/sizes").collect()} == {"s0": 80, "s1": 80}
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/tree/ranks").select("section", "name", "value").collect()} == {("s0", "ranked", 1.5), ("s1", "ranked", 2.5)}
    odd = obs.withColumn("label", F.when((F.col("section") == "s0") & (F.col("obs_id") == 55), "odd").otherwise(F.col("label")))
    sinks.write_refined(odd, obs, f"{tmp_path}/refined")
    back = {(r.section, r.obs_id): r for r in spark.read.parquet(f"{tmp_path}/refined/refined_labels").collect()}
    assert len(back) == 160 and (back["s0", 55].initial, back["s0", 55].refined) == ("odd", "same") and back["s1", 2].x == 2.0
    scores = spark.createDataFrame([("Gene", 0.5)], "modality string, mean double")
    sinks.write_clustering_config({"modalities": ["Gene", "Image"], "dim_reduction_method": "pca", "modality_scores": scores, "method_scores": scores}, f"{tmp_path}/config", spark)
    assert tuple(spark.read.parquet(f"{tmp_path}/config/chosen").first()) == ("Gene;Image", "pca")


def test_a_block_travels_a_few_times_however_many_it_meets(spark, monkeypatch):
    monkeypatch.setattr(blocks, "LANES", 3)
    monkeypatch.setattr(blocks, "SPAN", 16)
    table = spark.createDataFrame([(key, i) for key, n in (("a", 40), ("b", 2)) for i in range(n)], "key string, own int")
    left, right, tasks = blocks.sent(table, table, "key")
    assert left.count() == 40 * 3 + 2 and right.count() == 40 * 3 + 2 * 2 and tasks == 3 * 3 + 2
    pairs = blocks.block_pairs(table, table, "key")
    assert pairs.count() == pairs.select("key", "own", "own_b").distinct().count() == 40 * 40 + 4


def test_silhouettes_over_many_blocks_and_spans(spark, monkeypatch):
    monkeypatch.setattr(blocks, "LANES", 3)
    monkeypatch.setattr(blocks, "SPAN", 2)
    r = np.random.default_rng(3)
    x, g = r.normal(size=(120, 4)), np.arange(120) % 3
    drawn = np.stack([g, *[r.permutation(g) for _ in range(30)]], axis=1)  # more replicates than a chunk
    rows = [("m", i, x[i].tolist(), drawn[i].tolist()) for i in range(120)]
    found = h._replicate_silhouettes(spark.createDataFrame(rows, "region string, obs_id long, vector array<double>, groups array<int>"), block_rows=16)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    got = {row.replicate: row for row in found.collect()}
    assert sorted(got) == list(range(31))
    for k, row in got.items():
        of = np.stack([d[:, drawn[:, k] == c].sum(axis=1) for c in range(3)], axis=1)
        own = np.arange(3)[None] == drawn[:, k : k + 1]
        inside, outside = of[own] / 39, np.where(own, np.inf, of / 40).min(axis=1)
        assert row.n_obs == 120 and abs(row.silhouette - ((outside - inside) / np.maximum(inside, outside)).mean()) < 1e-9
