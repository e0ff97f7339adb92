"""Searches, embeddings and clusterings against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.operators import embedding as e
from loomspark.operators import features as f
from loomspark.operators import heterogeneity as h
from loomspark.operators import neighbours as n
from loomspark.operators import postprocess as pp
from loomspark.operators import subtypes as st


@pytest.fixture(scope="module")
def cloud(spark):
    r = np.random.default_rng(0)
    centres = r.normal(size=(4, 6)) * 4
    x = np.concatenate([centres[i % 4] + r.normal(size=6)[None] for i in range(240)])
    rows = [(f"s{i % 3}", i, f"r{i % 4}", [float(v) for v in x[i]], float(i % 20), float(i // 20)) for i in range(240)]
    return x, spark.createDataFrame(rows, "section string, obs_id long, label string, vector array<double>, x double, y double")


def nearest(x, queries, refs, k):
    out = {}
    for q in queries:
        d = np.round(np.sqrt(((x[refs] - x[q]) ** 2).sum(axis=1)), 9)
        out[q] = [refs[i] for i in np.lexsort((refs, d))[:k]]
    return out


@pytest.mark.parametrize("block_rows", [2048, 20])
def test_feature_neighbours_are_exact(cloud, block_rows):
    x, df = cloud
    refs, queries = [i for i in range(240) if i % 3 != 1], [i for i in range(240) if i % 3 == 1]
    for key, wanted in ((None, nearest(x, queries, refs, 7)), ("part", {q: v for p in (0, 1) for q, v in nearest(x, [i for i in queries if i % 2 == p], [i for i in refs if i % 2 == p], 7).items()})):
        named = df.withColumn("part", F.col("obs_id") % 2)
        got = {}
        for row in n.feature_neighbours(named.where("section = 's1'"), named.where("section != 's1'"), 7, key, block_rows=block_rows).orderBy("query_id", "place").collect():
            got.setdefault(row.query_id, []).append(row.ref_id)
        assert got == wanted


def test_cosine_and_few_references(cloud):
    x, df = cloud
    rows = n.feature_neighbours(df.where("obs_id < 5"), df.where("obs_id between 10 and 12"), 7, metric="cosine").collect()
    assert len(rows) == 15
    for row in rows:
        a, b = x[row.query_id], x[row.ref_id]
        assert row.distance == pytest.approx(1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-8)
    assert n.feature_neighbours(df.where("obs_id < 5"), df.limit(0), 3).count() == 0


def test_distance_quantiles(cloud, monkeypatch):
    _, df = cloud
    monkeypatch.setattr(n, "BLOCK_ROWS", 16)
    other = df.where("obs_id % 2 = 0")
    got = {r.section: r.radius for r in n.distance_quantile(df, other, k=9).collect()}
    inner = {r.section: r.radius for r in n.distance_quantile(df, df, q=0.37, own=True).collect()}
    for s in range(3):
        at = np.array([(i % 20, i // 20) for i in range(240) if i % 3 == s], dtype=float)
        even = np.array([(i % 20, i // 20) for i in range(240) if i % 3 == s and i % 2 == 0], dtype=float)
        d = np.sqrt(((at[:, None] - even[None]) ** 2).sum(axis=2))
        assert got[f"s{s}"] == pytest.approx(np.quantile(d, 9 / len(even)))
        own = np.sqrt(((at[:, None] - at[None]) ** 2).sum(axis=2))[np.triu_indices(len(at), 1)]
        assert inner[f"s{s}"] == pytest.approx(np.quantile(own, 0.37))


def test_components_explain_the_most(cloud):
    x, df = cloud
    rows = e.group_components(df, "section", 3).collect()
    for s in range(3):
        own = [r for r in rows if r.section == f"s{s}"]
        scores = np.array([r.pca for r in sorted(own, key=lambda r: r.obs_id)])
        centred = x[s::3] - x[s::3].mean(axis=0)
        singular = np.linalg.svd(centred, compute_uv=False)[:3]
        assert np.sqrt((scores**2).sum(axis=0)) == pytest.approx(singular)
        assert scores.mean(axis=0) == pytest.approx(np.zeros(3), abs=1e-9)
    again = e.group_components(df.repartition(7), "section", 3).collect()
    assert np.array([r.pca for r in sorted(again, key=lambda r: r.obs_id)]) == pytest.approx(np.array([r.pca for r in sorted(rows, key=lambda r: r.obs_id)]))


def test_k_means_finds_clear_groups(cloud):
    _, df = cloud
    found = e.group_k_means(df, "section", {"s0": 4, "s2": 4}).collect()
    assert {r.key for r in found} == {"s0", "s2"} and len(found) == 160
    for s in ("s0", "s2"):
        pairs = {(r.obs_id % 4, r.cluster) for r in found if r.key == s}
        assert len(pairs) == 4 and {c for _, c in pairs} == {0, 1, 2, 3}
    with pytest.raises(ValueError):
        e.group_k_means(df.where("obs_id < 2"), "section", {"s0": 4})


def test_best_number_of_clusters(cloud):
    _, df = cloud
    best = {r["key"]: r.k for r in st.best_cluster_numbers(df, "section", 2, 6).where("best").collect()}
    assert best == {"s0": 4, "s1": 4, "s2": 4}


def test_control_keeps_the_largest(spark):
    rows = [(i, 0, [0.0, 0.0]) for i in range(6)] + [(10 + i, 1, [9.0, 9.0]) for i in range(5)] + [(20, 2, [8.0, 8.0]), (21, 3, [1.0, 0.0]), (22, 3, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "obs_id int, cluster int, vector array<double>")
    merged = {r.obs_id: r.cluster for r in e.control_clusters(df, 2, 2).collect()}
    assert merged == {**{i: 0 for i in (*range(6), 21, 22)}, **{i: 1 for i in (*range(10, 15), 20)}}
    assert {r.cluster for r in e.kept_clusters(df, 50, 3).collect()} == {0, 1, 3}


def silhouettes(x, groups):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = []
    for i, g in enumerate(groups):
        own = (groups == g).sum()
        a = d[i, groups == g].sum() / max(own - 1, 1)
        b = min(d[i, groups == o].mean() for o in set(groups) - {g})
        out.append(0 if own <= 1 else (b - a) / max(a, b))
    return np.mean(out)


def test_silhouettes_in_blocks(cloud, monkeypatch):
    x, df = cloud
    monkeypatch.setattr(h, "BLOCK_ROWS", 17)
    monkeypatch.setattr(h, "CHUNK", 4)
    for row in h.silhouette(df).collect():
        own = np.array([i for i in range(240) if f"r{i % 4}" == row.region])
        assert row.silhouette == pytest.approx(silhouettes(x[own], own % 3)) and row.n_obs == 60
    for row in h.permuted_silhouette(df, 19).collect():
        assert 1 / 20 <= row.p <= 1 and row.mean == pytest.approx(row.observed - row.adjusted)
        assert abs(row.mean) < 0.1 and row.spread < 0.1
    split = df.withColumn("section", F.concat("label", F.lit("#1"))).withColumn("label", F.lit("r#1"))
    assert [r.label for r in h.permuted_silhouette(split, 3).collect()] == ["r#1"]
    assert h.silhouette(df.withColumn("section", F.lit("one"))).count() == 0


def test_components_of_graphs_and_rasters(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(40, 41), (43, 41)], "a int, b int")
    nodes = spark.createDataFrame([(i,) for i in [*range(31), 40, 41, 43, 50]], "node int")
    got = {r.node: r.component for r in pp.connected_components(nodes, edges).collect()}
    assert got == {**{i: 0 for i in range(31)}, 40: 40, 41: 40, 43: 40, 50: 50}
    art = ["aab", "abb", "bba"]
    cells = spark.createDataFrame([("s", x, y, c) for y, line in enumerate(art) for x, c in enumerate(line)], "section string, gx int, gy int, label string")
    found = pp.raster_components(cells, diagonal=False)
    assert {(r.label, r["size"]) for r in found.collect()} == {("a", 3), ("b", 5), ("a", 1)}
    assert {(r.gx, r.gy): r.relabelled for r in pp.relabel_small(found, 2).collect()}[(2, 2)] == "b"


def test_ward_joins_the_near_ones(spark):
    rows = [("g", f"f{i}", [float(i // 3 * 10 + i % 3)]) for i in range(9)]
    found = pp.ward_clusters(spark.createDataFrame(rows, "label string, feature string, vector array<double>"), 3).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.cluster, set()).add(int(r.feature[1:]) // 3)
    assert sorted(map(len, groups.values())) == [1, 1, 1]


def test_zeros_are_replaced_below_the_least_value(spark):
    rows = [("s", i, "l", "f", float(v)) for i, v in enumerate([0, 0, 2, 3, 0])] + [("s", i, "l", "g", 0.0) for i in range(3)]
    df = spark.createDataFrame(rows, "section string, obs_id int, label string, feature string, value double")
    got = {(r.feature, r.obs_id): r.value for r in f.replace_zeros(df, 0.5).collect()}
    assert all(0 < got["f", i] < 1 for i in (0, 1, 4)) and (got["f", 2], got["f", 3]) == (2, 3) and got["g", 0] == 0
    assert got == {(r.feature, r.obs_id): r.value for r in f.replace_zeros(df.repartition(5), 0.5).collect()}


def test_spots_take_small_regions(spark):
    pseudo = [("s", i, float(i % 10), float(i // 10), "big") for i in range(90)] + [("s", 90 + i, float(i), 9.0, "small" if i < 3 else "big") for i in range(10)]
    df = spark.createDataFrame(pseudo, "section string, obs_id int, x double, y double, label string")
    spots = spark.createDataFrame([("s", 1, 0.6, 8.6), ("s", 2, 7.0, 3.0)], "section string, obs_id int, x double, y double")
    plain = {r.obs_id: r.label for r in n.annotate_spots(spots, df, 7).collect()}
    small = {r.obs_id: r.label for r in n.annotate_spots(spots, df, 7, small_regions=True).collect()}
    assert plain == {1: "big", 2: "big"} and small == {1: "small", 2: "big"}
    near = {r.obs_id: r.label for r in n.annotate_spots(spots, df, 3, "radius").collect()}
    assert near == {1: near[1], 2: "big"} and near[1] in ("big", "small")


def test_counts_are_dealt_by_order(spark, monkeypatch):
    """Tasks follow from the number of lines, so what one holds does not grow with the table."""
    from loomspark.sources import tables as s

    d = "/root/testdata/sf0.001"
    whole = {(r.section, r.obs_id, r.label, r.feature): r.value for r in s.counts(spark, d).collect()}
    monkeypatch.setattr(s, "COUNT_ROWS", 700)
    held = s.counts(spark, d).withColumn("task", F.spark_partition_id())
    sizes = held.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("obs_id").alias("orders")).collect()
    assert 8 <= len(sizes) <= 9 and max(r.n for r in sizes) < 1000
    assert sum(r.orders for r in sizes) == len({k[1] for k in whole})
    assert {(r.section, r.obs_id, r.label, r.feature): r.value for r in held.collect()} == whole


def test_a_query_of_many_cells_leaves_a_task_in_slices(cloud, monkeypatch):
    """A query may ask every cell; batches of its copies stay as long as a slice."""
    x, df = cloud
    tasks = []
    plain = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, task, schema: tasks.append((task, schema)) or plain(self, task, schema))
    monkeypatch.setattr(n, "SLICE_ROWS", 16)
    assert n.feature_neighbours(df, df, 3, block_rows=8).count() == 3 * len(x)
    whole = n.pa.table({"key": [""] * len(x), "query_id": list(range(len(x))), "vector": x.tolist(), "bound": [1e3] * len(x)}).to_batches()
    wide = [len(b) for task, schema in tasks if "query_id" in schema for b in task(iter(whole))]
    assert sum(wide) > 4 * len(x) and max(wide) <= 16
