"""Neighbour searches against brute force on small inputs."""

import numpy as np
import pytest

from loomspark.functions.joins import if_small
from loomspark.operators import embedding as e
from loomspark.operators import neighbours as n
from loomspark.sources import tables as s


@pytest.fixture(scope="module")
def points(spark):
    r = np.random.default_rng(0)
    rows = [("s", i, "ab"[i % 2], float(x), float(y)) for i, (x, y) in enumerate(r.uniform(0, 20, (80, 2)))]
    rows += [("far", 100 + i, "a", x, x) for i, x in enumerate([0.0, 0.0, 300.0])]
    return rows, spark.createDataFrame(rows, "section string, obs_id long, label string, x double, y double")


def test_plane_search_equals_brute_force(points):
    rows, df = points
    got = {}
    for x in n.plane_neighbours(df, df, 5, cell=2.0).collect():
        got.setdefault(x.obs_id, {})[x.place] = x.other_id
    for sec, i, _, x, y in rows:
        others = sorted(((x - p) ** 2 + (y - q) ** 2, j) for t, j, _, p, q in rows if t == sec)
        assert [got[i][k] for k in sorted(got[i])] == [j for _, j in others[:5]]


def test_feature_search_over_blocks(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(60, 4))
    df = spark.createDataFrame([(i, [float(z) for z in x]) for i, x in enumerate(v)], "obs_id long, vector array<double>")
    got = {}
    for x in n.feature_neighbours(df.where("obs_id < 20"), df.where("obs_id >= 20"), 3, block_rows=16).collect():
        got.setdefault(x.query_id, {})[x.place] = x.ref_id
    for i in range(20):
        d = np.sqrt(((v[20:] - v[i]) ** 2).sum(1))
        assert [got[i][k] for k in (1, 2, 3)] == [int(j) + 20 for j in d.argsort()[:3]]


def test_one_wrong_label_is_refined(spark):
    rows = [("s", 4 * y + x, "b" if (x, y) == (1, 1) else "a", float(x), float(y)) for x in range(4) for y in range(4)]
    df = spark.createDataFrame(rows, "section string, obs_id long, label string, x double, y double")
    assert {x.refined for x in n.refine_labels(df, 4).collect()} == {"a"}


def test_components_are_centred_with_fixed_signs(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(40, 5)) * [5, 3, 1, 1, 1] + 7
    df = spark.createDataFrame([("s", i, [float(z) for z in row]) for i, row in enumerate(x)], "section string, obs_id long, vector array<double>")
    got = np.array([row.pca for row in e.principal_components(df, 2).orderBy("obs_id").collect()])
    _, _, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    want = np.stack([(x - x.mean(0)) @ (c * np.sign(c[np.abs(c).argmax()])) for c in vt[:2]], axis=1)
    assert got == pytest.approx(want, abs=1e-6)


def test_sections_and_coordinates_round_trip(spark, points, tmp_path):
    _, df = points
    s.write_sections(df, f"{tmp_path}/obs")
    assert s.sections(spark, f"{tmp_path}/obs", ["far"]).count() == 3
    s.write_coordinates(df.where("section = 'far'"), f"{tmp_path}/xy")
    assert sorted((x.x, x.y) for x in s.read_coordinates(spark, f"{tmp_path}/xy").collect()) == [(0.0, 0.0), (0.0, 0.0), (300.0, 300.0)]
    (tmp_path / "images").mkdir()
    (tmp_path / "images" / "a.png").write_bytes(b"x")
    (tmp_path / "images" / "a.txt").write_bytes(b"xx")
    assert [x.length for x in s.images(spark, f"{tmp_path}/images").collect()] == [1]


def test_only_small_tables_are_broadcast(spark):
    hinted = lambda t: "ResolvedHint" in t._jdf.queryExecution().analyzed().toString()
    wide = spark.range(30).selectExpr("id", "array_repeat(id, 100) AS v")
    assert hinted(if_small(wide)) and hinted(if_small(wide, most=30))
    for bounds in ({"most": 29}, {"most_bytes": 1_000}):
        kept = if_small(wide, **bounds)
        assert not hinted(kept) and kept.count() == 30


def test_a_block_of_queries_is_compared_in_slices():
    """A task's peak follows a slice of queries, not the block."""
    import tracemalloc

    import pyarrow as pa

    r = np.random.default_rng(2)
    x = r.normal(size=(2_048, 8))
    table = lambda name: pa.table({"key": ["a"] * len(x), name: list(range(len(x))), "vector": pa.array(x.tolist(), pa.list_(pa.float64()))})
    left, right = table("query_id"), table("ref_id")
    tracemalloc.start()
    found = n._nearest(left, right, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert found.column("ref_id").to_pylist() == d.argsort(axis=1, kind="stable")[:, :3].ravel().tolist()
    assert peak < 2_048 * 2_048 * 8


def test_a_bound_keeps_those_at_it_and_drops_those_beyond():
    """A cell that is asked again answers what may be among the k nearest, not k rows a query."""
    import pyarrow as pa

    r = np.random.default_rng(5)
    for spaced in (True, False):
        x, y = (r.integers(0, 4, (m, 3)).astype(float) if spaced else r.normal(size=(m, 3)) for m in (300, 500))
        d = np.round(np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2)), 9)
        bound = np.sort(d, axis=1)[np.arange(300), np.arange(300) % 8]  # the 1st to the 8th distance, met by ties too
        vectors = lambda v: pa.array(v.tolist(), pa.list_(pa.float64()))
        left = pa.table({"key": ["a"] * 300, "query_id": list(range(300)), "vector": vectors(x), "bound": bound})
        right = pa.table({"key": ["a"] * 500, "ref_id": list(range(500)), "vector": vectors(y)})
        found = [tuple(row.values())[1:] for row in n._nearest(left, right, 5).to_pylist()]
        want = [(i, int(j), d[i, j]) for i in range(300) for j in np.lexsort((np.arange(500), d[i]))[:5] if d[i, j] <= bound[i]]
        assert found == want and (spaced or len(found) < 5 * 300)


@pytest.mark.parametrize("text", [False, True])
def test_a_query_goes_to_a_shelf_once_however_many_cells_it_asks(spark, monkeypatch, text):
    """What is sent does not grow with the number of cells (F1, F2); shelves, tasks and a cell on several shelves lose nothing."""
    r = np.random.default_rng(7)
    x = np.concatenate((r.normal(size=(200, 3)), r.integers(0, 3, (120, 3)).astype(float), np.full((80, 3), 0.5)))
    part = np.arange(len(x)) % 5 == 0
    ids = [f"n{i:03}" if text else i for i in range(len(x))]
    df = spark.createDataFrame([("few" if p else "many", i, v.tolist()) for i, v, p in zip(ids, x, part, strict=True)], f"part string, obs_id {'string' if text else 'long'}, vector array<double>")
    tasks = []
    plain = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, task, schema: tasks.append((task, schema)) or plain(self, task, schema))
    monkeypatch.setattr(n, "HELD_BLOCKS", 6)
    got = {}
    for row in n.feature_neighbours(df, df, 5, "part", block_rows=8).orderBy("query_id", "place").collect():
        got.setdefault(row.query_id, []).append((row.ref_id, row.distance))
    for i in range(len(x)):
        d = np.round(np.sqrt(((x - x[i]) ** 2).sum(axis=1)), 9)
        others = [int(j) for j in np.lexsort((np.arange(len(x)), d)) if part[j] == part[i]][:5]
        assert got[ids[i]] == [(ids[j], pytest.approx(d[j], abs=1e-9)) for j in others]
    whole = n.pa.table({"key": ["many"] * len(x), "query_id": ids, "vector": x.tolist(), "bound": [1e3] * len(x)}).to_batches()
    sent = {schema: sum(len(b) for b in task(iter(whole))) for task, schema in tasks if "query_id" in schema}
    n_shelves = -(-int((~part).sum()) // 48)
    assert len(sent) == 2 and n_shelves == 7 and max(sent.values()) == n_shelves * len(x)  # of about 50 cells


def test_reassigning_reads_the_search_as_written(spark):
    """The anchor search of l06_reassign_novel runs once, not again in each reading of its labels (F1)."""
    from loomspark.plans.catalog import QUERIES
    from loomspark.plans import transfer_catalog  # noqa: F401  (adds its queries)

    out = QUERIES["l06_reassign_novel"](spark, "/root/testdata/sf0.001")
    assert out.count() == 125 and "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
