"""The approximate index against the exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.operators import feature_index as fi
from loomspark.operators import neighbours as n

N, WIDTH = 3_000, 18


@pytest.fixture(scope="module", params=["clustered", "uniform"])
def cloud(request, spark):
    r = np.random.default_rng(5)
    x = r.uniform(size=(N, WIDTH))
    if request.param == "clustered":
        x = r.normal(size=(40, WIDTH))[r.integers(0, 40, N)] * 3 + r.normal(size=(N, WIDTH))
    return x, spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "obs_id long, vector array<double>")


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_recall_reaches_its_goal(cloud, metric):
    x, df = cloud
    queries = df.where("obs_id % 20 = 0")
    index = fi.build_index(df, metric=metric)
    assert index.entries.count() == N
    probes, refine, measured = fi.tune(index, queries, df, 10)
    assert measured >= 0.95 and probes < index.n_lists
    y = x / np.linalg.norm(x, axis=1)[:, None] if metric == "cosine" else x
    found = {}
    for row in fi.search_index(index, queries, 10, probes, refine).collect():
        gap = ((y[row.query_id] - y[row.ref_id]) ** 2).sum()
        assert row.distance == pytest.approx(gap / 2 if metric == "cosine" else gap**0.5, abs=1e-8)
        found.setdefault(row.query_id, {})[row.place] = row.ref_id
    hits = 0
    for i in range(0, N, 20):
        assert sorted(found[i]) == list(range(1, 11))
        hits += len(set(found[i].values()) & set(((y - y[i]) ** 2).sum(axis=1).argsort(kind="stable")[:10].tolist()))
    assert hits / (10 * N / 20) >= 0.9


def test_all_lists_and_all_entries_are_exact_in_blocks(cloud, monkeypatch):
    _, df = cloud
    monkeypatch.setattr(fi, "BLOCK_ROWS", 16)
    few = df.where("obs_id < 400").withColumn("part", F.col("obs_id") % 2)
    queries = few.where("obs_id < 30")
    index = fi.build_index(few, "part", n_lists=5)
    got = fi.search_index(index, queries, 4, 5, 200)
    want = n.feature_neighbours(queries, few, 4, "part")
    as_set = lambda t: {(r.key, r.query_id, r.ref_id, r.place) for r in t.collect()}
    assert as_set(got) == as_set(want)


def test_text_ids_equal_vectors_nulls_and_empty_tables(spark):
    rows = [(f"n{i:03}", [1.0, 2.0]) for i in range(60)] + [("far", [9.0, 9.0]), ("none", None)]
    df = spark.createDataFrame(rows, "obs_id string, vector array<double>")
    got = fi.indexed_neighbours(df.where("obs_id in ('n007', 'none')"), df, 3).orderBy("place").collect()
    assert [(r.query_id, r.ref_id, r.distance) for r in got] == [("n007", f"n00{i}", 0.0) for i in range(3)]
    assert not fi.indexed_neighbours(df, df.where("false"), 3).count()
    assert not fi.indexed_neighbours(df.where("false"), df, 3).count()
    assert [r.ref_id for r in fi.indexed_neighbours(df.where("obs_id = 'far'"), df.where("obs_id = 'far'"), 3).collect()] == ["far"]


def test_queries_of_many_lists_leave_a_task_in_slices(spark, monkeypatch):
    """A query is copied once a list it looks into; batches of copies stay as long as a slice."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "obs_id long, vector array<double>")
    tasks = []
    plain = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, task, schema: tasks.append((task, schema)) or plain(self, task, schema))
    monkeypatch.setattr(fi, "SLICE_ROWS", 32)
    found = fi.search_index(fi.build_index(df), df, 3, 10)
    assert found.where("place = 1 and query_id = ref_id").count() == len(x)
    task = next(task for task, schema in tasks if "query_id" in schema)
    whole = fi.pa.table({"key": [""] * len(x), "query_id": list(range(len(x))), "vector": x.tolist()}).to_batches()
    wide = [len(b) for b in task(iter(whole))]
    assert sum(wide) == 10 * len(x) and max(wide) <= 32


@pytest.mark.parametrize("text", [False, True])
def test_queries_of_very_many_lists_go_by_blocks(spark, monkeypatch, text):
    """No copy of a query for each list; answers are those of the search by lists."""
    monkeypatch.setattr(fi, "QUERY_ROWS", 100)
    monkeypatch.setattr(fi, "ENTRY_ROWS", 64)
    monkeypatch.setattr(fi, "SLICE_QUERIES", 32)
    rng = np.random.default_rng(6)
    x = np.concatenate((rng.normal(size=(380, 6)), np.zeros((20, 6))))
    df = spark.createDataFrame([(f"n{i:03}" if text else i, v.tolist()) for i, v in enumerate(x)], f"obs_id {'string' if text else 'long'}, vector array<double>")
    index = fi.build_index(df, n_lists=40)
    tasks = []
    plain = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, task, schema: tasks.append(schema) or plain(self, task, schema))
    rows = lambda t: sorted((r.query_id, r.place, r.ref_id, round(r.distance, 8)) for r in t.collect())
    by_blocks = rows(fi.search_index(index, df, 5, 25, 3))
    assert not any("cell" in schema for schema in tasks)
    monkeypatch.setattr(fi, "LANES", 100)
    assert by_blocks == rows(fi.search_index(index, df, 5, 25, 3)) and len(by_blocks) == 5 * len(x)
    assert any("cell" in schema for schema in tasks)


@pytest.mark.parametrize("text", [False, True])
def test_tasks_of_a_search_by_blocks_hold_a_bounded_part(spark, monkeypatch, text):
    """Neither vectors nor codes of the whole index meet in a task, and answers are those of a search of all lists."""
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    held = []
    plain = PandasCogroupedOps.applyInArrow
    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", lambda self, task, schema: held.append((self._gd1._df, self._gd2._df)) or plain(self, task, schema))
    for name, rows in (("QUERY_ROWS", 64), ("ENTRY_ROWS", 16), ("SLICE_QUERIES", 8), ("CODE_ROWS", 200), ("ANSWER_ROWS", 600), ("HELD_BYTES", 8 * 5 * 50), ("SLICE_ROWS", 32)):
        monkeypatch.setattr(fi, name, rows)
    rng = np.random.default_rng(8)
    x = np.concatenate((rng.normal(size=(560, 5)), np.ones((40, 5))))
    df = spark.createDataFrame([(f"n{i:03}" if text else i, i % 3 // 2, v.tolist()) for i, v in enumerate(x)], f"obs_id {'string' if text else 'long'}, part int, vector array<double>")
    index = fi.build_index(df, "part", n_lists=30)
    assert index.entries.count() == len(x)
    got = fi.search_index(index, df, 4, 30, 200).select("key", "query_id", "ref_id", "distance", "place").collect()
    want = n.feature_neighbours(df, df, 4, "part").select("key", "query_id", "ref_id", "distance", "place").collect()
    assert len(got) == 4 * len(x) and {tuple(r) for r in got} == {tuple(r) for r in want}
    (queries, codes), (named, vectors) = held[:2]
    most = lambda t: t.groupBy("key", "span", "lane").count().agg(F.max("count")).first()[0]
    assert codes.columns[:4] == ["key", "ref_id", "cell", "code"] and most(queries) <= 3 * 8 and most(codes) <= 1.5 * 200
    assert most(named) <= 1.6 * 50 and most(vectors) <= 1.6 * 50
