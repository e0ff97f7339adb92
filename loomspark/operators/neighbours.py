"""Nearest neighbours, in the plane and in feature space, and votes among them.

Plane searches go by grid cells and never pair all points: a cell is joined with itself and the cells round
it, and the ring grows for points whose k-th neighbour might lie outside. Feature-space searches go by cells
round pivots: a query is compared with the cells nearest to it, which bounds its k-th distance, and then only
with cells that reach inside that bound. Neighbouring cells stand on shelves of a fixed size, and a query goes to a
shelf once, however many of its cells it asks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.joins import if_small
from loomspark.sources.materialise import materialise

#: References that are compared at a time in feature-space searches, and the most pivots of a group.
BLOCK_ROWS, PIVOTS = 2_048, 256
#: A task gets so many such blocks of queries and of references, or so many bytes of vectors, at most; a group has so many shelves at least.
HELD_BLOCKS, HELD_BYTES, SHELVES = 16, 16 << 20, 4
#: Rows that a task compares with the pivots, or sends to cells, at a time: a query may go to every cell.
SLICE_ROWS = 1_024
#: Queries of a block whose distances a task holds at a time.
NEAR_ROWS = 256


def _distance2(a: str, b: str) -> Column:
    return (F.col(f"{a}.x") - F.col(f"{b}.x")) ** 2 + (F.col(f"{a}.y") - F.col(f"{b}.y")) ** 2


def plane_neighbours(points: DataFrame, others: DataFrame, k: int, cell: float = 1.0, rounds: int = 24) -> DataFrame:
    """The k nearest ``others`` of each point of the same section, as ``(section, obs_id, other_id, d2, place)``.

    Both tables have ``section, obs_id, x, y``; ties go to the smaller id. A point is settled by a ring of
    cells once its k-th distance reaches no further than the ring; the ring doubles for the rest. Sections
    with fewer than k others give all they have. If both have ``z``, distances are those in space; cells stay in
    the plane, where no distance is longer.
    """
    axes = ["x", "y", *(["z"] if "z" in points.columns and "z" in others.columns else [])]
    d2 = reduce(Column.__add__, [(F.col(f"p.{c}") - F.col(f"o.{c}")) ** 2 for c in axes])
    grid = lambda c: F.floor(F.col(c) / cell).cast("long")
    there = others.select("section", F.col("obs_id").alias("other_id"), *axes, grid("x").alias("cx"), grid("y").alias("cy"))
    size = there.groupBy("section").agg(F.count(F.lit(1)).alias("n_others"), *[f(c).alias(f"{name}_{c}") for c in ("cx", "cy") for f, name in ((F.min, "low"), (F.max, "high"))])
    todo = points.select("section", "obs_id", *axes, grid("x").alias("cx"), grid("y").alias("cy")).join(if_small(size), "section")
    found, ring = None, max(1, int(np.ceil(np.sqrt(k))) // 2 + 1)
    for _ in range(rounds):
        near = lambda c: F.explode(F.sequence(F.greatest(F.col(c) - ring, F.col(f"low_{c}")), F.greatest(F.least(F.col(c) + ring, F.col(f"high_{c}")), F.greatest(F.col(c) - ring, F.col(f"low_{c}")))))
        asked = todo.withColumn("gx", near("cx")).withColumn("gy", near("cy")).alias("p")
        pairs = asked.join(there.alias("o"), (F.col("p.section") == F.col("o.section")) & (F.col("p.gx") == F.col("o.cx")) & (F.col("p.gy") == F.col("o.cy")))
        order = Window.partitionBy("section", "obs_id").orderBy("d2", "other_id")
        best = pairs.select("p.section", "p.obs_id", "p.x", "p.y", "p.cx", "p.cy", "p.n_others", "p.low_cx", "p.high_cx", "p.low_cy", "p.high_cy", "o.other_id", d2.alias("d2")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
        whole = (F.col("low_cx") >= F.col("cx") - ring) & (F.col("high_cx") <= F.col("cx") + ring) & (F.col("low_cy") >= F.col("cy") - ring) & (F.col("high_cy") <= F.col("cy") + ring)
        edge = F.least(F.col("x") - (F.col("cx") - ring) * cell, (F.col("cx") + ring + 1) * cell - F.col("x"), F.col("y") - (F.col("cy") - ring) * cell, (F.col("cy") + ring + 1) * cell - F.col("y"))
        by_point = Window.partitionBy("section", "obs_id")
        judged = materialise(best.withColumn("settled", whole | ((F.count(F.lit(1)).over(by_point) >= k) & (F.max("d2").over(by_point) < edge * edge))))
        done = judged.where("settled").select("section", "obs_id", "other_id", "d2", "place")
        found = done if found is None else found.union(done)
        left = todo.join(judged.where("settled").select("section", "obs_id").distinct(), ["section", "obs_id"], "left_anti")
        if not left.limit(1).count():
            return found
        todo, ring = left, ring * 2
    raise ValueError(f"neighbours unsettled after {rounds} rounds: choose a cell nearer to the spacing of the points")


def _stacked(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _nearest(left: pa.Table, right: pa.Table, k: int, asks: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> pa.Table:
    """The k rows of ``right`` nearest to each of ``left``, none beyond its ``bound`` if it has one, ties to the smaller id.

    One matrix product finds who may be near; distances of those are then taken from the differences, so that
    rounding is the same however the rows were cut into blocks. NEAR_ROWS rows of ``left`` are compared with
    BLOCK_ROWS of ``right`` at a time, so a task's memory is that of one such slice and the tables. ``asks`` tells
    for vectors and bounds which cells they ask, by number; ``right`` then has its rows in order of their ``cell``.
    """
    kinds = [("key", pa.string()), ("query_id", left.schema.field("query_id").type), ("ref_id", right.schema.field("ref_id").type), ("distance", pa.float64())]
    if not len(left) or not len(right):
        return pa.table([pa.array([], t) for _, t in kinds], names=[n for n, _ in kinds])
    left, right = left.combine_chunks(), right.combine_chunks()
    y = _stacked(right.column("vector").chunk(0))
    right_sides = np.vstack((y.T, np.ones(len(y)), (y**2).sum(axis=1)))
    ids = np.unique(right.column("ref_id").to_numpy(), return_inverse=True)[1]  # by their order, whatever their type
    cell = right.column("cell").to_numpy() if asks else np.zeros(len(y), dtype=np.int32)
    edges = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(y)]
    blocks = [slice(i, min(i + BLOCK_ROWS, high)) for low, high in zip(edges, edges[1:], strict=False) for i in range(low, high, BLOCK_ROWS)]
    parts = []
    for at in range(0, len(left), NEAR_ROWS):
        some = left.slice(at, NEAR_ROWS)
        x = _stacked(some.column("vector").chunk(0))
        bound = some.column("bound").to_numpy().copy() if "bound" in some.column_names else np.full(len(some), np.inf)
        asked = asks(x, bound) if asks else np.ones((len(x), 1), dtype=bool)
        found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
        for block in blocks:
            here = np.flatnonzero(asked[:, cell[block.start]])
            if len(here):
                rows, columns, exact = _nearest_rows(x[here], y[block], right_sides[:, block], ids[block], k, bound[here])
                found.append((here[rows], columns + block.start, exact))
                last = np.flatnonzero(np.bincount(rows, minlength=len(here)) == k)  # k are known: none further is
                bound[here[last]] = exact[np.searchsorted(rows, last, side="right") - 1]
        rows, columns, exact = _first(*(np.concatenate(f) for f in zip(*found, strict=True)), ids, k)
        own, other = pa.array(rows), pa.array(columns)
        parts.append(pa.table([some.column("key").take(own), some.column("query_id").take(own), right.column("ref_id").take(other), pa.array(exact)], names=[n for n, _ in kinds]))
    return pa.concat_tables(parts)


def _first(rows: np.ndarray, columns: np.ndarray, exact: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first of each row by distance, ties to the smaller id."""
    order = np.lexsort((ids[columns], exact, rows))
    rows, columns, exact = rows[order], columns[order], exact[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
    return rows[keep], columns[keep], exact[keep]


def _nearest_rows(x: np.ndarray, y: np.ndarray, right_sides: np.ndarray, ids: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row of x, row of y, distance)`` of the k nearest within ``bound`` (a row of x each); ``right_sides`` are y, ones and the squared lengths of y, across."""
    own = (x**2).sum(axis=1)
    d = np.column_stack((-2 * x, own, np.ones(len(x)))) @ right_sides
    wide = 1e-9 * (1 + own + right_sides[-1].max())
    near = ~(d > ((bound + 1e-8) ** 2 + wide)[:, None])
    many = np.flatnonzero(np.count_nonzero(near, axis=1) > k)
    if len(many):
        many = slice(None) if len(many) == len(x) else many  # all rows, without a copy
        last = np.maximum(np.partition(d[many], k - 1, axis=1)[:, k - 1 : k], 0)
        near[many] &= d[many] <= last + 1e-9 * (1 + last)
    rows, columns = np.divmod(np.flatnonzero(near), len(y))
    exact = np.round(np.sqrt(((x[rows] - y[columns]) ** 2).sum(axis=1)), 9)
    inside = ~(exact > bound[rows])
    return _first(rows[inside], columns[inside], exact[inside], ids, k)


def feature_neighbours(queries: DataFrame, references: DataFrame, k: int, key: str | None = None, metric: str = "euclidean", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k references nearest to each query, exactly, as ``(key, query_id, ref_id, distance, place)``.

    Both have ``obs_id`` and ``vector`` (doubles), and the column ``key`` if searches of several groups are
    asked at once; without it the key is empty. Ids may be numbers or text. Distances are rounded to 9 places before they are ranked, ties
    go to the smaller id. ``cosine`` distance is half the squared distance of the vectors at length 1.

    Pivots, at most PIVOTS a group, are references chosen by a hash. References go to their nearest pivot's
    cell. A query first asks the nearest cells that hold k references between them; the k-th distance found
    there rules out each cell whose pivot lies further than that and the cell's radius together, and in the other
    cells each reference beyond it: what a cell answers are the few that may still be among the k.

    A group's cells stand on shelves one after the other, a large cell on several. A query goes to each shelf where
    it asks a cell, and there only to such cells; a shelf's references go to as many tasks as its queries fill. So a
    vector is sent a few times (SHELVES up to 131,072 rows of 64 features, then once for each 32,768 rows of the
    other side), whether cells rule out much or nothing.
    """
    unit = lambda v: F.transform(v, lambda a: a / F.sqrt(F.greatest(F.aggregate(v, F.lit(0.0), lambda s, b: s + b * b), F.lit(1e-300))))
    vector = unit(F.col("vector")) if metric == "cosine" else F.col("vector")
    name = F.col(key).cast("string") if key else F.lit("")
    kinds = ["string" if dict(t.dtypes)["obs_id"] == "string" else "long" for t in (queries, references)]
    q = queries.select(name.alias("key"), F.col("obs_id").cast(kinds[0]).alias("query_id"), vector.alias("vector"))
    r = references.select(name.alias("key"), F.col("obs_id").cast(kinds[1]).alias("ref_id"), vector.alias("vector"))
    of_group = Window.partitionBy("key")
    n_pivots = F.least(F.lit(PIVOTS), F.ceil(F.sqrt(F.col("n") / block_rows) * 8))
    counted = r.groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("n_pivots", F.when(F.col("n") <= block_rows, 1).otherwise(n_pivots))
    likely = (F.shiftrightunsigned(F.xxhash64("ref_id"), 11) / float(1 << 53)) * F.col("n") < 4 * PIVOTS  # few rows are sorted
    first = r.join(if_small(counted), "key").where(likely).withColumn("at", F.row_number().over(of_group.orderBy(F.xxhash64("ref_id"), "ref_id")))
    chosen = first.where(F.col("at") <= F.col("n_pivots")).select("key", "ref_id", "vector").toArrow().sort_by("ref_id")
    pivots: dict[str, np.ndarray] = {}
    for group in sorted(set(chosen.column("key").to_pylist())):
        own = chosen.filter(pa.array([x == group for x in chosen.column("key").to_pylist()])).combine_chunks()
        pivots[group] = _stacked(own.column("vector").chunk(0))

    def to_pivots(group: str, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ pivots[group].T + (pivots[group] ** 2).sum(axis=1)[None], 0))

    def by_group(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        names = np.array(batch.column(0).to_pylist(), dtype=object)
        for group in dict.fromkeys(names):
            if group in pivots:
                here = np.flatnonzero(names == group)
                yield group, here, to_pivots(group, _stacked(batch.column(2).take(pa.array(here))))

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (batch.slice(at, SLICE_ROWS) for batch in batches for at in range(0, len(batch), SLICE_ROWS))

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            cell, far = np.zeros(len(batch), dtype=np.int32), np.zeros(len(batch))
            for _, here, d in by_group(batch):
                cell[here], far[here] = d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], ["key", "ref_id", "vector", "cell", "far"])

    celled = materialise(r.mapInArrow(to_cells, f"key string, ref_id {kinds[1]}, vector array<double>, cell int, far double"))
    cells = celled.groupBy("key", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).orderBy("key", "cell").collect()  # at most PIVOTS rows a group
    held = {group: [np.array(c) for c in zip(*((x.cell, x.n, x.radius) for x in cells if x.key == group), strict=True)] for group in pivots}
    most_rows = max(1, min(HELD_BLOCKS * block_rows, HELD_BYTES // (8 * max((p.shape[1] for p in pivots.values()), default=1) or 1)))
    shelf_rows = {group: min(most_rows, max(block_rows, -(-int(n.sum()) // SHELVES))) for group, (_, n, _) in held.items()}
    shelves = {}  # a row a cell: the shelves on which it stands
    for group, (_, n, _) in held.items():
        low, high = (np.cumsum(n) - n) // shelf_rows[group], (np.cumsum(n) - 1) // shelf_rows[group]
        number = np.arange(high.max() + 1)[None]
        shelves[group] = (low[:, None] <= number) & (number <= high[:, None])

    def reached(group: str, d: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Which cells may hold references within the bound, a column a cell."""
        number, _, radius = held[group]
        return ~(d[:, number] - radius[None] > (bound + 1e-6 * (1 + bound))[:, None])  # a distance that is no number rules out nothing

    def ask(batches: Iterator[pa.RecordBatch], again: bool) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows, found = [], []
            for group, here, d in by_group(batch):
                number, n, _ = held[group]
                if again:
                    at, which = np.nonzero(reached(group, d, batch.column(3).to_numpy()[here]) @ shelves[group])
                else:
                    order = np.argsort(d[:, number], axis=1, kind="stable")
                    enough = np.cumsum(n[order], axis=1) - n[order] < k  # cells until k references are held
                    near = np.zeros_like(enough)
                    np.put_along_axis(near, order, enough, axis=1)
                    at, which = np.nonzero(near)
                    which = number[which]
                rows.append(here[at])
                found.append(which)
            at = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
            place = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
            for i in range(0, len(at), SLICE_ROWS):  # as many copies of a vector as cells or shelves it asks
                kept = batch.take(pa.array(at[i : i + SLICE_ROWS]))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(place[i : i + SLICE_ROWS].astype(np.int32))], ["key", "query_id", "vector", "bound", "shelf" if again else "cell"])

    asked_schema = f"key string, query_id {kinds[0]}, vector array<double>, bound double"
    near_schema = f"key string, query_id {kinds[0]}, ref_id {kinds[1]}, distance double"
    order = Window.partitionBy("key", "query_id").orderBy("distance", "ref_id")
    ranked = lambda near: near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    all_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    deal = lambda c, m: F.pmod(F.xxhash64(c), F.col(m))

    def search_cells(asked: DataFrame) -> DataFrame:
        sizes = if_small(celled.groupBy("key", "cell").agg(F.count(F.lit(1)).alias("n_refs")))
        n = asked.groupBy("key", "cell").agg(F.count(F.lit(1)).alias("n_asked"))
        blocks = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / most_rows)).cast("int")
        both = if_small(n.join(sizes, ["key", "cell"]).select("key", "cell", blocks("n_asked").alias("qs"), blocks("n_refs").alias("rs")))
        left = asked.join(both, ["key", "cell"]).select("key", "cell", "query_id", "vector", "bound", deal("query_id", "qs").cast("int").alias("qb"), all_of("rs").alias("rb"))
        right = celled.join(both, ["key", "cell"]).select("key", "cell", "ref_id", "vector", deal("ref_id", "rs").cast("int").alias("rb"), all_of("qs").alias("qb"))
        groups = left.groupBy("key", "cell", "qb", "rb").cogroup(right.groupBy("key", "cell", "qb", "rb"))
        return groups.applyInArrow(lambda a, b: _nearest(a, b, k), near_schema)

    def in_shelf(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _nearest(left, right, k)
        group, left = left.column("key")[0].as_py(), left.combine_chunks()
        x = _stacked(left.column("vector").chunk(0))
        home = np.concatenate([to_pivots(group, x[i : i + SLICE_ROWS]).argmin(axis=1) for i in range(0, len(x), SLICE_ROWS)])
        numbers = held[group][0]

        def asks(x: np.ndarray, bound: np.ndarray) -> np.ndarray:
            asked = np.zeros((len(x), len(pivots[group])), dtype=bool)
            asked[:, numbers] = reached(group, to_pivots(group, x), bound)
            return asked

        return _nearest(left.take(pa.array(np.argsort(home, kind="stable"))), right.sort_by("cell"), k, asks)  # queries of a slice ask alike

    def search_shelves(asked: DataFrame, lanes: DataFrame) -> DataFrame:
        places = [(group, int(c), int(first), int(n), shelf_rows[group]) for group, (number, ns, _) in held.items() for c, first, n in zip(number, np.cumsum(ns) - ns, ns, strict=True)]
        plan = celled.sparkSession.createDataFrame(places, "key string, cell int, first long, n long, shelf_rows long")
        left = asked.join(lanes, "key").select("key", "shelf", "query_id", "vector", "bound", deal("query_id", "lanes").cast("int").alias("lane"))
        right = celled.join(if_small(plan.join(lanes, "key")), ["key", "cell"]).select("key", F.floor((F.col("first") + deal("ref_id", "n")) / F.col("shelf_rows")).cast("int").alias("shelf"), "ref_id", "vector", "cell", all_of("lanes").alias("lane"))
        return left.groupBy("key", "shelf", "lane").cogroup(right.groupBy("key", "shelf", "lane")).applyInArrow(in_shelf, near_schema)

    unbounded = q.withColumn("bound", F.lit(float("inf")))
    home = materialise(ranked(search_cells(materialise(unbounded.mapInArrow(lambda b: ask(b, False), f"{asked_schema}, cell int")))))
    if max((len(number) for number, _, _ in held.values()), default=0) > 1:
        bound = home.groupBy("key", "query_id").agg(F.max("distance").alias("bound"))
        bounded = q.join(bound, ["key", "query_id"]).select("key", "query_id", "vector", "bound")
        rows_of = F.least(F.lit(most_rows), F.greatest(F.lit(block_rows), F.ceil(F.col("n") / SHELVES)))
        lanes = if_small(home.where("place = 1").groupBy("key").agg(F.count(F.lit(1)).alias("n")).select("key", F.ceil(F.col("n") / rows_of).cast("int").alias("lanes")))
        home = ranked(search_shelves(bounded.mapInArrow(lambda b: ask(b, True), f"{asked_schema}, shelf int"), lanes))
    return home.withColumn("distance", F.col("distance") ** 2 / 2) if metric == "cosine" else home


def anchors(references: DataFrame, queries: DataFrame, k: int | dict[str, int] = 5, by: list[str] | None = None, metric: str = "euclidean", search: Callable[..., DataFrame] | None = None) -> DataFrame:
    """Queries that are among the k nearest of a reference with the label, as ``(by, label, obs_id, n_votes)``.

    The index is on the queries and each reference asks, so a label's anchors are the union of its answers; all
    labels, so both sides of a split, are asked in one search. ``k`` may differ by label. ``by`` names columns
    of both tables that keep searches apart, such as a tree node, a reference section or a modality. ``search``
    may be another search than the exact one, such as ``feature_index.indexed_neighbours``.
    """
    by = by or []
    most = max(k.values()) if isinstance(k, dict) else k
    own = F.concat_ws("\u0001", *by) if by else F.lit("")
    asking = F.xxhash64(*[c for c in ("section", "obs_id") if c in references.columns])  # references of several sections may share ids
    hits = (search or feature_neighbours)(references.withColumn("_key", own).withColumn("obs_id", asking), queries.withColumn("_key", own), most, "_key", metric)
    labelled = hits.join(references.select(own.alias("key"), asking.alias("query_id"), "label", *by).distinct(), ["key", "query_id"])
    if isinstance(k, dict):
        labelled = labelled.where(F.col("place") <= F.coalesce(*[F.when(F.col("label") == name, F.lit(n)) for name, n in k.items()], F.lit(0)))
    return labelled.groupBy(*by, "label", F.col("ref_id").alias("obs_id")).agg(F.count(F.lit(1)).alias("n_votes"))


def combine_modalities(hits: DataFrame, how: str = "union", n_modalities: int = 1, by: list[str] | None = None) -> DataFrame:
    """Anchors found in any modality (``union``) or in all of them (``shared``): ``(by, label, obs_id)``."""
    need = {"union": 1, "shared": n_modalities}[how]
    return hits.groupBy(*(by or []), "label", "obs_id").agg(F.countDistinct("modality").alias("n")).where(F.col("n") >= need).drop("n")


def vote_references(hits: DataFrame, references: DataFrame, max_missing: int = 1, by: list[str] | None = None) -> DataFrame:
    """Anchors that enough reference sections agree on, all but ``max_missing`` of them and one at least.

    ``hits(by, section, label, obs_id)``; ``references(by, section)`` lists the sections that were asked.
    """
    by = by or []
    asked = references.groupBy(*by).agg(F.countDistinct("section").alias("n_sections"))
    votes = hits.groupBy(*by, "label", "obs_id").agg(F.countDistinct("section").alias("n_votes"))
    both = votes.join(if_small(asked), by) if by else votes.join(F.broadcast(asked), how="cross")  # one row
    return both.where(F.col("n_votes") >= F.greatest(F.col("n_sections") - max_missing, F.lit(1))).select(*by, "label", "obs_id", "n_votes")


def _votes(near: DataFrame, labelled: DataFrame) -> DataFrame:
    named = labelled.select("section", F.col("obs_id").alias("other_id"), F.col("label").alias("vote"))
    return near.join(named, ["section", "other_id"])


def refine_labels(obs: DataFrame, k: int = 8) -> DataFrame:
    """A label changes if another one has more than half of the k + 1 nearest points, itself included."""
    votes = _votes(plane_neighbours(obs, obs, k + 1), obs)
    n = votes.groupBy("section", "obs_id", "vote").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("section", "obs_id").orderBy(F.desc("n"), "vote")
    top = n.withColumn("all", F.sum("n").over(Window.partitionBy("section", "obs_id"))).withColumn("r", F.row_number().over(order)).where("r = 1")
    return obs.join(top, ["section", "obs_id"]).select("section", "obs_id", "label", F.when(F.col("n") * 2 > F.col("all"), F.col("vote")).otherwise(F.col("label")).alias("refined"))


def nearest_majority(points: DataFrame, labelled: DataFrame, k: int, weighted: bool = False) -> DataFrame:
    """The label of most of a point's k nearest labelled points, ``(section, obs_id, label)``.

    With ``weighted`` votes count by inverse distance (1e-8 added). Of labels with equal votes the one whose
    nearest point is nearest wins.
    """
    votes = _votes(plane_neighbours(points, labelled, k), labelled)
    weight = F.sum(1 / (F.sqrt("d2") + 1e-8)) if weighted else F.count(F.lit(1)).cast("double")
    n = votes.groupBy("section", "obs_id", F.col("vote").alias("label")).agg(F.round(weight, 6).alias("w"), F.min("place").alias("first"))
    order = Window.partitionBy("section", "obs_id").orderBy(F.desc("w"), "first")
    return n.withColumn("r", F.row_number().over(order)).where("r = 1").select("section", "obs_id", "label")


def pooled_majority(points: DataFrame, labelled: DataFrame, k: int) -> DataFrame:
    """The label of most of all neighbours of a section's points together, ties by name: ``(section, label, n)``."""
    n = _votes(plane_neighbours(points, labelled, k), labelled).groupBy("section", F.col("vote").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("section").orderBy(F.desc("n"), "label"))).where("r = 1").drop("r")


def label_shares(obs: DataFrame, k: int = 6) -> DataFrame:
    """The share of each label among a point's k nearest, itself included, ties to the label in order of name."""
    return shares_of(_votes(plane_neighbours(obs, obs, k), obs))


def shares_of(votes: DataFrame) -> DataFrame:
    """Labels of each point's neighbours by falling count, then name, with their share."""
    n = votes.groupBy("section", "obs_id", F.col("vote").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("section", "obs_id")
    return n.withColumn("share", F.col("n") / F.sum("n").over(by)).withColumn("place", F.row_number().over(by.orderBy(F.desc("n"), "label")))


def distance_quantile(points: DataFrame, others: DataFrame, q: float | None = None, k: int | None = None, own: bool = False, bins: int = 4_096) -> DataFrame:
    """A section's radius as a quantile of distances, linearly interpolated: ``(section, radius)``.

    Between all points and all others, or with ``own`` between the different pairs of one table. ``q`` is given
    as it is, or as ``k`` over the number of others (with ``own``, others but one), 1 at most.

    A section's pairs are compared in blocks inside tasks, which return counts by bin of the squared distance;
    the pairs of the bins that hold the two order statistics are then looked at again. So the work is that of
    all pairs, as the definition asks, but what is sent and held does not depend on their number.
    """
    key = ["section"]
    span = lambda df: df.groupBy("section").agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y") for f, n in ((F.min, "low"), (F.max, "high"))], F.count(F.lit(1)).alias("n"))
    a, b = span(points).alias("a"), span(others).alias("b")
    reach = lambda c: F.greatest(F.col(f"a.high_{c}") - F.col(f"b.low_{c}"), F.col(f"b.high_{c}") - F.col(f"a.low_{c}"))
    pairs = (F.col("a.n") * (F.col("a.n") - 1) / 2).cast("long") if own else F.col("a.n") * F.col("b.n")
    share = F.lit(float(q)) if q is not None else F.least(F.lit(1.0), F.lit(float(k)) / (F.col("b.n") - (1 if own else 0)))
    plan = a.join(b, F.col("a.section") == F.col("b.section")).select("a.section", F.sqrt(reach("x") ** 2 + reach("y") ** 2).alias("wide"), ((pairs - 1) * share).alias("at"), F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"), pairs.alias("pairs")).where("pairs > 0")
    plan = if_small(plan)

    def dealt(df: DataFrame, mine: str, theirs: str, block: str, other: str) -> DataFrame:
        n_blocks = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / BLOCK_ROWS)).cast("int")
        return df.join(plan, key).select("section", "obs_id", "x", "y", "wide", F.pmod(F.xxhash64("obs_id"), n_blocks(mine)).cast("int").alias(block), F.explode(F.sequence(F.lit(0), n_blocks(theirs) - 1)).alias(other))

    left = dealt(points, "n_a", "n_b", "i", "j")
    right = dealt(others, "n_b", "n_a", "j", "i").toDF(*[f"{c}_b" for c in ("section", "obs_id", "x", "y", "wide", "j", "i")])

    def distances(p: pa.Table, o: pa.Table) -> np.ndarray:
        at = lambda t, c: t.column(c).to_numpy()
        d = np.sqrt((at(p, "x")[:, None] - at(o, "x_b")[None]) ** 2 + (at(p, "y")[:, None] - at(o, "y_b")[None]) ** 2)
        return d[at(p, "obs_id")[:, None] < at(o, "obs_id_b")[None]] if own else d.ravel()

    def count(p: pa.Table, o: pa.Table) -> pa.Table:
        if not len(p) or not len(o):
            return pa.table({"section": pa.array([], pa.string()), "bin": pa.array([], pa.int32()), "c": pa.array([], pa.int64())})
        wide = max(p.column("wide")[0].as_py(), 1e-300)
        bin_, n = np.unique(np.minimum((distances(p, o) / wide * bins).astype(np.int32), bins - 1), return_counts=True)
        return pa.table({"section": pa.array([p.column("section")[0].as_py()] * len(n), pa.string()), "bin": pa.array(bin_), "c": pa.array(n.astype(np.int64))})

    blocks = lambda df: df.groupBy("section", "i", "j").cogroup(right.groupBy("section_b", "i_b", "j_b"))
    counted = blocks(left).applyInArrow(count, "section string, bin int, c long").groupBy("section", "bin").agg(F.sum("c").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("section").orderBy("bin"))  # a row a bin
    ranked = counted.withColumn("before", upto - F.col("c")).join(plan, key)
    low, high = F.floor("at"), F.ceil("at")
    wanted = ranked.where((F.col("before") <= high) & (F.col("before") + F.col("c") > low)).groupBy("section").agg(F.collect_set("bin").alias("bins"), F.min("before").alias("before"), F.first("at").alias("at"))
    wanted = if_small(wanted)

    def values(p: pa.Table, o: pa.Table) -> pa.Table:
        if not len(p) or not len(o):
            return pa.table({"section": pa.array([], pa.string()), "d": pa.array([], pa.float64()), "c": pa.array([], pa.int64())})
        wide, d = max(p.column("wide")[0].as_py(), 1e-300), distances(p, o)
        here = np.isin(np.minimum((d / wide * bins).astype(np.int32), bins - 1), p.column("bins")[0].as_py())
        own_d, n = np.unique(d[here], return_counts=True)
        return pa.table({"section": pa.array([p.column("section")[0].as_py()] * len(n), pa.string()), "d": pa.array(own_d), "c": pa.array(n.astype(np.int64))})

    again = blocks(left.join(wanted, key)).applyInArrow(values, "section string, d double, c long").groupBy("section", "d").agg(F.sum("c").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("section").orderBy("d"))
    placed = again.withColumn("upto", upto).join(wanted, key).withColumn("last", F.col("before") + F.col("upto") - 1).withColumn("first", F.col("last") - F.col("c") + 1)
    holds = lambda rank: F.max(F.when((F.col("first") <= rank) & (rank <= F.col("last")), F.col("d")))
    ends = placed.groupBy("section").agg(holds(low).alias("low"), holds(high).alias("high"), F.first("at").alias("at"))
    return ends.select("section", (F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at"))).alias("radius"))


def within_radius(points: DataFrame, others: DataFrame, radii: DataFrame) -> DataFrame:
    """The others of the same section no further from a point than its section's radius.

    ``(section, obs_id, other_id, d2)``, by cells of the radius; ``radii(section, radius)`` has a row a section.
    """
    step = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    cell = lambda c: F.floor(F.col(c) / F.greatest("radius", F.lit(1e-12))).cast("long")
    known = if_small(radii)
    here = others.join(known, "section").select("section", F.col("obs_id").alias("other_id"), "x", "y", cell("x").alias("gx"), cell("y").alias("gy")).alias("o")
    asked = points.join(known, "section").select("section", "obs_id", "x", "y", "radius", cell("x").alias("cx"), cell("y").alias("cy")).withColumn("dx", step).withColumn("dy", step)
    asked = asked.withColumn("gx", F.col("cx") + F.col("dx")).withColumn("gy", F.col("cy") + F.col("dy")).alias("p")
    pairs = asked.join(here, (F.col("p.section") == F.col("o.section")) & (F.col("p.gx") == F.col("o.gx")) & (F.col("p.gy") == F.col("o.gy")))
    return pairs.where(F.sqrt(_distance2("p", "o")) <= F.col("p.radius")).select("p.section", "p.obs_id", "o.other_id", _distance2("p", "o").alias("d2"))


def annotate_spots(spots: DataFrame, pseudo: DataFrame, k: int, mode: str = "knn", small_regions: bool = False, dominant: float = 0.5, small: float = 0.25, novel: str = "novel_cluster", unknown: str = "unknown") -> DataFrame:
    """A label for each spot from the pseudo-spots round it: ``(section, obs_id, label, share)``.

    Neighbours are the k nearest (``knn``) or those within the distance quantile k / n (``radius``, J10). The
    commonest label wins, ties by name, but the novel one only where there is no other. With ``small_regions``,
    and a label of at least ``dominant`` of a section's pseudo-spots, a runner-up whose share of the section is
    below ``small`` wins if the winner is no such label and its share round the spot is above ``small``. Spots
    without neighbours are ``unknown``.
    """
    if mode == "knn":
        near = plane_neighbours(spots, pseudo, k)
    else:
        near = within_radius(spots, pseudo, distance_quantile(spots, pseudo, k=k))
    shares = shares_of(_votes(near, pseudo))
    whole = pseudo.groupBy("section", "label").agg(F.count(F.lit(1)).alias("n"))
    in_section = Window.partitionBy("section")  # a row a label
    part = F.col("n") / F.sum("n").over(in_section)
    sized = whole.withColumn("part", part).withColumn("top", F.max("part").over(in_section))
    rare = sized.where((F.col("top") >= dominant) & (F.col("part") < small) & (F.col("label") != novel)).select("section", "label", F.lit(True).alias("rare"))
    marked = shares.join(if_small(rare), ["section", "label"], "left").withColumn("rare", F.coalesce("rare", F.lit(False)))
    of = lambda place, c: F.max(F.when(F.col("place") == place, F.col(c)))
    firsts = marked.where("place <= 2").groupBy("section", "obs_id").agg(*[of(p, c).alias(f"{c}_{p}") for p in (1, 2) for c in ("label", "share", "rare")])
    second = (F.col("label_1") == novel) & F.col("label_2").isNotNull()
    if small_regions:
        second = second | (~F.col("rare_1") & F.coalesce("rare_2", F.lit(False)) & (F.col("share_2") > small))
    chosen = firsts.select("section", "obs_id", F.when(second, F.col("label_2")).otherwise(F.col("label_1")).alias("label"), F.when(second, F.col("share_2")).otherwise(F.col("share_1")).alias("share"))
    return spots.select("section", "obs_id").join(chosen, ["section", "obs_id"], "left").select("section", "obs_id", F.coalesce("label", F.lit(unknown)).alias("label"), "share")


def radius_pairs(obs: DataFrame, radius: float) -> DataFrame:
    """Pairs of a section's points no further apart than ``radius``, each with itself too, by cells of that size."""
    grid = lambda c: F.floor(F.col(c) / radius).cast("long")
    here = obs.select("section", "obs_id", "label", "x", "y", grid("x").alias("cx"), grid("y").alias("cy"))
    step = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    asked = here.withColumn("dx", step).withColumn("dy", step).withColumn("gx", F.col("cx") + F.col("dx")).withColumn("gy", F.col("cy") + F.col("dy")).alias("i")
    pairs = asked.join(here.alias("j"), (F.col("i.section") == F.col("j.section")) & (F.col("i.gx") == F.col("j.cx")) & (F.col("i.gy") == F.col("j.cy")))
    return pairs.where(_distance2("i", "j") <= radius * radius).select(F.col("i.section").alias("section"), F.col("i.obs_id").alias("i"), F.col("i.label").alias("label_i"), F.col("j.obs_id").alias("j"), F.col("j.label").alias("label_j"), F.sqrt(_distance2("i", "j")).alias("distance"))


def neighbour_composition(obs: DataFrame, radius: float) -> DataFrame:
    """A10: different points of each label within ``radius`` of a region; all cells get one more if any is empty."""
    n = radius_pairs(obs, radius).groupBy("section", "label_i", "label_j").agg(F.countDistinct("j").alias("n"))
    labels = obs.select("section", "label").distinct()
    grid = labels.withColumnRenamed("label", "label_i").join(labels.withColumnRenamed("label", "label_j"), "section")
    full = grid.join(n, ["section", "label_i", "label_j"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("n", F.col("n") + F.when(F.min("n").over(Window.partitionBy("section")) == 0, 1).otherwise(0))


def vote_anchors(flags: DataFrame, n_lists: int, rule: str = "union", least: int = 1) -> DataFrame:
    """Observations flagged by any list, by all, or by at least ``least``, for each label."""
    need = {"union": 1, "shared": n_lists, "min_count": least}[rule]
    return flags.groupBy("label", "obs_id").agg(F.countDistinct("section").alias("n_votes")).where(F.col("n_votes") >= need)
