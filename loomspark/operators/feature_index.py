"""An approximate index of vectors for neighbour searches over very many references.

Every reference goes to the list of its nearest centroid and is kept there as a code: its difference from the
centroid, cut into parts of SUB numbers, each replaced by the nearest word of the part's code book. A query looks
into the lists nearest to it, ranks what is there by its codes, and takes exact distances of the best. How many
lists, and how many of the best, follows from a recall goal, measured against the exact search.

The exact search (``neighbours.feature_neighbours``) stays the default; it may read most cells where vectors have
many independent dimensions, which is where an index pays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.blocks import LANES
from loomspark.functions.joins import if_small
from loomspark.operators.embedding import _seeded
from loomspark.operators.neighbours import BLOCK_ROWS, HELD_BYTES, SLICE_ROWS, _stacked, feature_neighbours
from loomspark.sources.materialise import materialise

#: Rows that centroids and code books are fitted on, at most; every row is indexed. Most lists, words of a book.
TRAIN_ROWS, MOST_LISTS, WORDS, SUB = 16_384, 1_024, 256, 4
#: Queries that recall is measured on, at most.
TUNE_QUERIES = 256
#: Queries of a task, and entries and queries that it compares at a time.
QUERY_ROWS, ENTRY_ROWS, SLICE_QUERIES = 16_384, 4_096, 128
#: Codes that a task holds, answers that it gives, and the tasks at least over which vectors of a group are dealt where they fill so many ENTRY_ROWS.
CODE_ROWS, ANSWER_ROWS, SPANS = 1 << 20, 1 << 20, 8


@dataclass(frozen=True)
class Index:
    """Centroids and books (fitted on a sample), and ``entries(key, ref_id, cell, code)`` of all references."""

    centres: np.ndarray
    books: np.ndarray
    entries: DataFrame
    vectors: DataFrame
    metric: str
    key: str | None

    @property
    def n_lists(self) -> int:
        return len(self.centres)


def _named(table: DataFrame, key: str | None, name: str, metric: str) -> DataFrame:
    v = F.col("vector")
    if metric == "cosine":
        v = F.transform(v, lambda a: a / F.sqrt(F.greatest(F.aggregate("vector", F.lit(0.0), lambda s, b: s + b * b), F.lit(1e-300))))
    return table.where(F.col("vector").isNotNull()).select((F.col(key).cast("string") if key else F.lit("")).alias("key"), F.col("obs_id").alias(name), v.alias("vector"))


def _gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ y.T + (y**2).sum(axis=1)[None], 0)


def _parts(residual: np.ndarray, n_parts: int) -> np.ndarray:
    """Rows cut into parts of SUB numbers, the last one filled with 0: ``(rows, parts, SUB)``."""
    out = np.zeros((len(residual), n_parts * SUB))
    out[:, : residual.shape[1]] = residual
    return out.reshape(len(residual), n_parts, SUB)


def build_index(references: DataFrame, key: str | None = None, metric: str = "euclidean", n_lists: int | None = None, train_rows: int = TRAIN_ROWS) -> Index:
    """Index ``references(obs_id, vector)``; rows without a vector are left out.

    ``key`` names a column that keeps searches of several groups apart; they share centroids. Ids are unique
    within a group and of any type. Centroids and books are fitted on at most ``train_rows`` rows, chosen by a
    hash of their ids, so that reruns agree; there are about sqrt(n) lists, MOST_LISTS at most.
    """
    rows = materialise(_named(references, key, "ref_id", metric))
    n = rows.count()
    likely = (F.shiftrightunsigned(F.xxhash64("key", "ref_id"), 11) / float(1 << 53)) * n < 2 * train_rows  # few rows are sorted
    drawn = rows.where(likely).orderBy(F.xxhash64("key", "ref_id"), "key", "ref_id").limit(train_rows).select("vector").toArrow()
    if not len(drawn):
        empty = rows.select("key", "ref_id", F.lit(0).alias("cell"), F.lit(b"").alias("code"))
        return Index(np.zeros((0, 0)), np.zeros((0, 0, SUB)), empty, rows, metric, key)
    x = _stacked(drawn.column("vector").combine_chunks())
    different = len(np.unique(x, axis=0))
    wanted = min(n_lists or max(1, round(n**0.5)), MOST_LISTS, max(1, different))
    centres = _seeded(x, wanted, np.random.default_rng(0))
    n_parts = -(-x.shape[1] // SUB)
    cut = _parts(x - centres[_gaps(x, centres).argmin(axis=1)], n_parts)
    n_words = min(WORDS, max(1, different))
    books = np.stack([_seeded(cut[:, j], n_words, np.random.default_rng(1 + j)) for j in range(n_parts)])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), SLICE_ROWS):
                some = batch.slice(at, SLICE_ROWS)
                v = _stacked(some.column("vector"))
                cell = _gaps(v, centres).argmin(axis=1)
                own = _parts(v - centres[cell], n_parts)
                code = np.stack([_gaps(own[:, j], books[j]).argmin(axis=1) for j in range(n_parts)], axis=1).astype(np.uint8)
                coded = pa.array([c.tobytes() for c in code], pa.binary())
                yield pa.RecordBatch.from_arrays([some.column("key"), some.column("ref_id"), pa.array(cell.astype(np.int32)), coded], ["key", "ref_id", "cell", "code"])

    kind = dict(rows.dtypes)["ref_id"]
    return Index(centres, books, materialise(rows.mapInArrow(encode, f"key string, ref_id {kind}, cell int, code binary")), rows, metric, key)


def _scan(index_centres: np.ndarray, books: np.ndarray, most: int, left: pa.Table, right: pa.Table, schema: pa.Schema) -> pa.Table:
    """The ``most`` entries of one block nearest to each query by code, ties to the smaller id."""
    if not len(left) or not len(right):
        return schema.empty_table()
    left, right = left.combine_chunks(), right.combine_chunks()
    x = _parts(_stacked(left.column("vector").chunk(0)) - index_centres[left.column("cell")[0].as_py()], len(books))
    code = np.frombuffer(b"".join(right.column("code").to_pylist()), dtype=np.uint8).reshape(len(right), len(books))
    d = np.zeros((len(left), len(right)))
    for j, book in enumerate(books):
        d += _gaps(x[:, j], book)[:, code[:, j]]
    ids = np.unique(right.column("ref_id").to_numpy(), return_inverse=True)[1]
    bound = np.partition(d, most - 1, axis=1)[:, most - 1 : most] if d.shape[1] > most else np.inf
    rows, columns = np.nonzero(d <= bound)
    order = np.lexsort((ids[columns], d[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < most
    rows, columns = rows[keep], columns[keep]
    asked, found = pa.array(rows), pa.array(columns)
    return pa.table([left.column("key").take(asked), left.column("query_id").take(asked), right.column("ref_id").take(found), pa.array(d[rows, columns])], schema=schema)


def _first(rows: np.ndarray, far: np.ndarray, columns: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``most`` first of each row by ``far``, ties to the smaller id."""
    order = np.lexsort((ids[columns], far, rows))
    rows, far, columns = rows[order], far[order], columns[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < most
    return rows[keep], far[keep], columns[keep]


def _scan_codes(centres: np.ndarray, books: np.ndarray, probes: int, most: int, left: pa.Table, right: pa.Table, schema: pa.Schema) -> pa.Table:
    """Of the entries ``right`` in lists that a query of ``left`` looks into the ``most`` best by code.

    SLICE_QUERIES queries meet ENTRY_ROWS entries at a time.
    """
    if not len(left) or not len(right):
        return schema.empty_table()
    left, right = left.combine_chunks(), right.combine_chunks()
    x, cell = _stacked(left.column("vector").chunk(0)), right.column("cell").to_numpy()
    code = np.frombuffer(b"".join(right.column("code").to_pylist()), dtype=np.uint8).reshape(len(right), len(books))
    ids = np.unique(right.column("ref_id").to_numpy(), return_inverse=True)[1]  # by their order, whatever their type
    slices = [slice(i, i + SLICE_QUERIES) for i in range(0, len(x), SLICE_QUERIES)]
    looks = np.zeros((len(x), len(centres)), dtype=bool)
    for s in slices:
        np.put_along_axis(looks[s], np.argsort(_gaps(x[s], centres), axis=1, kind="stable")[:, :probes], True, axis=1)
    none = (np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64))
    kept, added, bound = [none] * len(slices), [[] for _ in slices], np.full(len(x), np.inf)

    def trim(i: int) -> None:
        kept[i] = _first(*(np.concatenate(c) for c in zip(kept[i], *added[i], strict=True)), ids, most)
        rows, coded, _ = kept[i]
        size = np.bincount(rows, minlength=len(bound[slices[i]]))
        bound[slices[i]] = np.where(size >= most, coded[np.minimum(np.cumsum(size) - 1, len(coded) - 1)] if len(coded) else np.inf, np.inf)  # a row's last is its largest
        added[i].clear()

    for first in range(0, len(right), ENTRY_ROWS):
        block = slice(first, first + ENTRY_ROWS)
        built = centres[cell[block]] + np.concatenate([book[code[block, j]] for j, book in enumerate(books)], axis=1)[:, : centres.shape[1]]
        for i, s in enumerate(slices):
            d = _gaps(x[s], built)
            near = (d <= bound[s][:, None]) & looks[s][:, cell[block]]
            many = np.flatnonzero(np.count_nonzero(near, axis=1) > most)
            if len(many):
                near[many] &= d[many] <= np.partition(np.where(near[many], d[many], np.inf), most - 1, axis=1)[:, most - 1 : most]
            rows, columns = np.nonzero(near)
            added[i].append((rows, d[rows, columns], columns + first))
            if sum(len(c[0]) for c in added[i]) >= len(d) * most:  # else bounds would hardly change
                trim(i)
    for i in range(len(slices)):
        trim(i)
    rows, coded, columns = (np.concatenate(c) for c in zip(*((rows + s.start, coded, columns) for s, (rows, coded, columns) in zip(slices, kept, strict=True)), strict=True))
    own, other = pa.array(rows), pa.array(columns)
    return pa.table([left.column("key").take(own), left.column("query_id").take(own), right.column("ref_id").take(other), pa.array(coded)], schema=schema)


def _measure(k: int, left: pa.Table, right: pa.Table, schema: pa.Schema) -> pa.Table:
    """The k nearest, by exact distance, of those of ``right`` that a query of ``left`` names in ``refs``."""
    if not len(left) or not len(right):
        return schema.empty_table()
    left, right = left.combine_chunks(), right.combine_chunks()
    x, y, refs = (_stacked(left.column("vector").chunk(0)), _stacked(right.column("vector").chunk(0)), left.column("refs").chunk(0))
    rows = np.repeat(np.arange(len(left)), np.diff(refs.offsets.to_numpy()))
    columns = pc.index_in(refs.flatten(), value_set=right.column("ref_id").chunk(0)).to_numpy(zero_copy_only=False).astype(np.int64)
    slices = [slice(i, i + ENTRY_ROWS) for i in range(0, len(rows), ENTRY_ROWS)]
    exact = np.concatenate([np.round(np.sqrt(((x[rows[s]] - y[columns[s]]) ** 2).sum(axis=1)), 9) for s in slices])
    ids = np.unique(right.column("ref_id").to_numpy(), return_inverse=True)[1]
    rows, exact, columns = _first(rows, exact, columns, ids, k)
    own, other = pa.array(rows), pa.array(columns)
    return pa.table([left.column("key").take(own), left.column("query_id").take(own), right.column("ref_id").take(other), pa.array(exact)], schema=schema)


def _search_blocks(index: Index, asked: DataFrame, k: int, probes: int, most: int) -> DataFrame:
    """``search_index`` where queries look into many lists: ``(key, query_id, ref_id, distance)`` of the nearest of the best by code.

    Queries first meet the codes, of which a task holds CODE_ROWS, and then the vectors of their best. Both sides of
    a key are dealt over tasks (lanes of queries, spans of entries), so that what a task holds does not grow with
    the tables; a task gets so few queries that its answers are at most ANSWER_ROWS. Codes, which are short, go to each
    lane; a vector goes to each QUERY_ROWS queries.
    """
    centres, books = index.centres, index.books
    held = max(1, HELD_BYTES // (8 * centres.shape[1]))
    all_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    deal = lambda c, m: F.pmod(F.xxhash64(c), F.col(m)).cast("int")
    filled = lambda c, rows: F.greatest(F.lit(1), F.ceil(F.col(c) / rows)).cast("int")
    sizes = asked.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(index.entries.groupBy("key").agg(F.count(F.lit(1)).alias("m")), "key")
    lane_rows = max(1, min(QUERY_ROWS, held, max(SLICE_QUERIES, ANSWER_ROWS // most)))
    plan = if_small(sizes.select(
        "key", F.greatest(filled("n", lane_rows), F.least(F.lit(LANES), filled("n", SLICE_QUERIES))).alias("lanes"), filled("m", CODE_ROWS).alias("spans"),
        filled("n", min(QUERY_ROWS, held)).alias("vector_lanes"), F.greatest(filled("m", held), F.least(F.lit(SPANS), filled("m", ENTRY_ROWS))).alias("vector_spans"),
    ))
    id_kinds = {"query_id": dict(asked.dtypes)["query_id"], "ref_id": dict(index.entries.dtypes)["ref_id"]}

    def answers(task: Callable[[pa.Table, pa.Table, pa.Schema], pa.Table], left: DataFrame, right: DataFrame, value: str) -> DataFrame:
        def run(a: pa.Table, b: pa.Table) -> pa.Table:
            return task(a, b, pa.schema([("key", pa.string()), ("query_id", a.schema.field("query_id").type), ("ref_id", b.schema.field("ref_id").type), (value, pa.float64())]))

        by = ["key", "span", "lane"]
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, f"key string, query_id {id_kinds['query_id']}, ref_id {id_kinds['ref_id']}, {value} double")

    left = asked.join(plan, "key").select("key", "query_id", "vector", deal("query_id", "lanes").alias("lane"), all_of("spans").alias("span"))
    right = index.entries.join(plan, "key").select("key", "ref_id", "cell", "code", deal("ref_id", "spans").alias("span"), all_of("lanes").alias("lane"))
    coded = answers(lambda a, b, schema: _scan_codes(centres, books, probes, most, a, b, schema), left, right, "coded")
    order = Window.partitionBy("key", "query_id").orderBy("coded", "ref_id")
    best = coded.withColumn("at", F.row_number().over(order)).where(F.col("at") <= most)
    named = best.join(plan, "key").groupBy("key", "query_id", deal("ref_id", "vector_spans").alias("span")).agg(F.collect_list("ref_id").alias("refs"))
    left = named.join(asked, ["key", "query_id"]).join(plan, "key").select("key", "query_id", "vector", "refs", "span", deal("query_id", "vector_lanes").alias("lane"))
    right = index.vectors.join(plan, "key").select("key", "ref_id", "vector", deal("ref_id", "vector_spans").alias("span"), all_of("vector_lanes").alias("lane"))
    return answers(lambda a, b, schema: _measure(k, a, b, schema), left, right, "distance")


def search_index(index: Index, queries: DataFrame, k: int, probes: int, refine: int = 4) -> DataFrame:
    """The k references nearest to each query among those found: ``(key, query_id, ref_id, distance, place)``.

    A query looks into ``probes`` lists, by copies of it up to LANES lists and in blocks beyond; exact distances are taken of its ``refine * k`` best entries by code, and
    ranked as in the exact search. Lists and their queries are cut into blocks, so no group grows with the
    data. Fewer than k rows come back where the lists hold fewer.
    """
    asked = _named(queries, index.key, "query_id", index.metric)
    spark, kinds = queries.sparkSession, (dict(asked.dtypes)["query_id"], dict(index.entries.dtypes)["ref_id"])
    near_schema = f"key string, query_id {kinds[0]}, ref_id {kinds[1]}, coded double"
    if not index.n_lists:
        return spark.createDataFrame([], f"key string, query_id {kinds[0]}, ref_id {kinds[1]}, distance double, place int")
    centres, books, most, probes = index.centres, index.books, k * refine, min(probes, index.n_lists)
    if probes > LANES:  # copies of queries for their lists would be more than those of the index for its tasks
        return _ranked(_search_blocks(index, asked, k, probes, most), k, index.metric)

    def to_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            some = max(1, SLICE_ROWS // probes)  # as many copies of a vector as lists it looks into
            for i in range(0, len(batch), some):
                own = np.argsort(_gaps(_stacked(batch.column("vector").slice(i, some)), centres), axis=1, kind="stable")[:, :probes]
                kept = batch.take(pa.array(np.repeat(np.arange(i, i + len(own)), probes)))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(own.ravel().astype(np.int32))], ["key", "query_id", "vector", "cell"])

    probing = materialise(asked.mapInArrow(to_lists, f"key string, query_id {kinds[0]}, vector array<double>, cell int"))
    sizes = index.entries.groupBy("key", "cell").agg(F.count(F.lit(1)).alias("n_refs"))
    n_asked = probing.groupBy("key", "cell").agg(F.count(F.lit(1)).alias("n_asked"))
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / BLOCK_ROWS)).cast("int")
    both = if_small(n_asked.join(sizes, ["key", "cell"]).select("key", "cell", blocks("n_asked").alias("qs"), blocks("n_refs").alias("rs")))
    all_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    deal = lambda c, m: F.pmod(F.xxhash64(c), F.col(m)).cast("int")
    left = probing.join(both, ["key", "cell"]).select("key", "cell", "query_id", "vector", deal("query_id", "qs").alias("qb"), all_of("rs").alias("rb"))
    right = index.entries.join(both, ["key", "cell"]).select("key", "cell", "ref_id", "code", deal("ref_id", "rs").alias("rb"), all_of("qs").alias("qb"))
    block = ["key", "cell", "qb", "rb"]

    def scan(a: pa.Table, b: pa.Table) -> pa.Table:
        kind = lambda t, c: t.schema.field(c).type
        schema = pa.schema([("key", pa.string()), ("query_id", kind(a, "query_id")), ("ref_id", kind(b, "ref_id")), ("coded", pa.float64())])
        return _scan(centres, books, most, a, b, schema)

    coded = left.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(scan, near_schema)
    best = coded.withColumn("at", F.row_number().over(Window.partitionBy("key", "query_id").orderBy("coded", "ref_id"))).where(F.col("at") <= most)
    pairs = best.select("key", "query_id", "ref_id").join(asked.withColumnRenamed("vector", "v"), ["key", "query_id"]).join(index.vectors.withColumnRenamed("vector", "u"), ["key", "ref_id"])
    square: Column = F.aggregate(F.zip_with("v", "u", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, a: s + a)
    exact = pairs.select("key", "query_id", "ref_id", F.round(F.sqrt(square), 9).alias("distance"))
    return _ranked(exact, k, index.metric)


def _ranked(exact: DataFrame, k: int, metric: str) -> DataFrame:
    order = Window.partitionBy("key", "query_id").orderBy("distance", "ref_id")
    ranked = exact.select("key", "query_id", "ref_id", "distance").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return ranked.withColumn("distance", F.col("distance") ** 2 / 2) if metric == "cosine" else ranked


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact neighbours that were found; 1 if there are none."""
    both = exact.select("key", "query_id", "ref_id").join(found.select("key", "query_id", "ref_id", F.lit(1).alias("hit")), ["key", "query_id", "ref_id"], "left")
    n, hits = both.agg(F.count(F.lit(1)), F.count("hit")).first()
    return hits / n if n else 1.0


def tune(index: Index, queries: DataFrame, references: DataFrame, k: int, goal: float = 0.95) -> tuple[int, int, float]:
    """``(probes, refine, recall)`` that reach the goal on at most TUNE_QUERIES queries, chosen by a hash.

    Their exact neighbours tell in how many lists they lie, hence the number of lists, with half the allowed loss;
    then ``refine`` doubles until the measured recall reaches the goal, which it does once it covers all that
    the lists hold.
    """
    if not index.n_lists:
        return 1, 1, 1.0
    some = materialise(queries.where(F.col("vector").isNotNull()).orderBy(F.xxhash64("obs_id"), "obs_id").limit(TUNE_QUERIES))
    exact = materialise(feature_neighbours(some, references.where(F.col("vector").isNotNull()), k, index.key, index.metric))
    where = exact.join(index.entries.select("key", "ref_id", "cell"), ["key", "ref_id"]).select("key", "query_id", "cell")
    lying = where.join(_named(some, index.key, "query_id", index.metric), ["key", "query_id"]).select("cell", "vector").toArrow()  # TUNE_QUERIES * k rows
    if not len(lying):
        return 1, 1, 1.0
    order = _gaps(_stacked(lying.column("vector").combine_chunks()), index.centres).argsort(axis=1, kind="stable")
    rank = np.sort((order == lying.column("cell").to_numpy()[:, None]).argmax(axis=1))
    probes = int(rank[min(len(rank) - 1, int(np.ceil((1 + goal) / 2 * len(rank))) - 1)]) + 1
    n, refine = index.entries.count(), 4
    while True:
        reached = recall(search_index(index, some, k, probes, refine), exact)
        if reached >= goal or refine * k >= n:
            return probes, refine, reached
        refine *= 2


def indexed_neighbours(queries: DataFrame, references: DataFrame, k: int, key: str | None = None, metric: str = "euclidean", goal: float = 0.95) -> DataFrame:
    """J06 by an index tuned to ``goal``; takes and returns what ``feature_neighbours`` does, so ``anchors`` may use it."""
    index = build_index(references, key, metric)
    probes, refine, _ = tune(index, queries, references, k, goal)
    return search_index(index, queries, k, probes, refine)
