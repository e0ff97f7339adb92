"""Graph clustering of many groups at once, by modularity with a resolution.

A group is a section, a cluster or any other key; its graph links each observation with its nearest others. A graph
is cut into blocks of nodes, as many as its edges need, dealt anew each round so that small communities stay together.
A round joins the edges with the communities at their far ends; each block then moves its own nodes one after the
other while all others stay, and a coin tossed by hash for each pair of communities says which way nodes may go
between blocks, so that two do not swap places for ever. Nodes of a block that ended in one community are joined to
connected parts, which become the nodes of the next, smaller graph.

Tables are a row an edge or a row a node, a task holds one block, and the driver sees one row a group and round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.joins import if_small
from loomspark.operators.components import connected_components
from loomspark.operators.embedding import dense_by_size
from loomspark.operators.neighbours import feature_neighbours
from loomspark.sources.materialise import materialise

#: Edges that a block is meant to hold, rounds of a level where a graph has several, levels, and passes over a block.
BLOCK_EDGES, ROUNDS, LEVELS, PASSES = 500_000, 8, 10, 30
#: Steps of the bisection for a point's bandwidth, and its least value as a share of the mean distance.
BISECTIONS, LEAST_BANDWIDTH = 64, 1e-3


def bandwidths(d: np.ndarray, target: float) -> tuple[np.ndarray, np.ndarray]:
    """``(nearest, bandwidth)`` of each row of distances (nan: none): weights exp(-(d - nearest) / bandwidth) add up to ``target``."""
    known = ~np.isnan(d)
    nearest = np.where(known & (d > 0), d, np.inf).min(axis=1, initial=np.inf)
    nearest = np.where(np.isfinite(nearest), nearest, 0.0)
    beyond = np.where(known, np.maximum(d - nearest[:, None], 0), np.inf)
    low, high, width = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
    for _ in range(BISECTIONS):
        much = np.exp(-beyond / np.maximum(width, 1e-300)[:, None]).sum(axis=1) > target
        high, low = np.where(much, width, high), np.where(much, low, width)
        width = np.where(np.isfinite(high), (low + np.where(np.isfinite(high), high, 0)) / 2, 2 * width)
    mean = np.where(known, d, 0).sum(axis=1) / np.maximum(known.sum(axis=1), 1)
    return nearest, np.maximum(width, np.maximum(LEAST_BANDWIDTH * mean, 1e-12))


def neighbour_graph(vectors: DataFrame, key: str, k: int = 15, metric: str = "euclidean", found: DataFrame | None = None) -> DataFrame:
    """The weighted graph ``(key, a, b, w)``, each edge in both directions, of ``vectors(key, obs_id, vector)``.

    Each point is linked with its k - 1 nearest others, k being cut to the group's rows less one, by the weight of
    ``bandwidths`` with the target log2(k); the weights u and v that two points give each other join to u + v - uv.
    ``found`` is the answer of that search where the caller has it.
    """
    near = (feature_neighbours(vectors, vectors, k, key, metric) if found is None else found).where("query_id != ref_id")
    sizes = if_small(vectors.groupBy(F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")))
    asked = F.least(F.lit(k), F.greatest(F.col("n") - 1, F.lit(1))).cast("int")
    own = near.groupBy("key", "query_id").agg(F.array_sort(F.collect_list(F.struct("distance", "ref_id"))).alias("near"))
    cut = own.join(sizes, "key").select("key", "query_id", asked.alias("k"), F.slice("near", F.lit(1), F.greatest(asked - 1, F.lit(1))).alias("near"))
    flat = cut.select("key", F.col("query_id").alias("a"), "k", F.transform("near", lambda x: x["ref_id"]).alias("others"), F.transform("near", lambda x: x["distance"]).alias("distances"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(batch.column(4).offsets.to_numpy())
            inside = np.arange(max(lengths, default=0))[None] < lengths[:, None]
            d = np.full(inside.shape, np.nan)
            d[inside] = batch.column(4).flatten().to_numpy(zero_copy_only=False)
            target = np.log2(np.maximum(batch.column(2).to_numpy(), 2))
            nearest, width = bandwidths(d, target)
            w = np.exp(-np.maximum(d - nearest[:, None], 0) / width[:, None])[inside]
            row = pa.array(np.repeat(np.arange(len(lengths)), lengths))
            a, b = batch.column(1).take(row), batch.column(3).flatten()
            for ends in ((a, b), (b, a)):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), *ends, pa.array(w)], ["key", "a", "b", "w"])

    both = flat.mapInArrow(weigh, "key string, a long, b long, w double")
    joined = F.sum("w") - F.when(F.count(F.lit(1)) > 1, F.min("w") * F.max("w")).otherwise(0.0)
    return both.groupBy("key", "a", "b").agg(joined.alias("w"))


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """``(key, quality)`` of ``labels(key, node, community)`` on a graph whose edges stand in both directions."""
    ends = edges.join(labels.select("key", F.col("node").alias("a"), F.col("community").alias("ca")), ["key", "a"]).join(labels.select("key", F.col("node").alias("b"), F.col("community").alias("cb")), ["key", "b"])
    by = ends.groupBy("key", "ca").agg(F.sum("w").alias("volume"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inside"))
    total = F.sum("volume")
    return by.groupBy("key").agg((F.sum("inside") / total - resolution * F.sum(F.col("volume") * F.col("volume")) / (total * total)).alias("quality"))


def _scattered(x: np.ndarray, seed: int) -> np.ndarray:
    """A hash of 64-bit integers."""
    x = (x.astype(np.int64).view(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@dataclass
class Block:
    """A block's own nodes (places 0 to n_own - 1 of ``ids``) with their links, and the nodes that these lead to."""

    ids: np.ndarray
    n_own: int
    first: np.ndarray  # links of own node i: first[i] to first[i + 1]
    to: np.ndarray  # place in ids
    w: np.ndarray
    degree: np.ndarray  # of own nodes
    community: np.ndarray  # of all ids, as places in names
    names: np.ndarray
    volume: np.ndarray  # of names
    two_m: float

    @classmethod
    def read(cls, table: pa.Table) -> Block:
        a, b, w = (table.column(c).to_numpy() for c in ("a", "b", "w"))
        order = np.lexsort((b, a))
        a, b, w = a[order], b[order], w[order]
        own, begin = np.unique(a, return_index=True)
        ids = np.concatenate((own, np.setdiff1d(b, own)))
        by_name = np.argsort(ids, kind="stable")
        place = lambda x: by_name[np.searchsorted(ids[by_name], x)]
        labels = np.zeros(len(ids), dtype=np.int64)
        near, far, near_volume, far_volume = (table.column(c).to_numpy()[order] for c in ("near", "far", "near_volume", "far_volume"))
        labels[place(b)], labels[place(a)] = far, near
        names, at = np.unique(np.concatenate((near, far)), return_index=True)
        volume = np.concatenate((near_volume, far_volume))[at]
        return cls(ids, len(own), np.append(begin, len(a)), place(b), w, table.column("degree").to_numpy()[order][begin], np.searchsorted(names, labels), names, volume, float(table.column("two_m")[0].as_py()))

    def near(self) -> list[list[tuple[int, float]]]:
        """``(place in ids, weight)`` of the links of each own node, but those with itself."""
        to, w, first = self.to.tolist(), self.w.tolist(), self.first.tolist()
        return [[x for x in zip(to[first[i] : first[i + 1]], w[first[i] : first[i + 1]], strict=True) if x[0] != i] for i in range(self.n_own)]

    def settle(self, resolution: float, seed: int) -> np.ndarray:
        """Communities (places in names) of the own nodes after moving them, one at a time, until none gains."""
        label, volume, names = self.community.tolist(), self.volume.tolist(), self.names
        near, degree, scale = self.near(), self.degree.tolist(), resolution / self.two_m
        at_home = np.zeros(len(names), dtype=bool)
        at_home[self.community[: self.n_own]] = True
        foreign = np.zeros(len(names), dtype=bool)
        foreign[self.community[self.n_own :]] = True
        # A community is this block's alone if only own nodes of it are known; others may change meanwhile.
        alone, coin = (at_home & ~foreign).tolist(), (_scattered(names, seed) & np.uint64(1)).tolist()
        rank = np.argsort(_scattered(self.ids[: self.n_own], seed + 1), kind="stable").tolist()
        # A node that stayed stays again until one of the communities that it is in or linked with has gained or lost a node.
        moves, changed = 0, [0] * len(names)
        stayed, around = [-1] * self.n_own, [()] * self.n_own
        for _ in range(PASSES):
            n_moved = 0
            for i in rank:
                since = stayed[i]
                if since >= 0:
                    for c in around[i]:
                        if changed[c] > since:
                            break
                    else:
                        continue
                own, links = label[i], {}
                for j, weight in near[i]:
                    c = label[j]
                    links[c] = links.get(c, 0.0) + weight
                pull = scale * degree[i]
                best, most = own, links.get(own, 0.0) - pull * (volume[own] - degree[i]) + 1e-9
                for c, weight in links.items():
                    gain = weight - pull * volume[c]
                    if gain > most and c != own and (alone[c] or alone[own] or (coin[c] != coin[own]) == (c < own)):
                        best, most = c, gain
                if best != own:
                    volume[own] -= degree[i]
                    volume[best] += degree[i]
                    label[i] = best
                    n_moved += 1
                    moves += 1
                    changed[own] = changed[best] = moves
                    stayed[i] = -1
                else:
                    stayed[i], around[i] = moves, (own, *links)
            if not n_moved:
                break
        return np.array(label[: self.n_own], dtype=np.int64)

    def parts(self, community: np.ndarray, resolution: float, seed: int) -> np.ndarray:
        """Connected parts (places of own nodes) of the communities: single nodes join the part they gain most by."""
        to, w, first, degree, scale = self.to.tolist(), self.w.tolist(), self.first.tolist(), self.degree.tolist(), resolution / self.two_m
        part, size, volume, label = list(range(self.n_own)), [1] * self.n_own, list(degree), community.tolist()
        for i in np.argsort(_scattered(self.ids[: self.n_own], seed + 2), kind="stable").tolist():
            if size[i] != 1 or part[i] != i:
                continue
            links: dict[int, float] = {}
            for e in range(first[i], first[i + 1]):
                j = to[e]
                if j != i and j < self.n_own and label[j] == label[i]:
                    links[part[j]] = links.get(part[j], 0.0) + w[e]
            best, most = i, 0.0
            for p, weight in links.items():
                gain = weight - scale * degree[i] * volume[p]
                if gain > most:
                    best, most = p, gain
            if best != i:
                size[best] += 1
                volume[best] += degree[i]
                size[i], part[i] = 0, best
        return np.array(part, dtype=np.int64)


def _round(links: DataFrame, state: DataFrame, totals: DataFrame, resolution: float, seed: int) -> DataFrame:
    """``(key, node, degree, community, part)`` after every block moved its nodes once."""
    by = state.groupBy("key", "community").agg(F.sum("degree").alias("volume"), F.count(F.lit(1)).alias("members"))
    known = state.join(by, ["key", "community"]).join(totals, "key")
    together = F.when(F.col("members") * F.col("edges") <= F.lit(BLOCK_EDGES // 4) * F.col("nodes"), F.col("community")).otherwise(F.col("node"))
    block = F.pmod(F.xxhash64(F.lit(seed), "key", together), F.col("blocks")).cast("int").alias("block")
    here = known.select("key", F.col("node").alias("a"), F.col("community").alias("near"), F.col("volume").alias("near_volume"), "degree", "two_m", block)
    there = known.select("key", F.col("node").alias("b"), F.col("community").alias("far"), F.col("volume").alias("far_volume"))
    linked = links.join(there, ["key", "b"]).join(here, ["key", "a"])
    stay = here.select("key", "a", F.col("a").alias("b"), F.lit(0.0).alias("w"), F.col("near").alias("far"), F.col("near_volume").alias("far_volume"), "near", "near_volume", "degree", "two_m", "block")

    def work(table: pa.Table) -> pa.Table:
        held = Block.read(table)
        community = held.settle(resolution, seed)
        part = held.parts(community, resolution, seed)
        ids = held.ids[: held.n_own]
        key = pa.array([table.column("key")[0].as_py()] * held.n_own, pa.string())
        return pa.table([key, pa.array(ids), pa.array(held.degree), pa.array(held.names[community]), pa.array(ids[part])], names=["key", "node", "degree", "community", "part"])

    return linked.unionByName(stay).groupBy("key", "block").applyInArrow(work, "key string, node long, degree double, community long, part long")


def _moved(links: DataFrame, state: DataFrame, totals: DataFrame, sizes: dict[str, int], resolution: float, seed: int) -> DataFrame:
    """The rounds of one level; for each group the round of best modularity. A group of one block needs one round only."""
    first = materialise(_round(links, state, totals, resolution, seed))
    several = [key for key, blocks in sizes.items() if blocks > 1]
    if not several:
        return first
    some = F.col("key").isin(several)
    seen, best, graph = [first.where(some)], {}, links.where(some)
    for number in range(1, ROUNDS + 1):
        found = modularity(graph, seen[-1], resolution).collect()  # a row a group; self-links count the same in all rounds
        better = [r.key for r in found if r.key not in best or r.quality > best[r.key][0] + 1e-7]
        best |= {r.key: (r.quality, number - 1) for r in found if r.key in better}
        if not better or number == ROUNDS:
            break
        seen.append(materialise(_round(graph, seen[-1].drop("part"), totals, resolution, seed + 7 * number)))
    chosen = [part.where(F.col("key").isin([k for k, (_, at) in best.items() if at == i])) for i, part in enumerate(seen)]
    return reduce(DataFrame.union, chosen, first.where(~some))


def graph_communities(edges: DataFrame, resolution: float = 0.5, seed: int = 0) -> DataFrame:
    """``(key, node, cluster)`` of the graphs ``edges(key, a, b, w)``; clusters are numbered by falling size.

    Edges are weighted, stand in both directions, and join nodes (longs) of one key; a self-link counts once.
    Every cluster is connected. Reruns agree. A node without any edge has no row; an empty table gives none.
    """
    level = materialise(edges.select(F.col("key").cast("string").alias("key"), "a", "b", F.col("w").cast("double").alias("w")))
    state = level.groupBy("key", F.col("a").alias("node")).agg(F.sum("w").alias("degree")).withColumn("community", F.col("node"))
    members, before = None, None
    for depth in range(LEVELS):
        counted = level.groupBy("key").agg(F.sum("w").alias("two_m"), F.count(F.lit(1)).alias("edges"), F.countDistinct("a").alias("nodes"))
        totals = if_small(counted.withColumn("blocks", F.ceil(F.col("edges") / BLOCK_EDGES).cast("int")))
        sizes = {r.key: (r.nodes, r.blocks) for r in totals.collect()}  # a row a group
        if before is not None and all(sizes[key][0] == before[key][0] for key in sizes):
            break
        moved = _moved(level.where("a != b"), state, totals, {key: blocks for key, (_, blocks) in sizes.items()}, resolution, seed + 1_000 * depth)
        step = moved.select("key", "node", "part")
        members = step.withColumnRenamed("node", "obs") if members is None else members.withColumnRenamed("part", "node").join(step, ["key", "node"]).drop("node")
        end = lambda c: moved.select("key", F.col("node").alias(c), F.col("part").alias(f"p{c}"))  # noqa: E731, B023
        level = materialise(level.join(end("a"), ["key", "a"]).join(end("b"), ["key", "b"]).groupBy("key", F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.sum("w").alias("w")))
        state = moved.groupBy("key", F.col("part").alias("node")).agg(F.sum("degree").alias("degree"), F.min("community").alias("community"))
        before = sizes
    # a community that moves have cut apart is better as its pieces; each node of the last graph is connected in itself
    named = materialise(state.select("key", "node", "community", F.xxhash64("key", "node").alias("id")))
    at = lambda c: named.select("key", F.col("node").alias(c), F.col("community").alias(f"c{c}"), F.col("id").alias(f"i{c}"))
    inside = level.join(at("a"), ["key", "a"]).join(at("b"), ["key", "b"]).where("ca = cb and a < b").select(F.col("ia").alias("a"), F.col("ib").alias("b"))
    pieces = connected_components(named.select(F.col("id").alias("node")), inside).withColumnRenamed("node", "id")
    cut = named.join(pieces, "id").select("key", F.col("node").alias("part"), "component")
    placed = members.join(cut, ["key", "part"])
    least = placed.groupBy("key", "component").agg(F.min("obs").alias("cluster"))
    return dense_by_size(placed.join(least, ["key", "component"]).select("key", F.col("obs").alias("node"), "cluster"), ["key"])


def graph_clusters(vectors: DataFrame, key: str, resolution: float = 0.5, k: int = 10, column: str = "vector", metric: str = "euclidean", seed: int = 0) -> DataFrame:
    """C05, C06 for every group of ``vectors(key, obs_id, column)``: ``(key, obs_id, cluster)``.

    A group of one row is one cluster; ``obs_id`` is a number that is unique in its group.
    """
    rows = vectors.select(F.col(key).cast("string").alias("key"), "obs_id", F.col(column).alias("vector"))
    found = graph_communities(neighbour_graph(rows, "key", k, metric), resolution, seed).withColumnRenamed("node", "obs_id")
    return rows.select("key", "obs_id").join(found, ["key", "obs_id"], "left").withColumn("cluster", F.coalesce("cluster", F.lit(0)))
