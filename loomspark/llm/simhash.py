"""Near-duplicates by SimHash fingerprints, found through vantage-point trees.

A tree over a bounded sample of the fingerprints cuts Hamming space into shards: each node splits by the distance
to its vantage point. By the triangle inequality two fingerprints at most ``radius`` apart lie on the same side, or
one lies outside by at most ``radius``. So whoever is outside but that near the boundary also queries the inner
branch, everyone else prunes it, and each close pair meets in a shard. Inside a shard the same rule goes on with
trees over the shard's own points, and distances are computed among the few that meet in a leaf.

Equal fingerprints are one point, so copies cost nothing, and a leaf of mutually close points gives the links that
join them, not all their pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm import textarrays as ta
from loomspark.llm.graph import components
from loomspark.llm.scratch import durable
from loomspark.llm.skew import join_spread, spread_keys
from loomspark.llm.tables import id_and_text

#: Fingerprints that the shards' tree is built from at most, and those of them that a shard should hold at least.
SAMPLE, SAMPLED_A_SHARD = 1_000_000, 32
#: Points a shard is meant to hold, and points of a leaf inside a shard, whose distances are all computed.
SHARD, LEAF = 4_000, 192
#: Vantage points tried for a node, points by which they are judged, how often a split may place its points on
#: average, and the share of them that a branch may hold.
TRIED, JUDGED, MOST_PLACES, LARGEST_PART = 12, 2_048, 1.8, 0.95
#: Bytes of text whose shingles are hashed at a time.
PIECE_BYTES = 1 << 20

_GAP = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + PIECE_BYTES)
        to = gap.start() if gap else len(text)
        yield text[at:to].lower().split()
        at = to


def fingerprint(text: bytes, k: int) -> int:
    """64 bits, each set if more than half of the shingles' hashes have it; 0 without words."""
    ones, n, words = np.zeros(64, dtype=np.int64), 0, []

    def count(run: list[bytes], size: int) -> int:
        joined = b" ".join(run)
        ends = list(accumulate(map(len, run), lambda end, length: end + 1 + length))
        starts = [0, *(end + 1 for end in ends[: len(run) - size])]
        hashes = np.array([xxhash.xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts, ends[size - 1 :], strict=True)], dtype="<u8")
        ones[:] += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        return len(hashes)

    for more in _pieces(text):
        words += more
        if len(words) >= k:
            n += count(words, k)
            words = words[len(words) - k + 1 :]
    if not n and words:
        n = count(words, len(words))
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int) -> DataFrame:
    """``(doc_id, fingerprint)`` as longs."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = ta.text_bytes(batch.column(1))
            found = [fingerprint(data[offsets[i] : offsets[i + 1]].tobytes(), k) for i in range(len(offsets) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ta.as_signed(np.array(found, dtype=np.uint64)))], ["doc_id", "fingerprint"])

    return id_and_text(docs).mapInArrow(scan, "doc_id long, fingerprint long")


def distances(points: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ point).astype(np.int64)


def choose_split(points: np.ndarray, radius: int) -> tuple[np.uint64, int] | None:
    """A vantage point and threshold: fewest places for the points, none of the branches holding nearly all.

    None where every split would leave the points together or place them too often.
    """
    if len(points) > JUDGED:
        points = points[np.linspace(0, len(points) - 1, JUDGED).astype(np.int64)]
    vantages = points[np.linspace(0, len(points) - 1, min(TRIED, len(points))).astype(np.int64)]
    apart = np.bitwise_count(points[None, :] ^ vantages[:, None]).astype(np.int64) + 66 * np.arange(len(vantages))[:, None]
    upto = np.cumsum(np.bincount(apart.ravel(), minlength=66 * len(vantages)).reshape(-1, 66), axis=1) / len(points)
    thresholds = np.arange(64)
    inner, outer = upto[:, np.minimum(65, thresholds + radius)], 1 - upto[:, thresholds]
    # Halving with few copies: what the larger branch still has to split weighs as much as the copies.
    cost = np.where((np.minimum(inner, outer) > 0) & (np.maximum(inner, outer) < LARGEST_PART), inner + outer + np.abs(inner - outer), np.inf)
    cost[inner + outer >= MOST_PLACES] = np.inf
    row, column = np.unravel_index(int(cost.argmin()), cost.shape)
    return (vantages[row], int(thresholds[column])) if np.isfinite(cost[row, column]) else None


@dataclass
class Tree:
    """Node i: its vantage point, its threshold, and its inner and outer child; a child below 0 is shard ``-1 - child``."""

    vantage: np.ndarray
    threshold: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    shards: int

    def places(self, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(place of a point, shard) for every shard that a point is in or has to query."""
        if not len(self.vantage):
            return np.arange(len(points)), np.zeros(len(points), dtype=np.int64)
        at, shard, open_ = [], [], [(0, np.arange(len(points)))]
        while open_:
            node, here = open_.pop()
            if node < 0:
                at.append(here)
                shard.append(np.full(len(here), -1 - node))
            elif len(here):
                d = distances(points[here], self.vantage[node])
                open_.append((int(self.inner[node]), here[d <= self.threshold[node] + radius]))
                open_.append((int(self.outer[node]), here[d > self.threshold[node]]))
        return np.concatenate(at), np.concatenate(shard)


def grow(points: np.ndarray, radius: int, most: int) -> Tree:
    """A tree over sampled points whose leaves hold at most ``most`` of them where a split exists."""
    vantage, threshold, links, shards = [], [], [], 0
    open_ = [(np.unique(points), None)]
    while open_:
        here, parent = open_.pop()
        split = choose_split(here, radius) if len(here) > most else None
        name = len(vantage) if split else -1 - shards
        if parent is not None:
            links[parent[0]][parent[1]] = name
        if split is None:
            shards += 1
            continue
        d = distances(here, split[0])
        vantage.append(split[0])
        threshold.append(split[1])
        links.append([0, 0])
        open_.append((here[d <= split[1]], (name, 0)))
        open_.append((here[d > split[1]], (name, 1)))
    ends = np.array(links, dtype=np.int64).reshape(-1, 2)
    return Tree(np.array(vantage, dtype=np.uint64), np.array(threshold, dtype=np.int64), ends[:, 0], ends[:, 1], shards)


def _joined(points: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that join all points which chains of close pairs connect; every point is compared with those not reached yet."""
    left = np.arange(len(points))
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            near = distances(points[left], points[x]) <= radius
            if near.any():
                yield np.full(int(near.sum()), x), left[near]
                frontier.extend(left[near])
                left = left[~near]


def close_links(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (places in distinct ``points``) at most ``radius`` apart that connect all that such pairs connect."""
    group = np.arange(len(points))
    one, two = [], []

    def root(x: int) -> int:
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    open_ = [np.arange(len(points))]
    while open_:
        here = open_.pop()
        own = points[here]
        split = choose_split(own, radius) if len(here) > LEAF else None
        if split is not None:
            d = distances(own, split[0])
            open_.append(here[d <= split[1] + radius])
            open_.append(here[d > split[1]])
            continue
        found: Iterator[tuple[np.ndarray, np.ndarray]]
        if len(here) <= LEAF:
            a, b = np.nonzero(np.triu(np.bitwise_count(own[:, None] ^ own[None, :]) <= radius, 1))
            found = iter([(a, b)]) if len(a) <= 4 * len(here) else _joined(own, radius)
        else:
            found = _joined(own, radius)
        for a, b in found:
            for x, y in zip(here[a].tolist(), here[b].tolist(), strict=True):
                p, q = root(x), root(y)
                if p != q:
                    group[max(p, q)] = min(p, q)
                    one.append(x)
                    two.append(y)
    return np.array(one, dtype=np.int64), np.array(two, dtype=np.int64)


def close_pairs(prints: DataFrame, radius: int, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """``(a, b)`` links among the distinct longs ``fingerprint``, joining all that chains of close pairs connect.

    The shards' tree is grown at the driver from at most ``sample`` fingerprints (8 bytes each), those of least
    hash. It is broadcast; with the sample bounded, so is its size: a node for every SAMPLED_A_SHARD of them.
    """
    n = prints.count()
    share = min(1.0, sample / max(1, n))
    bound = int(share * 0.9 * (1 << 62)) if share < 1 else 1 << 62
    picked = prints.where(F.shiftrightunsigned(F.xxhash64("fingerprint"), 2) < bound).limit(sample)
    points = picked.toArrow().column("fingerprint").to_numpy().view(np.uint64)
    tree = prints.sparkSession.sparkContext.broadcast(grow(points, radius, max(SAMPLED_A_SHARD, int(shard * len(points) / max(1, n)))))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            at, shards = tree.value.places(own, radius)
            yield pa.RecordBatch.from_arrays([pa.array(shards), pa.array(own[at].view(np.int64))], ["shard", "fingerprint"])

    def link(group: pa.Table) -> pa.Table:
        own = group.column("fingerprint").to_numpy().view(np.uint64)
        a, b = close_links(own, radius)
        return pa.table({"a": pa.array(own[a].view(np.int64)), "b": pa.array(own[b].view(np.int64))})

    placed = prints.select("fingerprint").mapInArrow(route, "shard long, fingerprint long")
    return placed.groupBy("shard").applyInArrow(link, "a long, b long")


def simhash_duplicates(docs: DataFrame, k: int = 3, radius: int = 2, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """One row a document: ``(doc_id, fingerprint, component_id, kept)``.

    ``docs`` has ``doc_id`` and ``text``; other columns are left alone. A text is lower-cased (A-Z) and cut into words
    at ASCII white space; its shingles are all runs of k words, repeats included, or its whole sequence if it has
    fewer. A bit of the fingerprint (16 lowercase hex digits) is set if more than half of the shingles' XXH64 have
    it. Documents whose fingerprints differ in at most ``radius`` bits are linked, ``component_id`` is the smallest
    doc_id that links reach, and ``kept`` marks that document.

    Null, empty and blank texts have the fingerprint zero and are linked by it like any other. Equal fingerprints
    are linked. Rows of one doc_id but with other texts are judged each by its text. A row whose doc_id is null gets
    the smallest doc_id of its group too, or null if there is none, and is not kept. Repeated rows give repeated
    rows; an empty table gives none.
    """
    scanned = durable(fingerprints(docs, k), "fingerprints")
    counted = durable(scanned.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "classes")
    label = components(durable(close_pairs(counted.select("fingerprint"), radius, shard, sample), "links"))
    linked = durable(counted.join(label.withColumnRenamed("node", "fingerprint"), "fingerprint"), "linked")
    smallest = durable(linked.groupBy("component").agg(F.min("least").alias("smallest"), F.count(F.lit(1)).alias("prints")), "smallest")
    named = join_spread(linked, smallest.select("component", "smallest"), ["component"], "fingerprint", spread_keys(smallest, ["component"], "prints"))
    facts = counted.join(named.select("fingerprint", "smallest"), "fingerprint", "left").select("fingerprint", F.coalesce("smallest", "least").alias("component_id"))
    hot = spread_keys(counted, ["fingerprint"], "n")
    rows = join_spread(scanned, facts, ["fingerprint"], "doc_id", hot)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
