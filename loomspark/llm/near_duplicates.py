"""Near-duplicate documents by circulant MinHash.

A document is the set of its distinct runs of ``k`` words. Two permutations of the integers modulo 2**32
give the whole signature: the first scatters the shingles, the second ranks them, and coordinate ``i``
ranks them after the scattered values were shifted ``i`` places round the circle. Bands of coordinates
propose candidates, and a link counts only after both full sets were compared.

How it holds up with large groups: documents with equal sets become one class before anything else. All
members of a band's bucket go to the bucket's least document, its hub, and documents that share several
buckets mostly share the hub, so each is sent a few times, not once a band. A hub's members are compared
on full sets inside tasks, in blocks of a fixed size that all hold the hub, and only the links that join two
components leave the task: at most one a member. Members that no block joined with the hub are then compared
with all other blocks, so no pair that shares a bucket and could still join two components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm import textarrays as ta
from loomspark.llm.graph import components
from loomspark.llm.scratch import durable
from loomspark.llm.skew import join_hot
from loomspark.llm.tables import id_and_text

#: Coordinates a band and bands. At a similarity of 0.8 a pair shares no band with probability (1 - 0.8**4)**28 < 4e-7.
ROWS, BANDS = 4, 28
#: Shingles (8 bytes each) and members that a task holds at a time while it compares a hub's members.
BLOCK_SHINGLES, BLOCK_MEMBERS = 2_000_000, 256
#: Ids of documents to be compared again up to so many are broadcast to pick their texts before these are dealt.
BROADCAST_IDS = 500_000


def _shift_mix(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the integers modulo 2**32: every step can be undone."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(a)
    x = x ^ (x >> np.uint32(15))
    x = x * np.uint32(b)
    return x ^ (x >> np.uint32(16))


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash of a non-empty set of 64-bit shingles."""
    placed = _shift_mix((shingles ^ (shingles >> np.uint64(32))).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    out = np.full(coordinates, 0xFFFFFFFF, dtype=np.uint32)
    shifts = np.arange(coordinates, dtype=np.uint32)[:, None]
    for at in range(0, len(placed), 4096):
        block = _shift_mix(placed[None, at : at + 4096] + shifts, 0x2C1B3C6D, 0x297A2D39)
        np.minimum(out, block.min(axis=1), out=out)
    return out


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text in turn, its sorted distinct shingles: runs of k words, or all words where there are fewer."""
    for _, _, data, offsets in ta.text_chunks(column):
        words = ta.split_words(data, offsets)
        hashes = words.hashes(ta.lower_ascii(data))
        at, runs = ta.windows(hashes, words, k)
        first = np.searchsorted(at, words.first)
        for i, n in enumerate(words.counts):
            if n >= k:
                yield np.unique(runs[first[i] : first[i + 1]])
            elif n:
                own = hashes[words.first[i] : words.first[i + 1]]
                place = np.arange(1, n + 1, dtype=np.uint64) * ta.ODD
                yield ta.mix64(ta.mix64(own ^ place).sum(keepdims=True) + np.uint64(n))
            else:
                yield np.zeros(0, dtype=np.uint64)


def _fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the whole set."""
    return int(shingles.sum(dtype=np.uint64)), int(ta.mix64(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))


def signatures(docs: DataFrame, k: int, rows: int, bands: int) -> DataFrame:
    """``(doc_id, n_shingles, set_a, set_b, band_keys)``; no keys for a document without words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            sizes, one, two, keys = [], [], [], []
            for s in shingle_sets(batch.column(1), k):
                a, b = _fingerprint(s)
                sizes.append(len(s))
                one.append(a)
                two.append(b)
                if len(s):
                    coordinates = signature(s, rows * bands).reshape(bands, rows).astype(np.uint64)
                    key = number.copy()
                    for column in coordinates.T:
                        key = ta.mix64(key ^ column)
                    keys.append(ta.as_signed(key))
                else:
                    keys.append(np.zeros(0, dtype=np.int64))
            lengths = np.array([len(x) for x in keys], dtype=np.int64)
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(ta.as_signed(np.array(one, dtype=np.uint64))), pa.array(ta.as_signed(np.array(two, dtype=np.uint64))), lists],
                ["doc_id", "n_shingles", "set_a", "set_b", "band_keys"],
            )

    return id_and_text(docs).mapInArrow(scan, "doc_id long, n_shingles long, set_a long, set_b long, band_keys array<long>")


def joining_links(sets: list[np.ndarray], percent: int, component: np.ndarray | None = None, asked: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between the given sets that join all their components, found by exact comparison.

    ``component`` names what is joined already, and only the sets marked in ``asked`` are compared with all
    others (None: every one). A set that was compared is done; the search ends when no asked set is left
    that could still join two components.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    component = np.arange(len(sets)) if component is None else np.unique(component, return_inverse=True)[1]
    todo, links = np.ones(len(sets), dtype=bool) if asked is None else asked.copy(), []
    own = np.zeros(len(values), dtype=bool)
    while todo.any() and len(np.unique(component)) > 1:
        groups, counts = np.unique(component[todo], return_counts=True)
        if asked is None and len(groups) < 2:
            break  # what is done was compared with everything
        outside = np.flatnonzero(todo & (component != groups[counts.argmax()])) if len(groups) > 1 else np.flatnonzero(todo)
        x = int(outside[0])
        todo[x] = False
        mine = place[first[x] : first[x] + sizes[x]]
        own[mine] = True
        both = np.add.reduceat(own[place].astype(np.int64), first)
        own[mine] = False
        for y in np.flatnonzero((component != component[x]) & (100 * both >= percent * (sizes + sizes[x] - both))):
            if component[y] != component[x]:
                links.append((x, int(y)))
                component[component == component[y]] = component[x]
    return links


def _compare(dealt: DataFrame, docs: DataFrame, key: list[str], k: int, percent: int, ids: DataFrame | None = None) -> DataFrame:
    """``(a, b)`` links among the documents ``a`` that ``dealt`` sends to each ``key``, with ``component`` and ``asked``.

    The candidates grow with the corpus, so they and the texts are dealt by id at any size and never broadcast;
    only a counted list of ``ids`` is, where the caller has one, so that other texts stay where they are.
    """
    text = id_and_text(docs).where("doc_id is not null").withColumnRenamed("doc_id", "a")
    if ids is not None:
        text = text.join(F.broadcast(ids), "a", "left_semi")

    def compare(group: pa.Table) -> pa.Table:
        ids, component = group.column("a").to_numpy(), group.column("component").to_numpy()
        asked = group.column("asked").to_numpy(zero_copy_only=False).astype(bool)
        sets = [s for chunk in group.column("text").chunks for s in shingle_sets(chunk, k)]
        some = np.array([i for i, s in enumerate(sets) if len(s)], dtype=np.int64)
        found = joining_links([sets[i] for i in some], percent, component[some], None if asked.all() else asked[some]) if len(some) > 1 else []
        return pa.table({"a": pa.array([ids[some[x]] for x, _ in found], pa.int64()), "b": pa.array([ids[some[y]] for _, y in found], pa.int64())})

    return dealt.join(text.hint("merge"), "a").groupBy(*key).applyInArrow(compare, "a long, b long")


def _links(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``(a, b)`` links that join the members ``a`` of each hub ``b``; pairs has ``(a, b, n_shingles)``, b among its own.

    A group of one block is compared as a whole. A large group is dealt over blocks, each with its hub, and
    compared within them: one copy of each text. Members that are not joined with the hub then, by way of any
    group, are the rest; only they are compared with the other blocks.
    """
    need = lambda words, n: F.ceil(F.greatest(words / BLOCK_SHINGLES, n / BLOCK_MEMBERS)).cast("int")
    total, n = F.sum("n_shingles"), F.count(F.lit(1))
    large = durable(pairs.groupBy("b").agg(need(total, n).alias("blocks")).where("blocks > 1"), "large")
    own = F.pmod(F.hash("a", "b"), F.coalesce("blocks", F.lit(1)))
    placed = durable(join_hot(pairs, large, "b", "a").withColumn("own", own), "placed")
    hubs = large.select(F.col("b").alias("a"), "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"))
    members = placed.where("blocks is null or a != b").select("a", "b", "own").union(hubs)
    alone = members.select("a", "b", "own", F.col("a").alias("component"), F.lit(True).alias("asked"))
    within = durable(_compare(alone, docs, ["b", "own"], k, percent), "links")
    if not large.limit(1).count():
        return within

    label = components(within).withColumnRenamed("node", "a")
    named = placed.where("blocks is not null").join(label, "a", "left").select("a", "b", "n_shingles", "own", "blocks", F.coalesce("component", "a").alias("component"))
    main = named.where("a = b").select("b", F.col("component").alias("main"))
    known = durable(join_hot(named, main, "b", "a"), "named")
    rest = known.where("component != main")
    apart = durable(rest.groupBy("b").agg(need(total, n).alias("rest_blocks")), "rest")
    share = lambda c: F.pmod(F.xxhash64("a", "b"), F.col(c)).cast("int")
    numbers = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    cut = join_hot(known, apart, "b", "a").where("rest_blocks is not null")
    asked = cut.where("component != main").withColumn("rest", share("rest_blocks")).select("a", "b", "rest", numbers("blocks").alias("own"), "component", F.lit(True).alias("asked"))
    others = cut.select("a", "b", numbers("rest_blocks").alias("rest"), "own", "component", F.lit(False).alias("asked"))
    across = asked.union(others).groupBy("a", "b", "rest", "own").agg(F.first("component").alias("component"), F.max("asked").alias("asked"))
    again = durable(cut.select("a").distinct(), "again")
    ids = again if again.count() <= BROADCAST_IDS else None
    return within.union(durable(_compare(across, docs, ["b", "rest", "own"], k, percent, ids), "links"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """One row a document: ``(doc_id, n_shingles, component_id, kept)``.

    ``docs`` has ``doc_id`` and ``text``; other columns are left alone. Documents are linked where
    ``100 * |A and B| >= percent * |A or B|``; ``component_id`` is the smallest doc_id that links reach
    and ``kept`` marks that document.

    Null, empty and blank texts have an empty set and are linked with nothing. A text of fewer than k words
    is one shingle, its whole sequence. Repeated rows give repeated rows of the same result. Rows whose doc_id
    is null are reported with a null component and are not kept. An empty table gives an empty result.
    """
    scanned = durable(signatures(docs, k, rows, bands), "signatures")
    classes = durable(scanned.where("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("a")), "classes")
    firsts = classes.select(F.col("a").alias("doc_id"), "set_a", "set_b", "n_shingles")
    banded = scanned.join(firsts, ["doc_id", "set_a", "set_b", "n_shingles"], "left_semi").select("doc_id", "n_shingles", F.explode("band_keys").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("last")).where("b < last").select("band", "b")
    pairs = durable(banded.join(hubs, "band").groupBy(F.col("doc_id").alias("a"), "b").agg(F.first("n_shingles").alias("n_shingles")), "pairs")
    labels = components(durable(_links(pairs, docs, k, percent), "links"))

    result = scanned.join(classes, ["set_a", "set_b", "n_shingles"], "left").join(labels.withColumnRenamed("node", "a"), "a", "left")
    component = F.coalesce("component", "a", "doc_id")
    return result.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
