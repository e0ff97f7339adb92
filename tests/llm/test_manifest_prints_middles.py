"""Merkle manifest, SimHash groups and fill-in-the-middle cuts against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomspark.llm import boundaries as bd
from loomspark.llm import fill_in_middle as fm
from loomspark.llm import merkle, simhash


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(digests, arity):
    found = [digests]
    while len(found[-1]) > 1:
        found.append([sha("".join(found[-1][i : i + arity])) for i in range(0, len(found[-1]), arity)])
    return found


def siblings(levels, i, arity):
    found = []
    for level in levels[:-1]:
        first = i // arity * arity
        found.append(("".join(level[first:i]), "".join(level[i + 1 : first + arity])))
        i //= arity
    return found


def brute_manifest(rows, arity=3):
    """Rows are (doc_id, source, lang, n_chars, text); the result holds a sorted list of all output rows."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha("".join(field(v) for v in (*r[:4], text)))
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    ranked = {s: sorted(g, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4]))) for s, g in groups.items()}
    trees = {s: levels_of([leaf(r, r[4]) for r in g], arity) for s, g in ranked.items()}
    top = levels_of([trees[s][-1][0] for s in order], arity)
    root = top[-1][0]
    found = []
    for s in order:
        for i, r in enumerate(ranked[s]):
            path = siblings(trees[s], i, arity) + siblings(top, order.index(s), arity)
            hit = r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            folded = leaf(r, r[4].replace("\n", "") if hit else r[4])
            for left, right in path:
                folded = sha(left + folded + right)
            found.append((r[0], leaf(r, r[4]), trees[s][-1][0], root, sha("".join(a + b for a, b in path)), folded, folded == root))
    return sorted(found, key=repr)


DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree string, lo long, digest string, path string"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, "d", "p") for r in rows], DOCS).repartition(3)


def some_documents(n):
    r = random.Random(n)
    rows = [(i, r.choice(["a", "a", "a", "bé", None, "", "ab"]), r.choice(["en", None]), r.choice([None, i]), r.choice([None, "", "x\ny", "é\n\n", "word " * r.randint(1, 9)])) for i in range(n)]
    rows += [(3, "a", "en", 1, "again\n"), (3, "a", "en", 1, "again\n"), (3, "a", "en", 1, "other"), (None, "a", "en", 1, "no\nid"), (None, None, None, None, None), (n, "lone", "en", 7, "one\nleaf"), (n + 1, "long", "en", 7, "long \n" * 200_000)]
    return rows


@pytest.mark.parametrize("n", [0, 1, 30, 400])
def test_manifest_equals_brute_force(spark, n):
    rows = some_documents(n)
    assert sorted((tuple(r) for r in merkle.verified_documents(documents(spark, rows)).collect()), key=repr) == brute_manifest(rows)


def test_manifest_of_nothing_and_of_one_leaf(spark):
    assert merkle.verified_documents(documents(spark, [])).count() == 0
    only = [(4, "a", "en", 3, "a\nb")]
    (row,) = merkle.verified_documents(documents(spark, only)).collect()
    assert tuple(row) == brute_manifest(only)[0] and row.root == row.leaf == row.subroot and row.proof_sha256 == sha("")


@pytest.mark.parametrize("arity,levels", [(2, 1), (2, 4), (5, 2)])
def test_nodes_carry_the_intervals_that_they_cover(spark, arity, levels):
    rows = some_documents(90)
    built = merkle.manifest(documents(spark, rows), "source", ["doc_id"], merkle.COLUMNS, arity=arity, levels=levels)
    nodes = built.groups.nodes().collect()
    sizes = {r.tree: r.n for r in built.groups.leaves.select("tree", "n").distinct().collect()}
    by_level = defaultdict(dict)
    for r in nodes:
        assert r.lo not in by_level[r.tree, r.level]
        by_level[r.tree, r.level][r.lo] = r
    for tree, n in sizes.items():
        leaves = [by_level[tree, 0][i].digest for i in range(n)]
        for level, want in enumerate(levels_of(leaves, arity)):
            got = by_level[tree, level]
            assert [got[lo].digest for lo in sorted(got)] == want
            assert [(r.lo, r.hi) for r in (got[lo] for lo in sorted(got))] == [(i * arity**level, min(n, (i + 1) * arity**level)) for i in range(len(want))]
        assert (tree, len(levels_of(leaves, arity))) not in by_level
    proofs = built.proofs().select("root", merkle.fold(F.col("path"), F.col("digest")).alias("folded")).collect()
    assert len(proofs) == len(rows) and all(r.root == r.folded for r in proofs)


def brute_print(text, k):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(run, 42) for run in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    """For each place its component's first place, all pairs compared."""
    group = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    return group


def test_simhash_groups_equal_brute_force(make_docs, prose, monkeypatch):
    monkeypatch.setattr(simhash, "PIECE_BYTES", 50)
    base = prose(1, 600)
    texts = [(10 + i, base + " " + prose(70 + i, 1 + i)) for i in range(12)] + [(100 + i, prose(i, 40)) for i in range(40)]
    texts += [(3, None), (2, ""), (4, " \n\t"), (5, "One"), (6, "one"), (7, "one two"), (8, "ONE\x0btwo three"), (9, "one  two\nthree"), (900, prose(9, 30_000)), (901, base.upper()), (902, base)]
    got = {r.doc_id: (r.fingerprint, r.component_id, r.kept) for r in simhash.simhash_duplicates(make_docs(texts)).collect()}
    ids = [i for i, _ in texts]
    prints = [brute_print(t, 3) for _, t in texts]
    group = brute_components(prints, 2)
    least = {g: min(i for i, h in zip(ids, group, strict=True) if h == g) for g in group}
    assert got == {i: (f"{p:016x}", least[g], least[g] == i) for i, p, g in zip(ids, prints, group, strict=True)}


def test_simhash_with_repeated_rows_null_ids_and_empty_table(make_docs, prose):
    one, two = prose(1, 200), prose(2, 200)
    rows = simhash.simhash_duplicates(make_docs([(1, one), (1, one), (None, one), (7, two), (7, one), (None, "alone")])).collect()
    other, lone = (f"{brute_print(t, 3):016x}" for t in (two, "alone"))
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in rows) == [(0, 0, False), (0, 1, False), (1, 1, True), (1, 1, True), (7, 1, False), (7, 7, True)]
    assert {r.component_id for r in rows if r.fingerprint == other} == {7} and {r.component_id for r in rows if r.fingerprint == lone} == {None}
    assert simhash.simhash_duplicates(make_docs([])).count() == 0


def points_with_clusters(seed, n):
    rng = np.random.default_rng(seed)
    far = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
    near = far[: n // 4] ^ (np.uint64(1) << rng.integers(0, 64, n // 4).astype(np.uint64))
    dense = far[0] ^ np.array([sum(1 << int(b) for b in set(bits)) for bits in rng.integers(0, 64, (n // 2, 3))], dtype=np.uint64)
    return np.unique(np.concatenate((far, near, dense, [np.uint64(0)])))


def merged(n, pairs):
    group = np.arange(n)
    for a, b in pairs:
        low, high = sorted((group[a], group[b]))
        group[group == high] = low
    return group


@pytest.mark.parametrize("radius", [0, 2, 5])
def test_trees_lose_no_link(radius, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 16)
    points = points_with_clusters(radius, 800)
    pairs = [(i, int(j) + i + 1) for i in range(len(points)) for j in np.flatnonzero(np.bitwise_count(points[i + 1 :] ^ points[i]) <= radius)]
    want = merged(len(points), pairs)
    a, b = simhash.close_links(points, radius)
    assert len(a) < len(points) and (np.bitwise_count(points[a] ^ points[b]) <= radius).all()
    assert (merged(len(points), zip(a, b, strict=True)) == want).all()
    tree = simhash.grow(points[::3], radius, 40)
    at, shard = tree.places(points, radius)
    assert tree.shards > 4 and set(at) == set(range(len(points)))
    inside = defaultdict(set)
    for place, name in zip(at, shard, strict=True):
        inside[place].add(name)
    assert all(inside[i] & inside[j] for i, j in pairs)


def test_close_pairs_over_several_shards(spark):
    points = points_with_clusters(7, 600)
    rows = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fingerprint long")
    places = {int(p): i for i, p in enumerate(points.view(np.int64))}
    found = simhash.close_pairs(rows, 2, shard=50, sample=400).collect()
    pairs = [(i, int(j) + i + 1) for i in range(len(points)) for j in np.flatnonzero(np.bitwise_count(points[i + 1 :] ^ points[i]) <= 2)]
    assert (merged(len(points), [(places[r.a], places[r.b]) for r in found]) == merged(len(points), pairs)).all()


@pytest.mark.parametrize("density", [0.0001, 0.02, 0.4, 0.999, 1.0])
def test_boundary_sets_select_and_rank(density):
    member = np.random.default_rng(1).random(200_000) < density
    member[70_000:140_000] &= density < 0.9  # an empty container, and a part of one
    positions, chosen = np.flatnonzero(member), bd.BoundarySet(member)
    assert len(chosen) == len(positions)
    for k in range(0, len(positions), max(1, len(positions) // 500)):
        assert chosen.select(k) == positions[k]
    for p in range(0, len(member) + 1, 997):
        assert chosen.rank(p) == np.searchsorted(positions, p)
    for k in (-1, len(positions)):
        with pytest.raises(IndexError):
            chosen.select(k)


def test_each_form_of_container_is_taken():
    ascii_text = np.frombuffer(("a" * 70_000).encode(), dtype=np.uint8)
    sparse, mixed = np.zeros(66_000, dtype=bool), np.frombuffer(("aß€" * 12_000).encode(), dtype=np.uint8)
    sparse[::9] = True
    kinds = [type(c).__name__ for chosen in (bd.code_points(ascii_text), bd.BoundarySet(sparse), bd.code_points(mixed), bd.BoundarySet(sparse & (np.arange(66_000) < 900))) for c in chosen.containers]
    assert set(kinds) == {"_Runs", "_Bitmap", "_Array"}
    assert bd.code_points(ascii_text).nbytes < 100


def brute_cut(doc_id, text):
    draws = [int(sha(f"1:{'' if doc_id is None else doc_id}")[i : i + 8], 16) for i in (0, 8, 16, 24)]
    text = text or ""
    a, b = sorted(d % (len(text) + 1) for d in draws[:2])
    if not text or any(m in text for m in fm.MARKS) or draws[2] % 100 >= 90:
        return len(text), "plain", None, None, text
    if draws[3] % 100 < 20:
        return len(text), "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return len(text), "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_fill_in_middle_equals_brute_force(make_docs, prose):
    r = random.Random(3)
    texts = [(i, "".join(r.choice("ab<>PSM é€😀\ń") for _ in range(r.randint(0, 40)))) for i in range(300)]
    texts += [(-5, prose(1, 50)), (None, "no id"), (None, "no id"), (1000, None), (1001, ""), (1002, "a <S> b"), (1003, "é" * 200_000), (1004, prose(2, 60_000)), (1005, "x")]
    found = fm.fill_in_middle(make_docs(texts))
    rows = found.withColumn("back", fm.restored(F.col("output"), F.col("form"))).collect()
    got = sorted((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in rows if r.doc_id is not None)
    assert got == sorted((i, *brute_cut(i, t), t or "") for i, t in texts if i is not None)
    assert [(r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in rows if r.doc_id is None] == [brute_cut(None, "no id")] * 2
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    whole = dict(texts)
    assert all(len(whole[r.doc_id].encode()[: r.first_cut].decode()) == r.prefix_chars for r in rows if r.doc_id is not None and r.form != "plain")
    assert fm.fill_in_middle(make_docs([])).count() == 0
    with pytest.raises(ValueError):
        fm.fill_in_middle(make_docs([]), marks=("<P>", "<S>", "<P>x"))


def test_fill_in_middle_with_other_marks(make_docs):
    texts = [(i, f"text {i} with <P> inside") for i in range(60)]
    marks = ("<|pre.|>", "<|suf*|>", "<|mid|>")
    rows = fm.fill_in_middle(make_docs(texts), seed=9, rate=100, suffix_first=50, marks=marks)
    back = rows.select("doc_id", "form", fm.restored(F.col("output"), F.col("form"), marks).alias("back")).collect()
    assert {r.doc_id: r.back for r in back} == dict(texts) and {r.form for r in back} == {"psm", "spm"}
