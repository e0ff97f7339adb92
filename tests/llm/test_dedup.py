"""Near-duplicate groups and removed passages against brute force."""

import hashlib
import random

from loomspark.llm import graph
from loomspark.llm import near_duplicates as nd
from loomspark.llm import repeated_passages as rp
from loomspark.llm import skew


def sets_of(text, k):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute_groups(texts, k, percent=80):
    sets = {i: sets_of(t, k) for i, t in texts}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def edited(text, every, mark):
    w = text.split()
    return " ".join(f"{mark}{i}" if i % every == every - 1 else x for i, x in enumerate(w))


def near_texts(prose):
    base = prose(1, 300)
    chain = [base]
    for step in range(6):  # neighbours in the chain are similar, its ends are not
        w = chain[-1].split()
        w[step * 12 : step * 12 + 12] = [f"step{step}x{i}" for i in range(12)]
        chain.append(" ".join(w))
    texts = [(10 + i, t) for i, t in enumerate(chain)]
    texts += [(100 + i, edited(base, 20 + 7 * i, "v")) for i in range(25)]
    texts += [(200 + i, prose(50 + i, 80)) for i in range(10)]
    texts += [(300, base), (5, base.upper()), (301, None), (302, ""), (303, " \n\t "), (304, "one"), (305, "ONE"), (306, "one two"), (307, "one two three"), (400, prose(9, 20_000))]
    return texts


def test_groups_equal_brute_force(make_docs, prose):
    texts = near_texts(prose)
    for k in (2, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(make_docs(texts), k=k).collect()}
        assert got == brute_groups(texts, k)


def test_blocks_of_a_hub_lose_no_link(make_docs, prose, monkeypatch):
    texts = near_texts(prose)[:40]
    for shingles, members in ((700, 512), (2_000_000, 3)):
        monkeypatch.setattr(nd, "BLOCK_SHINGLES", shingles)
        monkeypatch.setattr(nd, "BLOCK_MEMBERS", members)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(make_docs(texts), k=2).collect()}
        assert got == brute_groups(texts, 2)


def test_components_of_a_hot_node(spark, monkeypatch):
    monkeypatch.setattr(graph, "HOT", 5)
    links = [(1, i) for i in range(10, 40)] + [(39, 50), (50, 51), (51, 52), (60, 61), (62, 61), (7, 7), (None, 3), (4, None)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in [1, *range(10, 40), 50, 51, 52]}, 60: 60, 61: 60, 62: 60, 7: 7}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_join_each_link_once(spark, monkeypatch):
    """The links of a star are joined once for each end, not in every round, and long paths are halved."""
    rng = random.Random(3)
    links = [(0, i) for i in range(1, 400)] + [(i, i + 1) for i in range(1000, 1100)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(260)]
    group = {n: n for link in links for n in link}
    for _ in range(101):
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    seen = []
    spread = graph.join_spread

    def counting(rows, facts, key, by, hot):
        out = spread(rows, facts, key, by, hot)
        if key in (["x"], ["y"]):
            seen.append(out.count())
        return out

    monkeypatch.setattr(graph, "join_spread", counting)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == group and sum(seen) <= 3 * len(links)


def test_repeated_rows_null_ids_and_empty_table(spark, make_docs, prose):
    texts = [(1, prose(1, 40)), (1, prose(1, 40)), (2, prose(1, 40)), (None, prose(1, 40))]
    rows = nd.near_duplicates(make_docs(texts)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in rows if r.doc_id) == [(1, 1, True), (1, 1, True), (2, 1, False)]
    assert [r.kept for r in rows if r.doc_id is None] == [False]
    assert nd.near_duplicates(make_docs([])).count() == 0


def brute_removed(texts, length):
    first = {}
    for i, t in sorted((i, t or "") for i, t in texts):
        w = t.encode().split()
        for p in range(len(w) - length + 1):
            first.setdefault(tuple(w[p : p + length]), i)
    out = {}
    for i, t in texts:
        w = (t or "").encode().split()
        gone = set()
        for p in range(len(w) - length + 1):
            if first[tuple(w[p : p + length])] < i:
                gone |= set(range(p, p + length))
        kept = [x for p, x in enumerate(w) if p not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def passage_texts(prose):
    long, short = prose(3, 130), prose(4, 50)
    texts = [(i, f"{prose(100 + i, 30)} {long}\n{prose(200 + i, 30)}") for i in range(8)]
    texts += [(20 + i, f"{prose(300 + i, 11)}\t{short} {prose(400 + i, 12)}") for i in range(8)]
    texts += [(40, "same " * 200), (41, "same " * 120 + "end"), (42, long), (43, long[: len(long) // 2]), (44, None), (45, ""), (46, " ".join(short.split()[:49])), (47, short), (50, prose(5, 20_000)), (51, prose(5, 20_000) + " tail")]
    return texts


def test_removal_equals_brute_force(make_docs, prose, monkeypatch):
    texts = passage_texts(prose)
    want = brute_removed(texts, 50)
    for longest, hot in ((2_000, 1_000), (1, 1)):  # by trees, and with every prefix made as long as the window and spread
        monkeypatch.setattr(rp, "PREFIX_CONTEXTS", longest)
        monkeypatch.setattr(skew, "HOT", hot)
        rows = rp.remove_repeated_passages(make_docs(texts)).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == want
    for r in rows:
        assert sum(c.n_words for c in r.cuts) == r.n_removed
        assert hashlib.sha256(b" ".join((r.kept_text or "").encode().split())).hexdigest() == r.kept_sha256
        if not r.n_removed:
            assert r.kept_text == dict(texts)[r.doc_id]


def test_removal_with_repeated_rows_null_ids_and_empty_table(make_docs, prose):
    t = prose(6, 60)
    rows = rp.remove_repeated_passages(make_docs([(1, t), (1, t), (2, t), (2, t), (None, t)])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in rows) == [(0, 0), (1, 0), (1, 0), (2, 60), (2, 60)]
    assert rp.remove_repeated_passages(make_docs([])).count() == 0
