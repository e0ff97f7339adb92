"""Classifiers, line rules and token counts."""

import os
import random
import time
import re
from collections import Counter

import numpy as np
import pytest

from loomspark.llm import line_quality as lq
from loomspark.llm import quality_trees as qt
from loomspark.llm import textarrays as ta
from loomspark.llm import token_counts as tc
from loomspark.llm import toxicity as tx

EDGES = [(9001, None), (9002, ""), (9003, " \n "), (9004, "word"), (9005, "word"), (9006, "x " * 30_000)]


@pytest.fixture(scope="module")
def labelled(spark, make_docs, prose):
    r = random.Random(0)
    texts, labels = [], []
    for i in range(400):
        lines = [prose(1000 + 10 * i + j, r.randint(5, 20)).capitalize() + "." for j in range(r.randint(3, 8))]
        toxic, junk = int(i % 4 == 0), int(i % 5 == 0)
        if toxic:
            lines[r.randrange(len(lines))] = prose(i, 6) + f" {r.choice(['grobian', 'lummox'])} " + prose(i + 1, 4) + "."
        if junk:
            lines = [re.sub(r"(\S+)", r"\1$$$", x) for x in lines]
        texts.append((i, "\n".join(lines)))
        labels.append((i, 1 - junk, toxic))
    return make_docs(texts + EDGES), spark.createDataFrame([*labels, (9001, 1, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def auc(rows, truth):
    score = np.array([r.score for r in rows])
    y = np.array([truth[r.doc_id] for r in rows])
    order = score.argsort().argsort() + 1
    p = y.sum()
    return (order[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


def test_toxicity_on_held_out_rows(labelled):
    docs, labels = labelled
    rows = tx.toxicity(docs, labels).collect()
    truth = {i: int(i % 4 == 0) for i in range(400)}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 40 and auc(held, truth) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert {r.doc_id for r in rows} >= {i for i, _ in EDGES}
    assert [r.score for r in rows if r.doc_id in (9001, 9002, 9003)] == [0, 0, 0]
    found = [r for r in rows if r.doc_id in truth and truth[r.doc_id] and r.predicted]
    assert np.mean([len(r.offending) == 1 for r in found]) > 0.8  # one sentence was made to offend


def test_toxicity_without_examples(spark, make_docs):
    docs = make_docs([(1, "a b c"), (1, "a b c")])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in tx.toxicity(docs, none).collect()] == pytest.approx([0, 0], abs=1e-6)
    assert tx.toxicity(make_docs([]), none).count() == 0


def test_noisy_or_matches_products():
    p = np.array([0.1, 0.5, 0.2])
    assert tx.noisy_or(p, np.array([0, 2, 2, 3])) == pytest.approx([1 - 0.9 * 0.5, 0, 0.2])


def test_quality_on_held_out_rows(labelled, spark, make_docs):
    docs, labels = labelled
    rows = qt.quality(docs, labels).collect()
    truth = {i: int(i % 5 != 0) for i in range(400)}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 80 and auc(held, truth) > 0.95
    assert len(rows) == 400 + len(EDGES) and all(0 <= r.score <= 1 for r in rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in qt.quality(make_docs([(1, "a")]), none).collect()] == [0.5]


def test_flat_trees_follow_the_rows():
    r = np.random.default_rng(0)
    x = r.normal(size=(500, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = qt.fit(x, y, trees=40)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.97

    def walk(row):
        total = model.base
        for f, c, leaf in zip(model.feature, model.cut, model.leaf, strict=True):
            node = 0
            for _ in range(qt.DEPTH):
                node = 2 * node + (2 if row[f[node]] > c[node] else 1)
            total += leaf[node - (2**qt.DEPTH - 1)]
        return total

    assert model.margin(x[:50]) == pytest.approx([walk(row) for row in x[:50]])


def brute_lines(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(runs)
    again = {j for i, x in enumerate(runs) if n[x] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again)


def test_line_counts_and_verdicts(labelled, make_docs):
    docs, labels = labelled
    field = lq.fit_lines(docs, labels)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    rows = lq.line_quality(docs, field).collect()
    for r in rows:
        want = brute_lines(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)
    good = [r for r in rows if r.doc_id < 400 and not r.base_failed]
    assert np.mean([r.kept == (r.doc_id % 5 != 0) for r in good]) > 0.95
    assert lq.line_quality(make_docs([]), field).count() == 0


def test_mixed_texts_are_marked_line_by_line(spark, make_docs, prose):
    r = random.Random(4)
    clean = lambda i: prose(i, r.randint(6, 14)).capitalize() + "."
    junk = lambda i: re.sub(r"(\S+)", r"\1$$$", prose(i, r.randint(6, 14)))
    texts, labels, truth = [], [], {}
    for i in range(300):
        n = r.randint(3, 10)
        marks = [r.random() < (0.8 if i % 3 == 0 else 0.15) for _ in range(n)]
        lines = [(junk if m else clean)(5000 + 20 * i + j) for j, m in enumerate(marks)]
        in_junk = sum(len(x.split()) for x, m in zip(lines, marks, strict=True) if m) / sum(len(x.split()) for x in lines)
        texts.append((i, "\n".join(lines)))
        labels.append((i, int(in_junk < 0.5), 0))
        truth[i] = marks
    for i, marks in ((1000, [False, True] * 8), (1001, [True] * 3 + [False] * 12), (1002, [False] * 4 + [True] * 9)):
        texts.append((i, "\n".join((junk if m else clean)(9000 + 20 * i + j) for j, m in enumerate(marks))))
        truth[i] = marks
    field = lq.fit_lines(make_docs(texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))

    def marked(text):
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        offsets = np.array([0, len(data)])
        found = lq.lines_of(data, offsets, ta.split_words(data, offsets))
        return (lq.viterbi(found.measures @ field.weights, found.first, field.steps) == 1).tolist()

    got = {i: marked(t) for i, t in texts}
    assert all(got[i] == truth[i] for i in (1000, 1001, 1002))
    right = [a == b for i in truth for a, b in zip(got[i], truth[i], strict=True)]
    assert np.mean(right) > 0.97


def test_chain_marginals_are_sums_over_paths():
    r = np.random.default_rng(2)
    first = np.array([0, 4, 4, 5, 5 + lq.CHAIN])
    scores, steps = r.normal(size=first[-1]), r.normal(size=(2, 2))
    chance, pairs = lq.Chains(first).marginals(scores, steps)
    for a, b in ((0, 4), (4, 5)):
        paths = [[m >> i & 1 for i in range(b - a)] for m in range(2 ** (b - a))]
        weight = [np.exp(sum(scores[a + i] * x for i, x in enumerate(p)) + sum(steps[x, y] for x, y in zip(p, p[1:], strict=False))) for p in paths]
        assert chance[a:b] == pytest.approx([sum(w for w, p in zip(weight, paths, strict=True) if p[i]) / sum(weight) for i in range(b - a)])
    assert [len(p) for p in pairs] == [2, 2, 2] + [1] * (lq.CHAIN - 4) and all(p.sum() == pytest.approx(len(p)) for p in pairs)


def test_samples_stay_within_their_budgets(spark, make_docs, prose):
    from pyspark.sql import functions as F

    from loomspark.llm.sampling import within_budget

    rows = spark.createDataFrame([(i, 10 + i) for i in range(50)] + [(99, 10**9)], "doc_id long, n long")
    kept = within_budget(rows, F.col("n"), 300).collect()
    assert 200 < sum(r.n for r in kept) <= 300 and 99 not in {r.doc_id for r in kept}


def test_rows_without_an_id_are_scored(spark, make_docs, labelled):
    _, labels = labelled
    odd = make_docs([(None, "a b c."), (None, None), (1, "a b."), (1, "a b.")])
    assert tx.toxicity(odd, labels).count() == qt.quality(odd, labels).count() == 4
    assert lq.line_quality(odd, lq.fit_lines(odd, labels)).count() == tc.token_counts(odd, tc.build([b"a"])).count() == 4
    none = make_docs([])
    assert qt.quality(none, labels).count() == lq.line_quality(none, lq.fit_lines(none, labels)).count() == 0


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(1)
    first = np.array([0, 4, 4, 5, 11])
    scores, steps = r.normal(size=11), r.normal(size=(2, 2))
    got = lq.viterbi(scores, first, steps)
    for a, b in zip(first[:-1], first[1:], strict=True):
        n = b - a
        value = lambda m: sum(scores[a + i] for i in range(n) if m >> i & 1) + sum(steps[m >> i & 1, m >> (i + 1) & 1] for i in range(n - 1))  # noqa: B023, E731
        if n:
            assert value(sum(int(x) << i for i, x in enumerate(got[a:b]))) == pytest.approx(max(value(m) for m in range(2**n)))


def brute_pieces(word, vocabulary):
    rest, n = b" " + word, 0
    while rest:
        size = next((k for k in range(len(rest), 0, -1) if rest[:k] in vocabulary), 0)
        if not size:
            return 1
        rest, n = rest[size:], n + 1
    return n


def test_token_counts_equal_greedy_matching(spark, make_docs, prose, tmp_path):
    r = random.Random(3)
    words = [prose(i, 1).encode() for i in range(300)]
    pieces = {b" ", *(bytes([b]) for w in words[:200] for b in w)}
    pieces |= {(b" " if r.random() < 0.5 else b"") + w[: r.randint(1, 5)] for w in words} | {w[r.randint(0, 2) : r.randint(3, 6)] for w in words} - {b""}
    automaton = tc.build(sorted(pieces))
    data = b" ".join(words)
    w = ta.split_words(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)]))
    assert automaton.counts(w.data, w.starts, w.ends).tolist() == [brute_pieces(x, pieces) for x in words]
    texts = [(1, data.decode()), (1, data.decode()), (2, None), (3, ""), (4, "x" * 50_000), (5, prose(2, 20_000))]
    for row in tc.token_counts(make_docs(texts), automaton).collect():
        mine = (dict(texts)[row.doc_id] or "").encode().split()
        assert (row.n_words, row.n_tokens) == (len(mine), sum(brute_pieces(x, pieces) for x in mine))
    unknown = tc.token_counts(make_docs([(1, "a b")]), tc.build([]))
    assert [(r.n_words, r.n_tokens) for r in unknown.collect()] == [(2, 2)]
    assert tc.token_counts(make_docs([]), automaton).count() == 0


@pytest.mark.skipif(not os.path.exists(tc.DEFAULT_VOCABULARY), reason="no vocabulary files")
def test_a_real_vocabulary(make_docs, prose):
    pieces = tc.read_vocabulary(tc.DEFAULT_VOCABULARY)
    known, automaton = set(pieces), tc.build(pieces)
    assert len(known) > 40_000
    text = "The quick brown fox's 1,234 jumps—naïve, überraschend! " + prose(5, 400) + " antidisestablishmentarianism " + "z" * 300
    row = tc.token_counts(make_docs([(1, text)]), automaton).first()
    assert row.n_tokens == sum(brute_pieces(w, known) for w in text.encode().split())


def test_a_word_of_a_megabyte_is_counted_in_seconds():
    """Long words are walked alone; the pieces are the same as in step with others, lost words included."""
    r = random.Random(4)
    pieces = {b" ", b" a", *(bytes([b]) for b in b"abcd"), *(bytes(r.choices(b"abcd", k=r.randint(2, 6))) for _ in range(400))}
    automaton = tc.build(sorted(pieces))
    words = [bytes(r.choices(b"abcd", k=n)) for n in (1_000_000, 900, 7)] + [b"abcx" + b"a" * 500, b"abc" * 100 + b"x"]
    data = b" ".join(words)
    w = ta.split_words(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)]))
    started = time.monotonic()
    got = automaton.counts(w.data, w.starts, w.ends)
    assert time.monotonic() - started < 5
    assert got[1:].tolist() == [brute_pieces(x, pieces) for x in words[1:]]
    short = words[0][:800]
    crowd = ta.split_words(np.frombuffer(b" ".join([short] * (tc.FEW + 1)), dtype=np.uint8), np.array([0, (len(short) + 1) * (tc.FEW + 1) - 1]))
    assert set(automaton.counts(crowd.data, crowd.starts, crowd.ends).tolist()) == {brute_pieces(short, pieces)}
