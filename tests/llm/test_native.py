"""Operators made of SQL functions: mixing, licenses, decontamination, URL rules."""

import random
import re
from collections import Counter, defaultdict

import pytest

from loomspark.llm import decontamination as dc
from loomspark.llm import licenses as li
from loomspark.llm import mixing as mx
from loomspark.llm import url_filter as uf


def has_python(df):
    return re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def mixed_docs(make_docs, prose):
    texts = [(i, prose(i, 20 + 37 * i % 700)) for i in range(60)] + [(60, None), (61, ""), (62, prose(7, 20_000))]
    source = {i: ["b", "a", "ü", None][i % 4] for i in range(63)}
    return texts, source, make_docs(texts, source)


def test_mixture_meets_targets(make_docs, prose):
    texts, source, docs = mixed_docs(make_docs, prose)
    rows = mx.mixture_by_document(docs).collect()
    assert sorted(r.doc_id for r in rows) == list(range(63))
    sizes = {i: len((t or "").split()) for i, t in texts}
    total = Counter()
    for i, n in sizes.items():
        total[source[i]] += n
    weights = {"a": 3, "b": 1, "ü": 2, None: 3}
    goal, open_ = {}, set(total)
    left = 1.5 * sum(total.values())
    while True:
        rate = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if weights[s] * rate > 2 * total[s]}
        if not over:
            break
        goal |= {s: 2.0 * total[s] for s in over}
        left -= sum(goal[s] for s in over)
        open_ -= over
    goal |= {s: weights[s] * rate for s in open_}
    taken = Counter()
    for r in rows:
        assert (r.size, r.source_size) == (sizes[r.doc_id], total[source[r.doc_id]])
        assert r.target == pytest.approx(goal[source[r.doc_id]])
        assert 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 1 for s in goal)
    again = {r.doc_id: r.taken for r in mx.mixture_by_document(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_shards_are_disjoint_and_even(make_docs, prose, monkeypatch):
    _, _, docs = mixed_docs(make_docs, prose)
    taken = {}
    for shard_blocks, n_shards, broadcast in ((1 << 16, 16, 1000), (16, 128, 0)):
        monkeypatch.setattr(mx, "BROADCAST_STRETCHES", broadcast)
        dealt, _ = mx.mix(docs, shard_blocks=shard_blocks, block_words=32)
        rows = dealt.collect()
        assert len({(r.doc_id, r.block, r.epoch) for r in rows}) == len(rows)
        n = Counter(r.shard for r in rows)
        assert set(n) == set(range(n_shards)) and max(n.values()) - min(n.values()) <= 1
        assert all(sorted(r.position for r in rows if r.shard == s) == list(range(n[s])) for s in n)
        assert not has_python(dealt)
        taken[n_shards] = {(r.doc_id, r.block, r.epoch, r.n_words) for r in rows}
    assert taken[16] == taken[128]


def test_the_tree_decides(make_docs, prose, monkeypatch):
    from pyspark.sql import functions as F

    _, _, docs = mixed_docs(make_docs, prose)
    mine = {tuple(r) for r in mx.mixture_by_document(docs).collect()}
    uneven = lambda quotas, levels, seed: quotas.select("source_no", F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("first"), F.col("quota").alias("past"))
    monkeypatch.setattr(mx, "split_quotas", uneven)
    assert mine != {tuple(r) for r in mx.mixture_by_document(docs).collect()}


def test_quotas_of_shards_are_hypergeometric(spark):
    from math import comb

    quotas = {1: 3000, 2: 4192, 3: 1000}
    rows = mx.split_quotas(spark.createDataFrame(list(quotas.items()), "source_no int, quota long"), 10, "test").collect()
    size = Counter()
    for source, quota in quotas.items():
        own = sorted((r.shard, r.first, r.past) for r in rows if r.source_no == source)
        assert [s for s, _, _ in own] == list(range(1024)) and own[0][1] == 0 and own[-1][2] == quota
        assert all(a[2] == b[1] for a, b in zip(own, own[1:], strict=False))
        size.update({s: past - first for s, first, past in own})
        seen = Counter(past - first for _, first, past in own)
        want = [1024 * comb(quota, x) * comb(8192 - quota, 8 - x) / comb(8192, 8) for x in range(9)]
        assert sum((seen[x] - w) ** 2 / w for x, w in enumerate(want) if w > 1) < 30
    assert set(size.values()) == {8}


def test_hypergeometric_draws(spark):
    from pyspark.sql import functions as F

    u = (F.col("id") + 0.5) / 4000.0
    rows = spark.range(4000).select(mx.hypergeometric(F.lit(30), F.lit(12), F.lit(10), u, u).alias("x")).groupBy("x").count().collect()
    from math import comb

    want = {x: comb(12, x) * comb(18, 10 - x) / comb(30, 10) for x in range(11)}
    for r in rows:
        assert r["count"] / 4000 == pytest.approx(want[r.x], abs=1e-3)


def test_wide_draws_are_exact(spark):
    from math import exp, lgamma

    from pyspark.sql import functions as F

    n, q, k = 8_000_000, 4_000_000, 4_000_000  # a spread of 707
    log_comb = lambda a, b: lgamma(a + 1) - lgamma(b + 1) - lgamma(a - b + 1)
    below, steps = {}, 0.0
    for x in range(q // 2 - 6000, q // 2 + 6001):
        below[x] = steps
        steps += exp(log_comb(q, x) + log_comb(n - q, k - x) - log_comb(n, k))
    us = [0.001, 0.1, 0.4, 0.5003, 0.77, 0.999]
    rows = spark.createDataFrame([(u,) for u in us], "u double").select("u", mx.hypergeometric(F.lit(n), F.lit(q), F.lit(k), F.col("u"), F.lit(0.5)).alias("x")).collect()
    for r in rows:
        assert below[r.x] / steps <= r.u + 1e-6 and below[r.x + 1] / steps >= r.u - 1e-6


def test_dealt_query_shows_shards(spark, make_docs, prose, tmp_path):
    from loomspark.llm.registry import QUERIES

    _, _, docs = mixed_docs(make_docs, prose)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op1_mixing_dealt"](spark, str(tmp_path)).collect()
    n = Counter(r.shard for r in rows)
    assert set(n) == set(range(16)) and max(n.values()) - min(n.values()) <= 4
    assert len({(r.shard, r.position) for r in rows}) == len(rows)


def test_mixing_nothing(make_docs):
    assert mx.mixture_by_document(make_docs([])).count() == 0
    assert [(r.size, r.taken) for r in mx.mixture_by_document(make_docs([(1, None)])).collect()] == [(0, 0)]


def test_repeated_rows_are_one_document(make_docs):
    rows = mx.mixture_by_document(make_docs([(1, "a b"), (1, "a b"), (2, "c"), (None, "d e f"), (None, "g")])).collect()
    assert sorted((r.doc_id or 0, r.size) for r in rows) == [(0, 4), (1, 4), (2, 1)]
    assert all(r.taken <= 2 * r.size for r in rows)


def brute_license(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in li.PHRASES.items():
        p = phrase.split()
        here = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += here
        labels |= {label} if here else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licenses(make_docs, prose):
    texts = [
        (1, "Released under the MIT License."), (2, "under-the mit\nLICENSE under the mit license cc by nc cc by nc"), (3, "Licensed under the Apache License, Version 2.0."), (4, None), (5, ""), (6, "?!"),
        (7, f"{prose(1, 500)} Licensed under CC BY-NC 4.0. {prose(2, 500)}"), (8, "cc by ncx under the mit licenses"), (9, "This program is free software: you can redistribute it and/or modify it under the terms of some GNU General Public License as published by the Free Software Foundation"),
        (10, "\u212Amit under the mit license \u0130"), (11, prose(3, 20_000)), (2, "under-the mit\nLICENSE under the mit license cc by nc cc by nc"), (None, "cc by nc"),
    ]
    df = li.scan_licenses(make_docs(texts))
    rows = df.collect()
    assert len(rows) == len(texts) and not has_python(df)
    by_id = dict(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_license(by_id[r.doc_id])
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    found = {r.doc_id: r for r in rows}
    assert found[9].labels == "gpl-3" and 0.8 < found[9].score < 1  # one word was changed
    assert found[11].labels == "" and found[1].labels == "mit"
    assert li.scan_licenses(make_docs([])).count() == 0


def test_licenses_by_shuffle_and_broken_ones(make_docs, prose, monkeypatch):
    monkeypatch.setattr(li, "BROADCAST_WORDS", 0)
    monkeypatch.setattr(li, "BROADCAST_KEYS", 0)
    mit = max((t for label, t in li.TEMPLATES if label == "mit"), key=len)
    words = mit.split()
    broken = " ".join(w if i % 3 < 2 else f"{w} zzz{i} yyy{i}" for i, w in enumerate(words))
    dropped = " ".join(w for i, w in enumerate(words) if i % 29 != 28)
    texts = [(1, f"{prose(1, 60)} {mit.upper()}. {prose(2, 60)}"), (2, broken), (3, dropped), (4, " ".join(reversed(words))), (5, prose(4, 300)), (None, mit)]
    got = {r.doc_id: r for r in li.scan_licenses(make_docs(texts)).collect()}
    assert got[1].labels == got[3].labels == got[None].labels == "mit" and got[1].score == 1
    assert got[2].labels == got[4].labels == got[5].labels == ""
    span = max(got[1].spans, key=lambda x: x.last - x.first)
    assert (span.first, span.last, span.cover) == (60, 60 + len(words) - 1, 1.0)


def test_leaks(spark, make_docs, prose):
    question = "A farmer named Tom has 12 sheep and buys 7 more sheep from his friend Maria for 3 dollars. How many sheep does Tom have after the 12 and the 7 are counted together"
    items = spark.createDataFrame([(1, question, "x"), (2, prose(1, 40), "x"), (3, "too short", "x"), (4, None, "x"), (5, prose(1, 40), "x")], "item_id long, text string, doc_id string")
    changed = question.replace("12", "31").replace("7", "9").replace("Tom", "Ali")
    one_changed = " ".join("other" if i == 20 else w for i, w in enumerate(prose(1, 40).split()))
    mixed = question.replace("12 sheep", "31 sheep")  # 12 stands for 31 here and for 12 there
    texts = [
        (1, f"{prose(2, 50)}. {question}. {prose(3, 50)}"), (2, f"{prose(2, 30)}. {changed}?"), (3, mixed), (4, prose(1, 40)), (5, " ".join(prose(1, 40).split()[:20])), (6, None), (7, ""), (8, prose(9, 20_000)),
        (4, prose(1, 40)), (9, one_changed), (None, question),
    ]
    df = dc.find_leaks(make_docs(texts), items)
    found = defaultdict(set)
    for r in df.collect():
        found[r.doc_id].add((r.item_id, r.n_changed > 0))
    assert not has_python(df)
    assert found == {1: {(1, False)}, 2: {(1, True)}, 4: {(2, False), (5, False)}, 9: {(2, False), (5, False)}}
    assert dc.find_leaks(make_docs([]), items).count() == 0 and dc.find_leaks(make_docs(texts), items.limit(0)).count() == 0


def test_leaks_of_listings(spark, make_docs, prose):
    listings = ["He bought 3 apples, 4 apples, 5 apples, 6 apples", "work out 5 plus 6 plus 7 plus 8"]
    items = spark.createDataFrame(list(enumerate(listings)), "item_id long, text string")
    around = lambda i, t: f"{prose(10 + i, 30)}. {t}. {prose(20 + i, 30)}"
    texts = [(i, around(i, t)) for i, t in enumerate(listings)]
    texts += [(2, around(2, listings[0].replace("4 apples", "4 big apples"))), (3, around(3, "He bought 13 apples, 14 apples, 15 apples, 16 apples")), (4, around(4, "work out 5 plus 6 plus 5 plus 5"))]
    df = dc.find_leaks(make_docs(texts), items)
    found = {(r.doc_id, r.item_id): r.n_changed for r in df.collect()}
    assert not has_python(df)
    assert found.items() >= {(0, 0): 0, (1, 1): 0, (3, 0): 4}.items() and (2, 0) in found and (4, 1) in found


def test_leaks_of_few_literals(spark, make_docs, prose):
    dense = ["Convert 5 km, 3 miles and 20 yards to meters", "Add 3, 5, 7, 9, 11 and 13", "Solve 7 times 8"]
    items = spark.createDataFrame(list(enumerate(dense)), "item_id long, text string")
    texts = [(i, f"{prose(30 + i, 30)}. {t}. {prose(40 + i, 30)}") for i, t in enumerate(dense)]
    texts += [(5, "Add 3, 5, 7, 9, 12 and 13 14 15"), (6, "Solve 7 times 9"), (7, dense[2].upper()), (None, dense[1])]
    texts += [(8, f"{prose(50, 9)}. Convert 9 km, 4 miles and 31 yards to meters"), (9, "Convert 9 km and 4 miles"), (10, "Add 3, 3, 3, 9, 12 and 13"), (11, "Sum 3, 5, 7, 9, 12 or 13")]
    df = dc.find_leaks(make_docs(texts), items)
    assert not has_python(df)
    found = {(r.doc_id, r.item_id): (r.coverage, r.n_changed) for r in df.collect()}
    assert found == {(0, 0): (1.0, 0), (1, 1): (1.0, 0), (2, 2): (1.0, 0), (7, 2): (1.0, 0), (5, 1): (0.875, 1), (8, 0): (1.0, 3), (10, 1): (0.875, 3)}


def test_leaks_in_other_letter_case(spark, make_docs, prose):
    questions = ["Tom has 3 apples and gives Maria 2 of the apples that he has", "The capital of France is Paris and the river there is the Seine", "which of them weighs more in the end and why"]
    items = spark.createDataFrame(list(enumerate(questions)), "item_id long, text string")
    texts = [(10 * i + j, f"{prose(i, 20)} {f(q)} {prose(9 + i, 20)}") for i, q in enumerate(questions) for j, f in enumerate((str.upper, str.lower, str.title, str))]
    texts += [(90, "The capital of Spain is Madrid and the river there is the Tajo"), (91, "the capital of spain is madrid and the river there is the tajo"), (92, f"{questions[0]} " * 2_000), (93, prose(1, 20_000))]
    found = {(r.doc_id, r.item_id): r.n_changed for r in dc.find_leaks(make_docs(texts), items).collect()}
    assert found == {**{(10 * i + j, i): 0 for i in range(3) for j in range(4)}, (90, 1): 3, (92, 0): 0}


def plain_tokens(text):
    """Words in lower case and their templates, by a reading of the rules with Python's own expressions."""
    text = re.sub("(?<=[0-9])[.,](?=[0-9])", "", (text or "").replace("\u00a7", " "))
    first = {m.end() for m in re.finditer(r"(?:^|[.!?]\s|\n)(?:(?![^\W_]).)*(?=[^\W_])", text, re.S)}
    words, tokens = [], []
    for m in re.finditer(r"[^\W_]+", text):
        word = m[0].lower()
        slot = "<num>" if word[0] in "0123456789" or word in dc.NUMBER_WORDS else "<unit>" if word in dc.UNITS else "<name>" if m.start() not in first and m[0][0] != word[0] else word
        words.append(word)
        tokens.append(slot)
    return words, tokens


def brute_leak(doc, item, k=5, cover=0.8):
    (dw, dt), (iw, it) = plain_tokens(doc), plain_tokens(item)
    size, slots = len(it), ("<num>", "<unit>", "<name>")
    asked = {(t, k, False) for t in range(size - k + 1)} if size >= k else {(0, size, False)} if size else set()
    for t in range(size - k + 1):
        for n in dc.lengths_of(k):
            s = min(t, size - n)
            if s >= 0 and sum(x not in slots for x in it[s : s + n]) >= dc.LITERALS:
                asked.add((s, n, True))
                break
    met = defaultdict(set)
    for t, n, template in asked:
        for d in range(len(dw) - n + 1):
            if (dt[d : d + n] == it[t : t + n]) if template else (dw[d : d + n] == iw[t : t + n]):
                met[d - t].add((t, n))
    clusters = []
    for g in sorted(met):
        if clusters and g - clusters[-1][-1] <= dc.MERGE:
            clusters[-1].append(g)
        else:
            clusters.append([g])
    under = lambda g: {x for t, n in met[g] for x in range(t, t + n)}
    best = None
    for cluster in clusters:
        if len(set().union(*map(under, cluster))) / size < cover:
            continue
        equal = {g: sum(iw[x] == dw[g + x] for x in under(g)) for g in cluster}
        for some in [[g] for g in cluster] + ([cluster] if len(cluster) > 1 else []):
            held = {x: max((g for g in some if x in under(g)), key=lambda g: (equal[g], -g)) for x in set().union(*map(under, some))}
            pairs = {(it[x], iw[x], dw[g + x]) for x, g in held.items() if it[x] in slots}
            if len(held) / size >= cover and len(pairs) == len({p[:2] for p in pairs}):
                windows = sum(len(met[g]) for g in set(held.values()))
                found = (len(held) / size, windows, -min(g + x for x, g in held.items()), len(pairs), sum(a != b for _, a, b in pairs))
                best = max(best or found, found)
    return best


def test_finds_and_non_finds_equal_brute_force(spark, make_docs, prose):
    r = random.Random(5)
    base = [t for t in seeded_items(prose)[:24]] + ["Convert 5 km, 3 miles and 20 yards to meters", "He bought 3 apples, 4 apples, 5 apples, 6 apples", "Anna saw Tom. Tom saw Anna and 2 dogs. Who saw Tom"]
    items = spark.createDataFrame(list(enumerate(base)), "item_id long, text string")
    docs = []
    for i, text in enumerate(base * 4):
        words = text.split()
        for _ in range(r.randint(0, 3)):  # other values, other words, words gone or doubled
            at = r.randrange(len(words))
            words[at : at + 1] = r.choice([[str(r.randint(2, 99))], ["Bert"], [], [words[at]] * 2, [words[at].upper()], ["km"]])
        docs.append((i, f"{prose(i, r.randint(0, 12))}. {' '.join(words)}{r.choice(['.', '', ' ' + text])} {prose(i + 500, r.randint(0, 9))}"))
    found = {(x.doc_id, x.item_id): x for x in dc.find_leaks(make_docs(docs), items).collect()}
    want = {(i, j): b for i, d in docs for j, t in enumerate(base) if (b := brute_leak(d, t))}
    assert set(found) == set(want) and 20 < len(want) < len(docs) * 2
    for key, b in want.items():
        x = found[key]
        assert (round(x.coverage, 9), x.n_windows, -x.first_token, x.n_slots, x.n_changed) == (round(b[0], 9), *b[1:])


def seeded_items(prose):
    """Items that repeat phrases, hold numbers only, or have a few words."""
    r = random.Random(11)
    items = []
    for i in range(20):
        phrase = prose(300 + i, 3)
        items.append(f"{prose(400 + i, 2)} " + " ".join(f"{phrase} {r.randint(2, 99)} {r.choice(['cups', 'days', 'km'])}" for _ in range(r.randint(2, 5))))
        items.append("".join(f"{r.randint(1000, 9999)} " for _ in range(r.randint(4, 12))).strip())
        items.append(prose(500 + i, 3))
        items.append(f"{prose(600 + i, 4)} Tom {prose(700 + i, 3)} Maria {r.randint(2, 9)} {prose(800 + i, 4)} Tom {r.randint(10, 99)}")
    return items


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_exact_copies_of_any_item_are_found(spark, make_docs, prose, monkeypatch, broadcast):
    monkeypatch.setattr(dc, "BROADCAST_WINDOWS", broadcast)
    texts = seeded_items(prose)
    items = spark.createDataFrame([*enumerate(texts), *enumerate(texts[:2]), (None, texts[0])], "item_id long, text string")
    docs = [(i, f"{prose(1000 + i, 25)}. {t}. {prose(2000 + i, 25)}") for i, t in enumerate(texts)] + [(500 + i, prose(3000 + i, 80)) for i in range(20)]
    df = dc.find_leaks(make_docs(docs), items)
    rows = df.collect()
    assert not has_python(df)
    assert {(r.doc_id, r.item_id) for r in rows} >= {(i, i) for i in range(len(texts))}
    assert not [r for r in rows if r.doc_id >= 500] and len({(r.doc_id, r.item_id) for r in rows}) == len(rows)
    assert all(r.n_changed == 0 and r.coverage == 1 for r in rows if r.doc_id == r.item_id)


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("a-b.net", "/", "block"), ("b.net", "/", "allow"), ("x.example.com", "/en/q", "block")]


def brute_url(url):
    m = re.search(r"(?s)://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else ("allow" if host else "block")


def test_url_rules(spark):
    hosts = ["example.com", "WWW.Example.com", "www.example.comx", "x.example.com", "deep.www.example.com", "net", "a.net", "a-b.net", "c.a-b.net", "b.net", "com", "", "example-x.com"]
    urls = [f"https://{h}{p}" for h in hosts for p in ("/en/1", "/en", "/es/2?q=/en/", "", "?/en/", "#x", "/en/q/r")] + [None, "", "no scheme", "a://b://c/en/", "http://example.com/en/\nx"]
    urls += ["https://m.example.com/en/7"] * 500
    pages = spark.createDataFrame([(i, u, "k", "p") for i, u in enumerate(urls)] + [(None, "http://a.com/", "k", "p")], "page_id long, url string, key string, part string").repartition(5)
    rules = spark.createDataFrame([*RULES, ("com", "/", "allow"), (None, "/", "block")], "host string, path string, verdict string")
    df = uf.filter_urls(pages, rules)
    rows = df.collect()
    assert len(rows) == len(urls) + 1 and not has_python(df)
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == brute_url(urls[r.page_id] if r.page_id is not None else "http://a.com/")
    unruled = uf.filter_urls(pages.where("page_id % 5 = 0"), rules.limit(0)).collect()
    assert len(unruled) > 100 and all((r.host, r.path) == brute_url(urls[r.page_id])[:2] for r in unruled)
    assert all(r.rule is None and r.verdict == ("allow" if r.host else "block") for r in unruled)
    assert uf.filter_urls(pages.limit(0), rules).count() == 0


def test_long_urls_and_clashing_columns(spark):
    long = "http://" + "a." * 5_000 + "example.com/en/" + "x" * 50_000
    rows = [(1, long, "h", "p", "v", "r"), (2, "http://net/es/", "h", "p", "v", "r"), (2, "http://net/es/", "h", "p", "v", "r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string, verdict string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = uf.filter_urls(pages, rules).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in got] == [("example.com/en/", "block"), ("net/es/", "block"), ("net/es/", "block")]
