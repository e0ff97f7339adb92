"""The pipeline end to end on planted cases."""

from collections import Counter

import corpus_pipeline as cp


def test_stages(spark, prose, tmp_path):
    clean = [(i, prose(i, 120)) for i in range(40)]
    toxic = [(100 + i, prose(500 + i, 40) + ". You are a lummox here. " + prose(600 + i, 40)) for i in range(40)]
    passage, item = prose(900, 60), prose(901, 40)
    planted = [(200, clean[3][1]), (201, clean[4][1] + " tail"), (202, prose(902, 40) + " " + passage), (203, prose(903, 40) + " " + passage), (204, prose(904, 40) + ". " + item), (205, None), (206, "")]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in clean + toxic + planted]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 100)) for i, _ in clean + toxic], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in cp.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
        assert name == "mixing" or docs.columns == columns
    assert not {i for i in kept["toxicity"] if 100 <= i < 200} and set(dict(clean)) <= set(kept["toxicity"])
    assert not {200, 201} & set(kept["near_duplicates"]) and set(dict(clean)) <= set(kept["near_duplicates"])
    assert passage in kept["repeated_passages"][202] and kept["repeated_passages"][203] == prose(903, 40)
    assert set(kept["repeated_passages"]) - set(kept["decontamination"]) == {204}
    assert set(kept["mixing"]) <= set(kept["decontamination"])
    assert cp.run(spark, str(tmp_path)).count() == len(kept["mixing"])


def test_rows_without_ids_and_texts_that_share_one(spark, prose, tmp_path):
    item, passage = prose(901, 40), prose(905, 60)
    toxic = [(100 + i, prose(500 + i, 40) + ". You are a lummox here. " + prose(600 + i, 40)) for i in range(40)]
    clean = [(i, prose(i, 120)) for i in range(40)]
    odd = [(None, prose(700, 80)), (None, clean[3][1]), (None, prose(701, 30) + ". You are a lummox here. " + prose(702, 30)), (None, prose(703, 30) + ". " + item), (None, prose(704, 30) + " " + passage)]
    odd += [(50, prose(705, 90)), (50, prose(706, 90)), (50, prose(706, 90)), (51, prose(707, 70) + " " + passage), (52, prose(708, 20_000)), (53, None), (None, None), (54, ""), (54, "")]
    rows = [(i, t, "en", f"s{n % 3}", len(t or ""), "k", "c", n % 2 == 0) for n, (i, t) in enumerate(clean + toxic + odd)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, component_id string, kept boolean"
    spark.createDataFrame(rows, schema).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 100)) for i, _ in clean + toxic], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in cp.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        left[name] = Counter((r.doc_id, r.text) for r in docs.collect())
    assert not any("lummox" in (t or "") for _, t in left["toxicity"]) and (None, prose(700, 80)) in left["toxicity"]
    assert (None, clean[3][1]) not in left["near_duplicates"] and (3, clean[3][1]) in left["near_duplicates"]
    assert left["near_duplicates"][(50, prose(705, 90))] == left["near_duplicates"][(50, prose(706, 90))] == 1
    assert left["near_duplicates"][(54, "")] == 1 and (None, None) in left["near_duplicates"]
    assert (None, prose(704, 30)) in left["repeated_passages"] and (51, prose(707, 70) + " " + passage) in left["repeated_passages"]
    assert (None, prose(703, 30) + ". " + item) in left["repeated_passages"] and not any(item in (t or "") for _, t in left["decontamination"])
    assert (52, prose(708, 20_000)) in left["decontamination"]
    assert cp.run(spark, str(tmp_path)).count() == len([t for _, t in left["decontamination"] if t])


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_mixture_has_the_drawn_words(spark, prose):
    texts = [(i, prose(i, 20 + 37 * i % 700), f"s{i % 3}") for i in range(60)] + [(60, prose(7, 20_000), "s1"), (61, prose(8, 30_000), None), (62, None, "s0"), (63, "", "s1")]
    texts += [(70, "b  c", "s1"), (70, "a\n", "s1"), (None, prose(71, 900), "s2"), (None, prose(72, 300), "s2")]
    rows = [(i, t, "en", s, len(t or "")) for i, t, s in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    own, words = {}, Counter()
    for i, t, s in sorted(texts, key=lambda x: x[1] or ""):
        own.setdefault((i if i is not None else t, s), []).extend((t or "").split())
    out = cp.mix_sources(spark, docs, "").collect()
    for r in out:
        written = r.text.split()
        whole = next(w for (i, s), w in own.items() if s == r.source and (i == r.doc_id if r.doc_id is not None else len(w) == r.size))
        assert written == [w for p in r.pieces for w in whole[p.first_word : p.first_word + p.n_words]]
        assert len(written) == r.taken <= 2 * r.size and len({(p.block, p.epoch) for p in r.pieces}) == len(r.pieces) == r.n_blocks
        words[r.source] += len(written)
    target = {r.source: r.target for r in out}
    assert len(target) == 4 and all(abs(words[s] - target[s]) <= 1 for s in target)
    assert any(r.taken < r.size for r in out) and any(r.taken > r.size for r in out)
    assert sum(r.doc_id is None for r in out) == 2


def test_an_id_of_which_one_text_is_a_copy(spark, prose):
    a, b, near = prose(1, 200), prose(2, 200), prose(1, 200) + " tail"
    rows = [(3, a), (7, near), (7, b), (7, b), (2, prose(4, 90)), (9, None), (9, ""), (9, b + " end")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    left = sorted(((r.doc_id, r.text) for r in cp.drop_near_duplicates(spark, docs, "").collect()), key=repr)
    assert left == sorted([(3, a), (7, b), (2, prose(4, 90)), (9, None), (9, "")], key=repr)
    other = spark.createDataFrame([(5, a, "x"), (5, near, "y"), (5, b, "z")], "doc_id long, text string, lang string")
    assert len({r.text for r in cp.drop_near_duplicates(spark, other, "").collect()} - {b}) == 1
