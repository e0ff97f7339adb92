"""License notices by diagonal voting.

Every run of K words of a text is hashed and joined with the places of that run in the notice templates. A hit
votes for a diagonal, the distance between its place in the text and in the template; an undisturbed notice
puts all its votes on one, an edited one on a few neighbours. Neighbouring diagonals are merged to spans; one
that is much longer than its template is no notice. A span counts once the template's words under its hits cover
enough of the template, and those words are then held against the text. All of it is SQL functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.llm.scratch import durable
from loomspark.llm.sqlblocks import let, runs

#: Words of a run, the largest step between diagonals that are merged, the share of a template that must be covered,
#: and the most words of a span, in percent of its template's.
K, MERGE, COVER, STRETCH = 3, 2, 0.8, 140
#: Documents whose spans are verified: up to so many keys (16 bytes each) are broadcast to pick their texts.
BROADCAST_KEYS = 1_000_000
#: Templates of up to so many words together are broadcast; larger sets are joined by shuffle.
BROADCAST_WORDS = 200_000

# Phrases that name a license wherever their words stand together.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Well-known notices, in lower-case words.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"
        " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished"
        " to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    (
        "apache-2",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express"
        " or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    (
        "bsd",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright"
        " notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    (
        "gpl-3",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu"
        " general public license for more details",
    ),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("all-rights-reserved", "all rights reserved"),
]


@dataclass(frozen=True)
class Tokens:
    padded: Column  # the words with one space before, between and after
    words: Column
    count: Column


def tokens(text: Column) -> Tokens:
    """Lower-cased words of a text: runs of digits, letters a-z and non-ASCII characters; null has none.

    Lower-casing all of Unicode makes the same ASCII words as lower-casing A-Z, once the Kelvin sign, the
    only other character whose lower case is an ASCII letter alone, is swapped for another non-ASCII letter.
    """
    lower = F.lower(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("K"), F.lit("Å")))
    padded = F.regexp_replace(F.concat(F.lit(" "), lower, F.lit(" ")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    words = let(F.trim(padded), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " ")))
    return Tokens(padded, words, F.length(padded) - F.length(F.replace(padded, F.lit(" "), F.lit(""))) - 1)


def _phrase(padded: Column, n_words: Column, phrase: str) -> tuple[Column, Column, Column]:
    """(places, first, last) of a phrase, the latter null without one."""
    there = F.contains(padded, F.lit(f" {phrase} "))
    back = F.reverse(padded)

    def before(text: Column, what: str) -> Column:
        head = F.substring_index(text, what, 1)
        return F.length(head) - F.length(F.replace(head, F.lit(" "), F.lit("")))

    size = len(phrase.split())
    places = F.when(there, F.regexp_count(padded, F.lit(f" {phrase}(?= )"))).otherwise(0)
    first = F.when(there, before(padded, f" {phrase} "))
    last = F.when(there, n_words - before(back, f" {phrase[::-1]} ") - size)
    return places.cast("long"), first.cast("long"), last.cast("long")


def _templates(spark: SparkSession, templates: list[tuple[str, str]], k: int) -> DataFrame:
    """``(hash, template, label, t, grams, t_words)`` of every run of every template."""
    listed = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(text).alias("text")) for i, (label, text) in enumerate(templates)])
    rows = spark.range(1).select(F.explode(listed).alias("x")).select("x.template", "x.label", F.split("x.text", " ").alias("words"))
    return rows.select("template", "label", F.size("words").alias("t_words"), F.posexplode(runs(F.col("words"), k)).alias("t", "hash"))


def _template_words(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """``(template, t_list)``: the words of every template."""
    listed = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(text).alias("text")) for i, (_, text) in enumerate(templates)])
    return spark.range(1).select(F.explode(listed).alias("x")).select("x.template", F.split("x.text", " ").alias("t_list"))


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, k: int = K) -> DataFrame:
    """One row a document: ``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans)``.

    ``docs`` has ``doc_id`` and ``text``; other columns are left alone. ``n_base`` counts all places of the
    phrases, ``first_word`` and ``last_word`` are their least and greatest first words (from 0; null without
    a place). ``labels`` adds the labels of templates covered by at least COVER in a span of at most STRETCH percent
    of the template's words, which are those of the text; ``score`` is the largest share of a template found in
    such a span, 1 where a phrase stands. ``spans`` lists (label, first, last, cover), words inclusive. Labels are distinct, sorted and joined by commas, empty without any. Null and empty texts have
    no words, labels or spans and score 0. Repeated rows give repeated rows of the same result; rows
    without a doc_id are scanned like all others; an empty table gives none. Templates of fewer than k words
    can't be found by the method. A run that very many documents share is no hot key: templates up to
    BROADCAST_WORDS are broadcast, and beyond that Spark splits the skewed side of the join.
    """
    text = F.col("text").cast("string")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    t = tokens(F.col("text"))
    padded = keyed.select("doc_id", "th", t.padded.alias("padded"))
    found = [_phrase(F.col("padded"), F.col("n_words"), p) for p in PHRASES]
    base_labels = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(n > 0, F.lit(label)) for (n, _, _), label in zip(found, PHRASES.values(), strict=True)]), lambda x: x.isNotNull())))
    base = padded.withColumn("n_words", (F.length("padded") - F.length(F.replace("padded", F.lit(" "), F.lit(""))) - 1).cast("long")).select(
        "doc_id",
        "th",
        "n_words",
        sum((n for n, _, _ in found), F.lit(0).cast("long")).alias("n_base"),
        F.least(*[first for _, first, _ in found]).alias("first_word"),
        F.greatest(*[last for _, _, last in found]).alias("last_word"),
        base_labels.alias("base"),
    )

    table = _templates(docs.sparkSession, templates, k)
    small = sum(len(text.split()) for _, text in templates) <= BROADCAST_WORDS
    if small:
        table = F.broadcast(table)
    grams = keyed.select("doc_id", "th", t.words.alias("words")).select("doc_id", "th", F.posexplode(runs(F.col("words"), k)).alias("d", "hash"))
    key = ["doc_id", "th", "template"]
    diagonals = grams.join(table, "hash").groupBy(*key, "label", "t_words", (F.col("d") - F.col("t")).alias("diagonal")).agg(F.collect_set("t").alias("ts"))
    order = Window.partitionBy(*key).orderBy("diagonal")
    starts = (F.col("diagonal") - F.lag("diagonal", 1).over(order) > MERGE).cast("int")
    merged = diagonals.withColumn("starts", F.coalesce(starts, F.lit(0))).withColumn("cluster", F.sum("starts").over(order))
    least, most = F.min(F.col("diagonal") + F.array_min("ts")), F.max(F.col("diagonal") + F.array_max("ts")) + k - 1
    on_diagonal = F.collect_list(F.struct("diagonal", "ts")).alias("diagonals")
    spans = merged.groupBy(*key, "label", "t_words", "cluster").agg(on_diagonal, least.alias("first"), most.alias("last")).where(100 * (F.col("last") - F.col("first") + 1) <= STRETCH * F.col("t_words"))
    under = lambda ts: F.flatten(F.transform(ts, lambda x: F.sequence(x, x + k - 1)))
    cover = F.size(F.array_distinct(F.flatten(F.transform("diagonals", lambda g: under(g["ts"]))))) / F.col("t_words")
    covered = durable(spans.withColumn("cover", cover).select("doc_id", "th", "template", "label", "t_words", "first", "last", "diagonals", "cover"), "spans")

    # the words of spans that cover enough are looked up again in their texts
    sure = covered.where(F.col("cover") >= COVER)
    keys = durable(sure.select("doc_id", "th").distinct(), "keys")
    known = lambda left, right: left["doc_id"].eqNullSafe(right["doc_id"]) & (left["th"] == right["th"])
    texts = keyed.alias("x").join(F.broadcast(keys).alias("y") if keys.count() <= BROADCAST_KEYS else keys.alias("y"), F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.th") == F.col("y.th")), "left_semi")
    held = texts.select("doc_id", "th", t.words.alias("words")).distinct()
    rows = F.broadcast(_template_words(docs.sparkSession, templates)) if small else _template_words(docs.sparkSession, templates)
    checked = sure.join(held, known(sure, held)).drop(held["doc_id"]).drop(held["th"]).join(rows, "template")
    same = lambda d: lambda x: F.get("words", x + d) == F.get("t_list", x)
    true_words = F.array_distinct(F.flatten(F.transform("diagonals", lambda g: F.filter(under(g["ts"]), same(g["diagonal"])))))
    verified = checked.select("doc_id", "th", "label", "first", "last", (F.size(true_words) / F.col("t_words")).alias("cover"))
    judged = verified.union(covered.where(F.col("cover") < COVER).select("doc_id", "th", "label", "first", "last", "cover"))
    by_doc = judged.select("doc_id", "th", F.struct("label", "first", "last", "cover").alias("span")).groupBy("doc_id", "th").agg(F.array_sort(F.collect_list("span")).alias("spans"))

    b, s = base.alias("b"), by_doc.alias("s")
    whole = b.join(s, F.col("b.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("b.th") == F.col("s.th")), "left")
    every = F.coalesce(F.col("s.spans"), F.array().cast("array<struct<label:string,first:int,last:int,cover:double>>"))
    sure = F.filter(every, lambda x: x["cover"] >= COVER)
    labels = F.array_sort(F.array_union(F.col("b.base"), F.transform(sure, lambda x: x["label"])))
    best = F.coalesce(F.array_max(F.transform(every, lambda x: x["cover"])), F.lit(0.0))
    return whole.select(
        "b.doc_id", "b.n_words", "b.n_base", "b.first_word", "b.last_word", F.array_join("b.base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.col("b.n_base") > 0, F.lit(1.0)).otherwise(best).alias("score"), sure.alias("spans"),
    )
