"""Removal of passages that repeat across documents, by prefix-partitioned suffix trees.

A window is a run of ``length`` words. The suffixes that begin with a repeated window are the leaves below
deep internal nodes of the corpus' suffix tree; the operator builds only those parts of it:

1. Suffixes are routed by a prefix of their window, its minimiser (the run of ``GRAM`` words with the least
   hash). Equal windows have equal minimisers, so no repeat is split. Windows that share a minimiser form a
   context, a few dozen words that are sent once. Prefixes seen in one document only hold no repeat and go
   no further.
2. A prefix under which all contexts are equal is a single edge, and its least document is all there is to
   know. Other prefixes are packed into groups of a fixed number of contexts, and for each group a task
   sorts the suffixes by prefix doubling and reads the nodes of depth ``length`` or more off the neighbours'
   common prefixes. A prefix with too many contexts for a group is made longer, up to the whole window;
   suffixes that share all of it are one node, which a map-side aggregate finds without a tree.
3. Each node's least doc_id tells which of its windows repeat an earlier document.

Equal contexts, however many documents hold them, are one row in steps 2 and 3.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm import textarrays as ta
from loomspark.llm.scratch import durable
from loomspark.llm.skew import join_hot, join_spread, spread_keys
from loomspark.llm.tables import id_and_text

#: Words of the prefix that routes a window.
GRAM = 10
#: Contexts that a task holds at a time, and how many of one prefix are still handled as a group.
GROUP_CONTEXTS, PREFIX_CONTEXTS = 1_000, 1_000


def _sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value (the first, on a tie) among each ``width`` consecutive ones."""
    n = len(values)
    places = np.arange(n, dtype=np.uint64)
    low = np.uint64((1 << 24) - 1)
    keyed = (values & ~low) | (places & low)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = keyed
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
    begin = places[: n - width + 1]
    return (begin + ((least - begin) & low)).astype(np.int64)


def contexts(words: ta.Words, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(prefix, context, first, last): runs of windows with one minimiser, named by the words their windows begin at."""
    none = np.zeros(0, dtype=np.int64)
    gram = min(GRAM, length)
    starts = ta.window_starts(words, length)
    if not len(starts):
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    runs = ta.RunHashes(hashes)
    every = np.arange(len(hashes) - gram + 1)
    grams = runs(every, every + gram)
    least = _sliding_argmin(grams, length - gram + 1)[starts]
    change = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1))))
    first, last = starts[change], starts[np.concatenate((change[1:], [len(starts)])) - 1]
    return grams[least[change]], runs(first, last + length), first, last


def _occurrences(docs: DataFrame, length: int) -> DataFrame:
    """``(prefix, context, doc_id, th, firsts, n)``: the contexts of every document, n windows each from every one of ``firsts``.

    A document that holds a context often, such as one word over and over, has one row for it.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at, to, data, offsets in ta.text_chunks(batch.column(2)):
                words = ta.split_words(data, offsets)
                prefix, context, first, last = contexts(words, words.hashes(), length)
                doc = np.searchsorted(words.first, first, side="right") - 1
                order = np.lexsort((first, context, prefix, doc))
                doc, prefix, context, first, last = doc[order], prefix[order], context[order], first[order], last[order]
                new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (prefix[1:] != prefix[:-1]) | (context[1:] != context[:-1])))) if len(doc) else first
                firsts = pa.ListArray.from_arrays(pa.array(np.concatenate((new, [len(doc)])).astype(np.int32)), pa.array((first - words.first[doc]).astype(np.int32)))
                n = (last - first + 1)[new].astype(np.int32)
                columns = [pa.array(c) for c in (ta.as_signed(prefix[new]), ta.as_signed(context[new]), ids[at:to][doc[new]], marks[at:to][doc[new]])]
                yield pa.RecordBatch.from_arrays([*columns, firsts, pa.array(n)], ["prefix", "context", "doc_id", "th", "firsts", "n"])

    return docs.select("doc_id", "th", "text").mapInArrow(scan, "prefix long, context long, doc_id long, th long, firsts array<int>, n int")


def _cut_contexts(asked: DataFrame, length: int) -> DataFrame:
    """For ``(doc_id, text, wanted)``, the words of each wanted context, and a key of each window where the prefix is long."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            out: list[tuple] = []
            for at, to, data, offsets in ta.text_chunks(batch.column(1)):
                words = ta.split_words(data, offsets)
                runs = ta.RunHashes(words.hashes())
                raw = data.tobytes()
                for i, wanted in enumerate(batch.column(2)[at:to].to_pylist()):
                    for w in wanted:
                        first, last = words.first[i] + w["first"], words.first[i] + w["first"] + w["n"] - 1
                        if w["long"]:
                            begins = np.arange(first, last + 1)
                            out.append((w["part"], w["prefix"], w["context"], ids[at + i], len(begins), None, ta.as_signed(runs(begins, begins + length)).tolist()))
                        else:
                            out.append((w["part"], w["prefix"], w["context"], ids[at + i], int(last - first + 1), raw[words.starts[first] : words.ends[last + length - 1]].decode(), None))
            names = ["part", "prefix", "context", "doc_id", "n", "words", "keys"]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([row[c] for row in out], kind) for c, kind in enumerate(kinds)], names)

    return asked.mapInArrow(cut, "part int, prefix long, context long, doc_id long, n int, words string, keys array<long>")


def deep_nodes(words: ta.Words, begins: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in sorted order, and where each node of depth ``length`` or more begins in that order.

    Ranks of runs of 1, 2, 4, ... words give the order; two neighbours whose first ``length`` words agree
    have a common prefix at least that deep and hang below one node.
    """
    _, rank = np.unique(words.hashes(), return_inverse=True)
    run = 1
    while 2 * run <= length:
        after = np.full(len(rank), -1, dtype=np.int64)
        after[:-run] = rank[run:]
        _, rank = np.unique(rank * (len(rank) + 2) + after + 1, return_inverse=True)
        run *= 2
    head, tail = rank[begins], rank[begins + length - run]
    order = np.lexsort((tail, head))
    head, tail = head[order], tail[order]
    return order, np.flatnonzero(np.concatenate(([True], (head[1:] != head[:-1]) | (tail[1:] != tail[:-1]))))


def _least_of_nodes(group: pa.Table, length: int) -> pa.Table:
    """The least document of each window's node, for a group of contexts."""
    group = group.combine_chunks()
    data, offsets = ta.text_bytes(group.column("words").chunk(0))
    words = ta.split_words(data, offsets)
    n = group.column("n").to_numpy().astype(np.int64)
    begins = np.repeat(words.first[:-1], n) + ta.ramp(n)
    order, nodes = deep_nodes(words, begins, length)
    docs = np.repeat(group.column("doc_id").to_numpy(), n)[order]
    least = np.empty(len(begins), dtype=np.int64)
    least[order] = np.repeat(np.minimum.reduceat(docs, nodes), np.diff(np.concatenate((nodes, [len(order)]))))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(least))
    return pa.table({"prefix": group.column("prefix").chunk(0), "context": group.column("context").chunk(0), "least": lists})


def _keep_rest(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, digests, texts, cuts = [], [], [], [], []
        for text, begins in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
            raw = (text or "").encode()
            words, stretches = raw.split(), []
            n_words.append(len(words))
            if begins.is_valid and len(begins):
                change = np.zeros(len(words) + 1, dtype=np.int64)
                at = np.unique(begins.values.to_numpy())
                change[at] += 1
                np.subtract.at(change, at + length, 1)
                covered = np.cumsum(change)[:-1] > 0
                words = [w for w, gone in zip(words, covered.tolist(), strict=True) if not gone]
                layout = ta.split_words(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]))
                edge = np.flatnonzero(np.diff(np.concatenate(([1], covered.astype(np.int8), [1]))))
                text = " ".join(raw[layout.starts[a] : layout.ends[b - 1]].decode() for a, b in edge.reshape(-1, 2))
                turn = np.flatnonzero(np.diff(np.concatenate(([0], covered.astype(np.int8), [0])))).reshape(-1, 2)
                stretches = [{"first": int(a), "n_words": int(b - a)} for a, b in turn]
            n_removed.append(n_words[-1] - len(words))
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            texts.append(text)
            cuts.append(stretches)
        columns = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())]
        spans = pa.array(cuts, pa.list_(pa.struct([("first", pa.int32()), ("n_words", pa.int32())])))
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "text_hash", "cuts"]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns, batch.column(1), spans], names)


def remove_repeated_passages(docs: DataFrame, length: int = 50) -> DataFrame:
    """One row a document: ``(doc_id, n_words, n_removed, kept_sha256, kept_text, text_hash, cuts)``.

    ``docs`` has ``doc_id`` and ``text``; other columns are left alone. A word goes if a window of ``length``
    words covers it whose words also begin in a document with a smaller doc_id; all windows are judged on the
    input. ``kept_sha256`` is of the kept words joined by one space. ``kept_text`` is the text as it was where
    nothing went, else the kept stretches with their own white space inside and one space between. ``cuts`` are
    the removed stretches as (first word, words); ``text_hash`` is xxhash64 of the text as it was.

    Null and empty texts have no words and keep nothing. A text of fewer than ``length`` words loses nothing.
    Rows without a doc_id lose nothing and are nobody's earlier copy. Repeated rows are treated alike, each by
    its own text; two rows with one doc_id are never each other's earlier copy. An empty table gives none.
    """
    # both joins below deal the texts by the same key with the same plan, so Spark shuffles them once
    known = id_and_text(docs).where("doc_id is not null").withColumn("th", F.xxhash64("text")).hint("merge")
    seen = durable(_occurrences(known, length), "occurrences")
    ends = [F.min("doc_id").alias("earliest"), F.max("doc_id").alias("latest"), F.min("context").alias("one"), F.max("context").alias("other"), F.count(F.lit(1)).alias("n_rows")]
    shared = seen.groupBy("prefix").agg(*ends).where("earliest < latest")
    shared = durable(shared.select("prefix", "earliest", (F.col("one") != F.col("other")).alias("branches"), "n_rows"), "prefixes")
    hot = spread_keys(shared, ["prefix"], "n_rows")
    found = join_spread(seen, shared.drop("n_rows"), ["prefix"], "doc_id", hot)
    found = durable(found.where("branches or doc_id > earliest"), "contexts")

    key = ["prefix", "context"]
    holder = F.min(F.struct("doc_id", "th", F.get("firsts", 0).alias("first"), "n")).alias("holder")
    branching = found.where("branches").groupBy(*key).agg(holder, F.count(F.lit(1)).alias("n_rows"))
    branching = durable(branching.select(*key, "holder.*", "n_rows"), "branching")
    parts = max(1, -(-branching.count() // GROUP_CONTEXTS))
    wide = branching.groupBy("prefix").count().where(F.col("count") > PREFIX_CONTEXTS).select("prefix", F.lit(True).alias("wide"))
    wanted = join_hot(branching, wide, "prefix", "context").withColumn("long", F.coalesce("wide", F.lit(False)))
    wanted = wanted.withColumn("part", F.pmod(F.xxhash64("prefix"), F.lit(parts)).cast("int"))
    wanted = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("part", "prefix", "context", "first", "n", "long")).alias("wanted"))
    cut = durable(_cut_contexts(known.join(wanted, ["doc_id", "th"]).select("doc_id", "text", "wanted"), length), "cut")
    to_trees = cut.where("keys is null").select("part", *key, "doc_id", "n", "words")
    trees = to_trees.groupBy("part").applyInArrow(lambda group: _least_of_nodes(group, length), "prefix long, context long, least array<long>")
    whole = cut.where("keys is not null").select(*key, "doc_id", F.posexplode("keys").alias("at", "key"))
    nodes = durable(whole.groupBy("key").agg(F.min("doc_id").alias("earliest"), F.count(F.lit(1)).alias("n_rows")), "nodes")
    told = join_spread(whole, nodes.drop("n_rows"), ["key"], "context", spread_keys(nodes, ["key"], "n_rows"))
    singles = told.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "earliest"))), lambda x: x["earliest"]).alias("least"))

    least = durable(trees.union(singles), "least")
    repeats = join_spread(found.where("branches"), least, key, "doc_id", spread_keys(branching, key, "n_rows"))
    late = F.filter(F.transform("least", lambda v, i: F.when(v < F.col("doc_id"), i)), lambda v: v.isNotNull())
    windows = F.flatten(F.transform("firsts", lambda x: F.transform(F.col("late"), lambda i: x + i)))
    edges = F.flatten(F.transform("firsts", lambda x: F.sequence(x, x + F.col("n") - 1)))
    begins = repeats.withColumn("late", late).where("size(late) > 0").select("doc_id", "th", windows.alias("begins"))
    begins = begins.union(found.where("not branches").select("doc_id", "th", edges.alias("begins")))
    gone = begins.groupBy("doc_id", "th").agg(F.flatten(F.collect_list("begins")).alias("begins"))
    judged = known.join(gone, ["doc_id", "th"], "left").select("doc_id", "th", "text", "begins")
    unknown = id_and_text(docs).where("doc_id is null").select("doc_id", F.xxhash64("text"), "text", F.lit(None).cast("array<int>").alias("begins"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, text_hash long, cuts array<struct<first: int, n_words: int>>"
    return judged.union(unknown).mapInArrow(lambda batches: _keep_rest(batches, length), schema)
