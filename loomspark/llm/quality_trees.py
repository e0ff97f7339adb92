"""Quality by histogram gradient-boosted trees over statistics of a document's text.

Trees are grown level by level on binned statistics and kept as flat arrays of complete binary trees, so
that a batch of documents walks down all of them with a few numpy look-ups a level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomspark.llm import textarrays as ta
from loomspark.llm.sampling import held_out, labelled_sample
from loomspark.llm.tables import id_and_text

#: Fitting takes at most so many documents of each class, by their statistics only.
SAMPLE_PER_CLASS = 10_000
BINS, DEPTH, TREES, RATE = 64, 4, 80, 0.15

_NEWLINE = np.zeros(256, dtype=bool)
_NEWLINE[10] = True


def _marks(text: str) -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    out[[ord(c) for c in text]] = 1
    return out


_KINDS = {
    "upper": _marks("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "digit": _marks("0123456789"),
    "symbol": _marks("#*$%&|<>"),
    "shout": _marks("!?"),
    "stop": _marks(".,;:"),
    "space": _marks(" \t\n\r\x0b\x0c"),
    "foreign": np.concatenate((np.zeros(128, dtype=np.int64), np.ones(128, dtype=np.int64))),
}
STATISTICS = [*(f"{k}_share" for k in _KINDS), "log_words", "mean_word", "long_words", "short_words", "distinct_words", "log_lines", "words_a_line", "repeated_lines", "repeated_runs", "marked_ends"]


def _distinct(doc: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """How many different hashes each text has."""
    order = np.lexsort((hashes, doc))
    d, h = doc[order], hashes[order]
    new = np.concatenate(([True], (d[1:] != d[:-1]) | (h[1:] != h[:-1]))) if len(d) else np.zeros(0, dtype=bool)
    return np.bincount(d[new], minlength=n)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text; all 0 for a text without words."""
    n = len(offsets) - 1
    words, lines = ta.split_words(data, offsets), ta.split_words(data, offsets, _NEWLINE)
    size = np.maximum(np.diff(offsets), 1)
    out = [ta.segment_sums(kind[data], offsets) / size for kind in _KINDS.values()]
    hashes, doc = words.hashes(ta.lower_ascii(data)), words.doc()
    count, length = np.maximum(words.counts, 1), words.ends - words.starts
    at, runs = ta.windows(hashes, words, 5)
    n_runs = np.bincount(doc[at], minlength=n)
    n_lines = np.maximum(lines.counts, 1)
    marked = _KINDS["symbol"][data[words.ends - 1]] + _KINDS["shout"][data[words.ends - 1]] if len(words.ends) else np.zeros(0, dtype=np.int64)
    out += [np.log1p(words.counts), ta.segment_sums(length, words.first) / count, ta.segment_sums((length > 12).astype(np.int64), words.first) / count, ta.segment_sums((length < 4).astype(np.int64), words.first) / count]
    out += [_distinct(doc, hashes, n) / count, np.log1p(lines.counts), words.counts / n_lines, 1 - _distinct(lines.doc(), lines.hashes(), n) / n_lines, 1 - _distinct(doc[at], runs, n) / np.maximum(n_runs, 1), ta.segment_sums(marked, words.first) / count]
    rows = np.stack(out, axis=1).astype(np.float64)
    rows[words.counts == 0] = 0
    return rows


@dataclass
class Trees:
    """Tree t splits node i on ``feature[t, i]`` at ``cut[t, i]`` into nodes 2i+1 (not above) and 2i+2; leaves follow."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows, total = np.arange(len(x)), np.full(len(x), self.base)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - (2**DEPTH - 1)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Logistic boosting with second-order gains over histograms of at most BINS quantile bins."""
    inner, n_features = 2**DEPTH - 1, x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(n_features)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    cuts = np.full((n_features, BINS), np.inf)
    for j, e in enumerate(edges):
        cuts[j, : len(e)] = e
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(prior / (1 - prior)))
    margin, column = np.full(len(y), base), np.arange(n_features) * BINS
    out = Trees(np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), np.inf), np.zeros((trees, 2**DEPTH)), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(DEPTH):
            begin, width = 2**level - 1, 2**level
            cell = ((node - begin)[:, None] * n_features * BINS + column + binned).ravel()
            gs, hs = (np.bincount(cell, weights=np.repeat(v, n_features), minlength=width * n_features * BINS).reshape(width, n_features, BINS).cumsum(axis=2) for v in (g, h))
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
            gain[(hs < 1) | (ht - hs < 1) | ~np.isfinite(cuts)[None]] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            feature, bin_ = best // BINS, best % BINS
            useful = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
            out.feature[t, begin : begin + width] = feature
            out.cut[t, begin : begin + width] = np.where(useful, cuts[feature, bin_], np.inf)
            f = feature[node - begin]
            node = 2 * node + 1 + (x[np.arange(len(y)), f] > out.cut[t, node])
        leaf = node - inner
        out.leaf[t] = -RATE * np.bincount(leaf, weights=g, minlength=2**DEPTH) / (np.bincount(leaf, weights=h, minlength=2**DEPTH) + 1)
        margin += out.leaf[t][leaf]
    return out


def fit_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, per_class: int = SAMPLE_PER_CLASS) -> Trees:
    """Learn from the statistics of a bounded sample of labelled documents outside the held-out fold.

    Without a labelled row the trees are empty and every text scores 0.5.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in ta.text_chunks(batch.column(1)):
                rows = statistics(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[at:to], batch.column(2)[at:to], lists], ["doc_id", "y", "x"])

    sample = labelled_sample(docs, labels, "quality", folds, fold, per_class).select("doc_id", "text", "y")
    table = sample.mapInArrow(scan, "doc_id long, y int, x array<double>").toArrow().sort_by("doc_id").combine_chunks()
    if not len(table):
        return Trees(np.zeros((0, 2**DEPTH - 1), dtype=np.int64), np.zeros((0, 2**DEPTH - 1)), np.zeros((0, 2**DEPTH)), 0.0)
    x = table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(STATISTICS))
    return fit(x, table.column("y").to_numpy().astype(np.float64))


def score_quality(docs: DataFrame, model: Trees) -> DataFrame:
    """One row a document: ``(doc_id, score, predicted)``; score is the probability of label 1.

    ``docs`` has ``doc_id`` and ``text``; other columns are left alone. Null, empty and wordless texts have
    statistics of 0 and are scored like any other. Repeated rows give repeated rows; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in ta.text_chunks(batch.column(1)):
                score = shared.value.score(statistics(data, offsets))
                yield pa.RecordBatch.from_arrays([batch.column(0)[at:to], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return id_and_text(docs).mapInArrow(scan, "doc_id long, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1) -> DataFrame:
    """Fit on the labelled rows outside the held-out fold and score every document, with ``held_out`` added."""
    return score_quality(docs, fit_quality(docs, labels, folds, fold)).withColumn("held_out", held_out(folds, fold))
