"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a score, a logistic function of its words' weights; a
document is toxic unless none of its sentences is (noisy-or). The weights are learned from document labels
alone, and the same scores then tell which sentences offend.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm import textarrays as ta
from loomspark.llm.sampling import held_out, labelled_sample, within_budget
from loomspark.llm.tables import id_and_text

#: Words are hashed into so many weights.
WEIGHTS = 1 << 18
#: Fitting takes at most so many documents of each class, and so many words of all of them together (4 bytes each).
SAMPLE_PER_CLASS, SAMPLE_WORDS = 2_500, 8_000_000
#: Standard errors between the shares of toxic and other texts from which a word is weighed.
SCREEN = 3.0

_BETWEEN = np.ones(256, dtype=bool)
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_STOP = np.zeros(256, dtype=np.int64)
_STOP[[ord(c) for c in ".!?\n"]] = 1


@dataclass
class Bags:
    """Words of texts as weight numbers; sentence s has words ``first[s] : first[s + 1]``, text i sentences ``bag[i] : bag[i + 1]``."""

    words: np.ndarray
    first: np.ndarray
    bag: np.ndarray


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def bags(data: np.ndarray, offsets: np.ndarray) -> Bags:
    """Sentences end at ``. ! ?`` or a line's end; only those with a word (letters, digits, non-ASCII) count."""
    words = ta.split_words(data, offsets, _BETWEEN)
    numbers = (words.hashes(ta.lower_ascii(data)) & np.uint64(WEIGHTS - 1)).astype(np.int64)
    sentence = np.cumsum(_STOP[data])[words.starts] if len(words.starts) else np.zeros(0, dtype=np.int64)
    doc = words.doc()
    change = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (sentence[1:] != sentence[:-1])))) if len(doc) else np.zeros(0, dtype=np.int64)
    return Bags(numbers, np.concatenate((change, [len(doc)])), np.searchsorted(doc[change], np.arange(len(offsets))))


def sentence_scores(b: Bags, model: Model) -> np.ndarray:
    z = ta.segment_sums(model.weights[b.words].astype(np.float64), b.first) + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def noisy_or(p: np.ndarray, bag: np.ndarray) -> np.ndarray:
    """1 - product of (1 - p) over each bag's sentences; 0 for an empty bag."""
    return -np.expm1(ta.segment_sums(np.log1p(-p), bag))


def fit(b: Bags, y: np.ndarray, rounds: int = 250, rate: float = 0.1, decay: float = 1e-3) -> Model:
    """Maximum likelihood of the bag labels under noisy-or, by Adam; classes weigh the same.

    Only words that stand in clearly more toxic than other texts get a weight: at least three texts, and a
    difference of the two shares of at least SCREEN standard errors.
    """
    lengths = np.diff(b.first)
    spread, toxic = np.zeros(WEIGHTS), np.zeros(WEIGHTS)
    for at in range(0, len(y), 500):  # documents at a time, to hold few words twice
        here = slice(b.first[b.bag[at]], b.first[b.bag[min(at + 500, len(y))]])
        owner = np.repeat(np.arange(at, min(at + 500, len(y))), np.diff(b.first[b.bag[at : at + 501]]))
        held = np.unique(b.words[here] * len(y) + owner)
        spread += np.bincount(held // len(y), minlength=WEIGHTS)
        toxic += np.bincount(held // len(y), weights=y[held % len(y)], minlength=WEIGHTS)
    n_toxic, n_other, rate_all = y.sum(), len(y) - y.sum(), spread / len(y)
    error = np.sqrt(np.maximum(rate_all * (1 - rate_all), 1e-12) * (1 / n_toxic + 1 / n_other))
    common = np.flatnonzero((spread >= 3) & (toxic / n_toxic - (spread - toxic) / n_other >= SCREEN * error))
    # words without a weight add nothing to a sentence, and sentences without another word are all alike
    number = np.full(WEIGHTS, -1, dtype=np.int64)
    number[common] = np.arange(len(common))
    words = number[b.words]
    lengths = ta.segment_sums((words >= 0).astype(np.int64), b.first)
    words, some = words[words >= 0], np.flatnonzero(lengths)
    bag = np.searchsorted(some, b.bag)
    lengths = lengths[some]
    first, sizes = np.concatenate(([0], np.cumsum(lengths))), np.diff(bag)
    bare = np.diff(b.bag) - sizes
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w, bias = np.zeros(len(common)), -4.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.clip(ta.segment_sums(w[words], first) + bias, -30, 30)
        p, p_bare = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-np.clip(bias, -30, 30)))
        p_bag = np.clip(-np.expm1(ta.segment_sums(np.log1p(-p), bag) + bare * np.log1p(-p_bare)), 1e-9, 1 - 1e-12)
        step = np.where(y == 1, 1 - 1 / p_bag, 1.0) * share
        by_sentence = p * np.repeat(step, sizes)
        g = np.bincount(words, weights=np.repeat(by_sentence, lengths), minlength=len(common)) + decay * w / max(1, len(common))
        gb = by_sentence.sum() + p_bare * (bare * step).sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(WEIGHTS, dtype=np.float32)
    weights[common] = w
    return Model(weights, float(bias))


def fit_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, per_class: int = SAMPLE_PER_CLASS, most_words: int = SAMPLE_WORDS) -> Model:
    """Learn from a bounded sample of labelled documents outside the held-out fold: ``per_class`` and ``most_words``.

    Without an example of either class the model has no weights, and every text scores about the share of
    toxic documents in the sample (0 without any).
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in ta.text_chunks(batch.column(1)):
                b = bags(data, offsets)
                counts = np.diff(b.first)
                rows = [(b.words[b.first[s] : b.first[e]].astype(np.int32), counts[s:e].astype(np.int32)) for s, e in zip(b.bag[:-1], b.bag[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[at:to], batch.column(2)[at:to], pa.array([w for w, _ in rows], pa.list_(pa.int32())), pa.array([n for _, n in rows], pa.list_(pa.int32()))],
                    ["doc_id", "y", "words", "lengths"],
                )

    sample = labelled_sample(docs, labels, "toxic", folds, fold, per_class).select("doc_id", "text", "y")
    read = sample.mapInArrow(scan, "doc_id long, y int, words array<int>, lengths array<int>")
    table = within_budget(read, F.size("words"), most_words).toArrow().sort_by("doc_id").combine_chunks()
    y = table.column("y").to_numpy()
    if not len(y) or y.min() == y.max():
        rate = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(WEIGHTS, dtype=np.float32), 30.0 if rate == 1 else -30.0)
    words, lengths = table.column("words").combine_chunks(), table.column("lengths").combine_chunks()
    sizes = lengths.value_lengths().to_numpy(zero_copy_only=False)
    first = np.concatenate(([0], np.cumsum(lengths.flatten().to_numpy().astype(np.int64))))
    return fit(Bags(words.flatten().to_numpy().astype(np.int64), first, np.concatenate(([0], np.cumsum(sizes)))), y)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """One row a document: ``(doc_id, score, predicted, n_sentences, offending)``.

    ``docs`` has ``doc_id`` and ``text``; other columns are left alone. ``score`` is the noisy-or of the
    sentence scores, ``predicted`` 1 from 0.5 on, and ``offending`` lists the sentences whose own score is
    0.5 or more as (sentence, score), sentences numbered from 0 in the whole text. Null, empty and wordless
    texts have no sentence and score 0. Repeated rows give repeated rows, rows without a doc_id are scored like
    any other, and an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in ta.text_chunks(batch.column(1)):
                b = bags(data, offsets)
                p = sentence_scores(b, shared.value)
                score = np.clip(noisy_or(p, b.bag), 0, 1)
                bad = np.flatnonzero(p >= 0.5)
                inside = np.searchsorted(b.bag, bad, side="right") - 1
                cuts = np.searchsorted(inside, np.arange(to - at + 1)).astype(np.int32)
                spans = pa.StructArray.from_arrays([pa.array((bad - b.bag[inside]).astype(np.int32)), pa.array(p[bad])], ["sentence", "score"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[at:to], pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(np.diff(b.bag)), pa.ListArray.from_arrays(pa.array(cuts), spans)],
                    ["doc_id", "score", "predicted", "n_sentences", "offending"],
                )

    return id_and_text(docs).mapInArrow(scan, "doc_id long, score double, predicted int, n_sentences long, offending array<struct<sentence: int, score: double>>")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0) -> DataFrame:
    """Fit on the labelled rows outside the held-out fold and score every document, with ``held_out`` added."""
    return score_toxicity(docs, fit_toxicity(docs, labels, folds, fold)).withColumn("held_out", held_out(folds, fold))
