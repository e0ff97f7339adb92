"""Quality rules over lines: a linear-chain conditional random field marks content and boilerplate.

Each line has a few measures; the field weighs them and the step from one line to the next, and Viterbi
decoding finds the best marking of a whole document. The share of words in content lines decides whether the
document stays, after some plain rules about its size and repeats.

Documents are labelled as a whole, lines are not. Which lines of a labelled document are boilerplate is a
hidden variable: the field's own expectation of it, moved as little as is needed for most of the words of a
bad document, and few of a good one's, to lie in boilerplate lines. The field is fitted to that expectation,
and both are repeated.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm import textarrays as ta
from loomspark.llm.sampling import labelled_sample, within_budget
from loomspark.llm.tables import id_and_text

#: Fitting takes at most so many documents of each class, and so many lines of all of them together (80 bytes each).
SAMPLE_PER_CLASS, SAMPLE_LINES = 600, 60_000
#: Lines of a chain in fitting; longer documents are several chains under one label.
CHAIN = 24
#: Share of a bad document's words that is expected in boilerplate lines, at least; of a good one's, one less this at most.
HIDDEN_SHARE = 0.6
#: A document stays with at least this share of its words in content lines.
CONTENT_SHARE = 0.5
#: The plain rules: fewest words, and most of the words, in percent, inside repeated windows of RUN words.
LEAST_WORDS, MOST_REPEATED, RUN = 20, 30, 8

MEASURES = ["one", "marks_a_word", "pipes_a_word", "shouts_a_word", "upper_share", "digit_share", "log_words", "mean_word", "full_stop", "repeated"]


def _only(text: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in text]] = True
    return out


_NEWLINE, _SYMBOL = _only("\n"), _only("#*$%&|<>")
_MARKS, _PIPES, _SHOUTS, _STOPS = _only("#*$%&<>"), _only("|"), _only("!"), _only(".?!:;\"'")
_UPPER, _DIGIT = _only("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _only("0123456789")


@dataclass
class Lines:
    """Lines with a word; text i has lines ``first[i] : first[i + 1]``."""

    words: np.ndarray
    repeated: np.ndarray
    measures: np.ndarray
    first: np.ndarray


def lines_of(data: np.ndarray, offsets: np.ndarray, words: ta.Words) -> Lines:
    runs = ta.split_words(data, offsets, _NEWLINE)
    edges = np.searchsorted(words.starts, np.concatenate((runs.starts, [len(data)])))
    n_words = np.diff(edges)
    inked = n_words > 0
    doc, hashes = runs.doc()[inked], runs.hashes()[inked]
    starts, ends, n_words, at = runs.starts[inked], runs.ends[inked], n_words[inked], edges[:-1][inked]
    order = np.lexsort((np.arange(len(doc)), hashes, doc))
    same = np.zeros(len(doc), dtype=bool)
    same[order[1:]] = (doc[order[1:]] == doc[order[:-1]]) & (hashes[order[1:]] == hashes[order[:-1]])
    size = np.maximum(ends - starts, 1)

    def share(kind: np.ndarray, of: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(kind[data])))
        return (total[ends] - total[starts]) / of

    last = words.ends[at + n_words - 1] - 1 if len(at) else np.zeros(0, dtype=np.int64)
    measures = np.stack(
        [np.ones(len(doc)), share(_MARKS, n_words), share(_PIPES, n_words), share(_SHOUTS, n_words), share(_UPPER, size), share(_DIGIT, size), np.log1p(n_words) / 3, size / n_words / 8, _STOPS[data[last]].astype(float), same.astype(float)],
        axis=1,
    )
    return Lines(n_words, same, np.minimum(measures, 4), np.searchsorted(doc, np.arange(len(offsets))))


@dataclass
class Field:
    """Weights of the measures for boilerplate (content has none), and of steps [from, to]; 0 is content."""

    weights: np.ndarray
    steps: np.ndarray


def viterbi(scores: np.ndarray, first: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The best marking (1: boilerplate) of the lines of every text at once, one step of all texts at a time."""
    lengths = np.diff(first)
    out = np.zeros(len(scores), dtype=np.int64)
    if not len(scores):
        return out
    order = np.argsort(-lengths, kind="stable")
    begin, lengths = first[:-1][order], lengths[order]
    active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
    back = [np.zeros((0, 2), dtype=np.int64)]
    best = np.stack([np.zeros(active[0]), scores[begin[: active[0]]]], axis=1)
    final = best.copy()
    for t in range(1, int(lengths[0])):
        n = active[t]
        ways = best[:n, :, None] + steps[None]
        back.append(ways.argmax(axis=1))
        best = ways.max(axis=1)
        best[:, 1] += scores[begin[:n] + t]
        final[:n] = best
    state = final.argmax(axis=1)
    for t in range(int(lengths[0]) - 1, -1, -1):
        n = active[t]
        out[begin[:n] + t] = state[:n]
        if t:
            state[:n] = back[t][np.arange(n), state[:n]]
    return out


class Chains:
    """Lines of texts as chains of at most CHAIN lines, the longest first; ``at[t]`` are the t-th lines of the first chains."""

    def __init__(self, first: np.ndarray) -> None:
        lengths = np.diff(first)
        pieces = -(-lengths // CHAIN)
        begin = np.repeat(first[:-1], pieces) + ta.ramp(pieces) * CHAIN
        size = np.minimum(np.repeat(first[1:], pieces) - begin, CHAIN)
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        self.at = [begin[: int(np.searchsorted(-size, -t, side="left"))] + t for t in range(int(size[0]))]
        self.n_lines = int(first[-1])

    def marginals(self, scores: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each line's chance to be boilerplate, and of each pair of states for every step, by forward-backward."""
        odds, move = np.exp(np.clip(scores, -25, 25)), np.exp(np.clip(steps, -25, 25))
        emit = [np.stack([np.ones(len(a)), odds[a]], axis=1) for a in self.at]
        ahead = [emit[0] / emit[0].sum(axis=1, keepdims=True)]
        for e in emit[1:]:
            x = (ahead[-1][: len(e)] @ move) * e
            ahead.append(x / x.sum(axis=1, keepdims=True))
        chance, pairs = np.zeros(self.n_lines), []
        behind = np.ones((0, 2))
        for t in range(len(self.at) - 1, -1, -1):
            n = len(behind)
            back = np.ones_like(ahead[t])
            if n:
                onward = behind * emit[t + 1]
                joint = ahead[t][:n, :, None] * move[None] * onward[:, None, :]
                pairs.append(joint / joint.sum(axis=(1, 2), keepdims=True))
                back[:n] = onward @ move.T
                back[:n] /= back[:n].sum(axis=1, keepdims=True)
            both = ahead[t] * back
            chance[self.at[t]] = both[:, 1] / both.sum(axis=1)
            behind = back
        return chance, pairs[::-1]


def fit(measures: np.ndarray, words: np.ndarray, first: np.ndarray, bad: np.ndarray, rounds: int = 6, moves: int = 20, rate: float = 0.15) -> Field:
    """Expectation under the documents' labels and maximum likelihood of the field, in turn.

    ``bad`` marks documents; line i has ``words[i]`` words. The start takes every line's label for its
    document's and no steps, so that lines found in both kinds of documents are told from those in one.
    """
    chains, doc = Chains(first), np.repeat(np.arange(len(bad)), np.diff(first))
    line_bad = bad[doc].astype(float)
    share = np.where(line_bad > 0, 0.5 / max(1.0, line_bad.sum()), 0.5 / max(1.0, (1 - line_bad).sum()))
    all_words = np.bincount(doc, weights=words, minlength=len(bad))
    theta = np.zeros(measures.shape[1] + 4)
    m, v, r = np.zeros_like(theta), np.zeros_like(theta), 0

    def climb(target: np.ndarray, seen: np.ndarray, moves: int) -> None:
        nonlocal theta, m, v, r
        for _ in range(moves):
            chance, pairs = chains.marginals(measures @ theta[:-4], theta[-4:].reshape(2, 2))
            expected = sum((p * share[a][:, None, None]).sum(axis=0) for p, a in zip(pairs, chains.at[1:], strict=True)) if pairs else np.zeros((2, 2))
            g = np.concatenate((((chance - target) * share) @ measures, ((expected - seen).ravel() if seen is not None else np.zeros(4)))) + 1e-3 * theta
            r += 1
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta - rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)

    climb(line_bad, None, 3 * moves)
    for _ in range(rounds):
        # each document's least shift of all its lines that meets its label, by bisection
        low, high = np.where(bad, 0.0, -25.0), np.where(bad, 25.0, 0.0)
        scores, steps = measures @ theta[:-4], theta[-4:].reshape(2, 2)
        for _ in range(10):
            shift = (low + high) / 2
            chance, _ = chains.marginals(scores + shift[doc], steps)
            more = np.bincount(doc, weights=words * chance, minlength=len(bad)) < np.where(bad, HIDDEN_SHARE, 1 - HIDDEN_SHARE) * all_words
            low, high = np.where(more, shift, low), np.where(more, high, shift)
        target, pairs = chains.marginals(scores + np.where(bad, high, low)[doc], steps)
        seen = sum((p * share[a][:, None, None]).sum(axis=0) for p, a in zip(pairs, chains.at[1:], strict=True)) if pairs else np.zeros((2, 2))
        climb(target, seen, moves)
    return Field(theta[:-4], theta[-4:].reshape(2, 2))


def fit_lines(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, most_lines: int = SAMPLE_LINES) -> Field:
    """Learn from a bounded sample, ``per_class`` and ``most_lines``, of documents labelled by quality.

    Where either class has no example the field is empty and every line is content.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in ta.text_chunks(batch.column(1)):
                found = lines_of(data, offsets, ta.split_words(data, offsets))
                keep = np.flatnonzero(np.diff(found.first) > 0)
                cuts = [slice(found.first[i], found.first[i + 1]) for i in keep]
                x = pa.array([found.measures[c].ravel() for c in cuts], pa.list_(pa.float64()))
                words = pa.array([found.words[c].astype(np.int32) for c in cuts], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[at:to].take(keep), batch.column(2)[at:to].take(keep), x, words], ["doc_id", "y", "x", "words"])

    sample = labelled_sample(docs, labels, "quality", 1, 1, per_class).select("doc_id", "text", "y")
    read = sample.mapInArrow(scan, "doc_id long, y int, x array<double>, words array<int>")
    table = within_budget(read, F.size("words"), most_lines).toArrow().sort_by("doc_id").combine_chunks()
    good = table.column("y").to_numpy()
    if not len(good) or good.min() == good.max():
        return Field(np.array([-1.0] + [0.0] * (len(MEASURES) - 1)), np.zeros((2, 2)))
    x, words = table.column("x").combine_chunks(), table.column("words").combine_chunks()
    first = np.concatenate(([0], np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
    return fit(x.flatten().to_numpy().reshape(-1, len(MEASURES)), words.flatten().to_numpy().astype(float), first, good == 0)


def line_quality(docs: DataFrame, field: Field) -> DataFrame:
    """One row a document: word counts, the plain rules' measures, the field's verdict.

    Returns ``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_content_lines,
    content_share, base_failed, kept)``. ``docs`` has ``doc_id`` and ``text``; other columns are left alone.
    Words are runs without ASCII white space, lines are split at ``\\n`` and count with a word in them.
    ``base_failed``: fewer than LEAST_WORDS words, or more than MOST_REPEATED percent of the words inside
    windows of RUN words that the text holds more than once. ``kept``: not failed, and at least CONTENT_SHARE
    of the words in content lines. Null and empty texts have counts of 0, a share of 0, and fail. Repeated
    rows give repeated rows, rows without a doc_id are judged like any other, and an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in ta.text_chunks(batch.column(1)):
                words = ta.split_words(data, offsets)
                n, doc = words.counts, words.doc()
                heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                begins, runs = ta.windows(words.hashes(), words, RUN)
                order = np.lexsort((runs, doc[begins]))
                d, h = doc[begins][order], runs[order]
                equal = (d[1:] == d[:-1]) & (h[1:] == h[:-1])
                again = begins[order[np.concatenate((equal, [False])) | np.concatenate(([False], equal))]] if len(d) else begins
                change = np.bincount(again, minlength=len(doc) + 1) - np.bincount(again + RUN, minlength=len(doc) + 1)
                repeats = ta.segment_sums((np.cumsum(change)[: len(doc)] > 0).astype(np.int64), words.first)
                lines = lines_of(data, offsets, words)
                content = viterbi(lines.measures @ shared.value.weights, lines.first, shared.value.steps) == 0
                share = ta.segment_sums(lines.words * content, lines.first) / np.maximum(n, 1)
                failed = (n < LEAST_WORDS) | (100 * repeats > MOST_REPEATED * n)
                columns = [
                    n,
                    ta.segment_sums(heads[words.ends] - heads[words.starts], words.first),
                    ta.segment_sums(_SYMBOL[data].astype(np.int64), offsets),
                    ta.segment_sums(lines.repeated.astype(np.int64), lines.first),
                    repeats,
                    np.diff(lines.first),
                    ta.segment_sums(content.astype(np.int64), lines.first),
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[at:to], *(pa.array(np.asarray(c, dtype=np.int64)) for c in columns), pa.array(share), pa.array(failed), pa.array(~failed & (share >= CONTENT_SHARE))],
                    ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_content_lines", "content_share", "base_failed", "kept"],
                )

    return id_and_text(docs).mapInArrow(scan, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_content_lines long, content_share double, base_failed boolean, kept boolean")
