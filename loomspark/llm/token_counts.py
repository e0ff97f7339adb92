"""Word-piece counts by a linear longest-match automaton.

The vocabulary is a trie of byte strings. A failure link of a node says where matching goes on once the node
has no child for the next byte: the longest pieces that the node's string begins with are popped, and the
rest of the string is again a node. How many pieces that pops is counted beforehand, so a word's greedy
length is found in one pass over its bytes, without building a piece.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomspark.llm import textarrays as ta
from loomspark.llm.tables import id_and_text

#: The automaton is broadcast; a vocabulary that makes it larger is refused.
MOST_BYTES = 256 << 20
#: Different words whose counts a task remembers before it starts afresh.
REMEMBERED = 400_000
#: Words up to which the last ones of a batch are walked one by one, not in step with each other.
FEW = 64
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@dataclass
class Automaton:
    """Child of node v on byte b: ``child[i]`` where ``edge[i] == 256 * v + b``. The root is 0."""

    edge: np.ndarray
    child: np.ndarray
    fail: np.ndarray  # -1: no piece begins the node's string
    popped: np.ndarray  # pieces popped by taking the failure link
    rest: np.ndarray  # pieces of the node's whole string; -1 where it can't be cut up

    def nbytes(self) -> int:
        return sum(a.nbytes for a in (self.edge, self.child, self.fail, self.popped, self.rest))

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Children, or -1."""
        key = node * 256 + byte
        at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
        return np.where(self.edge[at] == key, self.child[at], -1)

    def walk(self, word: bytes, node: int, known: dict[int, int]) -> tuple[int, int]:
        """Pieces popped along one word from a node on, and where it ends, -1 if it can't be cut up.

        A step is a look into ``known``, the edges that were met, so very long words take no array operation a byte.
        """
        edge, child, fail, popped = (memoryview(a) for a in (self.edge, self.child, self.fail, self.popped))
        total, i, n = 0, 0, len(word)
        while i < n:
            key = node * 256 + word[i]
            to = known.get(key)
            if to is None:
                at = bisect_left(edge, key)
                to = child[at] if at < len(edge) and edge[at] == key else -1
                if len(known) >= REMEMBERED:
                    known.clear()
                known[key] = to
            if to >= 0:
                node, i = to, i + 1
            else:
                total += popped[node]
                node = fail[node]
                if node < 0:
                    return total, -1
        return total, node

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Greedy piece counts of words, each read with a space before it; a word that can't be cut up counts 1."""
        node = np.repeat(self.step(np.zeros(1, dtype=np.int64), np.array([32])), len(starts)) if len(self.edge) else np.full(len(starts), -1)
        total, at = np.zeros(len(starts), dtype=np.int64), starts.astype(np.int64)
        lost = node < 0
        live = np.flatnonzero(~lost & (at < ends))
        while len(live) > FEW:
            to = self.step(node[live], data[at[live]].astype(np.int64))
            ahead = to >= 0
            going, stuck = live[ahead], live[~ahead]
            node[going] = to[ahead]
            at[going] += 1
            total[stuck] += self.popped[node[stuck]]
            node[stuck] = self.fail[node[stuck]]
            lost[stuck[node[stuck] < 0]] = True
            live = live[~lost[live] & (at[live] < ends[live])]
        known: dict[int, int] = {}
        for i in live.tolist():
            more, node[i] = self.walk(data[at[i] : ends[i]].tobytes(), int(node[i]), known)
            total[i] += more
            lost[i] = node[i] < 0
        end = np.where(lost, -1, self.rest[np.maximum(node, 0)])
        return np.where(end < 0, 1, total + end)


def build(pieces: list[bytes]) -> Automaton:
    """Trie, failure links and counts of a vocabulary; one pass over the nodes by depth."""
    children: list[dict[int, int]] = [{}]
    whole = [False]
    for piece in pieces:
        v = 0
        for b in piece:
            if b not in children[v]:
                children[v][b] = len(children)
                children.append({})
                whole.append(False)
            v = children[v][b]
        whole[v] = v > 0
    n = len(children)
    fail, popped = [-1] * n, [0] * n
    layer = [0]
    while layer:
        below = []
        for u in layer:
            for b, v in children[u].items():
                below.append(v)
                if whole[v]:
                    fail[v], popped[v] = 0, 1
                    continue
                z, count = fail[u], popped[u]
                while z >= 0 and b not in children[z]:
                    count += popped[z]
                    z = fail[z]
                if z >= 0:
                    fail[v], popped[v] = children[z][b], count
        layer = below
    rest = [0] * n
    for v in range(1, n):
        z, count = v, 0
        while z > 0:
            count += popped[z]
            z = fail[z]
        rest[v] = count if z == 0 else -1
    edges = sorted((256 * u + b, v) for u, below in enumerate(children) for b, v in below.items())
    keys, ends = (np.array([e[i] for e in edges], dtype=np.int64) for i in (0, 1))
    return Automaton(keys, ends, np.array(fail, dtype=np.int64), np.array(popped, dtype=np.int64), np.array(rest, dtype=np.int64))


def read_vocabulary(path: str) -> list[bytes]:
    """Pieces of a rank file (a base64 piece and its rank a line), read where the job is started; tasks get the automaton."""
    with open(path, encoding="ascii") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


def token_counts(docs: DataFrame, automaton: Automaton) -> DataFrame:
    """One row a document: ``(doc_id, n_words, n_tokens, longest_word_tokens)``.

    ``docs`` has ``doc_id`` and ``text``; other columns are left alone. Words are runs without ASCII white
    space, each cut greedily into the longest pieces with a space before it; a word that the vocabulary can't
    spell counts as one unknown piece. Null and empty texts count 0. Repeated rows give repeated rows, rows
    without a doc_id are counted like any other; an empty table gives none, and with an empty vocabulary every
    word is unknown. An automaton of more than MOST_BYTES is refused.
    """
    if automaton.nbytes() > MOST_BYTES:
        raise ValueError(f"the automaton takes {automaton.nbytes()} bytes; at most {MOST_BYTES} are broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            for at, to, data, offsets in ta.text_chunks(batch.column(1)):
                words = ta.split_words(data, offsets)
                different, one, place = np.unique(words.hashes(), return_index=True, return_inverse=True)
                where = np.searchsorted(known, different)
                old = np.zeros(len(different), dtype=bool)
                inside = where < len(known)
                old[inside] = known[where[inside]] == different[inside]
                counts = np.zeros(len(different), dtype=np.int64)
                counts[old] = known_counts[where[old]]
                new = one[~old]
                counts[~old] = shared.value.counts(data, words.starts[new], words.ends[new])
                if len(known) > REMEMBERED:
                    known, known_counts = different, counts
                else:
                    both = np.concatenate((known, different[~old]))
                    order = np.argsort(both, kind="stable")
                    known, known_counts = both[order], np.concatenate((known_counts, counts[~old]))[order]
                each = counts[place]
                most = np.zeros(to - at, dtype=np.int64)
                np.maximum.at(most, words.doc(), each)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[at:to], pa.array(words.counts.astype(np.int64)), pa.array(ta.segment_sums(each, words.first)), pa.array(most)],
                    ["doc_id", "n_words", "n_tokens", "longest_word_tokens"],
                )

    return id_and_text(docs).mapInArrow(scan, "doc_id long, n_words long, n_tokens long, longest_word_tokens long")
