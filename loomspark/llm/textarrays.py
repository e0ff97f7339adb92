"""Words of many texts as numpy arrays, taken from the buffers of an Arrow string column.

The helpers look at UTF-8 bytes. A word is a maximal run of bytes that are not ASCII white space
(``[^\\x20\\x09-\\x0D]+``); bytes of multi-byte characters are never white space, so byte runs and
character runs are the same words. A chunk holds whole texts, never a part of one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at a time inside a task; a longer text is a chunk of its own.
CHUNK_BYTES = 2_000_000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

ODD = np.uint64(0x9E3779B97F4A7C15)
#: ODD times this is 1 modulo 2**64.
_ODD_INVERSE = np.uint64(pow(int(ODD), -1, 1 << 64))
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of the 64-bit integers that spreads every input bit (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX_A
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX_B
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of the texts of one chunk. ``first[i] : first[i + 1]`` are those of text i."""

    data: np.ndarray  # bytes of all texts, one after the other
    offsets: np.ndarray  # where each text begins in data, and the end
    starts: np.ndarray  # of words, in data
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def within(self) -> np.ndarray:
        """Each word's place in its text, from 0."""
        return np.arange(len(self.starts)) - np.repeat(self.first[:-1], self.counts)

    def hashes(self, values: np.ndarray | None = None) -> np.ndarray:
        """64-bit hashes of the words; ``values`` replaces the bytes, such as lower-cased ones."""
        v = self.data if values is None else values
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        lengths = self.ends - self.starts
        width = int(lengths.max())
        powers = np.cumprod(np.full(width, ODD, dtype=np.uint64))
        inside = np.repeat(self.starts, lengths) + ramp(lengths)
        terms = (v[inside].astype(np.uint64) + np.uint64(1)) * powers[ramp(lengths)]
        sums = np.add.reduceat(terms, np.concatenate(([0], np.cumsum(lengths)[:-1])))
        return mix64(sums ^ (lengths.astype(np.uint64) << np.uint64(48)))


def ramp(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each length, one run after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def split_words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> Words:
    """The words between the bytes that ``space`` marks; no word crosses from one text into the next."""
    ink = ~space[data]
    begins, closes = ink.copy(), ink.copy()
    if len(data):
        begins[1:] &= ~ink[:-1]
        closes[:-1] &= ~ink[1:]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        begins[inner] = ink[inner]
        closes[inner - 1] = ink[inner - 1]
    starts = np.flatnonzero(begins)
    return Words(data, offsets, starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a whole string column; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, places, content = column.buffers()
    offsets = np.frombuffer(places, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(content, dtype=np.uint8) if content is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, offsets) for runs of whole texts of about CHUNK_BYTES; null counts as empty."""
    data, offsets = text_bytes(column)
    n = len(offsets) - 1
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


class RunHashes:
    """Hashes of runs of consecutive words, any length, by differences of prefix sums modulo 2**64."""

    def __init__(self, word_hashes: np.ndarray) -> None:
        n = len(word_hashes) + 1
        powers = np.cumprod(np.full(n, ODD, dtype=np.uint64))
        self._back = np.cumprod(np.full(n, _ODD_INVERSE, dtype=np.uint64))
        self._prefix = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(word_hashes * powers[:-1])))

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        length = np.asarray(stop - start).astype(np.uint64)
        return mix64((self._prefix[stop] - self._prefix[start]) * self._back[start] + length)


def window_starts(words: Words, k: int) -> np.ndarray:
    """The first word of each run of k consecutive words inside one text."""
    left = np.repeat(words.first[1:], words.counts) - np.arange(len(words.starts))
    return np.flatnonzero(left >= k)


def windows(word_hashes: np.ndarray, words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of each run of k consecutive words inside one text."""
    at = window_starts(words, k)
    return at, RunHashes(word_hashes)(at, at + k)


def segment_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[i] : first[i + 1]] for each i; 0 for an empty run."""
    total = np.concatenate((np.zeros(1, dtype=values.dtype), np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]


def as_signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.astype(np.uint64).view(np.int64)
