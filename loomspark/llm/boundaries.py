"""A compressed set of byte positions that answers "where is the k-th?".

Positions are split into a high part, one container each, and 16 low bits. A container is the smallest of three
forms: a sorted array, a bitmap of 64-bit words, or runs. The containers' cumulative cardinalities say which one
holds the k-th position; the rest is a look-up inside that container.
"""

from __future__ import annotations

import numpy as np

#: Positions that share their high part.
SPAN = 1 << 16
_WORDS = SPAN // 64


class _Array:
    def __init__(self, low: np.ndarray) -> None:
        self.low = low.astype(np.uint16)
        self.nbytes = self.low.nbytes

    def select(self, k: int) -> int:
        return int(self.low[k])

    def rank(self, low: int) -> int:
        return int(np.searchsorted(self.low, low))


class _Bitmap:
    def __init__(self, low: np.ndarray) -> None:
        bits = np.zeros(SPAN, dtype=bool)
        bits[low] = True
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.uint32)
        self.before = np.concatenate((np.zeros(1, dtype=np.uint32), np.cumsum(counts, dtype=np.uint32)))
        self.nbytes = self.words.nbytes + self.before.nbytes

    def _bits(self, word: int) -> np.ndarray:
        return np.unpackbits(self.words[word : word + 1].view(np.uint8), bitorder="little")

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, side="right")) - 1
        return 64 * word + int(np.flatnonzero(self._bits(word))[k - int(self.before[word])])

    def rank(self, low: int) -> int:
        word, bit = divmod(low, 64)
        return int(self.before[word]) + (int(self._bits(word)[:bit].sum()) if bit else 0)


class _Runs:
    def __init__(self, low: np.ndarray, heads: np.ndarray) -> None:
        self.starts = low[heads].astype(np.uint16)
        self.before = heads.astype(np.uint16)  # members in the runs before
        self.size = len(low)
        self.nbytes = self.starts.nbytes + self.before.nbytes

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.starts[run]) + k - int(self.before[run])

    def rank(self, low: int) -> int:
        run = int(np.searchsorted(self.starts, low, side="right")) - 1
        if run < 0:
            return 0
        past = int(self.before[run + 1]) if run + 1 < len(self.before) else self.size
        return min(int(self.before[run]) + low - int(self.starts[run]), past)


def _container(low: np.ndarray) -> _Array | _Bitmap | _Runs:
    heads = np.concatenate((np.zeros(1, dtype=np.int64), np.flatnonzero(np.diff(low) != 1) + 1))
    array, runs, bitmap = 2 * len(low), 4 * len(heads), 12 * _WORDS + 4
    if runs <= min(array, bitmap):
        return _Runs(low, heads)
    return _Array(low) if array <= bitmap else _Bitmap(low)


class BoundarySet:
    """Positions given by a mask over bytes."""

    def __init__(self, member: np.ndarray) -> None:
        keys, containers, sizes = [], [], []
        for at in range(0, len(member), SPAN):
            low = np.flatnonzero(member[at : at + SPAN])
            if len(low):
                keys.append(at)
                containers.append(_container(low))
                sizes.append(len(low))
        self.keys, self.containers = keys, containers
        self.before = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(np.array(sizes, dtype=np.int64))))

    def __len__(self) -> int:
        return int(self.before[-1])

    @property
    def nbytes(self) -> int:
        return 8 * len(self.keys) + self.before.nbytes + sum(c.nbytes for c in self.containers)

    def select(self, k: int) -> int:
        """The k-th position, from 0."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        return self.keys[at] + self.containers[at].select(k - int(self.before[at]))

    def rank(self, position: int) -> int:
        """How many positions are below ``position``."""
        at = int(np.searchsorted(self.keys, position, side="right")) - 1
        if at < 0:
            return 0
        low = position - self.keys[at]
        return int(self.before[at + 1]) if low >= SPAN else int(self.before[at]) + self.containers[at].rank(low)


def code_points(data: np.ndarray) -> BoundarySet:
    """Where the code points of UTF-8 bytes begin."""
    return BoundarySet((data & 0xC0) != 0x80)
