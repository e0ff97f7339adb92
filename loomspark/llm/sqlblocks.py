"""Building blocks for operators made of SQL functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once a row.

    The optimiser may copy a column's definition to all places that use it, into the body of a lambda too,
    where it would be computed for each element; a lambda's own variable can't be copied.
    """
    return F.get(F.transform(F.array(value), then), 0)


def runs(words: Column, k: int) -> Column:
    """64-bit hashes of the runs of k words, in order; empty for a shorter array."""

    def hashes(w: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.xxhash64(F.slice(w, i, k)))
        return F.when(F.size(w) >= k, every).otherwise(F.array().cast("array<bigint>"))

    return let(words, hashes)
