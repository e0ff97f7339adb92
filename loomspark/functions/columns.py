"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def between(value: Column, low: Column, high: Column) -> Column:
    """``value`` on the way from low to high, in [0, 1]; 0 where they are the same."""
    return F.when(high > low, (value - low) / F.when(high > low, high - low)).otherwise(0.0)


def min_max(value: Column, by: WindowSpec) -> Column:
    """To [0, 1] within a partition; a constant one becomes 0. For partitions of a few rows, such as region pairs."""
    return between(value, F.min(value).over(by), F.max(value).over(by))


def ratio_or_inf(top: Column, bottom: Column) -> Column:
    """x/0 is infinite, which passes any lower bound; 0/0 is null, which passes none."""
    return F.when(bottom > 0, top / F.when(bottom > 0, bottom)).when(top > 0, F.lit(float("inf")))


def two_sided_p(z: Column) -> Column:
    """Two-sided p-value of a standard normal z by a five-term rational approximation (error under 1.5e-7)."""
    x = F.abs(z) / (2**0.5)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), poly * F.exp(-x * x)))


def hashed_uniform(*parts: Column | str) -> Column:
    """A number in (0, 1) fixed by a hash of the parts."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) + 0.5) / float(1 << 40)
