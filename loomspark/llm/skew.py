"""Joins in which one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks that the rows of a hot key are spread over, and rows from which a key counts as hot.
SALTS, HOT = 64, 1_000


def join_hot(rows: DataFrame, facts: DataFrame, key: str, by: str, salts: int = SALTS) -> DataFrame:
    """``rows`` left-joined with ``facts``, which has a row for each of the few hot values of ``key``.

    A row's salt comes from ``by``; each fact stands once under every salt. So the rows of one key are dealt
    over ``salts`` tasks, and keys without a fact get nulls. ``facts`` must hold hot keys only: it is copied
    ``salts`` times, which stays below the number of rows while a hot key has at least ``salts`` of them.
    """
    salt = F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")
    copies = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", salt).join(copies, [key, "_salt"], "left").drop("_salt")


#: A key is spread over tasks if it has at least one in so many rows, so there are at most as many such keys.
SHARE = 10_000


def spread_keys(counted: DataFrame, key: list[str], n: str, least: int = HOT) -> DataFrame:
    """The keys of ``counted``, a row a key, that hold at least 1 / SHARE of all ``n`` rows and ``least`` of them.

    There are at most SHARE, whatever the size of the data, so the result may be broadcast.
    """
    total = counted.agg(F.sum(n)).first()[0] or 0
    return counted.where(F.col(n) >= max(least, total // SHARE)).select(*key, F.lit(True).alias("_hot"))


def join_spread(rows: DataFrame, facts: DataFrame, key: list[str], by: str, hot: DataFrame, salts: int = SALTS) -> DataFrame:
    """Inner join with ``facts``, a row a key, in which the rows of a hot key are dealt over ``salts`` tasks.

    ``hot`` comes from ``spread_keys``. Only the facts of hot keys are copied, and both sides move once.
    """
    hot = F.broadcast(hot)
    way = F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).otherwise(0)
    ways = F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    left = rows.join(hot, key, "left").withColumn("_way", way).drop("_hot")
    right = facts.join(hot, key, "left").withColumn("_way", ways).drop("_hot")
    return left.join(right, [*key, "_way"]).drop("_way")
