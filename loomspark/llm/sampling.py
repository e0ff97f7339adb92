"""Bounded samples of labelled documents for fitting, and the usual split into learning and held-out rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.tables import id_and_text


def held_out(folds: int, fold: int) -> Column:
    """Whether crc32 of doc_id as text leaves the remainder ``fold``; null ids are held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, per_class: int) -> DataFrame:
    """``(doc_id, text, y)`` of at most ``per_class`` labelled documents of each class outside the held-out fold.

    The choice is by a hash of doc_id, so it is the same in every run and needs no shuffle of texts: the
    chosen ids, at most twice ``per_class``, are broadcast. Labels other than 0 and 1 are ignored.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(~held_out(folds, fold))
    chosen = [known.where(F.col("y") == y).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    return id_and_text(docs).join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")


def within_budget(sample: DataFrame, size: Column, most: int) -> DataFrame:
    """The rows of a bounded sample, in the order of a hash of doc_id, whose sizes together stay within ``most``.

    A row that is larger by itself is left out and does not count.
    """
    fits = sample.withColumn("_size", size).where(F.col("_size") <= most)
    in_order = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row a sampled document
    return fits.withColumn("_upto", F.sum("_size").over(in_order)).where(F.col("_upto") <= most).drop("_size", "_upto")
