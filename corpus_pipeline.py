"""From raw documents to a training mixture in five stages, each read from what the one before wrote.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of
``docs``. Extra columns pass through, whatever their names. Each stage is judged on its own input: what was
dropped before no longer counts.

Rows without a doc_id are judged like all others. They come after all documents with one, in the order of a
hash of their text.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.llm.decontamination import find_leaks
from loomspark.llm.mixing import mixture_texts
from loomspark.llm.near_duplicates import near_duplicates
from loomspark.llm.repeated_passages import remove_repeated_passages
from loomspark.llm.scratch import durable, new_folder, scope
from loomspark.llm.toxicity import fit_toxicity, score_toxicity


def _text() -> Column:
    return F.col("text").cast("string")


def _rank() -> Column:
    """doc_id, or a number above all of them where there is none: the order in which documents come."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.pmod(F.xxhash64(_text()), F.lit(1 << 61)))


def _row() -> Column:
    """A number for the id and text of a row, so that rows that share a doc_id are judged each by its text."""
    return F.xxhash64(F.col("doc_id").cast("long"), _text())


def _keyed(docs: DataFrame, key: Column) -> DataFrame:
    """The two columns that the operators read, with ``key`` for doc_id."""
    return docs.select(key.alias("doc_id"), _text().alias("text"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier calls toxic. A null or empty text scores 0 and stays."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    pa.default_memory_pool().release_unused()  # what the fit's sample took, before the other stages
    toxic = score_toxicity(_keyed(docs, _row()), model).where("predicted = 1").select(F.col("doc_id").alias("__key")).distinct()
    return docs.withColumn("__key", _row()).join(toxic, "__key", "left_anti").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least doc_id of each group of near-duplicates.

    Five-word shingles, similarity of 0.8 or more. Rows of one doc_id but with other texts are judged each by its
    text; of those in one group the one with the least hash of id and text is kept. Of rows equal in id and text the
    one with the least hash of all its columns is kept. Empty texts are in no group and stay.
    """
    ranks = durable(docs.groupBy(_row().alias("__key")).agg(F.min(_rank()).alias("__rank")), "ranks")
    grouped = near_duplicates(_keyed(docs, _row()), k=5, percent=80).select(F.col("doc_id").alias("__key"), "component_id").join(ranks, "__key")
    kept = durable(grouped.groupBy("component_id").agg(F.min(F.struct("__rank", "__key"))["__key"].alias("__key")).select("__key"), "kept")
    known = docs.withColumn("__key", _row()).join(kept, "__key", "left_semi")
    equal = Window.partitionBy("__key").orderBy(F.xxhash64(*docs.columns))
    return known.withColumn("__copy", F.row_number().over(equal)).where("__copy = 1").select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 words that an earlier document holds; a document with nothing left goes.

    ``n_chars`` follows the text where it was cut. Texts that lost nothing stay as they are, empty ones too.
    """
    cut = remove_repeated_passages(_keyed(docs, _rank()), length=50).where("n_removed > 0")
    left = F.max(F.col("n_words") - F.col("n_removed")).alias("__left")
    cut = cut.groupBy(F.col("doc_id").alias("__key"), F.col("text_hash").alias("__th")).agg(F.min("kept_text").alias("__kept"), left)
    whole = docs.withColumn("__key", _rank()).withColumn("__th", F.xxhash64(_text())).join(cut, ["__key", "__th"], "left").where("__left is null or __left > 0")
    out = whole.withColumn("text", F.when(F.col("__left").isNull(), F.col("text")).otherwise(F.col("__kept")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__left").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, also one with other numbers or names."""
    leaked = find_leaks(_keyed(docs, _row()), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("__key")).distinct()
    return docs.withColumn("__key", _row()).join(leaked, "__key", "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: each document that is taken from, with the drawn words alone and as often as they are drawn.

    ``pieces`` has the epoch, shard and position of each drawn block, in the order of the text.
    """
    return mixture_texts(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeats),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: A learned classifier decides in the first stage, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again.

    What a stage wrote on the way goes when it is done, and its result when the next stage is.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scope(spark):
        for name, stage in STAGES[:-1]:
            path = new_folder(spark, f"pipeline-{name}")
            with scope(spark):
                stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
        name, stage = STAGES[-1]
        with scope(spark):
            mixture = stage(spark, docs, sf_dir)
            path = f"{new_folder(spark, 'pipeline')}-{name}"  # outlives the scopes
            mixture.write.parquet(path)
    return spark.read.parquet(path)
