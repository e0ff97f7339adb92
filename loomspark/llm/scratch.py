"""Durable intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders written in the scopes that are open, the innermost last.
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where the setting is absent and Spark runs on this machine alone, as in tests, is a temporary folder
    taken; on a cluster a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    fallback = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed with the innermost scope."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder from whatever store holds it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written inside are deleted at the end, when their last reader must have run.

    Operators return frames that still read their intermediate tables, so the caller sets the scope: around
    the operator and the action that consumes it.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks it was running, never the table,
    and a table that several branches read is computed once.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
