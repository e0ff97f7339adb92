"""The two columns that most operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def id_and_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` as long and ``text`` as string, cast only where they aren't; all other columns go.

    Without needless casts, plans that read the two columns are equal, and Spark can reuse their shuffles.
    """
    kinds = dict(docs.dtypes)
    doc_id = F.col("doc_id") if kinds["doc_id"] == "bigint" else F.col("doc_id").cast("long").alias("doc_id")
    text = F.col("text") if kinds["text"] == "string" else F.col("text").cast("string").alias("text")
    return docs.select(doc_id, text)
