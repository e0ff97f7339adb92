"""Joins with tables that are small as a rule, and large ones without harm."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType

#: Rows up to which a table is brought to the driver and broadcast; fewer if rows hold arrays, maps or bytes.
SMALL_ROWS, SMALL_WIDE_ROWS = 200_000, 20_000
#: Bytes up to which it is broadcast.
SMALL_BYTES = 64 << 20


def if_small(table: DataFrame, most: int = SMALL_ROWS, most_bytes: int = SMALL_BYTES) -> DataFrame:
    """``table`` to be broadcast if it has few rows and bytes, else as it is, to be joined by shuffle.

    The rows are computed once: up to ``most`` of them become a local table.
    """
    if any(isinstance(c.dataType, ArrayType | BinaryType | MapType) for c in table.schema.fields):
        most = min(most, SMALL_WIDE_ROWS)
    rows = table.limit(most + 1).toArrow()
    if len(rows) > most or rows.nbytes > most_bytes:
        return table
    return F.broadcast(table.sparkSession.createDataFrame(rows, schema=table.schema))
