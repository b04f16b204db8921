"""How large a frame is, before it is sent to every task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BROADCAST_ROWS = 16384
MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def _bytes(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        size = F.octet_length(column)
    elif isinstance(kind, T.StructType):
        size = F.lit(0)
        for field in kind.fields:
            size = size + _bytes(column[field.name], field.dataType)
    elif isinstance(kind, T.ArrayType):
        inner = kind.elementType
        if isinstance(inner, T.StringType | T.StructType):
            size = F.aggregate(column, F.lit(0).cast("bigint"), lambda acc, x: acc + _bytes(x, inner))
        else:
            size = F.size(column) * 8
    else:
        size = F.lit(8)
    return F.coalesce(size, F.lit(0)).cast("bigint")


def _row_bytes(df: DataFrame) -> Column:
    """Bytes one row takes once sent to a task, from its column types."""
    total = F.lit(0).cast("bigint")
    for field in df.schema.fields:
        total = total + _bytes(F.col(f"`{field.name}`"), field.dataType)
    return total


def measured(df: DataFrame) -> tuple[int, int]:
    """Rows and bytes of a frame."""
    return tuple(df.agg(F.count(F.lit(1)), F.coalesce(F.sum(_row_bytes(df)), F.lit(0))).first())


def fits(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> int | None:
    """Row count of a frame small enough to be sent everywhere, else ``None``."""
    n, size = measured(df)
    return n if n <= max_rows and size <= max_bytes else None


def sent(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """The frame marked for broadcast where it fits, else as it is, for a shuffled join."""
    return F.broadcast(df) if fits(df, max_rows) is not None else df
