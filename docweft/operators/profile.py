"""The input and output schema of a frame, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def schema_profile(df: DataFrame) -> DataFrame:
    """``(column, type, nullable, n_rows, n_nulls)`` from one aggregation."""
    counts = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(f.name).alias(f"c{i}") for i, f in enumerate(df.schema)])
    fields = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.lit(f.nullable).alias("nullable"),
                F.col("n_rows").alias("n_rows"),
                (F.col("n_rows") - F.col(f"c{i}")).alias("n_nulls"),
            )
            for i, f in enumerate(df.schema)
        ]
    )
    return counts.select(F.inline(fields))
