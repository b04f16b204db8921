"""Text metrics of an evaluation set, per run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sentences(text: Column) -> Column:
    """Number of sentence ends."""
    return F.regexp_count(text, F.lit("[.!?]+")).cast("bigint")


def percentiles(df: DataFrame, run: str, value: str, points: dict[str, float]) -> DataFrame:
    """Exact interpolated percentiles per run.

    Rows are first counted per (run, value), so a run of any size reaches its
    task as one row per distinct value.
    """
    counted = df.groupBy(run, value).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(run).agg(
        *[F.round(F.percentile(F.col(value), F.lit(p), F.col("_n")), 6).alias(name) for name, p in points.items()]
    )


def mean(column: str) -> Column:
    """Mean of an integer column from its exact sum, rounded."""
    return F.round(F.sum(column) / F.count(column), 6)


def compared(means: DataFrame, group: str, run: str, value: str, runs: list[str]) -> DataFrame:
    """Runs side by side per group, and how far each lies from the first."""
    wide = means.groupBy(group).pivot(run, runs).agg(F.first(value))
    return wide.withColumns({f"{r}_minus_{runs[0]}": F.round(F.col(r) - F.col(runs[0]), 6) for r in runs[1:]})
