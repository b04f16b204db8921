"""Run parameters, metrics and text outputs as a long table."""

from __future__ import annotations

from collections.abc import Sequence
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.operators.sizes import sent


def long_form(wide: DataFrame, run: str, values: Sequence[str]) -> DataFrame:
    """``(run_id, key, value)`` from one column per key; numbers keep six decimals."""
    kinds = dict(wide.dtypes)
    as_text = [
        (F.round(F.col(v), 6).cast("decimal(38,6)") if kinds[v] == "double" else F.col(v)).cast("string").alias(v)
        for v in values
    ]
    return wide.select(F.col(run).cast("string").alias("run_id"), *as_text).unpivot(
        ["run_id"], list(values), "key", "value"
    )


_ROWS = "run_id STRING, key STRING, value STRING"


def write_attempt(rows: DataFrame, path: str) -> str:
    """Write rows ``(run_id, key, value)`` as a new attempt, which nobody reads before it is committed; returns its name."""
    attempt = uuid4().hex
    rows.select("run_id", "key", "value").write.parquet(f"{path}/attempts/attempt={attempt}")
    return attempt


def commit_attempt(spark: SparkSession, path: str, attempt: str) -> None:
    """Make an attempt the one that counts for each of its runs, by one row per run."""
    number = _commits(spark, path).agg((F.coalesce(F.max("number"), F.lit(0)) + 1).cast("bigint").alias("number")).scalar()
    runs = spark.read.schema(_ROWS).parquet(f"{path}/attempts/attempt={attempt}").select("run_id").distinct()
    runs.select("run_id", number.alias("number"), F.lit(attempt).alias("attempt")).write.parquet(f"{path}/commits/of={attempt}")


def append_log(rows: DataFrame, path: str) -> None:
    """Write and commit. A write that is repeated replaces its runs; one that fails midway leaves what was there."""
    commit_attempt(rows.sparkSession, path, write_attempt(rows, path))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """``(run_id, key, value)`` of each run's newest committed attempt."""
    newest = _commits(spark, path).groupBy("run_id").agg(F.max(F.struct("number", "attempt"))["attempt"].alias("attempt"))
    counts = sent(newest.select(F.col("run_id").alias("_run"), F.col("attempt").alias("_attempt")))
    rows = _read(spark, f"{path}/attempts", f"{_ROWS}, attempt STRING")
    return rows.join(counts, F.col("run_id").eqNullSafe(F.col("_run")) & (F.col("attempt") == F.col("_attempt"))).select("run_id", "key", "value")


def _commits(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, f"{path}/commits", "run_id STRING, number BIGINT, attempt STRING")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path).select([c.split()[0] for c in schema.split(", ")])
    except AnalysisException as e:
        # Nothing was written there yet.
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
