"""Namespaces and tables that may already exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def ensure_namespace(spark: SparkSession, name: str, location: str) -> None:
    """Create a namespace once; later calls change nothing."""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{name}` LOCATION '{location}'")


def ensure_table(spark: SparkSession, namespace: str, name: str, rows: DataFrame) -> DataFrame:
    """The table, filled from ``rows`` when it is not there yet."""
    full = f"`{namespace}`.`{name}`"
    if not spark.catalog.tableExists(f"{namespace}.{name}"):
        rows.write.format("parquet").saveAsTable(full)
    return spark.table(full)
