"""Starting a stream over files and draining it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docweft.session import fresh_path


def file_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.getFileStatus(where).isFile():
        # A file stream watches a folder.
        return reader.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())
    return reader.parquet(path)


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> None:
    """Run ``each`` on every batch of what is available, then stop."""
    spark = stream.sparkSession
    run = (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint or fresh_path(spark, "stream"))
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()


def collect(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The drained stream as a stored frame."""
    spark = stream.sparkSession
    path = fresh_path(spark, "collected")
    run = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", fresh_path(spark, "stream"))
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
