"""Files as frames: listings, whole texts, choice of reader by extension."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.functions.text import extension, path_tail


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``(name, length)`` of the files below a folder; contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(folder)
    )
    return files.select(path_tail(F.col("path"), "\0").alias("name"), "path", "length")


def read_texts(spark: SparkSession, folder: str, pattern: str = "*.txt", partitions: int | None = None) -> DataFrame:
    """One row per file with its whole text."""
    texts = (
        spark.read.option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .text(folder, wholetext=True)
        .select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))
    )
    return texts.repartition(partitions) if partitions else texts


def read_binaries(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select(F.col("path").alias("source"), "content")
    )


def extracted(
    df: DataFrame,
    path: str,
    content: str,
    extractors: Mapping[str, Callable[[Column], Column]],
    text: str = "text",
) -> DataFrame:
    """Apply the reader that belongs to each row's extension; other rows keep their content."""
    ext = extension(F.col(path))
    value, reader = F.col(content), F.lit("plain")
    for name, read in extractors.items():
        value = F.when(ext == name, read(F.col(content))).otherwise(value)
        reader = F.when(ext == name, name).otherwise(reader)
    return df.withColumns({"ext": ext, "extractor": reader, text: value})
