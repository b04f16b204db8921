"""Indexes that outlive a query: built once per state of the input, found again by later calls."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.operators.embedding import DIM, embed
from docweft.operators.retrieval import mapped
from docweft.plans.frames import CHUNK_OVERLAP, CHUNK_TOKENS, document_chunks, documents, vectors
from docweft.session import fresh_path, released, shared_dir
from docweft.sources.lists import ListIndex
from docweft.sources.postings import BLOCK_TEXTS, BUCKETS, Postings
from docweft.sources.tables import load_spread, table_path

_OPEN: dict[tuple[str, str], object] = {}


def state_of(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the files under a path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    walk, seen = files.listFiles(where, True), []
    while walk.hasNext():
        one = walk.next()
        seen.append(f"{one.getPath()} {one.getLen()} {one.getModificationTime()}")
    return "\n".join(sorted(seen))


def kept(spark: SparkSession, label: str, source: str, build: Callable[[str], tuple[object, str]], reopen: Callable[[str, str], object]) -> object:
    """What ``build(path)`` made of the files at ``source``, from an earlier call where there was one.

    ``build`` gives the result and a note that ``reopen(path, note)`` needs. The path and the note are
    recorded last, so that an unfinished build is never found; of two builds at once the later record counts.
    """
    key = hashlib.sha256(f"{label}\n{state_of(spark, source)}".encode()).hexdigest()[:32]
    opened = (spark.sparkContext.applicationId, key)
    if opened not in _OPEN:
        record = f"{shared_dir(spark)}/kept-{key}"
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{record}/_SUCCESS")
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            row = spark.read.schema("path string, note string").parquet(record).first()
            _OPEN[opened] = reopen(row["path"], row["note"])
        else:
            path = fresh_path(spark, label)
            made, note = build(path)
            spark.createDataFrame([(path, note)], "path string, note string").coalesce(1).write.mode("overwrite").parquet(record)
            _OPEN[opened] = made
            # Whole texts are shuffled for an index.
            released(spark)
    return _OPEN[opened]


def _lists(spark: SparkSession, label: str, source: str, rows: Callable[[], DataFrame]) -> ListIndex:
    def build(path: str) -> tuple[ListIndex, str]:
        index = ListIndex.build(rows(), path)
        return index, index.schema.json()

    return kept(spark, f"{label}-{DIM}", source, build, lambda path, note: ListIndex(spark, path, T.StructType.fromJson(json.loads(note))))


def _embedded(rows: DataFrame) -> DataFrame:
    return rows.withColumn("embedding", embed(F.col("text")))


def document_index(spark: SparkSession, sf_dir: str) -> ListIndex:
    """Whole documents by ``doc_id``."""
    return _lists(spark, "documents-index", table_path(sf_dir, "documents"), lambda: _embedded(documents(spark, sf_dir)))


def chunk_index(spark: SparkSession, sf_dir: str) -> ListIndex:
    """Overlapping chunks of the documents."""
    label = f"chunks-{CHUNK_TOKENS}-{CHUNK_OVERLAP}-index"
    return _lists(spark, label, table_path(sf_dir, "documents"), lambda: _embedded(document_chunks(spark, sf_dir)))


def page_index(spark: SparkSession, sf_dir: str) -> ListIndex:
    """Pages, a table under foreign column names."""

    def rows() -> DataFrame:
        foreign = mapped(load_spread(spark, sf_dir, "pages", "page_id"), {"row_id": "page_id", "source_doc": "url", "page_content": "html"})
        return _embedded(mapped(foreign, {"id": "row_id", "text": "page_content"}))

    return _lists(spark, "pages-index", table_path(sf_dir, "pages"), rows)


def vector_index(spark: SparkSession, sf_dir: str) -> ListIndex:
    """The given vectors."""
    columns = ["id", F.col("embedding").cast("array<double>").alias("embedding")]
    return _lists(spark, "vectors-index", table_path(sf_dir, "embeddings"), lambda: vectors(spark, sf_dir).select(*columns))


def document_postings(spark: SparkSession, sf_dir: str) -> Postings:
    """The words of whole documents."""

    def build(path: str) -> tuple[Postings, str]:
        index = Postings.build(documents(spark, sf_dir), path)
        return index, json.dumps([index.n_texts, index.mean_length])

    # Whatever decides the layout is part of the name.
    return kept(spark, f"documents-postings-by-task-{BUCKETS}-{BLOCK_TEXTS}", table_path(sf_dir, "documents"), build, lambda path, note: Postings(spark, path, *json.loads(note)))
