"""A vector index kept as Parquet tables of writes, replaced document by document.

Every write is a folder ``seq=<n>`` of rows and one of the documents it writes, two
narrow columns. Appending never touches earlier data and a repeated write of the same
number replaces itself. Readers see the newest write of each document, whole: a document
that shrank leaves no chunk behind, and one that is written without rows is gone.
Which writes are superseded is found from the narrow table and sent to the rows, which
stay where they are; many of them are a reason to :meth:`~VectorIndex.compact`.

Rows are stored before their documents, so that a reader meets the old version until the
new one is complete, or both while a write is being repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.functions.text import blank_tokens, chunk_array
from docweft.operators.embedding import embed
from docweft.operators.sizes import sent

# Declared layout of an index row; the vector length is checked on write.
INDEX_SCHEMA = "id STRING, doc STRING, text STRING, text_vector ARRAY<DOUBLE>, source STRING"
COLUMNS = ["id", "doc", "text", "text_vector", "source"]
# A text of more chunks is refused.
CHUNKS_PER_TEXT = 1 << 22
# Superseded writes that are sent to the rows; beyond, rows are shuffled to them.
MAX_SUPERSEDED = 2_000_000


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str, dim: int):
        self.spark = spark
        self.path = path
        self.dim = dim

    @classmethod
    def open_or_create(cls, spark: SparkSession, path: str, dim: int) -> VectorIndex:
        """The existing index at ``path``, else a new empty one.

        An index whose rows have another dimension is refused.
        """
        index = cls(spark, path, dim)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            other = index.log().select(F.size("text_vector").alias("d")).where(F.col("d") != dim).head(1)
            if other:
                raise ValueError(f"index at {path} has dimension {other[0].d}, not {dim}")
        else:
            spark.createDataFrame([], INDEX_SCHEMA).write.parquet(f"{path}/rows/seq=0")
            spark.createDataFrame([], "doc STRING").write.parquet(f"{path}/docs/seq=0")
        return index

    def _read(self, table: str, schema: str) -> DataFrame:
        path = f"{self.path}/{table}"
        return self.spark.read.schema(f"{schema}, seq BIGINT").option("basePath", path).parquet(path)

    def log(self) -> DataFrame:
        """All rows ever written, with the write number ``seq``."""
        return self._read("rows", INDEX_SCHEMA)

    def written(self) -> DataFrame:
        """``(doc, seq)``: which documents each write holds, also those it holds no rows of."""
        return self._read("docs", "doc STRING")

    def write(self, rows: DataFrame, seq: int, docs: DataFrame | None = None) -> None:
        """Store rows as write ``seq``; running it again replaces it.

        ``doc`` names the document a row belongs to, the row itself where there is no such column. ``docs``
        lists the documents in full, where some may have no rows. Ids are unique within a write.
        """
        if "doc" not in rows.columns:
            rows = rows.withColumn("doc", F.col("id"))
        size = F.size("text_vector")
        message = F.concat(F.lit(f"vector is not of dimension {self.dim}: "), size.cast("string"))
        checked = rows.select(*COLUMNS).withColumn(
            "text_vector", F.when(size == self.dim, F.col("text_vector")).otherwise(F.raise_error(message))
        )
        checked.write.mode("overwrite").parquet(f"{self.path}/rows/seq={seq}")
        if docs is None:
            docs = self.spark.read.schema(INDEX_SCHEMA).parquet(f"{self.path}/rows/seq={seq}")
        docs.select(F.col("doc").cast("string").alias("doc")).distinct().write.mode("overwrite").parquet(f"{self.path}/docs/seq={seq}")

    def delete(self, docs: DataFrame, seq: int) -> None:
        """Take documents out of the index, as write ``seq``."""
        self.write(self.spark.createDataFrame([], INDEX_SCHEMA), seq, docs)

    def superseded(self) -> DataFrame:
        """``(doc, seq)`` of writes that a later write of the document replaces."""
        written = self.written()
        newest = written.groupBy("doc").agg(F.max("seq").alias("newest"), F.count(F.lit(1)).alias("n")).where("n > 1")
        return written.join(newest.select("doc", "newest"), "doc").where(F.col("seq") < F.col("newest")).select("doc", "seq")

    def latest(self) -> DataFrame:
        """The rows of the newest write of each document."""
        return self.log().join(sent(self.superseded(), MAX_SUPERSEDED), ["doc", "seq"], "left_anti")

    def compact(self, path: str) -> VectorIndex:
        """A new index that holds the newest rows only."""
        index = VectorIndex.open_or_create(self.spark, path, self.dim)
        index.write(self.latest(), 1)
        return index


def chunks(documents: DataFrame, size: int = 1024, overlap: int = 20) -> DataFrame:
    """``(id, doc_id, chunk_no, text, source)``, ids unique and ordered by document."""
    cut = documents.select("doc_id", "source", blank_tokens(F.col("text")).alias("tokens")).select(
        "doc_id", "source", F.posexplode(chunk_array(F.col("tokens"), size, overlap)).alias("chunk_no", "text")
    )
    number = F.when(F.col("chunk_no") < CHUNKS_PER_TEXT, F.col("doc_id") * F.lit(CHUNKS_PER_TEXT) + F.col("chunk_no"))
    return cut.select(
        number.otherwise(F.raise_error(F.lit(f"a text of more than {CHUNKS_PER_TEXT} chunks"))).alias("id"),
        "doc_id",
        "chunk_no",
        "text",
        "source",
    )


def document_of(chunk: str):
    """Document id of a chunk id."""
    return F.expr(f"`{chunk}` div {CHUNKS_PER_TEXT}")


def index_rows(documents: DataFrame, size: int = 1024, overlap: int = 20, factory=None) -> DataFrame:
    """Chunks of documents as index rows, embedded."""
    return chunks(documents, size, overlap).select(
        F.concat_ws("-", "doc_id", "chunk_no").alias("id"),
        F.col("doc_id").cast("string").alias("doc"),
        "text",
        embed(F.col("text"), factory).alias("text_vector"),
        "source",
    )
