"""Held-back emission over a stream, batch by batch.

State is two tables per batch number: how many rows each key has sent, and its
rows not yet emitted, fewer than ``every + held`` per key. Rows of a batch are
numbered with the same skew-safe numbering the batch form uses, so a key that
sends most rows of a batch is spread over tasks. Tables carry the batch number
and are overwritten when a batch is repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.operators.numbering import numbered
from docweft.operators.signal import check_window


class HeldBackSink:
    def __init__(self, spark: SparkSession, root: str, key: str, order: str, every: int, held: int):
        check_window(every, held)
        self.spark, self.root, self.key, self.order = spark, root, key, order
        self.every, self.held = every, held

    def _table(self, name: str, batch: int) -> str:
        return f"{self.root}/{name}/batch={batch}"

    def _last_batch(self) -> int:
        """Number of the last finished batch; its pending rows are written last."""
        found = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/pending/batch=*")
        files = found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [status.getPath().getName() for status in files.globStatus(found)]
        return max((int(name.removeprefix("batch=")) for name in names), default=-1)

    def _state(self, batch: int, fields: str) -> tuple[DataFrame, DataFrame]:
        """Counts and pending rows after a batch; empty before the first."""
        counts, pending = f"{self.key} BIGINT, seen BIGINT", f"{fields}, i BIGINT"
        if batch < 0:
            return self.spark.createDataFrame([], counts), self.spark.createDataFrame([], pending)
        read = self.spark.read
        return (
            read.schema(counts).parquet(self._table("counts", batch)),
            read.schema(pending).parquet(self._table("pending", batch)),
        )

    def __call__(self, rows: DataFrame, batch: int) -> None:
        rows = rows.persist()
        try:
            self._take(rows, batch)
        finally:
            rows.unpersist()

    def _take(self, rows: DataFrame, batch: int) -> None:
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
        seen, pending = self._state(batch - 1, fields)
        arrived = rows.groupBy(self.key).agg(F.count(F.lit(1)).alias("new"))
        totals = seen.join(arrived, self.key, "full").select(
            self.key,
            F.coalesce("seen", F.lit(0)).alias("before"),
            (F.coalesce("seen", F.lit(0)) + F.coalesce("new", F.lit(0))).alias("seen"),
        )
        totals.select(self.key, "seen").write.mode("overwrite").parquet(self._table("counts", batch))
        indexed = (
            numbered(rows, [self.key], self.order, "_rn")
            .join(totals, self.key)
            .withColumn("i", F.col("before") + F.col("_rn") - 1)
            .select(*rows.columns, "i", "seen")
        )
        waiting = pending.join(totals.select(self.key, "seen"), self.key).select(*rows.columns, "i", "seen")
        number = F.ceil((F.col("i") + 1 + self.held) / self.every)
        due = waiting.unionByName(indexed).withColumn("flush_no", number.cast("bigint"))
        ready = F.col("flush_no") <= F.floor(F.col("seen") / self.every)
        due.where(ready).select(*rows.columns, "flush_no").write.mode("overwrite").parquet(self._table("out", batch))
        due.where(~ready).select(*rows.columns, "i").write.mode("overwrite").parquet(self._table("pending", batch))

    def finish(self, schema: str) -> DataFrame:
        """Flush what is held back and return everything emitted."""
        last = self._last_batch()
        counts, pending = self._state(last, schema)
        columns = [f.name for f in pending.schema.fields if f.name != "i"]
        final = (F.floor(F.col("seen") / self.every) + 1).cast("bigint")
        rest = pending.join(counts, self.key).select(*columns, final.alias("flush_no"))
        rest.write.mode("overwrite").parquet(self._table("out", last + 1))
        return self.spark.read.schema(f"{schema}, flush_no BIGINT").parquet(f"{self.root}/out").select(*columns, "flush_no")
