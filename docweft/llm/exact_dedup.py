"""Exact duplicates with the frequent digests split off.

Per partition a Misra-Gries summary of the digests is kept. Summed over
partitions, an entry understates its count by at most ``rows / (counters + 1)``,
so every digest above ``rows / HOT_KEYS`` is among the candidates, of which
there are at most ``2 * HOT_KEYS``. Their exact counts are taken in one scan with
partial sums, the winners are broadcast, and their rows are settled where they
are. All other digests have few rows each and go through an ordinary shuffle.

Defined cases: a null text counts as empty. A null ``doc_id`` sorts last. Rows
that share a ``doc_id`` and a text are copies of each other; exactly one row of a
group has ``kept``, whatever repeats. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweft.llm.common import HOT_KEYS, documents, query, staged, unused

COUNTERS = 2 * HOT_KEYS
WHITE = r"[\x20\x09-\x0D]+"


def text_digest(text: Column) -> Column:
    """SHA-256 of the text with each run of white space as one space."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " "), 256))


def frequent(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``(digest, n)``: a Misra-Gries summary, ``n`` at most ``rows / (counters + 1)`` too low."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            for pair in batch.column(0).value_counts().to_pylist():
                held[pair["values"]] = held.get(pair["values"], 0) + pair["counts"]
            if len(held) > counters:
                off = sorted(held.values(), reverse=True)[counters]
                held = {d: n - off for d, n in held.items() if n > off}
        yield pa.RecordBatch.from_pydict({"digest": pa.array(held.keys(), pa.binary()), "n": pa.array(held.values(), pa.int64())})

    parts = digests.select("digest").mapInArrow(summary, "digest binary, n bigint")
    return parts.groupBy("digest").agg(F.sum("n").alias("n"))


def marked(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, digest)``, one row per input row."""
    rows = docs.select(F.col(key).alias("doc_id"), text_digest(F.col(text)).alias("digest"))
    rows = staged(rows.withColumn("at", F.monotonically_increasing_id()), "digests")
    total = rows.count()
    least = total // HOT_KEYS
    candidates = frequent(rows).where(F.col("n") > least - total // (COUNTERS + 1)).select("digest")
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "at")
    counted = rows.join(F.broadcast(candidates), "digest", "left_semi").groupBy("digest")
    winners = counted.agg(F.count(F.lit(1)).alias("group_size"), F.min(first).alias("first"))
    winners = F.broadcast(staged(winners.where(F.col("group_size") > least), "winners"))
    hot = rows.join(winners, "digest")
    same = Window.partitionBy("digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti").withColumns(
        {"group_size": F.count(F.lit(1)).over(same), "first": F.min(first).over(same)}
    )
    return hot.unionByName(rest).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("at") == F.col("first.at")).alias("kept"),
        "digest",
    )


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with its columns: one per distinct text."""
    own = unused(docs, "copy_key")
    kept = marked(docs, key, text).where("kept").select(F.struct("doc_id", "digest").alias(own))
    keyed = docs.withColumn(own, F.struct(F.col(key).alias("doc_id"), text_digest(F.col(text)).alias("digest")))
    place = unused(keyed, "copy_place")
    one = keyed.withColumn(place, F.row_number().over(Window.partitionBy(own).orderBy(own))).where(F.col(place) == 1)
    return one.join(kept, own, "left_semi").select(*docs.columns)


SQL = r"""
WITH h AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM h WINDOW w AS (PARTITION BY text_sha256)"""


@query("op8_exact_dedup", SQL)
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = marked(documents(spark, sf_dir))
    return rows.withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")
