"""Approximate neighbours by random hyperplanes.

Vectors on the same side of all planes of a table share a bucket, and only
bucket mates are scored. Two things keep buckets workable without leaving a
mate out:

* copies are folded: of equal corpus vectors only the smallest ids can be among
  anyone's k best, and equal questions have equal answers;
* a large bucket is cut into blocks, and every block pair is scored, so no task
  holds a whole bucket.

Planes grow with the corpus, and tables with the planes, so that a neighbour at
cosine ``NEAR`` shares a bucket with the probability ``RECALL`` at any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.operators.matching import CosineScorer, block_pairs, vector_matrix
from docweft.operators.numbering import top_per_key
from docweft.operators.sizes import sent
from docweft.session import staged

BUCKET_ROWS = 1024
BLOCK_ROWS = 4096
MAX_BITS = 36
TABLES = 12
NEAR = 0.9
RECALL = 0.95
MAX_CROWDED = 1_000_000
_STEP_ROWS = 512


def copy_key(vector: str) -> Column:
    """Equal for equal vectors only."""
    return F.md5(F.to_binary(F.array_join(F.transform(vector, lambda x: x.cast("string")), ","), F.lit("utf-8")))


def tables_for(bits: int) -> int:
    """As many tables as give ``RECALL`` for a neighbour at cosine ``NEAR``, and ``TABLES`` at least."""
    together = (1 - math.acos(NEAR) / math.pi) ** bits
    return max(TABLES, math.ceil(math.log(1 - RECALL) / math.log1p(-together)))


def signatures(df: DataFrame, dim: int, tables: int, bits: int, seed: int = 7) -> DataFrame:
    """One row per table: ``(…, tab INT, sig BIGINT)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(seed).normal(size=(dim, tables * bits))
        first = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            # A row goes out once per table, so few rows are held at a time.
            for start in range(0, batch.num_rows, _STEP_ROWS):
                rows = batch.slice(start, _STEP_ROWS)
                n = rows.num_rows
                side = (vector_matrix(pa.chunked_array([rows.column("embedding")])) @ planes > 0).reshape(n, tables, bits)
                out = rows.take(pa.array(np.repeat(np.arange(n), tables)))
                out = out.append_column("tab", pa.array(np.tile(np.arange(tables, dtype=np.int32), n)))
                yield out.append_column("sig", pa.array((side * first).sum(axis=2).reshape(-1)))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, tab int, sig bigint")


def nearest_by_hash(
    questions: DataFrame,
    corpus: DataFrame,
    k: int = 4,
    exclude_self: bool = False,
    tables: int | None = None,
    bits: int | None = None,
    bucket_rows: int = BUCKET_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Approximate k nearest corpus rows of every question: ``(qid, id, score, rk)``.

    ``questions`` has ``qid BIGINT, embedding``, ``corpus`` has ``id BIGINT,
    embedding``. Unless ``bits`` is given, it grows with the corpus so that an
    even spread leaves about ``bucket_rows`` vectors per bucket; unless ``tables``
    is given, it follows from ``bits``.
    """
    n, dim = corpus.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    if not n:
        return questions.sparkSession.createDataFrame([], "qid bigint, id bigint, score double, rk bigint")
    if bits is None:
        bits = min(MAX_BITS, max(2, math.ceil(math.log2(n / bucket_rows))))
    if tables is None:
        tables = tables_for(bits)
    want = k + 1 if exclude_self else k
    asked = questions.select("qid", "embedding", copy_key("embedding").alias("copy"))
    # One question per distinct vector, under its smallest id. Stored, as the
    # buckets are counted before the vectors are sent to them.
    asked_once = staged(top_per_key(asked, ["copy"], [F.col("qid")], 1, "first").drop("first"), "questions")
    kept = corpus.select("id", "embedding", copy_key("embedding").alias("copy"))
    kept = staged(top_per_key(kept, ["copy"], [F.col("id")], want, "nth").select("id", "embedding"), "corpus")
    left = signatures(asked_once.select("qid", "embedding"), dim, tables, bits)
    right = signatures(kept, dim, tables, bits)
    bucket = ["tab", "sig"]
    counted = staged(
        right.groupBy(*bucket).agg(F.count(F.lit(1)).alias("c"), F.lit(0).cast("bigint").alias("q")).unionByName(
            left.groupBy(*bucket).agg(F.lit(0).cast("bigint").alias("c"), F.count(F.lit(1)).alias("q"))
        ),
        "buckets",
    )

    # Blocks of what is large.
    parts = counted.groupBy(*bucket).agg(
        F.ceil(F.sum("q") / F.lit(block_rows)).cast("int").alias("q_blocks"),
        F.ceil(F.sum("c") / F.lit(block_rows)).cast("int").alias("c_blocks"),
    )
    parts = sent(staged(parts.where("q_blocks > 1 OR c_blocks > 1"), "parts"), MAX_CROWDED)

    def cut(df: DataFrame, own: str, other: str, own_id: str, own_n: str, other_n: str) -> DataFrame:
        sized = df.join(parts, bucket, "left")
        here, there = F.greatest(F.coalesce(own_n, F.lit(1)), F.lit(1)), F.greatest(F.coalesce(other_n, F.lit(1)), F.lit(1))
        return (
            sized.withColumn(own, F.pmod(F.xxhash64(own_id), here).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), there - 1)))
            .select(own_id, "embedding", *bucket, "qb", "cb")
        )

    pairs = block_pairs(
        cut(left, "qb", "cb", "qid", "q_blocks", "c_blocks"),
        cut(right, "cb", "qb", "id", "c_blocks", "q_blocks"),
        [*bucket, "qb", "cb"],
        [("hash", CosineScorer())],
        want,
        False,
    )
    found = pairs.groupBy("qid", "id").agg(F.max("score").alias("score"))
    order = [F.col("score").desc(), F.col("id")]
    best = top_per_key(found, ["qid"], order, want)

    # Back to every question. An answer list holds at most k + 1 rows and travels
    # as one array, so many copies of a question are a plain skewed equi-join.
    answers = best.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rk", "id", "score"))).alias("found"))
    answers = answers.join(asked_once.select("qid", "copy"), "qid").select("copy", "found")
    listed = asked.select("qid", "copy").join(answers, "copy")
    rest = F.filter("found", lambda m: m["id"] != F.col("qid")) if exclude_self else F.col("found")
    ranked = listed.select("qid", F.posexplode(F.slice(rest, 1, k)).alias("pos", "m"))
    return ranked.select("qid", "m.id", "m.score", (F.col("pos") + 1).cast("bigint").alias("rk"))
