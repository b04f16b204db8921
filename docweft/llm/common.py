"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.operators.numbering import top_per_key
from docweft.plans.registry import Query
from docweft.session import staged
from docweft.sources.tables import load

#: Keys that hold more than one row in so many are hot; there are always fewer of them than this.
HOT_KEYS = 1000

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """List a query of this subpackage, with its SQL where there is one."""

    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents")


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores in front until the frame has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Rows with the columns of their group; ``groups`` has one row per key and the key's row count.

    Keys above ``total / HOT_KEYS`` rows are fewer than ``HOT_KEYS``, so they are
    broadcast and their rows never shuffled; the rest is an ordinary join whose
    keys are all small.
    """
    least = total // HOT_KEYS
    hot = F.broadcast(groups.where(F.col(size) > least))
    small = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(small.join(groups.where(F.col(size) <= least), key))


def drawn(rows: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """At most ``k`` different values per key, those with the smallest hashes: ``(key, value)``.

    The different values are counted first, to within some 5 percent, and only the
    part of the hashes that holds about ``3 * k`` of them goes on, each value once per
    task. So what is shuffled follows ``k`` and not the rows. Keys are the classes
    that a model is trained for; a null is one of them.
    """
    counts = rows.groupBy(F.col(key).alias("_key")).agg(F.approx_count_distinct(value).alias("_n"))
    near = rows.join(F.broadcast(counts), F.col(key).eqNullSafe(F.col("_key")))
    near = near.where(F.pmod(F.xxhash64(value), F.lit(1 << 40)) * F.col("_n") < F.lit(3 * k * float(1 << 40)))
    order = [F.pmod(F.xxhash64(value), F.lit(1 << 40)), F.col(value)]
    return top_per_key(near.select(key, value).distinct(), [key], order, k).select(key, value)


def per_text(df: DataFrame, run: Callable[[list[str], pa.RecordBatch], dict[str, pa.Array]], schema: str, text: str = "text", step: int = 4 << 20) -> DataFrame:
    """Map batches through ``run(texts, batch)``, a null text read as empty.

    A batch is cut where its texts exceed ``step`` bytes, so that memory follows
    the longest text and not the batch.
    """

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch, text, step):
                texts = [t or "" for t in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_pydict(run(texts, part))

    return df.mapInArrow(mapped, schema)


def cut(batch: pa.RecordBatch, text: str, step: int) -> Iterator[pa.RecordBatch]:
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
    start, held = 0, 0
    for at, size in enumerate(sizes):
        if held and held + size > step:
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += size + 1
    if start < batch.num_rows:
        yield batch.slice(start)


class Cache(dict):
    """A bounded map from short strings to what ``make`` gives for them; emptied when full."""

    def __init__(self, make: Callable, most: int, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, key: str):
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


__all__ = ["HOT_KEYS", "ORACLES", "QUERIES", "Cache", "cut", "documents", "drawn", "join_groups", "per_text", "query", "staged", "unused"]
