"""Text to vector. The shipped embedder is a stand-in: a hashed bag of words.

A real model is plugged in as a factory that is called once per task and
returns a function from a list of texts to a matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

try:
    # The interpreter's own takes half the time on a word.
    from _md5 import md5
except ImportError:
    from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.functions.text import spaced

DIM = 64
# Bytes of texts that are cut into words at once.
PIECE_BYTES = 2 << 20

Embedder = Callable[[list[str]], np.ndarray]


def coded_words(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words of a list column as (row, code) per word and the word behind each code.

    Python then handles each different word of a batch once.
    """
    rows, codes, known = _coded(column)
    return rows, codes, known.to_pylist()


def _coded(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(lists) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.string())
    coded = lists.flatten().dictionary_encode()
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(lists)), sizes), codes, coded.dictionary


def pieces(column: pa.Array, most: int = PIECE_BYTES) -> list[tuple[int, int]]:
    """Where to begin and how many texts to take, so that each piece holds about ``most`` bytes or one text more."""
    ends = np.cumsum(pa.compute.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    begins = np.flatnonzero(np.diff(ends // most, prepend=-1)).tolist()
    return [(low, high - low) for low, high in zip(begins, [*begins, len(column)][1:], strict=True)]


def _utf8(known: pa.Array) -> list[bytes]:
    """The bytes of each word, cut from one buffer."""
    held = known.cast(pa.large_binary())
    _, offsets, data = held.buffers()
    ends = np.frombuffer(offsets, np.int64)[held.offset : held.offset + len(held) + 1].tolist()
    whole = data.to_pybytes() if data is not None else b""
    return [whole[low:high] for low, high in zip(ends, ends[1:], strict=False)]


class HashedWords:
    """The stand-in: word counts by md5 bucket, scaled to length one."""

    def __init__(self, dim: int = DIM):
        self.dim = dim

    def _buckets(self, known: pa.Array) -> np.ndarray:
        """The first three bytes of each word's digest, as a number, modulo the dimension."""
        digests = b"".join([md5(word).digest()[:3] for word in _utf8(known)])
        return np.frombuffer(digests, np.uint8).reshape(-1, 3) @ np.array([1 << 16, 1 << 8, 1]) % self.dim

    def of_texts(self, column: pa.Array) -> np.ndarray:
        """Vectors of texts whose words have single spaces or more between them."""
        parts = [self.of_words(pa.compute.split_pattern(column.slice(*piece), " ")) for piece in pieces(column)]
        return np.concatenate([np.zeros((0, self.dim)), *parts])

    def of_words(self, column: pa.Array | pa.ChunkedArray) -> np.ndarray:
        """Vectors of lists of words; an empty string is none."""
        rows, codes, known = _coded(column)
        n = len(column)
        if not len(known):
            return np.zeros((n, self.dim))
        empty = pa.compute.index(known, "").as_py()
        if empty >= 0:
            rows, codes = rows[codes != empty], codes[codes != empty]
        buckets = self._buckets(known)[codes]
        counts = np.bincount(rows * self.dim + buckets, minlength=n * self.dim)
        return unit_rows(counts.reshape(n, self.dim).astype(np.float64))


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def _lists(matrix: np.ndarray) -> pa.Array:
    matrix = np.ascontiguousarray(matrix, dtype=np.float64)
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * (matrix.shape[1] if matrix.ndim == 2 else 0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.reshape(-1)))


def embed(text: Column, factory: Callable[[], Embedder] | None = None) -> Column:
    """Vector column of a text column; the embedder is built once per task."""

    @F.arrow_udf("array<double>")
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = HashedWords()
        for batch in batches:
            yield _lists(model.of_texts(batch))
            # A worker waits for its next task, and would keep what it no longer uses.
            pa.default_memory_pool().release_unused()

    @F.arrow_udf("array<double>")
    def modelled(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = factory()
        for batch in batches:
            yield _lists(model(batch.to_pylist()))

    return hashed(spaced(text)) if factory is None else modelled(text)


def model_dimension(factory: Callable[[], Embedder]) -> int:
    """Vector length of a model, found by embedding one probe text."""
    return factory()(["hello"]).shape[1]


def dimension_profile(df: DataFrame, column: str, dim: int | None = None) -> DataFrame:
    """Smallest and largest vector size, and how many differ from ``dim`` (default: the largest)."""
    sizes = df.groupBy(F.size(column).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    expected = F.lit(dim) if dim is not None else F.max("d")
    first = sizes.agg(
        F.min("d").cast("bigint").alias("min_dim"),
        F.max("d").cast("bigint").alias("max_dim"),
        expected.cast("bigint").alias("expected_dim"),
        F.sum("n").alias("n_vectors"),
        F.collect_list(F.struct("d", "n")).alias("_sizes"),
    )
    wrong = F.aggregate(
        F.filter("_sizes", lambda s: s["d"] != F.col("expected_dim")),
        F.lit(0).cast("bigint"),
        lambda acc, s: acc + s["n"],
    )
    return first.withColumn("n_violations", wrong).drop("_sizes")
