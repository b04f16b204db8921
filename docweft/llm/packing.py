"""Best-fit packing of documents into token sequences, by exact complements.

Only the longest pieces depend on the data's order: a packing of lengths is
settled on the histogram of lengths, which has at most ``size`` entries whatever
the number of documents. For each length, longest first, the gap it leaves is
looked up among single lengths, sums of two and sums of three that are still
available; a combination is taken as often as its rarest part allows. What has no
exact complement is placed best-fit, longest first. The plan is a list of
patterns with counts; each pattern step uses up one length, so the plan stays
small too. Pieces then get a rank within their length, block by block, and read
their place off the plan.

Defined cases: a null text is empty; an empty text is the one end token; a null
or repeated ``doc_id`` is a document of its own; an empty table packs to nothing.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweft.llm.bytepair import byte_level, read_source
from docweft.llm.common import Cache, documents, per_text, query, staged

SIZE = 4096
END = 1
CACHED = 500_000
BLOCK = 20_000
#: Marks at the end of a chunk are one pre-token, whatever stands before them.
MARKS = ".,;:!?#$%&*+-/=@^_~|"
#: White space on which the tokenizer's own rule and str.split() may differ; texts that hold any are encoded whole.
ODD = regex.compile("[\x1c-\x1f\x85​﻿]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of texts whose tokenizer drops white space: each run between white space is encoded apart and remembered."""

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(source)
        self.library.no_truncation()
        self.library.no_padding()
        self.merge = self.library.model.tokenize
        self.words = Cache(self._word, CACHED)
        self.marks = Cache(self._ids, CACHED)
        self.chunks = Cache(self._chunk, CACHED)

    def _ids(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of one lower-case pre-token."""
        return array("I", [t.id for t in self.merge(byte_level(word))]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """A chunk is often a word with marks behind it; both parts are known better apart."""
        body = chunk.rstrip(MARKS)
        marks = chunk[len(body) :]
        # Beyond Latin-1 lower case and normal form can change which characters are letters.
        if body.isalpha() and max(body) <= "\xff":
            return self.words[body.lower()] + (self.marks[marks] if marks else b"")
        return self._ids(chunk)

    def encode(self, text: str) -> bytes:
        if ODD.search(text):
            return self._ids(text)
        return b"".join(map(self.chunks.__getitem__, text.split()))


_encoders: dict[int, WordEncoder] = {}


def pieces(
    docs: DataFrame,
    path: str | None = None,
    size: int = SIZE,
    end: int = END,
    key: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``: each document's ids and an end token, cut at ``size``."""
    sent = docs.sparkSession.sparkContext.broadcast(read_source(path or default_path()))
    last = np.array([end], dtype="<u4").tobytes()

    def run(texts: list[str], batch: pa.RecordBatch) -> dict[str, pa.Array]:
        source = sent.value
        if hash(source) not in _encoders:
            _encoders[hash(source)] = WordEncoder(source)
        encode = _encoders[hash(source)].encode
        row, piece, start, length, crc, ids = [], [], [], [], [], []
        for at, t in enumerate(texts):
            whole = encode(t) + last
            for i, begin in enumerate(range(0, len(whole), 4 * size)):
                part = whole[begin : begin + 4 * size]
                row.append(at)
                piece.append(i)
                start.append(begin // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
                if with_ids:
                    ids.append(np.frombuffer(part, dtype="<u4").astype(np.int32))
        out = {
            "doc_id": batch.column("doc_id").take(pa.array(row, pa.int64())),
            "piece": pa.array(piece, pa.int32()),
            "start": pa.array(start, pa.int64()),
            "length": pa.array(length, pa.int64()),
            "ids_crc32": pa.array(crc, pa.int64()),
        }
        return out | ({"ids": pa.array(ids, pa.list_(pa.int32()))} if with_ids else {})

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return per_text(rows, run, schema)


class _Sums:
    """Available lengths, and witnesses for sums of two; a sum without one never gets one again."""

    def __init__(self, have: np.ndarray):
        self.have = have
        self.dead = np.zeros(len(have), dtype=bool)
        self.dead[:2] = True
        self.pair: dict[int, tuple[int, int]] = {}

    def allowed(self, parts: tuple[int, ...]) -> bool:
        return all(self.have[p] >= n for p, n in Counter(parts).items())

    def two(self, total: int) -> tuple[int, int] | None:
        if total < 2 or self.dead[total]:
            return None
        known = self.pair.get(total)
        if known and self.allowed(known):
            return known
        low = np.arange(1, total // 2 + 1)
        both = (self.have[low] > 0) & (self.have[total - low] > 0)
        if total % 2 == 0 and self.have[total // 2] < 2:
            both[-1] = False
        at = np.flatnonzero(both)
        if len(at) == 0:
            self.dead[total] = True
            return None
        self.pair[total] = (int(low[at[0]]), int(total - low[at[0]]))
        return self.pair[total]

    def complement(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that add up to the gap."""
        if gap >= 1 and self.have[gap] > 0:
            return (gap,)
        if found := self.two(gap):
            return found
        third = np.arange(gap - 2, 0, -1)
        third = third[(self.have[third] > 0) & ~self.dead[gap - third]]
        for c in third.tolist():
            found = self.two(gap - c)
            if found and self.allowed((*found, c)):
                return (*found, c)
        return None


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns ``((length, repeats), ...)`` with how often each is used, for a histogram of lengths."""
    have = np.zeros(size + 1, dtype=np.int64)
    for length, n in counts.items():
        have[length] += n
    done: list[tuple[tuple[int, ...], int]] = []
    sums = _Sums(have)
    left: list[tuple[int, int]] = []
    for length in range(size, 0, -1):
        while have[length] > 0:
            if length == size:
                found: tuple[int, ...] | None = ()
            else:
                have[length] -= 1
                found = sums.complement(size - length)
                have[length] += 1
            if found is None:
                left.append((length, int(have[length])))
                have[length] = 0
                break
            parts = (length, *found)
            uses = Counter(parts)
            times = min(int(have[p]) // n for p, n in uses.items())
            for p, n in uses.items():
                have[p] -= n * times
            done.append((parts, times))
    out = [(tuple(sorted(Counter(parts).items(), reverse=True)), times) for parts, times in done]
    return out + _best_fit(left, size)


def _best_fit(left: list[tuple[int, int]], size: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Lengths, longest first, each into the open sequences with the smallest gap that takes it."""
    opened: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    gaps = np.zeros(size + 1, dtype=bool)
    closed = []

    def put(gap: int, pattern: tuple, times: int) -> None:
        if gap == 0:
            closed.append((pattern, times))
        else:
            opened.setdefault(gap, []).append((pattern, times))
            gaps[gap] = True

    for length, n in left:
        while n:
            fitting = np.flatnonzero(gaps[length:])
            if len(fitting):
                gap = int(fitting[0]) + length
                pattern, times = opened[gap].pop()
                if not opened[gap]:
                    gaps[gap] = False
                each = gap // length
            else:
                gap, pattern, each = size, (), size // length
                times = max(1, n // each)
            each = min(each, n)
            full = min(times, n // each)
            if full < times and (pattern or full == 0):
                put(gap, pattern, times - full)
            put(gap - each * length, (*pattern, (length, each)), full)
            n -= full * each
    return closed + [one for some in opened.values() for one in some]


def _slots(patterns: list) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: first rank of each slot, repeats, first sequence and offset."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for length, repeats in pattern:
            first = ranks.get(length, 0)
            rows.setdefault(length, []).append((first, repeats, sequence, offset))
            ranks[length] = first + repeats * times
            offset += length * repeats
        sequence += times
    return {length: tuple(np.array(c, dtype=np.int64) for c in zip(*some, strict=True)) for length, some in rows.items()}


def ranked(rows: DataFrame, total: int) -> DataFrame:
    """Rows with ``rank``, from 0, within their length; a length that holds most rows is numbered in blocks."""
    blocks = max(1, math.ceil(total / BLOCK))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "at"), F.lit(blocks)))
    sizes = rows.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")
    sizes = sizes.select("length", "block", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "piece", "at"))
    out = rows.withColumn("place", place).join(sizes, ["length", "block"])
    return out.withColumn("rank", F.col("before") + F.col("place") - 1).drop("block", "before", "place")


def packed(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; ``rows`` has ``doc_id``, ``piece`` and ``length``."""
    rows = staged(rows.withColumn("at", F.monotonically_increasing_id()), "pieces")
    # At most ``size`` rows, whatever the input.
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    sent = rows.sparkSession.sparkContext.broadcast(_slots(plan(counts, size)))

    def place(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for one in np.unique(length):
                at = np.flatnonzero(length == one)
                first, repeats, start, begin = sent.value[int(one)]
                slot = np.searchsorted(first, rank[at], side="right") - 1
                inside = rank[at] - first[slot]
                sequence[at] = start[slot] + inside // repeats[slot]
                offset[at] = begin[slot] + inside % repeats[slot] * one
            out = batch.drop_columns(["rank", "at"])
            yield out.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    kept = [f for f in rows.schema.fields if f.name != "at"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    numbered = ranked(rows, sum(counts.values())).select(*[f.name for f in kept], "at", "rank")
    return numbered.mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint")


@query("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(pieces(documents(spark, sf_dir)))
