"""Vectors as short codes: product quantisation, its codebooks trained on all vectors.

Every partition cuts its rows into blocks and builds one cover tree per block and
part position: a node's points lie within its radius of its centre, its children's
centres are more than half that radius apart and the centre itself is one of them.
Points are stored in tree order, so a subtree is a range and its sum the difference
of two cumulative sums. The trees are written once and read in every round.

A round descends the trees level by level. An entry farther from a node's centre
than the nearest one by more than twice the radius is nearest to nothing below it;
once one entry is left, the whole subtree is its. Leaves that several entries may
own are compared exactly. Bounds keep a margin above rounding errors, so ties are
always compared, and comparisons are exact integers.

Tasks send on one sum per part position and entry; the driver sees the codebooks only.

Defined cases: rows whose vector is null or holds null or non-finite components are
dropped. Components ``floor(1024 * x)`` beyond 32 bits are held at the nearest such
integer, errors beyond 63 bits likewise. Vectors of different lengths, or of a length
that four does not divide, are read as if zeros followed up to the longest one's
length, raised to a multiple of four. A null ``vec_id`` sorts last, repeated ones by
their vectors; every row is coded, whatever repeats. With fewer than 256 rows there are
as many entries. Other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.llm.common import join_groups, query, staged
from docweft.sources.tables import load

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
BLOCK = 2048
LEAF = 8
_HELD = (1 << 31) - 1
_MOST = (1 << 63) - 1
# Nodes and points whose distances to all entries are held at once.
_STEP = 4096


class Tree(NamedTuple):
    """Nodes in breadth-first order over points in depth-first order."""

    order: np.ndarray  # the block's point at each place
    centre: np.ndarray  # place of each node's centre
    low: np.ndarray  # a node's places are low to high
    high: np.ndarray
    first: np.ndarray  # its children are first to last, none for a leaf
    last: np.ndarray
    radius: np.ndarray


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """The cover tree of some points, by farthest-first choice of children."""
    n = len(points)
    exact = points.astype(np.float64)
    squares = (exact * exact).sum(axis=1)
    apart = np.sqrt(np.maximum(squares[:, None] - 2 * (exact @ exact.T) + squares, 0))
    np.fill_diagonal(apart, 0)
    order = np.arange(n)
    centre, low, high, first, last, radius = [0], [0], [n], [], [], []
    at = 0
    while at < len(centre):
        begin, end = low[at], high[at]
        mine = order[begin:end].copy()
        near = apart[centre[at], mine]
        reach = float(near.max())
        first.append(len(centre))
        radius.append(reach)
        if end - begin > leaf and reach > 0:
            owner = np.zeros(len(mine), dtype=np.int64)
            chosen = [centre[at]]
            while True:
                far = int(near.argmax())
                if near[far] <= reach / 2:
                    break
                distance = apart[mine[far], mine]
                owner[distance < near] = len(chosen)
                owner[far] = len(chosen)
                near = np.minimum(near, distance)
                near[far] = 0
                chosen.append(int(mine[far]))
            by_owner = np.argsort(owner, kind="stable")
            order[begin:end] = mine[by_owner]
            edges = begin + np.searchsorted(owner[by_owner], np.arange(len(chosen) + 1))
            centre.extend(chosen)
            low.extend(edges[:-1].tolist())
            high.extend(edges[1:].tolist())
        last.append(len(centre))
        at += 1
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    # A distance from rounded squares may fall short of the true one by this much.
    slack = 1e-6 * (math.sqrt(float(squares.max())) + 1)
    whole = [np.array(x, dtype=np.int64) for x in (low, high, first, last)]
    return Tree(order, place[np.array(centre)], *whole, np.array(radius) + slack)


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer points to integer entries."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * most * most * max(1, points.shape[1]) < 1 << 52:
        a, b = points.astype(np.float64), entries.astype(np.float64)
        return (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)
    a, b = points.astype(object), entries.astype(object)
    return np.stack([((a - e) ** 2).sum(axis=1) for e in b], axis=1)


class Assigned(NamedTuple):
    code: np.ndarray  # the entry of each place of the tree
    whole: np.ndarray  # subtrees given to one entry: (low, high, entry)
    single: np.ndarray  # places that were compared with the entries themselves


def assigned(tree: Tree, points: np.ndarray, entries: np.ndarray) -> Assigned:
    """The nearest entry of every point, the lowest of equally near ones; ``points`` are in tree order."""
    code = np.zeros(len(points), dtype=np.int64)
    given, single = [], []
    nodes, open_ = np.zeros(1, np.int64), np.ones((1, len(entries)), bool)
    while len(nodes):
        next_nodes, next_open = [], []
        for step in range(0, len(nodes), _STEP):
            part, may = nodes[step : step + _STEP], open_[step : step + _STEP]
            apart = np.sqrt(np.maximum(squared(points[tree.centre[part]], entries).astype(np.float64), 0))
            apart[~may] = np.inf
            best = apart.min(axis=1)
            margin = 1e-9 * (best + 1)
            may = apart <= (best + 2 * tree.radius[part] + margin)[:, None]
            one = may.sum(axis=1) == 1
            given.append(np.stack([tree.low[part[one]], tree.high[part[one]], may[one].argmax(axis=1)], axis=1))
            inner = ~one & (tree.first[part] < tree.last[part])
            single.extend(np.arange(tree.low[p], tree.high[p]) for p in part[~one & ~inner])
            counts = tree.last[part[inner]] - tree.first[part[inner]]
            next_nodes.extend(np.arange(tree.first[p], tree.last[p]) for p in part[inner])
            next_open.append(np.repeat(may[inner], counts, axis=0))
        nodes = np.concatenate(next_nodes) if next_nodes else np.zeros(0, np.int64)
        open_ = np.concatenate(next_open) if next_open else open_[:0]
    whole = np.concatenate(given)
    for low, high, entry in whole:
        code[low:high] = entry
    at = np.concatenate(single) if single else np.zeros(0, np.int64)
    for step in range(0, len(at), _STEP):
        part = at[step : step + _STEP]
        code[part] = squared(points[part], entries).argmin(axis=1)
    return Assigned(code, whole, at)


def sums_of(found: Assigned, points: np.ndarray, n_entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Per entry the sum and the number of its points; subtrees by cumulative sums."""
    running = np.zeros((len(points) + 1, points.shape[1]), dtype=np.int64)
    np.cumsum(points, axis=0, out=running[1:])
    sums = np.zeros((n_entries, points.shape[1]), dtype=np.int64)
    low, high, entry = found.whole.T
    np.add.at(sums, entry, running[high] - running[low])
    np.add.at(sums, found.code[found.single], points[found.single])
    return sums, np.bincount(found.code, minlength=n_entries)


# ---- blocks as rows ---------------------------------------------------------

_BLOCK_ROW = ", ".join(
    ["ids array<bigint>", "labels array<int>", "points binary"]
    + [f"order{p} array<int>, nodes{p} array<int>, radius{p} array<double>" for p in range(PARTS)]
)


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad


def integers(vectors: pa.Array, width: int) -> np.ndarray:
    """Components as integers, one row per vector, zeros after its end."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    out = np.zeros((len(vectors), width), dtype=np.int64)
    row = np.repeat(np.arange(len(vectors)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.clip(flat, -_HELD, _HELD).astype(np.int64)
    return out


def _block_row(rows: pa.RecordBatch, width: int) -> pa.RecordBatch:
    points = integers(rows.column("embedding"), width)
    columns = {
        "ids": pa.array([rows.column("vec_id").to_pylist()], pa.list_(pa.int64())),
        "labels": pa.array([rows.column("label").to_pylist()], pa.list_(pa.int32())),
        "points": pa.array([points.astype("<i4").tobytes()], pa.binary()),
    }
    for p, part in enumerate(np.split(points, PARTS, axis=1)):
        tree = cover_tree(part)
        columns[f"order{p}"] = pa.array([tree.order], pa.list_(pa.int32()))
        columns[f"nodes{p}"] = pa.array([np.concatenate(tree[1:6])], pa.list_(pa.int32()))
        columns[f"radius{p}"] = pa.array([tree.radius], pa.list_(pa.float64()))
    return pa.RecordBatch.from_pydict(columns)


def planted(rows: DataFrame, width: int, block: int = BLOCK) -> DataFrame:
    """Blocks of ``(vec_id, label, embedding)`` with their trees, one row each; written already."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                held.append(batch.slice(at, block))
                n += held[-1].num_rows
                while n >= block:
                    whole = pa.concat_batches(held)
                    yield _block_row(whole.slice(0, block), width)
                    held, n = [whole.slice(block)], n - block
        if n:
            yield _block_row(pa.concat_batches(held), width)

    return staged(rows.mapInArrow(build, _BLOCK_ROW), "trees")


def _opened(row: dict, width: int) -> Iterator[tuple[Tree, np.ndarray]]:
    """The tree and the points in tree order of each part position."""
    points = np.frombuffer(row["points"], dtype="<i4").reshape(len(row["ids"]), width).astype(np.int64)
    for p, part in enumerate(np.split(points, PARTS, axis=1)):
        nodes = np.array(row[f"nodes{p}"], dtype=np.int64).reshape(5, -1)
        tree = Tree(np.array(row[f"order{p}"], dtype=np.int64), *nodes, np.array(row[f"radius{p}"]))
        yield tree, part[tree.order]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield batch.slice(at, 1).to_pylist()[0]


def moved(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry the floored mean of its parts, an unused one as it was."""
    _, n_entries, size = books.shape
    sent = trees.sparkSession.sparkContext.broadcast(books)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for row in _rows(batches):
            for p, (tree, points) in enumerate(_opened(row, PARTS * size)):
                more = sums_of(assigned(tree, points, sent.value[p]), points, n_entries)
                sums[p] += more[0]
                counts[p] += more[1]
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array(part, pa.int32()),
                "entry": pa.array(entry, pa.int32()),
                "n": pa.array(counts[part, entry]),
                "sums": pa.array(list(sums[part, entry]), pa.list_(pa.int64())),
            }
        )

    rows = trees.mapInArrow(add, "part int, entry int, n bigint, sums array<bigint>")
    whole = rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(size)]).alias("sums"))
    out = books.copy()
    # At most one row per part position and entry.
    for row in whole.collect():
        out[row["part"], row["entry"]] = [s // row["n"] for s in row["sums"]]
    return out


def coded(trees: DataFrame, books: np.ndarray) -> DataFrame:
    """``(vec_id, label, code, error)`` of every vector under the given codebooks."""
    sent = trees.sparkSession.sparkContext.broadcast(books)
    width = PARTS * books.shape[2]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            codes, error = np.zeros((len(row["ids"]), PARTS), np.int64), np.zeros(len(row["ids"]), object)
            for p, (tree, points) in enumerate(_opened(row, width)):
                found = assigned(tree, points, sent.value[p]).code
                codes[tree.order, p] = found
                apart = (points - sent.value[p][found]).astype(object if np.abs(points).max(initial=0) > 1 << 24 else np.int64)
                error[tree.order] += (apart * apart).sum(axis=1)
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": pa.array(row["ids"], pa.int64()),
                    "label": pa.array(row["labels"], pa.int32()),
                    "code": pa.array([bytes(c).hex() for c in codes.astype(np.uint8)], pa.string()),
                    "error": pa.array([min(int(e), _MOST) for e in error], pa.int64()),
                }
            )

    return trees.mapInArrow(code, "vec_id bigint, label int, code string, error bigint")


def first_books(rows: DataFrame, width: int, entries: int = ENTRIES) -> np.ndarray:
    """The parts of the vectors with the smallest ids, ``(part position, entry, place)``."""
    first = rows.orderBy(F.col("vec_id").isNull(), "vec_id", "embedding").limit(entries).select("embedding").toArrow()
    points = integers(first["embedding"].combine_chunks(), width)
    return np.stack(np.split(points, PARTS, axis=1))


def compressed(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, label, code, error)`` of every usable vector, and the codebooks ``(part position, entry, place)``."""
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(label).cast("int").alias("label"), F.col(vector).alias("embedding"))
    rows = rows.where(usable(F.col("embedding")))
    width = -(-(rows.agg(F.max(F.size("embedding"))).first()[0] or 0) // PARTS) * PARTS
    books = first_books(rows, width)
    trees = planted(rows, width)
    if books.shape[1] > 0 and width > 0:
        for _ in range(rounds):
            books = moved(trees, books)
    return coded(trees, books), books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def audited(vectors: DataFrame) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)``."""
    found, books = compressed(vectors)
    rows = staged(found.withColumn("class", F.struct("label")), "codes")
    # Errors add up beyond long before they are held there.
    added = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_MOST).cast("decimal(38,0)")).cast("bigint")
    sums = staged(rows.groupBy("class").agg(F.count(F.lit(1)).alias("n"), added.alias("label_error")), "label_errors")
    out = join_groups(rows, sums, "class", "n", rows.count())
    return out.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    def nearest(name: str, books: str) -> str:
        apart = "x.sq - 2 * list_inner_product(x.v, e.v) + e.sq"
        return f"""
{name} AS MATERIALIZED (SELECT vec_id, label, part, min(d) AS d, arg_min(entry, d * 256 + entry) AS entry FROM (
  SELECT x.vec_id, x.label, x.part, e.entry, {apart} AS d FROM x JOIN {books} e ON x.part = e.part) GROUP BY ALL)"""

    def means(name: str, books: str, owner: str) -> str:
        return f"""
{name}_s AS (SELECT part, entry, j, sum(c)::HUGEINT AS s, count(*) AS n FROM (
  SELECT o.part, o.entry, unnest(x.v) AS c, unnest(range(len(x.v))) AS j FROM {owner} o JOIN x USING (vec_id, part)) GROUP BY ALL),
{name}_m AS (SELECT part, entry, list(floor_div ORDER BY j)::DOUBLE[] AS v FROM (
  SELECT part, entry, j, (s - ((s % n) + n) % n) // n AS floor_div FROM {name}_s) GROUP BY ALL),
{name} AS MATERIALIZED (SELECT part, entry, v, list_inner_product(v, v) AS sq FROM (
  SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM {books} b LEFT JOIN {name}_m m USING (part, entry)))"""

    steps = []
    for i in range(ROUNDS):
        steps += [nearest(f"o{i}", f"b{i}"), means(f"b{i + 1}", f"b{i}", f"o{i}")]
    steps.append(nearest("o", f"b{ROUNDS}"))
    chain = ",".join(steps)
    return f"""
WITH r AS (SELECT vec_id, label, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS MATERIALIZED (SELECT vec_id, label, part, v, list_inner_product(v, v) AS sq FROM (
  SELECT vec_id, label, p AS part, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS v FROM r, unnest(range({PARTS})) AS u(p))),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM r ORDER BY vec_id LIMIT {ENTRIES}),
b0 AS MATERIALIZED (SELECT part, entry, v, sq FROM f JOIN x USING (vec_id)),{chain},
c AS (SELECT vec_id, label, string_agg(printf('%02x', entry::INTEGER), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM o GROUP BY ALL),
h AS (SELECT sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY part, entry, j)) AS codebooks_sha256 FROM (
  SELECT part, entry, unnest(v) AS c, unnest(range(len(v))) AS j FROM b{ROUNDS}))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM c, h"""


@query("op11_vector_codes", _sql())
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(load(spark, sf_dir, "embeddings"))
