"""Approximate nearest neighbours over learned partitions.

Equal vectors are folded first; of each, the ``k + 1`` smallest ids can ever be
answers. Learning takes a bounded sample of distinct vectors: its neighbour graph
is cut in two again and again, into halves of equal size with few edges between
them (spectral order, then exchanges that cut fewer edges), and a small network
learns which part a vector belongs to. Every vector is indexed under its most
probable part. A query goes to its most probable parts, as many as hold
``RECALL`` of the graph's edges, and is ranked there against all members in
double precision. Queries lie in blocks by their first part, members in chunks by
their part; a block meets a chunk once, if one of its queries visits a part of it,
and gives the best of all those parts together. So a task is bounded, a part that
holds most vectors is spread over tasks, and what goes on follows the queries and
not the parts they visit.

Defined cases: vectors that are null, zero, hold null or non-finite components,
or have another length than most take no part, nor do rows without an id. Ties
go to the smaller id. An id's repeated rows are no candidates of its own query.
Where all candidates are fewer than ``k``, all are returned; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.llm.common import join_groups, query, staged
from docweft.operators.numbering import top_per_key
from docweft.sources.tables import load

K = 20
EVERY = 20
SAMPLE = 8192
GRAPH = 20
PART_ROWS = 2048
MOST_PARTS = 256
HIDDEN = 64
RECALL = 0.985
BLOCK = 4096
CHUNK_BYTES = 32 << 20
#: Scored pairs that a task holds before it keeps the best only.
HELD = 1 << 21


class Router(NamedTuple):
    """A network of one hidden layer from vectors to parts."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    def logits(self, vectors: np.ndarray) -> np.ndarray:
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        return np.tanh(unit @ self.w1 + self.b1) @ self.w2 + self.b2


def neighbour_graph(vectors: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` rows of largest inner product beside each row."""
    out = np.zeros((len(vectors), min(k, len(vectors) - 1)), dtype=np.int64)
    for start in range(0, len(vectors), 1024):
        scores = vectors[start : start + 1024] @ vectors.T
        scores[np.arange(len(scores)), np.arange(start, start + len(scores))] = -np.inf
        out[start : start + 1024] = np.argpartition(-scores, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def _halves(nodes: np.ndarray, graph: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of equal size with few edges between them."""
    place = np.full(graph.shape[0], -1)
    place[nodes] = np.arange(len(nodes))
    to = place[graph[nodes]].ravel()
    source = np.repeat(np.arange(len(nodes)), graph.shape[1])[to >= 0]
    to = to[to >= 0]
    a, b = np.concatenate([source, to]), np.concatenate([to, source])
    degree = np.maximum(np.bincount(a, minlength=len(nodes)), 1).astype(float)

    def summed(x: np.ndarray) -> np.ndarray:
        return np.bincount(a, x[b], len(nodes))

    x = rng.standard_normal(len(nodes))
    for _ in range(60):
        x = 0.5 * x + 0.5 * summed(x) / degree
        x -= (x * degree).sum() / degree.sum()
        x /= np.linalg.norm(x) + 1e-30
    side = np.zeros(len(nodes), dtype=bool)
    side[np.argsort(x, kind="stable")[len(nodes) // 2 :]] = True
    for _ in range(10):
        gain = np.where(side, -1, 1) * (2 * summed(side.astype(float)) - summed(np.ones(len(nodes))))
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        n = min(len(left), len(right), max(1, len(nodes) // 50))
        better = gain[left[:n]] + gain[right[:n]] > 0
        if not better.any():
            break
        side[left[:n][better]], side[right[:n][better]] = True, False
    return nodes[~side], nodes[side]


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 7) -> np.ndarray:
    """A part per node; ``parts`` is a power of two."""
    rng = np.random.default_rng(seed)
    groups = [np.arange(graph.shape[0])]
    while len(groups) < parts:
        groups = [half for group in groups for half in _halves(group, graph, rng)]
    label = np.zeros(graph.shape[0], dtype=np.int64)
    for number, group in enumerate(groups):
        label[group] = number
    return label


def trained(vectors: np.ndarray, label: np.ndarray, parts: int, epochs: int = 40, seed: int = 11) -> Router:
    """Softmax training with Adam in mini-batches."""
    rng = np.random.default_rng(seed)
    dim = vectors.shape[1]
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    weights = [rng.standard_normal((dim, HIDDEN)), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, parts)) / math.sqrt(HIDDEN), np.zeros(parts)]
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(unit))
        for start in range(0, len(order), 128):
            at = order[start : start + 128]
            x = unit[at]
            hidden = np.tanh(x @ weights[0] + weights[1])
            out = hidden @ weights[2] + weights[3]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            out /= out.sum(axis=1, keepdims=True)
            out[np.arange(len(at)), label[at]] -= 1
            out /= len(at)
            back = (out @ weights[2].T) * (1 - hidden**2)
            step += 1
            rate = 0.01 * (1 - epoch / epochs)
            for i, g in enumerate((x.T @ back, back.sum(axis=0), hidden.T @ out, out.sum(axis=0))):
                mean[i] = 0.9 * mean[i] + 0.1 * g
                square[i] = 0.999 * square[i] + 0.001 * g * g
                weights[i] = weights[i] - rate * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)
    return Router(*weights, probes=1)


def learn(vectors: np.ndarray, total: int) -> Router:
    """A router from a bounded sample, for ``total`` distinct vectors."""
    dim = vectors.shape[1] if vectors.size else 1
    parts = 1 << max(0, round(math.log2(max(1, min(MOST_PARTS, total / PART_ROWS, len(vectors) / 32)))))
    if parts == 1:
        return Router(np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    graph = neighbour_graph(vectors, GRAPH)
    router = trained(vectors, balanced_parts(graph, parts), parts)
    logits = router.logits(vectors)
    home = logits.argmax(axis=1)
    rank = np.argsort(np.argsort(-logits, axis=1, kind="stable"), axis=1, kind="stable")
    needed = np.take_along_axis(rank, home[graph], axis=1)
    held = np.cumsum(np.bincount(needed.ravel(), minlength=parts)) / needed.size
    return router._replace(probes=int(np.searchsorted(held, RECALL)) + 1)


def sound(vector: str) -> Column:
    """Whether a vector may take part, but for its length."""
    return F.expr(
        f"{vector} IS NOT NULL AND forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) "
        f"AND exists({vector}, x -> x <> 0)"
    )


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _routed(vectors: DataFrame, router: Router, probes: int, members: np.ndarray | None, least: int) -> DataFrame:
    """``vectors`` with the parts to visit, most probable first; further ones where the first hold fewer than ``least`` ids."""
    sent = vectors.sparkSession.sparkContext.broadcast((router, members))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, sizes = sent.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            order = np.argsort(-model.logits(_matrix(batch.column("embedding"))), axis=1, kind="stable")
            visit = np.broadcast_to(np.arange(order.shape[1]) < probes, order.shape)
            if sizes is not None:
                before = np.cumsum(sizes[order], axis=1) - sizes[order]
                visit = visit | (before < least)
            ends = np.concatenate([[0], np.cumsum(visit.sum(axis=1))]).astype(np.int32)
            parts = pa.ListArray.from_arrays(pa.array(ends), pa.array(order[visit].astype(np.int32)))
            yield batch.append_column("parts", parts)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields)
    return vectors.mapInArrow(route, f"{fields}, parts array<int>").withColumn("part", F.col("parts")[0])


_FOUND = "q bigint, score double, low bigint, ids array<bigint>"


def nearest(rows: DataFrame, asked: Column, k: int = K, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for the rows where ``asked`` holds, against all rows."""
    rows = rows.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).alias("embedding"), asked.alias("asked"))
    rows = rows.where(F.col("vec_id").isNotNull() & sound("embedding"))
    sizes = rows.groupBy(F.size("embedding").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    usual = sizes.orderBy(F.desc("n"), "size").first()
    rows = rows.where(F.size("embedding") == (usual["size"] if usual else 0))
    few = top_per_key(rows.select("embedding", "vec_id").distinct(), ["embedding"], [F.col("vec_id")], k + 1)
    folded = few.groupBy("embedding").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    folded = staged(folded.withColumn("at", F.monotonically_increasing_id()), "vectors")
    total = folded.count()
    sample = folded.select("embedding", "at").orderBy(F.xxhash64("embedding"), "at").limit(SAMPLE).toArrow()
    router = learn(_matrix(sample.column("embedding").combine_chunks()) if total else np.zeros((0, 1)), total)
    index = staged(_routed(folded, router, 1, None, 0).drop("parts"), "index")
    members = {r["part"]: (r["n"], r["ids"]) for r in index.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("ids")).alias("ids")).collect()}
    parts = len(router.b2)
    n, held = (np.array([members.get(p, (0, 0))[i] for p in range(parts)]) for i in (0, 1))
    queries = rows.where("asked").select("vec_id", "embedding")
    distinct = queries.groupBy("embedding").agg(F.count(F.lit(1)).alias("uses"))
    distinct = staged(distinct.withColumn("q", F.monotonically_increasing_id()), "queries")
    routed = staged(_routed(distinct.select("q", "embedding"), router, router.probes, held, k + 1), "routed")
    # At most a row per pair of parts.
    visits = routed.select("part", F.explode("parts").alias("to")).groupBy("part", "to").agg(F.count(F.lit(1)).alias("n")).collect()
    asked, reach = np.zeros(parts, np.int64), np.zeros((parts, parts), bool)
    for r in visits:
        reach[r["part"], r["to"]] = True
        if r["part"] == r["to"]:
            asked[r["part"]] = r["n"]
    chunk = max(256, CHUNK_BYTES // (8 * (usual["size"] if usual else 1)))
    blocks, chunks = Slots.of(asked, min(BLOCK, chunk)), Slots.of(n, chunk)
    found = _scored(_dealt(routed, "q", blocks, chunks, reach, True), _dealt(index, "at", chunks, blocks, reach.T, False), k)
    best = top_per_key(found, ["q"], [F.desc("score"), F.col("low")], k + 1)
    each = best.select("q", F.explode(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("below"), i.alias("vec_id")))).alias("x"))
    lists = each.groupBy("q").agg(F.slice(F.sort_array(F.collect_set("x")), 1, k + 1).alias("near"))
    answered = distinct.join(lists, "q").select("embedding", "uses", "near")
    out = join_groups(queries.select("vec_id", "embedding").distinct(), staged(answered, "answers"), "embedding", "uses", queries.count())
    own = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("vec_id")), 1, k)
    out = out.select(F.col("vec_id").alias("query_id"), F.posexplode(own).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", (-F.col("x.below")).alias("score"))


class Slots(NamedTuple):
    """Rows of a part in a row of slots, part after part, cut into groups of bounded size."""

    start: np.ndarray  # the first slot of each part
    rows: np.ndarray
    size: int

    @classmethod
    def of(cls, rows: np.ndarray, size: int) -> Slots:
        return cls(np.cumsum(rows) - rows, rows, size)

    def groups(self, parts: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of the groups that hold rows of the given parts, apart from each other."""
        out: list[tuple[int, int]] = []
        for p in np.flatnonzero(parts & (self.rows > 0)):
            low, high = int(self.start[p]) // self.size, int(self.start[p] + self.rows[p] - 1) // self.size
            if out and low <= out[-1][1] + 1:
                out[-1] = (out[-1][0], max(high, out[-1][1]))
            else:
                out.append((low, high))
        return out


def _dealt(rows: DataFrame, key: str, own: Slots, others: Slots, reach: np.ndarray, first: bool) -> DataFrame:
    """Each row in its own group, once for every group of the other side that its part has to do with."""
    about = [(p, int(own.start[p]), int(own.rows[p]), others.groups(reach[p])) for p in range(len(reach)) if own.rows[p]]
    table = rows.sparkSession.createDataFrame(about, "part int, start bigint, n bigint, ranges array<struct<low: bigint, high: bigint>>")
    dealt = rows.join(F.broadcast(table), "part").withColumn("mine", F.expr(f"(start + pmod(xxhash64({key}), n)) div {own.size}"))
    dealt = dealt.withColumn("other", F.explode(F.flatten(F.transform("ranges", lambda r: F.sequence(r["low"], r["high"])))))
    return dealt.withColumnsRenamed({"mine": "qb", "other": "cb"} if first else {"mine": "cb", "other": "qb"})


def _best(who: np.ndarray, at: np.ndarray, score: np.ndarray, low: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores of each query, ties to the smaller ``low``."""
    order = np.lexsort((low[at], -score, who))
    ordered = who[order]
    return order[np.arange(len(order)) - np.searchsorted(ordered, ordered) < k]


def _scored(queries: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """The ``k + 1`` best distinct vectors per query in each pair of a block and a chunk, among members of the parts it visits."""

    def pair(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "low": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64()))})
        vectors, wanted = (_matrix(t.column("embedding").combine_chunks()) for t in (held, asked))
        ids, visited = held.column("ids").combine_chunks(), asked.column("parts").combine_chunks()
        low, part = ids.flatten().to_numpy()[ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()], held.column("part").to_numpy()
        visitor, visits = np.repeat(np.arange(asked.num_rows), visited.value_lengths().to_numpy()), visited.flatten().to_numpy()
        top = np.full((asked.num_rows, k + 1), -np.inf)
        who, at, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        kept, pending = [], 0
        for p in np.unique(part):
            mine, those = np.flatnonzero(part == p), visitor[visits == p]
            for start in range(0, len(mine), BLOCK):
                near = mine[start : start + BLOCK]
                for begin in range(0, len(those), 512):
                    some = those[begin : begin + 512]
                    scores = wanted[some] @ vectors[near].T
                    # The bound of what was scored so far lets few through.
                    top[some] = np.partition(np.concatenate([top[some], scores], axis=1), -k - 1, axis=1)[:, -k - 1 :]
                    row, column = np.nonzero(scores >= top[some].min(axis=1, keepdims=True))
                    kept.append((some[row], near[column], scores[row, column]))
                    pending += len(row)
                    if pending > HELD:
                        who, at, score = (np.concatenate([a, *b]) for a, b in zip((who, at, score), zip(*kept, strict=True), strict=True))
                        best = _best(who, at, score, low, k + 1)
                        who, at, score, kept, pending = who[best], at[best], score[best], [], 0
        if kept:
            who, at, score = (np.concatenate([a, *b]) for a, b in zip((who, at, score), zip(*kept, strict=True), strict=True))
        best = _best(who, at, score, low, k + 1)
        names = asked.column("q").to_numpy()
        return pa.table({"q": names[who[best]], "score": score[best], "low": low[at[best]], "ids": ids.take(pa.array(at[best]))})

    left = queries.select("qb", "cb", "q", "embedding", "parts").groupBy("qb", "cb")
    return left.cogroup(members.select("qb", "cb", "part", "embedding", "ids").groupBy("qb", "cb")).applyInArrow(pair, _FOUND)


@query("op2_neighbours")
def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(load(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
