"""The k best corpus rows for every question, exactly, by any score.

Scores come from a scorer, a small object that turns one batch of corpus rows
into a score matrix. Pairs are never rows of a frame: a task keeps the k best
per question and sends only those on, so the shuffle carries k rows per
question and task. Two ways lead there, chosen by a size check of the question
side:

* it fits: it is broadcast and the corpus is scanned in place, unshuffled;
* it does not: both sides are cut into blocks and every block pair is one task.

Scores are rounded to six places before ranking and ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import Any, NamedTuple, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweft.operators.embedding import unit_rows
from docweft.operators.numbering import top_per_key
from docweft.operators.sizes import MAX_BROADCAST_BYTES, MAX_BROADCAST_ROWS, fits, measured

QUESTION_BLOCK = 16384
CORPUS_BLOCK = 65536
BLOCK_BYTES = 64 * 1024 * 1024
# Rows scored at once, and cells of one score matrix.
_STEP_ROWS = 2048
_STEP_CELLS = 1 << 20
# Scores are rounded to six places.
_TIE = 1e-6
# Pairs that are scored anew at once, and found rows that wait to be ranked at most.
_PAIRS = 1 << 15
_WAITING = 1 << 18
# Tasks per core of a corpus scan: each sends on k rows per question.
_TASKS_PER_CORE = 8

OUT = "side string, qid bigint, id bigint, score double"


class Scorer(Protocol):
    """Scores of all questions against a slice of corpus rows; -inf marks no match."""

    def prepare(self, questions: pa.Table) -> Any: ...

    def score(self, state: Any, corpus: pa.Table) -> np.ndarray: ...


class Matches(NamedTuple):
    """Ranked matches, how many a question has at most, and a bound on all where questions were checked."""

    frame: DataFrame
    per_question: int
    row_bound: int | None


def vector_matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as a double matrix, without per-row Python."""
    whole = column.combine_chunks()
    if isinstance(whole, pa.ChunkedArray):
        whole = pa.concat_arrays(whole.chunks) if whole.num_chunks else pa.array([], pa.list_(pa.float64()))
    if len(whole) == 0:
        return np.zeros((0, 0))
    sizes = pa.compute.list_value_length(whole)
    if whole.null_count or pa.compute.count_distinct(sizes).as_py() > 1 or whole.flatten().null_count:
        raise ValueError("vectors must be present, without null components and of one length")
    flat = whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(whole), -1)


def _cells(open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the few true cells; runs of cells without one are passed over."""
    flat = np.ascontiguousarray(open_).reshape(-1)
    whole = len(flat) // 64 * 64
    runs = np.flatnonzero(np.packbits(flat[:whole]).view(np.uint64))
    run, place = np.nonzero(flat[:whole].reshape(-1, 64)[runs])
    at = np.concatenate([runs[run] * 64 + place, whole + np.flatnonzero(flat[whole:])])
    return at // max(1, open_.shape[1]), at % max(1, open_.shape[1])


class CosineScorer:
    """Cosine between question and corpus vectors."""

    def __init__(self, question_column: str = "embedding", corpus_column: str = "embedding"):
        self.question_column = question_column
        self.corpus_column = corpus_column

    def prepare(self, questions: pa.Table) -> np.ndarray:
        return unit_rows(vector_matrix(questions[self.question_column]))

    def score(self, state: np.ndarray, corpus: pa.Table) -> np.ndarray:
        return state @ unit_rows(vector_matrix(corpus[self.corpus_column])).T


class Best:
    """The k best (score, id) per question seen so far in one task."""

    def __init__(self, qids: np.ndarray, k: int, exclude_self: bool, low: np.ndarray | None = None, points: np.ndarray | None = None):
        self.qids = qids
        self.k = k
        self.exclude_self = exclude_self
        # Rows below a question's ``low`` are known not to be among its best.
        self.low = np.full(len(qids), -np.inf) if low is None else low
        # The questions' vectors, of length one, where rows are met as vectors.
        self.points = points
        self.rough = None if points is None else points.astype(np.float32)
        self.scores = np.full((len(qids), k), -np.inf)
        self.ids = np.zeros((len(qids), k), dtype=np.int64)
        self.lists = np.zeros((len(qids), k), dtype=np.int32)
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.n_waiting = 0

    def meet(self, asked: np.ndarray, vectors: np.ndarray, ids: np.ndarray, list_: int = 0) -> None:
        """Questions at ``asked`` against rows of one list, vectors of length one, a bounded number of cells at a time.

        Single precision shows which pairs may stay; only those are scored in double precision.
        """
        rows = vectors.astype(np.float32)
        # An inner product of n terms is off by less than n + 2 roundings where both lengths are one.
        slack = _TIE + (rows.shape[1] + 4) * 2.0**-24
        step = max(1, _STEP_CELLS // max(1, len(ids)))
        for at in range(0, len(asked), step):
            some = asked[at : at + step]
            least = self._least(some)
            q, j = _cells(self._open(self.rough[some] @ rows.T, least, slack))
            parts = [slice(low, low + _PAIRS) for low in range(0, len(q), _PAIRS)]
            scores = [np.einsum("ij,ij->i", self.points[some[q[part]]], vectors[j[part]]) for part in parts]
            if scores:
                self._keep(np.concatenate(scores), q, j, least, ids, some, list_)

    def take(self, scores: np.ndarray, ids: np.ndarray, asked: np.ndarray | None = None, list_: int = 0) -> None:
        """Scores of all questions, or of those at ``asked``, against rows of one list."""
        asked = np.arange(len(self.qids)) if asked is None else asked
        least = self._least(asked)
        q, j = _cells(self._open(scores, least, _TIE))
        self._keep(scores[q, j], q, j, least, ids, asked, list_)

    def _least(self, asked: np.ndarray) -> np.ndarray:
        return np.maximum(self.scores[asked, -1], self.low[asked])

    def _open(self, scores: np.ndarray, least: np.ndarray, slack: float) -> np.ndarray:
        """Which cells may stay, where a score is off by less than ``slack``; only these are rounded."""
        open_ = scores >= (least - slack)[:, None].astype(scores.dtype)
        if np.isneginf(least).any():
            open_ &= scores > -np.inf
        kth = self.k + self.exclude_self
        if scores.shape[1] > kth and np.count_nonzero(open_) > 4 * len(scores) * self.k:
            # Nothing below the slice's own k-th score can be among the k best; ties stay.
            open_ &= scores >= np.partition(scores, -kth, axis=1)[:, [-kth]] - 2 * slack
        return open_

    def _keep(self, scores: np.ndarray, q: np.ndarray, j: np.ndarray, least: np.ndarray, ids: np.ndarray, asked: np.ndarray, list_: int) -> None:
        exact = np.round(scores, 6)
        stay = exact >= least[q]
        if self.exclude_self:
            stay &= self.qids[asked[q]] != ids[j]
        q, j, exact = q[stay], j[stay], exact[stay]
        if len(q) == 0:
            return
        self.waiting.append((asked[q], exact, ids[j], np.full(len(j), list_, np.int32)))
        self.n_waiting += len(q)
        # Rows wait while there is a least score, which they would only raise.
        if self.n_waiting > _WAITING or np.isneginf(least).any():
            self._merge()

    def _merge(self) -> None:
        if not self.waiting:
            return
        rows, scores, ids, lists = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        self.waiting, self.n_waiting = [], 0
        at = np.unique(rows)
        row = np.concatenate([np.repeat(at, self.k), rows])
        score = np.concatenate([self.scores[at].ravel(), scores])
        found = np.concatenate([self.ids[at].ravel(), ids])
        lists = np.concatenate([self.lists[at].ravel(), lists])
        order = np.lexsort((found, -score, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        best = place < self.k
        row, place, order = row[best], place[best], order[best]
        self.scores[row, place], self.ids[row, place], self.lists[row, place] = score[order], found[order], lists[order]

    def listed(self) -> pa.RecordBatch:
        """``(qid, id, score, list)``."""
        self._merge()
        q, j = np.nonzero(self.scores > -np.inf)
        return pa.RecordBatch.from_pydict(
            {
                "qid": pa.array(self.qids[q], pa.int64()),
                "id": pa.array(self.ids[q, j], pa.int64()),
                "score": pa.array(self.scores[q, j], pa.float64()),
                "list": pa.array(self.lists[q, j], pa.int32()),
            }
        )

    def rows(self, side: str) -> pa.RecordBatch:
        self._merge()
        q, j = np.nonzero(self.scores > -np.inf)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([side] * len(q), pa.string()),
                pa.array(self.qids[q], pa.int64()),
                pa.array(self.ids[q, j], pa.int64()),
                pa.array(self.scores[q, j], pa.float64()),
            ],
            names=["side", "qid", "id", "score"],
        )


def _scan(
    questions: pa.Table,
    batches: Iterator[pa.Table],
    scorers: Sequence[tuple[str, Scorer]],
    k: int,
    exclude_self: bool,
) -> Iterator[pa.RecordBatch]:
    if questions.num_rows == 0:
        return
    qids = questions["qid"].to_numpy()
    states = [(side, scorer, scorer.prepare(questions), Best(qids, k, exclude_self)) for side, scorer in scorers]
    step = max(1, min(_STEP_ROWS, _STEP_CELLS // len(qids)))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            ids = part["id"].to_numpy()
            for _, scorer, state, best in states:
                best.take(scorer.score(state, part), ids)
    for side, _, _, best in states:
        yield best.rows(side)


def _blocks(df: DataFrame, rows: int) -> int:
    """Into how many blocks a side is cut, so that none exceeds the row or byte size."""
    n, size = measured(df)
    return max(1, math.ceil(n / rows), math.ceil(size / BLOCK_BYTES))


def best_matches(
    questions: DataFrame,
    corpus: DataFrame,
    scorers: Sequence[tuple[str, Scorer]],
    k: int,
    exclude_self: bool = False,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
    question_block: int = QUESTION_BLOCK,
    corpus_block: int = CORPUS_BLOCK,
) -> Matches:
    """Ranked ``(side, qid, id, score, rk)``, at most ``k`` per side and question.

    ``questions`` has ``qid BIGINT``, ``corpus`` has ``id BIGINT``; further
    columns are what the scorers read.
    """
    scorers = list(scorers)
    n_questions = fits(questions, max_broadcast_rows)
    if n_questions is not None:
        sent = questions.sparkSession.sparkContext.broadcast(questions.toArrow())

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = (pa.Table.from_batches([b]) for b in batches)
            yield from _scan(sent.value, tables, scorers, k, exclude_self)

        tasks = corpus.sparkSession.sparkContext.defaultParallelism * _TASKS_PER_CORE
        partial = corpus.coalesce(tasks).mapInArrow(scan, OUT)
    else:
        partial = _block_scan(questions, corpus, scorers, k, exclude_self, question_block, corpus_block)
    order = [F.col("score").desc(), F.col("id")]
    ranked = top_per_key(partial, ["side", "qid"], order, k)
    per_question = k * len(scorers)
    return Matches(ranked, per_question, None if n_questions is None else n_questions * per_question)


def _block_scan(questions, corpus, scorers, k, exclude_self, question_block, corpus_block) -> DataFrame:
    """Every question block against every corpus block, one task-sized pair at a time."""
    q_blocks, c_blocks = _blocks(questions, question_block), _blocks(corpus, corpus_block)
    left = questions.withColumn("_qb", F.pmod(F.xxhash64("qid"), F.lit(q_blocks)).cast("int")).withColumn(
        "_cb", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1)))
    )
    right = corpus.withColumn("_cb", F.pmod(F.xxhash64("id"), F.lit(c_blocks)).cast("int")).withColumn(
        "_qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))
    )
    return block_pairs(left, right, ["_qb", "_cb"], scorers, k, exclude_self)


def block_pairs(left, right, keys, scorers, k, exclude_self) -> DataFrame:
    """Best matches inside each group that both sides share under ``keys``."""

    def pair(q: pa.Table, c: pa.Table) -> pa.Table:
        out = list(_scan(q, iter([c]), scorers, k, exclude_self))
        return pa.Table.from_batches(out) if out else _EMPTY

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(pair, OUT)


_EMPTY = pa.table(
    {
        "side": pa.array([], pa.string()),
        "qid": pa.array([], pa.int64()),
        "id": pa.array([], pa.int64()),
        "score": pa.array([], pa.float64()),
    }
)


def nearest(
    questions: DataFrame,
    corpus: DataFrame,
    k: int = 4,
    exclude_self: bool = False,
    **options,
) -> Matches:
    """Exact cosine neighbours: ``(qid, id, score, rk)``.

    Both sides carry ``embedding``. A filter on the corpus belongs before this
    call, so that k rows survive it.
    """
    found = best_matches(
        questions.select("qid", "embedding"),
        corpus.select("id", "embedding"),
        [("vector", CosineScorer())],
        k,
        exclude_self,
        **options,
    )
    return found._replace(frame=found.frame.drop("side"))


def attach(matches: Matches, corpus: DataFrame, on: str = "id") -> DataFrame:
    """Corpus columns for the matched ids; the corpus is not shuffled while matches are few.

    A match row is a handful of numbers.
    """
    bound = matches.row_bound
    if bound is not None and bound * 64 <= MAX_BROADCAST_BYTES:
        return corpus.join(F.broadcast(matches.frame), on)
    return corpus.join(matches.frame, on)
