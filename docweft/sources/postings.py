"""A keyword index: postings in blocks, each with the best a text of it can score.

A task gathers the texts it reads into blocks of at most ``BLOCK_TEXTS``, texts of similar length together.
A row holds the postings of one term in one block: ids, counts and lengths, how many
there are, and the largest gain among them. Rows lie in Parquet partitions by a hash of the term;
one partition more holds a row per block with the texts themselves.

A question reads the narrow columns of its own terms first. Their weighted best gains,
added up per block, bound every score in the block, so blocks below a known score
are never opened. The texts themselves are not read at question time.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.functions.text import words
from docweft.operators.embedding import coded_words
from docweft.operators.matching import Best
from docweft.operators.numbering import top_per_key
from docweft.session import staged
from docweft.sources.lists import best_rows, least_scores

K1 = 1.2
B = 0.75
BUCKETS = 16
BLOCK_TEXTS = 4096
# Scores are rounded to six places, so a bound this much lower may still tie.
_TIE = 1e-6

# Texts cut at once, and postings that a task holds back.
_STEP = 1024
_POSTINGS = 2_000_000
# Stands for no term; no word is empty.
NONE = ""

ROWS = "term string, block bigint, n bigint, best double, ids array<bigint>, tf array<int>, length array<int>, bucket int"
TEXTS = "id bigint, block bigint"


def asked_terms(questions: DataFrame) -> DataFrame:
    """The different words of each question."""
    return questions.select("qid", F.explode(F.array_distinct(words(F.col("text")))).alias("term"))


def _bucket(term: str):
    return (F.crc32(F.col(term).cast("binary")) % BUCKETS).cast("int")


class _Texts:
    """Texts of similar length whose postings one task gathers."""

    def __init__(self):
        self.ids, self.lengths, self.terms, self.at, self.tf = [], [], [], [], []
        self.n = self.postings = 0

    def add(self, ids: np.ndarray, lengths: np.ndarray, terms: pa.Array, at: np.ndarray, tf: np.ndarray) -> None:
        """Some texts, and their postings with the text's place among them."""
        for held, new in ((self.ids, ids), (self.lengths, lengths), (self.terms, terms), (self.at, at + self.n), (self.tf, tf)):
            held.append(new)
        self.n += len(ids)
        self.postings += len(tf)

    def block(self, number: int, mean_length: float) -> pa.RecordBatch:
        """One row per term, and one of no term for the texts themselves."""
        ids, lengths = np.concatenate(self.ids), np.concatenate(self.lengths)
        coded = pa.concat_arrays(self.terms).dictionary_encode()
        at, tf, code = np.concatenate(self.at), np.concatenate(self.tf), coded.indices.to_numpy()
        order = np.lexsort((ids[at], code))
        at, tf = at[order], tf[order]
        gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[at] / mean_length))
        terms = coded.dictionary.to_pylist()
        n = np.bincount(code, minlength=len(terms))
        begins = np.cumsum(n) - n
        best = np.maximum.reduceat(gain, begins) if len(terms) else np.zeros(0)
        ends = pa.array(np.concatenate([[0], np.cumsum(n), [len(at) + len(ids)]]), pa.int32())
        lists = ((ids[at], ids, pa.int64()), (tf, np.zeros(len(ids)), pa.int32()), (lengths[at], lengths, pa.int32()))
        values = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([one, two]).astype(kind.to_pandas_dtype()), kind)) for one, two, kind in lists]
        columns = {
            "term": pa.array([*terms, NONE], pa.string()),
            "block": pa.array(np.full(len(terms) + 1, number), pa.int64()),
            "n": pa.array(np.append(n, len(ids)), pa.int64()),
            "best": pa.array(np.append(best, 0.0)),
            **dict(zip(("ids", "tf", "length"), values, strict=True)),
            "bucket": pa.array([*(zlib.crc32(t.encode("utf-8")) % BUCKETS for t in terms), BUCKETS], pa.int32()),
        }
        return pa.RecordBatch.from_pydict(columns)


def _cut(batches: Iterator[pa.RecordBatch], number: int, block_texts: int, mean_length: float) -> Iterator[pa.RecordBatch]:
    """Blocks of ``(id, words)``, numbered on; what is held back is bounded in texts and postings."""
    held: dict[int, _Texts] = {}
    for whole in batches:
        for start in range(0, whole.num_rows, min(block_texts, _STEP)):
            batch = whole.slice(start, min(block_texts, _STEP))
            rows, codes, known = coded_words(batch.column("words"))
            pairs, tf = np.unique(rows * max(1, len(known)) + codes, return_counts=True)
            row, code = np.divmod(pairs, max(1, len(known)))
            terms, ids = pa.array(known, pa.string()), batch.column("id").to_numpy()
            lengths = np.bincount(rows, minlength=batch.num_rows)
            grade = np.floor(np.log2(lengths + 1)).astype(int)
            for g in np.unique(grade).tolist():
                texts = held.setdefault(g, _Texts())
                mine, own = grade == g, np.flatnonzero(grade[row] == g)
                if texts.n and texts.n + np.count_nonzero(mine) > block_texts:
                    yield held.pop(g).block(number, mean_length)
                    number, texts = number + 1, held.setdefault(g, _Texts())
                place = np.cumsum(mine) - 1
                texts.add(ids[mine], lengths[mine], terms.take(pa.array(code[own])), place[row[own]], tf[own])
            while sum(t.postings for t in held.values()) > _POSTINGS:
                largest = max(held, key=lambda g: held[g].postings)
                yield held.pop(largest).block(number, mean_length)
                number += 1
    for texts in held.values():
        yield texts.block(number, mean_length)
        number += 1


class Postings:
    def __init__(self, spark: SparkSession, path: str, n_texts: int, mean_length: float):
        self.spark = spark
        self.path = path
        self.n_texts = n_texts
        self.mean_length = mean_length

    @classmethod
    def build(cls, corpus: DataFrame, path: str, block_texts: int = BLOCK_TEXTS) -> Postings:
        """Index the words of ``(id, text)`` under ``path``; ids are unique."""
        spark = corpus.sparkSession
        cut = corpus.select("id", words(F.col("text")).alias("words"))
        total = cut.agg(F.count(F.lit(1)), F.sum(F.coalesce(F.size("words"), F.lit(0)))).first()
        n_texts, mean_length = total[0] or 0, max(total[1] or 0, 1) / max(total[0] or 0, 1)

        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _cut(batches, TaskContext.get().partitionId() << 32, block_texts, mean_length)

        # Blocks are made where the texts are read, so nothing is shuffled; one write holds postings and texts.
        rows = cut.mapInArrow(made, ROWS).sortWithinPartitions("bucket", "term")
        rows.write.partitionBy("bucket").parquet(f"{path}/postings")
        index = cls(spark, path, n_texts, mean_length)
        index.rows().where(F.col("bucket") == BUCKETS).select(F.explode("ids").alias("id"), "block").write.parquet(f"{path}/texts")
        return index

    def rows(self) -> DataFrame:
        return self.spark.read.schema(ROWS).parquet(f"{self.path}/postings")

    def asked(self, questions: DataFrame) -> Asked:
        """What a set of questions needs of the index: their own words, known on the driver, and the narrow columns of their postings, written once."""
        terms = asked_terms(questions).withColumn("bucket", _bucket("term")).toArrow()
        buckets = pa.compute.unique(terms["bucket"]).to_pylist()
        different = self.spark.createDataFrame(pa.table({"term": pa.compute.unique(terms["term"])}))
        heads = self.rows().where(F.col("bucket").isin(buckets)).select("term", "block", "n", "best")
        heads = staged(heads.join(F.broadcast(different), "term", "left_semi"), "heads")
        counts = heads.groupBy("term").agg(F.sum("n").alias("df")).toArrow()
        df = dict(zip(counts["term"].to_pylist(), counts["df"].to_pylist(), strict=True))
        known = [(q, t, math.log(1 + (self.n_texts - df[t] + 0.5) / (df[t] + 0.5))) for q, t in zip(terms["qid"].to_pylist(), terms["term"].to_pylist(), strict=True) if t in df]
        return Asked(self, known, heads, buckets)


def _gain(tf: str, length: str, mean_length: float):
    return F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(length) / mean_length))


SCORED = "qid bigint, id bigint, score double"
_SCORED = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])


class Asked:
    """Questions against a keyword index; ``weights`` holds their words and is sent to tasks."""

    def __init__(self, index: Postings, weights: list[tuple[int, str, float]], heads: DataFrame, buckets: list[int]):
        self.index = index
        self.buckets = buckets
        spark = index.spark
        columns = list(zip(*weights, strict=True)) or [(), (), ()]
        kinds = {"qid": pa.int64(), "term": pa.string(), "idf": pa.float64()}
        known = spark.createDataFrame(pa.table({n: pa.array(c, t) for (n, t), c in zip(kinds.items(), columns, strict=True)}))
        bounds = heads.join(F.broadcast(known), "term").groupBy("qid", "block")
        # No text of a block scores more than its bound, and ``n`` of them or more score.
        self.bounds = bounds.agg(F.sum(F.col("idf") * F.col("best")).alias("bound"), F.max("n").alias("n"))
        self.qids = np.unique(np.array([q for q, _, _ in weights], dtype=np.int64))
        place = dict(zip(self.qids.tolist(), range(len(self.qids)), strict=True))
        by_term: dict[str, list[tuple[int, float]]] = {}
        for q, term, idf in weights:
            by_term.setdefault(term, []).append((place[q], idf))
        held = {t: (np.array([q for q, _ in p], np.int64), np.array([w for _, w in p])) for t, p in by_term.items()}
        self.sent = spark.sparkContext.broadcast((self.qids, held))

    def _blocks(self, blocks: DataFrame, run: Callable[[np.ndarray, np.ndarray, np.ndarray, pa.Table], pa.Table], schema: str) -> DataFrame:
        """``run(qids, ids, scores, pairs)`` for the questions that the rows ``(qid, block, …)`` name, block by block.

        Only postings of asked terms in named blocks are shuffled, once for all questions.
        """
        sent, mean_length = self.sent, self.index.mean_length
        terms = self.index.spark.createDataFrame(pa.table({"term": pa.array(list(sent.value[1]), pa.string())}))
        rows = self.index.rows().where(F.col("bucket").isin(self.buckets)).select("term", "block", "ids", "tf", "length")
        rows = rows.join(F.broadcast(terms), "term", "left_semi").join(blocks.select("block").distinct(), "block", "left_semi")

        def score(postings: pa.Table, pairs: pa.Table) -> pa.Table:
            qids, weights = sent.value
            here = np.unique(pairs["qid"].to_numpy())
            local = np.full(len(qids), -1)
            local[np.searchsorted(qids, here)] = np.arange(len(here))
            lists = postings["ids"].combine_chunks()
            every, place = np.unique(lists.flatten().to_numpy(), return_inverse=True)
            tf, length = (postings[c].combine_chunks().flatten().to_numpy() for c in ("tf", "length"))
            gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))
            edges = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            scores = np.zeros((len(here), len(every)))
            for at, term in enumerate(postings["term"].to_pylist()):
                of, idf = weights[term]
                mine = local[of] >= 0
                part = slice(edges[at], edges[at + 1])
                scores[np.ix_(local[of[mine]], place[part])] += np.outer(idf[mine], gain[part])
            return run(here, every, np.round(scores, 6), pairs)

        return rows.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(score, schema)

    def first_blocks(self, k: int) -> DataFrame:
        """Per question the blocks of the highest bounds, so many that they hold ``k`` texts that score."""
        best = top_per_key(self.bounds, ["qid"], [F.col("bound").desc(), F.col("block")], k, "place")
        # At most k blocks per question are left here.
        before = F.expr("coalesce(sum(n) OVER (PARTITION BY qid ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)")
        return best.withColumn("before", before).where(F.col("before") < k).select("qid", "block")

    def reaching(self, lows: DataFrame) -> DataFrame:
        """``(qid, block)`` that may hold a text scoring the question's ``low`` or more; questions without one are read in full."""
        return self.bounds.join(F.broadcast(lows), "qid", "left").where(F.col("low").isNull() | (F.col("bound") >= F.col("low") - _TIE)).select("qid", "block")

    def best(self, k: int) -> pa.Table:
        """The ``k`` best texts per question, ``(qid, id, score, rk)``."""

        def top(qids: np.ndarray, ids: np.ndarray, scores: np.ndarray, _: pa.Table) -> pa.Table:
            best = Best(qids, k, False)
            best.take(np.where(scores > 0, scores, -np.inf), ids)
            return pa.Table.from_batches([best.listed()]).drop_columns("list")

        def found(blocks: DataFrame) -> pa.Table:
            ranked = top_per_key(self._blocks(blocks, top, SCORED), ["qid"], [F.col("score").desc(), F.col("id")], k)
            return ranked.drop("rk").toArrow().cast(_SCORED)

        spark = self.index.spark
        # At most k blocks per question.
        first = spark.createDataFrame(self.first_blocks(k).toArrow(), "qid bigint, block bigint")
        near = found(first)
        lows = pa.table({"qid": pa.array(self.qids), "low": pa.array(least_scores(self.qids, near, k))})
        more = self.reaching(spark.createDataFrame(lows)).join(F.broadcast(first), ["qid", "block"], "left_anti")
        return best_rows(pa.concat_tables([near, found(more)]), k)

    def of(self, pairs: DataFrame) -> DataFrame:
        """``(qid, id, score)`` of given ``(qid, id)``; those without an asked term are left out. The pairs are few."""
        texts = self.index.spark.read.schema(TEXTS).parquet(f"{self.index.path}/texts")
        placed = texts.join(F.broadcast(pairs), "id").select("qid", "id", "block").toArrow()
        placed = self.index.spark.createDataFrame(placed, "qid bigint, id bigint, block bigint")

        def pick(qids: np.ndarray, ids: np.ndarray, scores: np.ndarray, wanted: pa.Table) -> pa.Table:
            q, i = wanted["qid"].to_numpy(), wanted["id"].to_numpy()
            known = np.isin(i, ids)
            q, i = q[known], i[known]
            found = scores[np.searchsorted(qids, q), np.searchsorted(ids, i)]
            q, i, found = q[found > 0], i[found > 0], found[found > 0]
            return pa.table({"qid": pa.array(q, pa.int64()), "id": pa.array(i, pa.int64()), "score": pa.array(found, pa.float64())})

        return self._blocks(placed.where(F.col("qid").isin(self.qids.tolist())), pick, SCORED)

    def places(self, wanted: pa.Table) -> DataFrame:
        """``(qid, id, place)`` of given ``(qid, id, score)`` among all texts of their questions: better ones are counted, not sorted."""
        q, i, s = (wanted[c].to_numpy() for c in ("qid", "id", "score"))
        mine = {int(one): (s[q == one], i[q == one]) for one in np.unique(q)}
        lows = pa.table({"qid": pa.array(list(mine), pa.int64()), "low": pa.array([float(scores.min()) for scores, _ in mine.values()], pa.float64())})
        lows = self.index.spark.createDataFrame(lows)
        sent = self.index.spark.sparkContext.broadcast(mine)

        def count(qids: np.ndarray, ids: np.ndarray, scores: np.ndarray, _: pa.Table) -> pa.Table:
            out = []
            for at, one in enumerate(qids.tolist()):
                score, own = sent.value[one]
                row = scores[at]
                ahead = (row[:, None] > score) | ((row[:, None] == score) & (ids[:, None] < own))
                out.append((np.full(len(own), one), own, ahead.sum(axis=0)))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)]
            return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("qid", "id", "n"), columns, strict=True)})

        blocks = self.reaching(lows).join(F.broadcast(lows.select("qid")), "qid", "left_semi")
        counts = self._blocks(blocks, count, "qid bigint, id bigint, n bigint")
        return counts.groupBy("qid", "id").agg((F.sum("n") + 1).alias("place"))
