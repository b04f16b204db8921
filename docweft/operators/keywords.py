"""Keyword search (Okapi BM25), rank fusion and term-overlap reranking."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweft.functions.text import spaced, words
from docweft.operators.embedding import HashedWords, coded_words, pieces
from docweft.operators.matching import CosineScorer, Matches, best_matches
from docweft.operators.numbering import top_per_key
from docweft.operators.sizes import MAX_BROADCAST_BYTES, fits, sent
from docweft.session import staged
from docweft.sources.lists import ListIndex

K1 = 1.2
B = 0.75
FUSION = 60


MAX_TERMS = 500_000
# Questions that meet one copy of a text, about; a text that more are near to is dealt to several tasks.
CROWD = 512
_ENTRIES = 4_000_000
# Stands for "any text" among the terms; no word is empty.
ANY = ""


def asked_terms(questions: DataFrame) -> DataFrame:
    return questions.select("qid", F.explode(F.array_distinct(words(F.col("text")))).alias("term"))


def term_statistics(corpus: DataFrame, asked: DataFrame, text: str = "text") -> DataFrame:
    """``(term, df, length)`` of the asked terms in one pass over the corpus.

    ``df`` counts the texts a term occurs in. The term ``ANY`` counts all texts,
    and its ``length`` is their total length in words. Counts are summed per
    task before the shuffle, so a word found everywhere is one row per task. A
    checked list of terms drops all other words first; a longer one is joined
    to the finished counts.
    """
    # Exploded straight from the expression; an array column in between costs twice as much.
    found = corpus.select(words(F.col(text)).alias("w")).select(
        F.size("w").cast("bigint").alias("n"),
        F.explode(F.concat(F.array(F.lit(ANY)), F.array_distinct("w"))).alias("term"),
    )
    spark = corpus.sparkSession
    terms = asked.select("term").distinct().unionByName(spark.createDataFrame([(ANY,)], "term string"))
    few = fits(terms, MAX_TERMS) is not None
    if few:
        found = found.join(F.broadcast(terms), "term", "left_semi")
    length = F.sum(F.when(F.col("term") == ANY, F.col("n")))
    counted = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"), length.alias("length"))
    return counted if few else counted.join(terms, "term", "left_semi")


def weighted_terms(asked: DataFrame, statistics: DataFrame, n_texts: int) -> DataFrame:
    """Terms of each question with their inverse document frequency.

    Terms the corpus lacks are dropped: they score nothing.
    """
    weight = F.log(1 + (F.lit(float(n_texts)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = asked.join(sent(statistics, MAX_TERMS), "term").select("qid", "term", weight.alias("idf"))
    # A question's own distinct words: no larger than the question itself.
    return weighted.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("term", "idf"))).alias("t")).select(
        "qid", F.col("t.term").alias("terms"), F.col("t.idf").alias("idf")
    )


class KeywordScorer:
    """BM25 of whole texts against each question's weighted terms."""

    def __init__(self, mean_length: float):
        self.mean_length = mean_length

    def prepare(self, questions: pa.Table) -> dict[str, Any]:
        vocabulary: dict[str, int] = {}
        postings: list[list[tuple[int, float]]] = []
        pairs = zip(questions["terms"].to_pylist(), questions["idf"].to_pylist(), strict=True)
        for q, (terms, weights) in enumerate(pairs):
            for term, weight in zip(terms or [], weights or [], strict=True):
                slot = vocabulary.setdefault(term, len(vocabulary))
                if slot == len(postings):
                    postings.append([])
                postings[slot].append((q, weight))
        counts = np.array([len(p) for p in postings], dtype=np.int64)
        return {
            "n": questions.num_rows,
            "vocabulary": vocabulary,
            "count": counts,
            "start": np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64) if len(counts) else counts,
            "question": np.array([q for p in postings for q, _ in p], dtype=np.int64),
            "idf": np.array([w for p in postings for _, w in p]),
        }

    def score(self, state: dict[str, Any], corpus: pa.Table) -> np.ndarray:
        n_texts, vocabulary = corpus.num_rows, state["vocabulary"]
        rows, codes, known = coded_words(corpus["words"])
        lengths = np.bincount(rows, minlength=n_texts)
        slots = np.array([vocabulary.get(w, -1) for w in known], dtype=np.int64)[codes] if known else codes
        held = slots >= 0
        if not held.any():
            return np.full((state["n"], n_texts), -np.inf)
        pairs, tf = np.unique(rows[held] * len(vocabulary) + slots[held], return_counts=True)
        text, slot = np.divmod(pairs, len(vocabulary))
        gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[text] / self.mean_length))
        count = state["count"][slot]
        total = np.zeros(state["n"] * n_texts)
        # One entry per (text, term, question), a bounded number of them at a time.
        cuts = np.searchsorted(np.cumsum(count), np.arange(_ENTRIES, count.sum() + _ENTRIES, _ENTRIES), side="right")
        for low, high in zip(np.concatenate([[0], cuts[:-1]]), cuts, strict=True):
            c = count[low:high]
            first = np.repeat(state["start"][slot[low:high]] - (np.cumsum(c) - c), c)
            at = first + np.arange(c.sum())
            cell = state["question"][at] * n_texts + np.repeat(text[low:high], c)
            total += np.bincount(cell, np.repeat(gain[low:high], c) * state["idf"][at], len(total))
        # Weights are positive, so a total of zero means no shared term.
        return np.where(total > 0, total, -np.inf).reshape(state["n"], n_texts)


class WordVectorScorer(CosineScorer):
    """Cosine of the stand-in embedding, taken from the words of the corpus batch."""

    def prepare(self, questions: pa.Table) -> tuple[np.ndarray, HashedWords]:
        return super().prepare(questions), HashedWords()

    def score(self, state: tuple[np.ndarray, HashedWords], corpus: pa.Table) -> np.ndarray:
        matrix, model = state
        return matrix @ model.of_words(corpus["words"]).T


def hybrid_ranks(questions: DataFrame, corpus: DataFrame, depth: int, **options) -> Matches:
    """Best ``depth`` per side (vector, keyword) in one scan of the corpus."""
    terms = asked_terms(questions)
    statistics = staged(term_statistics(corpus, terms), "terms")
    n_texts, length = statistics.where(F.col("term") == ANY).select("df", "length").first() or (0, 0)
    weighted = weighted_terms(terms, statistics, n_texts)
    asked = questions.select("qid", "embedding").join(weighted, "qid", "left")
    return best_matches(
        asked,
        corpus.select("id", words(F.col("text")).alias("words")),
        [("vector", WordVectorScorer()), ("keyword", KeywordScorer(max(length, 1) / max(n_texts, 1)))],
        depth,
        **options,
    )


def fused(ranks: DataFrame, k: int, constant: int = FUSION) -> DataFrame:
    """Reciprocal-rank fusion: ``(qid, id, score, rk)``; ties to the smaller id."""
    share = 1 / (F.lit(float(constant)) + F.col("rk"))
    both = ranks.groupBy("qid", "id").agg(F.round(F.sum(share), 6).alias("score"))
    return top_per_key(both, ["qid"], [F.col("score").desc(), F.col("id")], k)


def hybrid(questions: DataFrame, corpus: DataFrame, k: int = 5, depth: int = 20, **options) -> DataFrame:
    return fused(hybrid_ranks(questions, corpus, depth, **options).frame, k)


def reranked(questions: DataFrame, corpus: DataFrame, candidates: Matches, keep: int, tasks: int | None = None) -> Matches:
    """Candidates rescored by how many different question words they hold.

    ``(qid, id, overlap, rk)``, best ``keep`` per question, ties to the smaller id.
    The question's words meet the candidates first, so that a text is read and
    scored where it lies, or dealt to ``tasks`` once it is cut, and only counts are
    shuffled. Where there are too many words for that, texts and words are dealt by
    id and each text is cut once.
    """
    # Words hold no blank, and as one string they travel in half the bytes of an array.
    asked = questions.select("qid", F.array_join(F.array_distinct(words(F.col("text"))), " ").alias("_asked"))
    more = [c for c in ("list",) if c in corpus.columns]
    # A question travels once per candidate.
    if candidates.row_bound is not None and fits(asked, max_bytes=MAX_BROADCAST_BYTES // candidates.per_question):
        wanted = candidates.frame.select("qid", "id").join(asked, "qid")
        texts = corpus.select("id", *more, words(F.col("text")).alias("_words"))
        texts = (texts if tasks is None else texts.repartition(tasks, "id")).join(F.broadcast(wanted), "id")
        # The set is made of the second array, here the shorter one.
        overlap = F.size(F.array_intersect("_words", F.split("_asked", " "))).cast("bigint")
        scored = texts.select("qid", "id", *more, overlap.alias("overlap"))
    else:
        # Dealt by question, or Spark takes the words from the text anew for each candidate, inside the join.
        wanted = candidates.frame.select("qid", "id").join(asked.repartition("qid"), "qid")
        crowds = candidates.frame.groupBy("id").agg(F.ceil(F.count(F.lit(1)) / CROWD).alias("_parts")).where("_parts > 1")
        parts = F.coalesce("_parts", F.lit(1).cast("bigint"))
        texts = corpus.select("id", F.lit(None).cast("bigint").alias("qid"), *more, spaced(F.col("text")).alias("said"))
        texts = texts.join(F.broadcast(crowds), "id", "left").select(*texts.columns, F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("_part"))
        none = [F.lit(None).cast(corpus.schema[c].dataType).alias(c) for c in more]
        part = F.pmod(F.xxhash64("qid"), parts).alias("_part")
        wanted = wanted.join(F.broadcast(crowds), "id", "left").select("id", "qid", *none, F.col("_asked").alias("said"), part)
        scored = _overlaps(texts.unionByName(wanted), more)
    ranked = top_per_key(scored, ["qid"], [F.col("overlap").desc(), F.col("id")], keep)
    bound = candidates.row_bound
    return Matches(ranked, keep, None if bound is None else bound // candidates.per_question * keep)


def _overlaps(rows: DataFrame, more: list[str]) -> DataFrame:
    """``(qid, id, …, overlap)`` of texts ``(id, …, said)``, whose ``qid`` is null, and questions ``(id, qid, said)`` of different words.

    A text stands in each ``_part`` of its questions. Ids are keys.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in (whole.slice(*piece) for whole in batches for piece in pieces(whole.column("said"))):
            # The text that the first questions meet may have come before.
            table = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks()
            is_text = table["qid"].is_null().to_numpy()
            begins = np.flatnonzero(is_text)
            if len(begins):
                n_texts = np.cumsum(is_text)
                met = begins[np.maximum(n_texts - 1, 0)]
                said, ids = table["said"].combine_chunks(), table["id"].to_numpy()
                none = said.is_null().to_numpy(zero_copy_only=False)
                overlap = pa.array(shared_counts(said, begins), pa.int64(), mask=none | none[met])
                columns = {c: table[c].take(pa.array(met)) for c in more}
                out = pa.table({"qid": table["qid"], "id": table["id"], **columns, "overlap": overlap})
                yield from out.filter(pa.array(~is_text & (n_texts > 0) & (ids == ids[met]))).combine_chunks().to_batches()
                last = table.slice(begins[-1], 1).to_batches()[0]
        pa.default_memory_pool().release_unused()

    dealt = rows.repartition("id", "_part").sortWithinPartitions("id", "_part", F.col("qid").asc_nulls_first())
    kinds = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in more)
    return dealt.mapInArrow(count, f"qid bigint, id bigint{kinds}, overlap bigint")


def shared_counts(said: pa.Array, begins: np.ndarray) -> np.ndarray:
    """How many of a row's words stand in the text before it; texts are the rows at ``begins``, words stand between spaces."""
    cut = pa.compute.split_pattern(said, " ")
    coded = cut.flatten().dictionary_encode()
    code = coded.indices.to_numpy()
    ends = np.concatenate([[0], np.cumsum(cut.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    empty = pa.compute.index(coded.dictionary, "").as_py()
    counts, held = np.zeros(len(said), np.int64), np.zeros(len(coded.dictionary), bool)
    for text, after in zip(begins.tolist(), [*begins[1:].tolist(), len(said)], strict=True):
        if after - text > 1:
            own = code[ends[text] : ends[text + 1]]
            held[own] = True
            if empty >= 0:
                held[empty] = False
            found = np.concatenate([[0], np.cumsum(held[code[ends[text + 1] : ends[after]]])])
            counts[text + 1 : after] = np.diff(found[ends[text + 1 : after + 1] - ends[text + 1]])
            held[own] = False
    return counts


def reranked_in(index: ListIndex, questions: DataFrame, candidates: Matches, keep: int) -> Matches:
    """As :func:`reranked`, over the lists the candidates were found in; ``list`` stays."""
    corpus = index.lists_of(candidates, "id", "text")
    if candidates.row_bound is None:
        return reranked(questions, corpus, candidates, keep)
    # Texts that many questions are near to lie in the same lists: each is cut once, then dealt to all tasks.
    corpus = corpus.join(F.broadcast(candidates.frame.select("list", "id").distinct()), ["list", "id"], "left_semi")
    return reranked(questions, corpus, candidates, keep, 4 * index.spark.sparkContext.defaultParallelism)
