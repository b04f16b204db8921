"""The keyword index and fusion without a depth, against plain counting."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F
from test_queries import plan_of

from docweft.operators.embedding import embed
from docweft.operators.fusion import contenders, fused
from docweft.plans import QUERIES, stored
from docweft.session import fresh_path, staged
from docweft.sources import postings as postings_module
from docweft.sources.lists import ListIndex
from docweft.sources.postings import Postings


def texts(n, seed=1):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    return [" ".join(draw.choices(words, weights, k=draw.choice([1, 3, 8, 40, 200]))) for _ in range(n)] + ["", None, "W1  w1\tw2\n", "w1 w1 w2"]


def bm25(corpus, question):
    cut = [(t or "").lower().split() for t in corpus]
    mean = max(sum(map(len, cut)), 1) / len(cut)
    df = Counter(w for words in cut for w in set(words))
    out = {}
    for at, words in enumerate(cut):
        tf = Counter(words)
        parts = [
            math.log(1 + (len(cut) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(words) / mean))
            for w in set((question or "").lower().split())
            if tf[w]
        ]
        if parts:
            out[at] = round(sum(parts), 6)
    return out


QUESTIONS = ["w0 w1", "w7 w33 w59", "w59", "unknown words", "", None, "w2 w2 W2", "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9"]


@pytest.fixture(scope="module")
def corpus(spark):
    made = texts(400)
    rows = spark.createDataFrame(list(enumerate(made)), "id bigint, text string").repartition(3)
    asked = spark.createDataFrame(list(enumerate(QUESTIONS)), "qid bigint, text string")
    return made, rows, asked.withColumn("embedding", embed(F.col("text")))


@pytest.fixture(scope="module")
def postings(spark, corpus):
    return Postings.build(corpus[1], fresh_path(spark, "postings"), block_texts=16)


@pytest.mark.parametrize("k", [1, 7, 1000])
def test_best_texts_equal_plain_scores(corpus, postings, k):
    made, _, asked = corpus
    rows = postings.asked(asked).best(k).to_pylist()
    for q, question in enumerate(QUESTIONS):
        ranked = sorted(bm25(made, question).items(), key=lambda x: (-x[1], x[0]))[:k]
        got = [(r["id"], r["rk"]) for r in rows if r["qid"] == q]
        assert got == [(i, at) for at, (i, _) in enumerate(ranked, 1)]


def test_bounds_hold_and_blocks_are_skipped(corpus, postings):
    made, _, asked = corpus
    questions = postings.asked(asked)
    bounds = {(r.qid, r.block): r.bound for r in questions.bounds.collect()}
    block = {r.id: r.block for r in postings.spark.read.parquet(f"{postings.path}/texts").collect()}
    for q, question in enumerate(QUESTIONS):
        for i, score in bm25(made, question).items():
            assert score <= bounds[q, block[i]] + 1e-6
    low = sorted(bm25(made, QUESTIONS[1]).values(), reverse=True)[2]
    lows = postings.spark.createDataFrame([(1, low)], "qid bigint, low double")
    mine = [b for q, b in bounds if q == 1]
    read = questions.reaching(lows).where("qid = 1").count()
    assert len(mine) > 10 and read < len(mine) * 2 / 3


def test_places_and_scores_of_given_texts(spark, corpus, postings):
    made, _, asked = corpus
    questions = postings.asked(asked)
    pairs = [(0, i) for i in (3, 50, 399, 402, 400)] + [(1, 7), (3, 1), (7, 0)]
    got = {(r.qid, r.id): r.score for r in questions.of(spark.createDataFrame(pairs, "qid bigint, id bigint")).collect()}
    want = {(q, i): s for q, i in pairs for s in [bm25(made, QUESTIONS[q]).get(i)] if s}
    assert got == want
    table = questions.of(spark.createDataFrame(pairs, "qid bigint, id bigint")).toArrow()
    for r in questions.places(table).collect():
        ranked = sorted(bm25(made, QUESTIONS[r.qid]).items(), key=lambda x: (-x[1], x[0]))
        assert [i for i, _ in ranked].index(r.id) + 1 == r.place


def test_contenders_keep_every_winner():
    draw = np.random.default_rng(0)
    for depth in (2, 10, 30):
        for _ in range(40):
            n, k = 60, 3
            sides = [dict(zip(draw.permutation(n).tolist(), range(1, n + 1), strict=True)) for _ in range(2)]
            read = [{i: p for i, p in side.items() if p <= depth} for side in sides]
            whole = sorted(range(n), key=lambda i: (-round(sum(1 / (60 + s[i]) for s in sides), 6), i))[:k]
            seen = read[0].keys() | read[1].keys()
            assert {i for i in whole if i in seen} <= contenders(*read, depth, k)


@pytest.mark.parametrize(("k", "most"), [(5, 1024), (1, 3)])
def test_fusion_has_no_depth(spark, corpus, postings, k, most):
    made, rows, asked = corpus
    vectors = ListIndex.build(rows.withColumn("embedding", embed(F.col("text"))), fresh_path(spark, "lists"))
    got = {(r.qid, r.id, r.score, r.rk) for r in fused(asked, vectors, postings, k, most=most).collect()}
    everything = vectors.nearest(asked, len(made)).frame.where("score > 0").collect()
    want = set()
    for q, question in enumerate(QUESTIONS):
        near = {r.id: r.rk for r in everything if r.qid == q}
        said = {i: at for at, (i, _) in enumerate(sorted(bm25(made, question).items(), key=lambda x: (-x[1], x[0])), 1)}
        scores = {i: round(sum(1 / (60 + side[i]) for side in (near, said) if i in side), 6) for i in near.keys() | said.keys()}
        want |= {(q, i, s, at) for at, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k], 1)}
    assert got == want


def test_a_text_late_on_both_sides_can_win():
    """Places 21 and 21 add up to more than place 1 alone."""
    one, two = ({i: p for p, i in enumerate([*range(off, off + 20), 99], 1)} for off in (0, 40))
    assert 99 in contenders(one, two, 21, 1) and 2 / 81 > 1 / 61


def test_questions_read_no_texts(spark, sf_dir, monkeypatch):
    QUERIES["hybrid_topk"](spark, sf_dir)
    seen = []
    real = Postings.rows
    monkeypatch.setattr(Postings, "rows", lambda self: seen.append(plan_of(real(self))) or real(self))
    monkeypatch.setattr(stored, "documents", lambda *_: pytest.fail("the corpus is read again"))
    assert QUERIES["hybrid_topk"](spark, sf_dir).count() > 0 and seen


def test_an_empty_corpus_answers_nothing(spark, corpus):
    rows = corpus[1].limit(0)
    index = Postings.build(rows, fresh_path(spark, "postings"))
    vectors = ListIndex.build(rows.withColumn("embedding", embed(F.col("text"))), fresh_path(spark, "lists"))
    assert fused(corpus[2], vectors, index).isEmpty()


def test_postings_are_built_without_a_shuffle(spark, corpus, monkeypatch):
    made, rows, asked = corpus
    plans, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *args, **more: plans.append(plan_of(self._df)) or write(self, *args, **more))
    monkeypatch.setattr(postings_module, "_POSTINGS", 50)
    stored_rows = staged(rows, "corpus")
    plans.clear()
    index = Postings.build(stored_rows, fresh_path(spark, "postings"))
    assert plans and not any("Exchange" in plan for plan in plans)
    # Blocks are cut by postings too, and hold every text once.
    blocks = spark.read.parquet(f"{index.path}/texts").collect()
    assert sorted(r.id for r in blocks) == list(range(len(made))) and len({r.block for r in blocks}) > 1
    got = {(r["qid"], r["id"], r["rk"]) for r in index.asked(asked).best(9).to_pylist()}
    want = {(q, i, at) for q, t in enumerate(QUESTIONS) for at, (i, _) in enumerate(sorted(bm25(made, t).items(), key=lambda x: (-x[1], x[0]))[:9], 1)}
    assert got == want
