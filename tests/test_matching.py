import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_queries import plan_of

from docweft.functions.text import words
from docweft.operators import hashing, keywords
from docweft.operators.embedding import dimension_profile, embed, model_dimension, pieces, unit_rows
from docweft.operators.hashing import nearest_by_hash, signatures
from docweft.operators.keywords import hybrid, reranked
from docweft.operators.matching import Best, Matches, nearest

DIM = 8


def hashed(texts):
    """Word counts by md5 bucket, one word at a time."""
    out = np.zeros((len(texts), 64))
    for row, text in enumerate(texts):
        for word in text.lower().split():
            out[row, int(hashlib.md5(word.encode()).hexdigest()[:6], 16) % 64] += 1
        if text:
            out[row] /= np.linalg.norm(out[row])
    return out


def brute(matrix, ids, k, exclude_self=True):
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 6)
    out = {}
    for q, qid in enumerate(ids):
        pairs = sorted((-s, i) for s, i in zip(scores[q], ids, strict=True) if not (exclude_self and i == qid))
        out[qid] = [(i, -s) for s, i in pairs[:k]]
    return out


def by_question(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.qid, r.rk)):
        out.setdefault(r.qid, []).append((r.id, r.score))
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    """A third of the vectors are copies of one."""
    rng = np.random.default_rng(3)
    matrix = rng.normal(size=(240, DIM)).astype(np.float32)
    matrix[::3] = matrix[0]
    ids = [int(i) for i in rng.permutation(1000)[:240]]
    rows = [(i, [float(x) for x in m]) for i, m in zip(ids, matrix, strict=True)]
    return spark.createDataFrame(rows, "id bigint, embedding array<float>").repartition(5), matrix.astype(float), ids


@pytest.mark.parametrize("options", [{}, {"max_broadcast_rows": 10, "question_block": 40, "corpus_block": 50}])
def test_nearest_equals_brute_force(vectors, options):
    df, matrix, ids = vectors
    found = nearest(df.withColumnRenamed("id", "qid"), df, 5, exclude_self=True, **options)
    assert (found.row_bound is None) == bool(options)
    assert by_question(found.frame) == brute(matrix, ids, 5)


def test_fewer_rows_than_wanted(spark, vectors):
    df, _, _ = vectors
    few = df.orderBy("id").limit(3)
    got = by_question(nearest(df.withColumnRenamed("id", "qid"), few, 5).frame)
    assert all(len(v) == 3 for v in got.values()) and len(got) == 240
    assert nearest(df.withColumnRenamed("id", "qid").where("qid < 0"), df, 5).frame.count() == 0


def test_scores_never_increase_with_rank(vectors):
    df, _, _ = vectors
    for answers in by_question(nearest(df.withColumnRenamed("id", "qid"), df, 7).frame).values():
        scores = [s for _, s in answers]
        assert scores == sorted(scores, reverse=True)


def hashed_self(df, k, **options):
    return by_question(nearest_by_hash(df.withColumnRenamed("id", "qid"), df, k, exclude_self=True, **options))


def recall(exact, got, k):
    return sum(len({i for i, _ in exact[q]} & {i for i, _ in got.get(q, [])}) for q in exact) / (k * len(exact))


def test_hashed_neighbours(vectors):
    df, matrix, ids = vectors
    got = hashed_self(df, 5, tables=16, bits=2)
    assert recall(brute(matrix, ids, 5), got, 5) >= 0.9
    assert all(q not in [i for i, _ in answers] and len(answers) <= 5 for q, answers in got.items())
    # All copies find each other, smallest ids first.
    copies = sorted(ids[::3])
    assert [i for i, s in got[copies[0]]] == copies[1:6]


def test_hashed_blocks_do_not_change_answers(vectors):
    df, _, _ = vectors
    assert hashed_self(df, 4, tables=4, bits=3) == hashed_self(df, 4, tables=4, bits=3, block_rows=7)


def test_crowded_buckets_get_more_planes(spark):
    """All vectors lie close together, so the planned planes hardly part them."""
    rng = np.random.default_rng(11)
    matrix = (np.ones(DIM) * 3 + rng.normal(size=(300, DIM))).astype(np.float32)
    rows = [(i, [float(x) for x in m]) for i, m in enumerate(matrix)]
    df = spark.createDataFrame(rows, "id bigint, embedding array<float>")
    got = hashed_self(df, 3, tables=24, bits=2, bucket_rows=16, block_rows=16)
    assert recall(brute(matrix.astype(float), list(range(300)), 3), got, 3) >= 0.8


def test_hashed_questions_on_another_table(spark, vectors):
    df, matrix, ids = vectors
    asked = spark.createDataFrame([(7, [float(x) for x in matrix[1]]), (8, [float(x) for x in matrix[1]])],
                                  "qid bigint, embedding array<float>")
    got = by_question(nearest_by_hash(asked, df, 3, tables=16, bits=2))
    assert got[7] == got[8] and got[7][0] == (ids[1], 1.0)
    assert nearest_by_hash(asked, df.where("id < 0"), 3).count() == 0


@pytest.fixture(scope="module")
def texts(spark):
    corpus = [
        (1, "the cat sat on the mat"),
        (2, "the dog sat on the log"),
        (3, "cats and dogs"),
        (4, "a completely different text about spark jobs"),
        (5, "the the the the"),
        (6, ""),
        (7, "spark spark spark cat"),
        (8, "the cat sat on the mat"),
    ]
    asked = [(10, "Cat on the mat"), (11, "spark jobs"), (12, "nothing shared here?")]
    c = spark.createDataFrame(corpus, "id bigint, text string")
    q = spark.createDataFrame(asked, "qid bigint, text string").withColumn("embedding", embed(F.col("text")))
    return c, q, corpus, asked


def bm25(corpus, asked):
    cut = {i: t.lower().split() for i, t in corpus}
    n, mean = len(cut), sum(map(len, cut.values())) / len(cut)
    df = {}
    for t in cut.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = {}
    for q, text in asked:
        scores = []
        for i, t in cut.items():
            terms = [w for w in set(text.lower().split()) if w in t]
            if terms:
                s = sum(
                    math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.2
                    / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean))
                    for w in terms
                )
                scores.append((-round(s, 6), i))
        out[q] = [i for _, i in sorted(scores)]
    return out


@pytest.mark.parametrize("options", [{}, {"max_broadcast_rows": 1, "question_block": 1, "corpus_block": 3}])
def test_hybrid_equals_brute_force(texts, options):
    c, q, corpus, asked = texts
    vectors, questions = hashed([t for _, t in corpus]), hashed([t for _, t in asked])
    cosine = np.round(questions @ vectors.T, 6)
    keyword = bm25(corpus, asked)
    want = {}
    for at, (qid, _) in enumerate(asked):
        ranks = {}
        by_vector = sorted((-s, i) for s, (i, _) in zip(cosine[at], corpus, strict=True))
        for ranked in ([i for _, i in by_vector], keyword[qid]):
            for rk, i in enumerate(ranked[:6], start=1):
                ranks[i] = ranks.get(i, 0) + 1 / (60 + rk)
        best = sorted((-round(s, 6), i) for i, s in ranks.items())[:3]
        want[qid] = [(i, -s) for s, i in best]
    assert by_question(hybrid(q, c, k=3, depth=6, **options)) == want


@pytest.mark.parametrize("options", [{}, {"max_broadcast_rows": 1}])
def test_rerank(texts, options):
    c, q, _, _ = texts
    candidates = nearest(q, c.select("id", embed(F.col("text")).alias("embedding")), 8, **options)
    got = {}
    for r in sorted(reranked(q, c, candidates, 2).frame.collect(), key=lambda r: (r.qid, r.rk)):
        got.setdefault(r.qid, []).append((r.id, r.overlap))
    assert got[10] == [(1, 4), (8, 4)]
    assert got[11] == [(4, 2), (7, 1)]
    assert got[12] == [(1, 0), (2, 0)]


def test_embedding_is_a_pluggable_model(spark):
    def factory():
        return lambda texts: np.array([[float(len(t)), 1.0] for t in texts])

    assert model_dimension(factory) == 2
    df = spark.createDataFrame([("abc",), ("",)], "t string")
    assert [r.v for r in df.select(embed(F.col("t"), factory).alias("v")).collect()] == [[3.0, 1.0], [0.0, 1.0]]


def test_words_are_cut_at_blanks_only(spark):
    text = "  Élan\tvital\r\n\nÜber  straße . a"
    on_spark = spark.createDataFrame([(text,), ("",)], "t string").select(words(F.col("t"))).collect()
    assert [r[0] for r in on_spark] == [["élan", "vital", "über", "straße", ".", "a"], []]


def test_stand_in_vectors(spark):
    texts = ["b a b", "", "zz"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(embed(F.col("t"))).collect()
    assert np.allclose(np.array([r[0] for r in got]), hashed(texts))


def test_dimension_profile(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],), ([3.0, 4.0],)], "v array<double>")
    row = dimension_profile(df, "v").first()
    assert (row.min_dim, row.max_dim, row.n_vectors, row.n_violations) == (1, 2, 3, 1)
    assert dimension_profile(df, "v", 3).first().n_violations == 3


@pytest.mark.parametrize("rows", [[[1.0, 2.0, 3.0], [4.0], [5.0, 6.0]], [[1.0], None], [[1.0, None], [2.0, 3.0]]])
def test_ragged_and_null_vectors_are_refused(rows):
    import pyarrow as pa

    from docweft.operators.matching import vector_matrix

    with pytest.raises(ValueError):
        vector_matrix(pa.chunked_array([pa.array(rows, pa.list_(pa.float64()))]))


def test_table_function_returns_as_many_rows_as_asked(spark, sf_dir):
    from docweft.plans.scoring import find_similar

    rows = find_similar(spark, sf_dir, 25).groupBy("qid").count()
    assert rows.agg({"count": "min"}).first()[0] == 25
    with pytest.raises(Exception, match="set up for 25"):
        spark.sql("SELECT * FROM find_similar(26)").collect()


def test_crowded_buckets_lose_no_mate(spark):
    draw = np.random.default_rng(4)
    vectors = draw.normal(size=16) + 0.3 * draw.normal(size=(600, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id bigint, embedding array<double>")
    got = {(r["qid"], r["id"]) for r in nearest_by_hash(df.withColumnRenamed("id", "qid"), df, 4, exclude_self=True, tables=2, bits=2, bucket_rows=16).collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    score = unit @ unit.T - 2 * np.eye(600)
    want = {(q, int(i)) for q in range(600) for i in np.argsort(-score[q])[:4]}
    assert len(got & want) >= 0.99 * len(want)


def test_tables_keep_the_recall_at_any_size():
    for bits in (2, 7, 14, 27, 36):
        shared = (1 - math.acos(0.9) / math.pi) ** bits
        assert 1 - (1 - shared) ** hashing.tables_for(bits) >= 0.95


def test_hashed_rows_leave_in_small_batches():
    """A batch of any size goes out once per table without being held that often."""

    class Rows:
        schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])

        def mapInArrow(self, run, schema):
            return run

    points = np.random.default_rng(0).normal(size=(10_000, 8)).astype(np.float32)
    vectors = pa.ListArray.from_arrays(pa.array(range(0, 80_001, 8), pa.int32()), pa.array(points.ravel()))
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(10_000)), "embedding": vectors})
    out = list(signatures(Rows(), 8, 12, 5)(iter([batch])))
    assert sum(b.num_rows for b in out) == 120_000 and max(b.num_rows for b in out) <= 12 * 1024
    assert len({b.slice(0, 0).schema for b in out}) == 1 and out[1]["id"][0].as_py() > 0


@pytest.mark.parametrize("known", [False, True], ids=["no least score", "least scores"])
def test_rough_scores_lose_no_row(known):
    """Rows so alike that single precision does not order them are ranked as in double precision, which few pairs need."""
    draw = np.random.default_rng(3)
    rows = unit_rows(np.concatenate([np.array([1.0, 1, 0, 0, 0]) + 3e-6 * draw.normal(size=(900, 5)), draw.normal(size=(2100, 5))]))
    asked, ids = unit_rows(draw.normal(size=(40, 5)) + [2, 0, 0, 0, 0]), draw.permutation(3000)
    scores = np.round(asked @ rows.T, 6)
    order = [np.lexsort((ids, -row))[:7] for row in scores]
    low = np.array([row[at[-1]] for row, at in zip(scores, order, strict=True)]) if known else None
    best = Best(np.arange(40), 7, False, low, asked)
    assert best.rough.dtype == np.float32
    for at in range(0, 3000, 500):
        best.meet(np.arange(40), rows[at : at + 500], ids[at : at + 500])
    found = best.listed()
    got = sorted(zip(found["qid"].to_pylist(), (-x for x in found["score"].to_pylist()), found["id"].to_pylist(), strict=True))
    assert got == [(q, -scores[q, i], ids[i]) for q, at in enumerate(order) for i in at]


@pytest.mark.parametrize("crowd", [512, 3])
def test_rerank_of_many_counts_as_by_hand(spark, monkeypatch, crowd):
    """Texts dealt by id meet their questions over any number of batches and copies; a text without words shares none, a missing one is not counted."""
    monkeypatch.setattr(keywords, "CROWD", crowd)
    draw = np.random.default_rng(5)
    texts = {i: " ".join(f"w{n}" for n in draw.integers(0, 60, i)) + " \n\t A  a" * (i % 2) for i in range(40)} | {40: None, 41: " "}
    asked = {q: " ".join(f"W{n}" for n in draw.integers(0, 60, 12)) + "  a" for q in range(30)} | {30: "", 31: " \n "}
    pairs = [(q, i) for q in asked for i in {7, 40, 41, q, int(draw.integers(0, 40))}]
    c = spark.createDataFrame(list(texts.items()), "id bigint, text string")
    q = spark.createDataFrame(list(asked.items()), "qid bigint, text string")
    candidates = Matches(spark.createDataFrame(pairs, "qid bigint, id bigint"), 5, None)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        ranked = reranked(q, c, candidates, 5).frame
        assert "MapInArrow" in plan_of(ranked) and "array_intersect" not in plan_of(ranked)
        rows = ranked.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {(r.qid, r.id): r.overlap for r in rows}
    assert len(rows) == len(pairs)
    held = {i: None if t is None else set(t.lower().split()) for i, t in texts.items()}
    assert got == {(q, i): None if held[i] is None else len(held[i] & set(asked[q].lower().split())) for q, i in pairs}


def test_vectors_come_from_texts_cut_in_python(spark):
    """Only the text travels to Python, not a list of its words; no word is counted that is none."""
    texts = ["b  a b\t", "", " \n ", "Élan Über straße", None, "x" * 70_000 + " y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(embed(F.col("t")).alias("v"))
    assert "split(" not in plan_of(df)
    assert np.allclose(np.array([r.v for r in df.collect()]), np.concatenate([hashed(texts[:2]), np.zeros((1, 64)), hashed(texts[3:4]), np.zeros((1, 64)), hashed(texts[5:])]))


def test_texts_are_cut_in_bounded_pieces():
    texts = pa.array(["ab", None, "c" * 50, "", "d" * 7, "e"] * 40)
    cut = pieces(texts, 20)
    assert [low for low, _ in cut] == [0, *np.cumsum([n for _, n in cut])[:-1].tolist()] and sum(n for _, n in cut) == 240
    assert max(sum(len(t or "") for t in texts.slice(*piece).to_pylist()) for piece in cut) <= 20 + 50
    assert len(cut) >= 80 and pieces(texts.slice(0, 0)) == []
