"""Retrieval, citations, tool lookups and expectations: the joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweft.operators.citations import citation_edges, two_hops
from docweft.operators.embedding import embed
from docweft.operators.hashing import nearest_by_hash
from docweft.operators.fusion import fused
from docweft.operators.keywords import reranked_in
from docweft.operators.matching import nearest
from docweft.operators.prompts import candidate_matrix as matrix
from docweft.operators.prompts import shared_words
from docweft.operators.tools import calculator_registry, dispatched
from docweft.operators.conversations import history_pairs, request_id, request_texts
from docweft.functions.tools import value_or_error
from docweft.plans.frames import (
    NEIGHBOURS,
    SQL_CALLS,
    SQL_PAPERS,
    SQL_REQUESTS,
    chat_requests,
    papers,
    paper_id,
    questions,
    sql_error,
    sql_nearest,
    sql_number,
    sql_paper,
    sql_value,
    sql_vectors,
    sql_words,
    tool_calls,
    vectors,
)
from docweft.plans.registry import query
from docweft.operators.sizes import fits
from docweft.plans.stored import document_index, document_postings, vector_index
from docweft.session import staged
from docweft.sources.tables import load

SQL_KNN = """
knn_s AS (SELECT q.vec_id AS qid, d.vec_id AS id,
    round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q JOIN embeddings d ON q.vec_id <> d.vec_id),
knn_r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rk FROM knn_s)"""


def knn(spark, sf_dir, k):
    """The k nearest others of every vector."""
    rows = vectors(spark, sf_dir)
    asked = rows.withColumnRenamed("id", "qid")
    if fits(asked) is None:
        # Too many questions for every task: rows travel only to groups of questions that may need them.
        return vector_index(spark, sf_dir).nearest(asked, k, exclude_self=True).frame.drop("list")
    return nearest(asked, rows, k, exclude_self=True).frame


@query("knn_topk", f"WITH {SQL_KNN} SELECT qid, id, score, rk FROM knn_r WHERE rk <= {NEIGHBOURS}")
def knn_topk(spark, sf_dir):
    return knn(spark, sf_dir, NEIGHBOURS)


@query("knn_lsh")
def knn_lsh(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return nearest_by_hash(rows.withColumnRenamed("id", "qid"), rows, NEIGHBOURS, exclude_self=True)


SQL_BM25 = f"""
q_t AS (SELECT DISTINCT item_id AS qid, unnest({sql_words('text')}) AS term FROM benchmark),
d_l AS (SELECT doc_id, {sql_words('text')} AS toks FROM documents),
d_n AS (SELECT count(*)::DOUBLE AS n, sum(len(toks))::DOUBLE / count(*) AS avglen FROM d_l),
d_t AS (SELECT doc_id, len(toks)::DOUBLE AS l, unnest(toks) AS term FROM d_l),
d_tf AS (SELECT doc_id, l, term, count(*)::DOUBLE AS tf FROM d_t GROUP BY ALL),
d_df AS (SELECT term, count(*)::DOUBLE AS df FROM d_tf GROUP BY term),
kw_s AS (SELECT q.qid, t.doc_id AS id,
    round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / avglen))), 6) AS score
  FROM q_t q JOIN d_tf t ON q.term = t.term JOIN d_df f ON f.term = t.term, d_n GROUP BY q.qid, t.doc_id),
kw AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rk FROM kw_s)"""


@query(
    "hybrid_topk",
    f"""WITH {sql_vectors('qv', 'benchmark', 'item_id', 'text')}, {sql_vectors('dv', 'documents', 'doc_id', 'text')},
        {sql_nearest('vec', 'qv', 'dv')}, {SQL_BM25},
        f AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rk)), 6) AS score
              FROM (SELECT qid, id, rk FROM vec UNION ALL SELECT qid, id, rk FROM kw) GROUP BY qid, id)
        SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rk FROM f)
        WHERE rk <= 5""",
)
def hybrid_topk(spark, sf_dir):
    return fused(questions(spark, sf_dir), document_index(spark, sf_dir), document_postings(spark, sf_dir), k=5)


SQL_RERANK = f"""
qw AS (SELECT qid, list_distinct({sql_words('question')}) AS w FROM asked),
dw AS (SELECT doc_id AS id, list_distinct({sql_words('text')}) AS w FROM documents),
rr_s AS (SELECT c.qid, c.id, len(list_intersect(qw.w, dw.w))::BIGINT AS overlap
  FROM cand c JOIN qw ON qw.qid = c.qid JOIN dw ON dw.id = c.id),
rr AS (SELECT * FROM (SELECT qid, id, overlap, row_number() OVER (PARTITION BY qid ORDER BY overlap DESC, id) AS rk
  FROM rr_s) WHERE rk <= 3)"""


@query(
    "rerank",
    f"""WITH asked AS (SELECT item_id AS qid, text AS question FROM benchmark),
        {sql_vectors('qv', 'asked', 'qid', 'question')}, {sql_vectors('dv', 'documents', 'doc_id', 'text')},
        {sql_nearest('cand', 'qv', 'dv', 10)}, {SQL_RERANK} SELECT qid, id, overlap, rk FROM rr""",
)
def rerank(spark, sf_dir):
    return ranked_again(spark, sf_dir, questions(spark, sf_dir)).frame.select("qid", "id", "overlap", "rk")


def ranked_again(spark, sf_dir, asked):
    """The three of a question's ten nearest documents that hold most of its words."""
    index = document_index(spark, sf_dir)
    return reranked_in(index, asked, index.nearest(asked, 10), 3)


SQL_HISTORY_ASKED = f"""{SQL_REQUESTS},
asked AS (SELECT qid, question FROM req)"""


def history_questions(spark, sf_dir):
    """Chat requests rewritten with their whole history, as questions."""
    asked = request_texts(chat_requests(spark, sf_dir), F.col("content")).select(request_id().alias("qid"), "text")
    # Rewriting and embedding run once; checks and joins read the stored rows.
    return staged(asked.withColumn("embedding", embed(F.col("text"))), "questions")


SQL_HISTORY_RERANK = f"""{SQL_HISTORY_ASKED},
{sql_vectors('qv', 'asked', 'qid', 'question')}, {sql_vectors('dv', 'documents', 'doc_id', 'text')},
{sql_nearest('cand', 'qv', 'dv', 10)}, {SQL_RERANK}"""


def history_ranked(spark, sf_dir):
    return ranked_again(spark, sf_dir, history_questions(spark, sf_dir))


@query("history_rerank", f"WITH {SQL_HISTORY_RERANK} SELECT qid, id, overlap, rk FROM rr")
def history_rerank(spark, sf_dir):
    return history_ranked(spark, sf_dir).frame.select("qid", "id", "overlap", "rk")


@query(
    "citation_hop2",
    f"""WITH {SQL_PAPERS},
        seed AS (SELECT {sql_paper('doc_id')} AS paper FROM labels WHERE toxic = 1),
        stored AS (SELECT {sql_paper('doc_id')} AS paper FROM labels),
        h1 AS (SELECT DISTINCT dst AS paper FROM edges WHERE src IN (SELECT paper FROM seed)),
        h2 AS (SELECT DISTINCT dst AS paper FROM edges WHERE src IN (SELECT paper FROM h1)),
        r AS (SELECT paper, min(hop) AS hop FROM (SELECT paper, 1::BIGINT AS hop FROM h1
              UNION ALL SELECT paper, 2 FROM h2) GROUP BY paper)
        SELECT paper, hop FROM r WHERE paper NOT IN (SELECT paper FROM stored)""",
)
def citation_hop2(spark, sf_dir):
    labels = load(spark, sf_dir, "labels")
    # Both hops read the edges; the texts are searched once.
    edges = staged(citation_edges(papers(spark, sf_dir), "paper", "text"), "edges")
    seeds = labels.where("toxic = 1").select(paper_id("doc_id").alias("paper"))
    return two_hops(edges, seeds, labels.select(paper_id("doc_id").alias("paper")))


SQL_DISPATCHED = f"""{SQL_CALLS},
dispatched AS (SELECT *, CASE WHEN name NOT IN ('add', 'subtract', 'multiply', 'divide') THEN 'Unknown tool: ' || name
    ELSE {sql_error()} END AS error FROM calls),
outputs AS (SELECT call_id, name, error,
    CASE WHEN error IS NULL THEN {sql_number(sql_value())} END AS output, request_id, l_linenumber FROM dispatched)"""


@query("tool_dispatch", f"WITH {SQL_DISPATCHED} SELECT call_id, name, output, error FROM outputs")
def tool_dispatch(spark, sf_dir):
    calls = dispatched(tool_calls(spark, sf_dir), calculator_registry(spark))
    return calls.select("call_id", "name", "output", "error")


@query(
    "call_output_pair",
    f"""WITH {SQL_DISPATCHED}, o AS (SELECT call_id, coalesce(error, output) AS text FROM outputs WHERE l_linenumber <> 7)
        SELECT c.call_id, 1::BIGINT AS seq, 'function_call' AS type, c.name AS text,
          o.call_id IS NOT NULL AS answered FROM calls c LEFT JOIN o ON o.call_id = c.call_id
        UNION ALL SELECT call_id, 2, 'function_call_output', text, TRUE FROM o""",
)
def call_output_pair(spark, sf_dir):
    """Each call followed by its output; calls of the seventh line are not answered."""
    calls = tool_calls(spark, sf_dir)
    done = dispatched(calls, calculator_registry(spark)).where("l_linenumber <> 7")
    outputs = done.select("call_id", value_or_error(F.col("error"), F.col("output")).alias("result"))
    paired = calls.select("call_id", "name").join(outputs, "call_id", "left")
    answered = F.col("result").isNotNull()
    call = F.struct(
        F.lit(1).cast("bigint").alias("seq"), F.lit("function_call").alias("type"), F.col("name").alias("text")
    )
    output = F.struct(
        F.lit(2).cast("bigint").alias("seq"), F.lit("function_call_output").alias("type"), F.col("result").alias("text")
    )
    items = F.when(answered, F.array(call, output)).otherwise(F.array(call))
    return paired.select("call_id", answered.alias("answered"), F.inline(items))


def training_examples(spark, sf_dir):
    """Question and expected answer from answered user turns."""
    pairs = history_pairs(load(spark, sf_dir, "conversations"))
    return pairs.select("conv_id", "turn", F.col("human").alias("question"), F.col("ai").alias("expected"))


def candidate_prompts(spark, sf_dir):
    """One candidate per language: its shortest document."""
    rows = load(spark, sf_dir, "documents").groupBy(F.col("lang").alias("name"))
    # A few short rows, wanted several times: the texts are read once.
    return staged(rows.agg(F.min_by("text", F.struct("n_chars", "doc_id")).alias("template")), "candidates")


def candidate_scores(spark, sf_dir, candidates=None):
    cells = matrix(training_examples(spark, sf_dir), candidates or candidate_prompts(spark, sf_dir))
    prompt = F.concat("template", F.lit("\n"), "question")
    return cells.select("conv_id", "turn", "name", shared_words(prompt, F.col("expected")).alias("score"))


SQL_SCORED = f"""
ex_w AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS r1, lead(text) OVER w AS t1 FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
ex AS (SELECT conv_id, turn, text AS question, t1 AS expected FROM ex_w WHERE role = 'user' AND r1 = 'assistant'),
cand_p AS (SELECT lang AS name, arg_min(text, (n_chars, doc_id)) AS template FROM documents GROUP BY lang),
scored AS (SELECT conv_id, turn, name, len(list_intersect(list_distinct({sql_words("template || chr(10) || question")}),
    list_distinct({sql_words('expected')})))::BIGINT AS score FROM ex, cand_p)"""


@query("candidate_matrix", f"WITH {SQL_SCORED} SELECT conv_id, turn, name, score FROM scored")
def candidate_matrix(spark, sf_dir):
    return candidate_scores(spark, sf_dir)


@query(
    "expectation_join",
    """SELECT d.doc_id, CASE WHEN n_chars >= 1000 THEN '1' ELSE '0' END = quality::VARCHAR AS exact_match,
         contains('quality ' || CASE WHEN n_chars >= 1000 THEN '1' ELSE '0' END || ' of ' || source, quality::VARCHAR)
           AS contains_match
       FROM documents d JOIN labels l ON l.doc_id = d.doc_id""",
)
def expectation_join(spark, sf_dir):
    answers = load(spark, sf_dir, "documents").select(
        "doc_id", "source", F.when(F.col("n_chars") >= 1000, "1").otherwise("0").alias("answer")
    )
    expected = load(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("expected"))
    joined = answers.join(expected, "doc_id")
    said = F.concat(F.lit("quality "), "answer", F.lit(" of "), "source")
    return joined.select(
        "doc_id",
        (F.col("answer") == F.col("expected")).alias("exact_match"),
        F.contains(said, F.col("expected")).alias("contains_match"),
    )
