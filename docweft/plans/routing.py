"""Projections, filters and routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweft.functions.messages import DONE, route, step_kind
from docweft.functions.text import same_paper, words
from docweft.operators.citations import found_citations
from docweft.operators.conversations import last_messages, request_texts
from docweft.operators.matching import nearest
from docweft.operators.retrieval import mapped
from docweft.operators.scoring import batch_predict, keyword_intent_model
from docweft.plans.frames import (
    NEIGHBOURS,
    SQL_PAPERS,
    SQL_REQUESTS,
    chat_requests,
    papers,
    sql_words,
    vectors,
)
from docweft.plans.registry import query
from docweft.sources.tables import load


@query("retrieve_columns", "SELECT text AS page_content, source, doc_id FROM documents")
def retrieve_columns(spark, sf_dir):
    return mapped(load(spark, sf_dir, "documents"), {"page_content": "text"}, ["source", "doc_id"])


@query(
    "column_override",
    "SELECT vec_id AS row_id, label AS source_doc, len(embedding)::BIGINT AS doc_page FROM embeddings",
)
def column_override(spark, sf_dir):
    foreign = load(spark, sf_dir, "embeddings").withColumn("pages", F.size("embedding").cast("bigint"))
    return mapped(foreign, {"row_id": "vec_id", "source_doc": "label", "doc_page": "pages"})


@query(
    "filtered_retrieval",
    f"""WITH s AS (SELECT q.vec_id AS qid, d.vec_id AS id,
           round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS score
         FROM embeddings q, embeddings d WHERE d.label = 3 AND q.vec_id <> d.vec_id)
       SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rk FROM s)
       WHERE rk <= {NEIGHBOURS}""",
)
def filtered_retrieval(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    asked = rows.withColumnRenamed("id", "qid")
    return nearest(asked, rows.where("label = 3"), NEIGHBOURS, exclude_self=True).frame


@query(
    "history_passthrough",
    f"WITH {SQL_REQUESTS} SELECT conv_id, turn, n_messages = 1 AS unchanged, question FROM req",
)
def history_passthrough(spark, sf_dir):
    """The last question of every conversation behind its whole history; unchanged where there is none."""
    messages = chat_requests(spark, sf_dir)
    alone = messages.groupBy("conv_id", "turn").agg((F.count(F.lit(1)) == 1).alias("unchanged"))
    asked = request_texts(messages, F.col("content")).withColumnRenamed("text", "question")
    return alone.join(asked, ["conv_id", "turn"])


SQL_INTENT = (
    "CASE WHEN contains(' ' || text || ' ', ' the ') THEN 'research' "
    "WHEN contains(' ' || text || ' ', ' and ') THEN 'reporting' ELSE 'general' END"
)


def intents(spark, sf_dir):
    """Last user message per conversation with the stand-in's one-word intent."""
    users = load(spark, sf_dir, "conversations").where("role = 'user'")
    return batch_predict(last_messages(users), "text", keyword_intent_model, "intent")


SQL_LAST_USER = """
last_user AS (SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations
  WHERE role = 'user' GROUP BY conv_id)"""


@query(
    "route_query",
    """SELECT conv_id, turn, CASE WHEN contains(c, 'research') THEN 'research'
         WHEN contains(c, 'reporting') THEN 'reporting' ELSE 'general' END AS route
       FROM (SELECT conv_id, turn, replace(replace(text, 'the', 'research'), 'and', 'reporting') AS c
             FROM conversations)""",
)
def route_query(spark, sf_dir):
    said = F.replace(F.replace("text", F.lit("the"), F.lit("research")), F.lit("and"), F.lit("reporting"))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", route(said).alias("route"))


@query("intent_classify", f"WITH {SQL_LAST_USER} SELECT conv_id, turn, {SQL_INTENT} AS intent FROM last_user")
def intent_classify(spark, sf_dir):
    return intents(spark, sf_dir).select("conv_id", "turn", "intent")


@query(
    "route_branches",
    f"""WITH {SQL_LAST_USER}, r AS (SELECT *, {SQL_INTENT} AS route FROM last_user)
        SELECT conv_id, route, CASE route WHEN 'research' THEN 'search: ' || lower(text)
          WHEN 'reporting' THEN 'report: ' || length(text) ELSE text END AS content FROM r""",
)
def route_branches(spark, sf_dir):
    """One pass: a route decides which expression fills the common column."""
    rows = intents(spark, sf_dir).withColumn("route", route(F.col("intent")))
    content = (
        F.when(F.col("route") == "research", F.concat(F.lit("search: "), F.lower("text")))
        .when(F.col("route") == "reporting", F.concat(F.lit("report: "), F.length("text").cast("string")))
        .otherwise(F.col("text"))
    )
    return rows.select("conv_id", "route", content.alias("content"))


@query(
    "agent_step_kind",
    """SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'final' WHEN length(text) % 2 = 0 THEN 'tool' ELSE 'llm' END
         AS step FROM (SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, arg_max(text, turn) AS text
                       FROM conversations GROUP BY conv_id)""",
)
def agent_step_kind(spark, sf_dir):
    last = last_messages(load(spark, sf_dir, "conversations"))
    type_ = F.when(F.length("text") % 2 == 0, "function_call").otherwise("message")
    return last.select("conv_id", "turn", step_kind(F.col("role"), type_).alias("step"))


def stream_events(events):
    """Events as response stream rows; a purchase completes an item."""
    type_ = F.when(F.col("event_type") == "purchase", DONE).otherwise("response.output_text.delta")
    return events.select("event_id", "user_id", type_.alias("type"), F.col("props").alias("item"))


def completed(events):
    """Completed items only; the same step serves tables and streams."""
    return events.where(F.col("type") == DONE).select("event_id", "user_id", "item")


@query("done_events", "SELECT event_id, user_id, props AS item FROM events WHERE event_type = 'purchase'")
def done_events(spark, sf_dir):
    return completed(stream_events(load(spark, sf_dir, "events")))


@query(
    "nonempty_chunks",
    f"""SELECT conv_id, turn, len(c)::BIGINT AS n_choices, c[1] AS first_choice FROM (
          SELECT conv_id, turn, list_filter({sql_words('text')}, lambda w: length(w) > 12) AS c FROM conversations)
        WHERE len(c) > 0""",
)
def nonempty_chunks(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.filter(words(F.col("text")), lambda w: F.length(w) > 12).alias("choices")
    )
    return rows.where(F.size("choices") > 0).select(
        "conv_id", "turn", F.size("choices").cast("bigint").alias("n_choices"), F.col("choices")[0].alias("first_choice")
    )


@query(
    "non_self_citation",
    f"WITH {SQL_PAPERS} SELECT src, dst FROM found WHERE substr(src, 1, 10) <> substr(dst, 1, 10)",
)
def non_self_citation(spark, sf_dir):
    found = found_citations(papers(spark, sf_dir), "paper", "text")
    return found.where(~same_paper(F.col("src"), F.col("dst")))
