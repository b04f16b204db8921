"""Whole jobs put together from the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweft.functions.messages import one_line_base64, route
from docweft.functions.text import fill, fill_column, without_phrase
from docweft.functions.tools import calculator_error, calculator_value, number_text, value_or_error
from docweft.operators.context import (
    HISTORY_PROMPT,
    QUERY_PROMPT,
    RAG_SYSTEM,
    joined_context,
    rag_messages,
)
from docweft.operators.conversations import request_id, request_texts
from docweft.operators.embedding import DIM
from docweft.operators.evaluation import mean
from docweft.operators.numbering import top_per_key
from docweft.operators.prompts import best, latest, mean_scores, with_new_version
from docweft.operators.scoring import batch_predict, echo_model, transcript_model, word_count_model
from docweft.operators.tools import MAX_ROUNDS, listed_calls_planner, tool_loop
from docweft.plans.frames import (
    CHUNK_OVERLAP,
    CHUNK_TOKENS,
    NEIGHBOURS,
    SQL_CALLS,
    SQL_REGISTRY,
    chat_requests,
    prompt_registry,
    questions,
    sql_chunks,
    sql_error,
    sql_nearest,
    sql_number,
    sql_value,
    sql_vectors,
    sql_words,
    tool_calls,
)
from docweft.plans.grouping import SQL_RETRIEVED, contexts
from docweft.plans.lookups import (
    SQL_HISTORY_RERANK,
    SQL_SCORED,
    candidate_prompts,
    candidate_scores,
    history_ranked,
)
from docweft.plans.registry import query
from docweft.plans.routing import SQL_INTENT, SQL_LAST_USER, intents
from docweft.plans.stored import document_index, page_index
from docweft.sources.index import VectorIndex, index_rows
from docweft.sources.payloads import first_prediction
from docweft.sources.runs import append_log, long_form, read_log
from docweft.sources.tables import load, load_spread
from docweft.session import fresh_path, released, staged


@query(
    "ingest_documents",
    f"""WITH {sql_chunks()} SELECT source, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs,
          sum(len(string_split(text, ' ')))::BIGINT AS n_tokens FROM chunk GROUP BY source""",
)
def ingest_documents(spark, sf_dir):
    """Load, chunk, embed, store by key; read back the newest row per key."""
    index = VectorIndex.open_or_create(spark, fresh_path(spark, "index"), DIM)
    rows = index_rows(load_spread(spark, sf_dir, "documents", "doc_id"), CHUNK_TOKENS, CHUNK_OVERLAP)
    index.write(rows, 1)
    stored = index.latest()
    document = F.substring_index("id", "-", 1)
    per_document = stored.groupBy("source", document.alias("doc")).agg(
        F.count(F.lit(1)).alias("c"), F.sum(F.size(F.split("text", " "))).alias("t")
    )
    return per_document.groupBy("source").agg(
        F.sum("c").alias("n_chunks"), F.count(F.lit(1)).alias("n_docs"), F.sum("t").alias("n_tokens")
    )


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


SQL_RAG_SYSTEM = (
    _sql_text(RAG_SYSTEM.split("{rag_content}")[0]) + " || context || " + _sql_text(RAG_SYSTEM.split("{rag_content}")[1])
)


@query(
    "rag_prompt",
    f"""WITH {SQL_RETRIEVED} SELECT c.qid, c.n_ctx, {SQL_RAG_SYSTEM} AS system, b.text AS "user"
        FROM ctx c JOIN benchmark b ON b.item_id = c.qid""",
)
def rag_prompt(spark, sf_dir):
    """Question, nearest chunks, context in rank order, filled prompt."""
    asked = questions(spark, sf_dir)
    found = contexts(spark, sf_dir, asked).join(asked.select("qid", "text"), "qid")
    return rag_messages(found, "text", "context").select("qid", "n_ctx", "system", "user")


_HISTORY_PARTS = HISTORY_PROMPT.replace("{context}", "{input}").replace("{chat_history}", "{input}").split("{input}")


@query(
    "history_rag",
    f"""WITH {SQL_HISTORY_RERANK},
        ctx AS (SELECT rr.qid, string_agg(d.text, chr(10) || chr(10) ORDER BY rr.rk) AS context
          FROM rr JOIN documents d ON d.doc_id = rr.id GROUP BY rr.qid)
        SELECT req.qid, {_sql_text(_HISTORY_PARTS[0])} || req.text || {_sql_text(_HISTORY_PARTS[1])} || ctx.context ||
          {_sql_text(_HISTORY_PARTS[2])} || said || {_sql_text(_HISTORY_PARTS[3])} AS prompt
        FROM req JOIN ctx ON ctx.qid = req.qid""",
)
def history_rag(spark, sf_dir):
    """Question with history, reranked context, and the history itself in one prompt."""
    ranked = history_ranked(spark, sf_dir)
    ranked = ranked._replace(frame=staged(ranked.frame, "ranked"))
    # Texts were shuffled to be ranked, and those kept are shuffled again.
    released(spark)
    context = joined_context(document_index(spark, sf_dir).fetched(ranked, "text"), ["qid"])
    messages = chat_requests(spark, sf_dir)
    speaker = F.when(F.col("role") == "user", "Human: ").when(F.col("role") == "assistant", "AI: ").otherwise("System: ")
    said = request_texts(messages.where("pos < turn"), F.concat(speaker, "content"))
    said = said.select(request_id().alias("qid"), F.col("text").alias("said"))
    asked = messages.where("pos = turn").select("qid", F.col("content").alias("text")).join(said, "qid", "left")
    asked = asked.withColumn("said", F.coalesce("said", F.lit("")))
    values = {"input": F.col("text"), "context": F.col("context"), "chat_history": F.col("said")}
    return asked.join(context, "qid").select("qid", fill(HISTORY_PROMPT, values).alias("prompt"))


_QUERY_PARTS = QUERY_PROMPT.replace("{context}", "{input}").split("{input}")


@query(
    "query_engine",
    f"""WITH {sql_vectors('qv', 'benchmark', 'item_id', 'text')},
        foreign_index AS (SELECT page_id AS row_id, url AS source_doc, html AS page_content FROM pages),
        {sql_vectors('fv', 'foreign_index', 'row_id', 'page_content')}, {sql_nearest('hit', 'qv', 'fv', NEIGHBOURS)},
        ctx AS (SELECT h.qid, string_agg(f.page_content, chr(10) || chr(10) ORDER BY h.rk) AS context
          FROM hit h JOIN foreign_index f ON f.row_id = h.id GROUP BY h.qid)
        SELECT qid, {_sql_text(_QUERY_PARTS[0])} || context || {_sql_text(_QUERY_PARTS[1])} || text ||
          {_sql_text(_QUERY_PARTS[2])} AS prompt FROM ctx JOIN benchmark ON item_id = qid""",
)
def query_engine(spark, sf_dir):
    """Retrieval over a table under foreign column names."""
    asked, index = questions(spark, sf_dir), page_index(spark, sf_dir)
    found = index.fetched(index.nearest(asked, NEIGHBOURS), "text")
    context = joined_context(found, ["qid"]).join(asked.select("qid", F.col("text").alias("question")), "qid")
    values = {"context": F.col("context"), "input": F.col("question")}
    return context.select("qid", fill(QUERY_PROMPT, values).alias("prompt"))


@query(
    "routed_answer",
    f"""WITH {SQL_LAST_USER}, r AS (SELECT *, {SQL_INTENT} AS route FROM last_user)
        SELECT conv_id, route, CASE route WHEN 'research' THEN 'Context for: ' || text
          WHEN 'reporting' THEN 'Usage asked: ' || text ELSE 'Continue: ' || text END AS content FROM r""",
)
def routed_answer(spark, sf_dir):
    """Classify, route, answer per route in one common shape."""
    rows = intents(spark, sf_dir).withColumn("route", route(F.col("intent")))
    lead = F.when(F.col("route") == "research", "Context for: {input}").when(
        F.col("route") == "reporting", "Usage asked: {input}"
    ).otherwise("Continue: {input}")
    return rows.select("conv_id", "route", fill_column(lead, {"input": F.col("text")}).alias("content"))


def order_calls(spark, sf_dir):
    """The calls an order's planner can reach: a round runs one step, so ten calls never all run."""
    calls = tool_calls(spark, sf_dir)
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "x", "y")]
    return top_per_key(calls, ["request_id"], order, MAX_ROUNDS, "call_no")


_X, _Y = sql_number("x"), sql_number("y")
SQL_LOOP = f"""{SQL_CALLS},
open_r AS (SELECT o_orderkey AS request_id FROM orders WHERE o_orderstatus <> 'F'),
n_calls AS (SELECT *, coalesce({sql_error()}, {sql_number(sql_value())}) AS result,
  row_number() OVER (PARTITION BY request_id ORDER BY l_linenumber, l_partkey, l_suppkey, x, y) AS j FROM calls),
mine AS (SELECT c.* FROM n_calls c JOIN open_r o ON o.request_id = c.request_id),
total AS (SELECT o.request_id, count(m.j) AS m, arg_max(m.result, m.j) AS final
  FROM open_r o LEFT JOIN mine m ON m.request_id = o.request_id GROUP BY o.request_id)
SELECT request_id, 2 * j - 1 AS round, 'function_call' AS type,
  name || '(' || {_X} || ', ' || {_Y} || ')' AS content FROM mine WHERE 2 * j - 1 <= {MAX_ROUNDS}
UNION ALL SELECT request_id, 2 * j, 'function_call_output', result FROM mine WHERE 2 * j <= {MAX_ROUNDS}
UNION ALL SELECT request_id, 2 * m + 1, 'message', 'Answer: ' || coalesce(final, 'nothing to compute')
  FROM total WHERE 2 * m + 1 <= {MAX_ROUNDS}
UNION ALL SELECT request_id, {MAX_ROUNDS + 1}, 'message', 'Max iterations reached. Stopping.'
  FROM total WHERE 2 * m + 1 >= {MAX_ROUNDS}"""


@query("tool_loop", f"WITH {SQL_LOOP}")
def run_tool_loop(spark, sf_dir):
    """Every order as a request that lists what to compute; finished orders already end on an answer."""
    listed = order_calls(spark, sf_dir).groupBy("request_id").agg(
        F.sort_array(F.collect_list(F.struct("call_no", "name", "x", "y"))).alias("calls")
    )
    prompt = F.to_json(F.transform("calls", lambda c: F.struct(c["name"].alias("name"), c["x"].alias("x"), c["y"].alias("y"))))
    orders = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"), (F.col("o_orderstatus") == "F").alias("answered")
    )
    requests = orders.join(listed, "request_id", "left").select("request_id", "answered", prompt.alias("prompt"))
    return tool_loop(requests, listed_calls_planner)


@query(
    "one_shot_tools",
    f"""WITH c AS (SELECT event_id, event_type, value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
        SELECT event_id, event_type || ' ' || {sql_number('x + k')} || ' ' ||
          CASE WHEN k % 5 = 0 THEN 'Error: Division by zero' ELSE {sql_number('x / (k % 5)')} END ||
          ' Error: Unknown operation' AS output_text FROM c""",
)
def one_shot_tools(spark, sf_dir):
    """One completion with three calls; each result follows the text after a blank."""
    k = F.from_json("props", "k BIGINT")["k"].cast("double")
    rows = load(spark, sf_dir, "events").select("event_id", "event_type", F.col("value").alias("x"), k.alias("k"))
    calls = F.array(
        F.struct(F.lit("add").alias("op"), F.col("x").alias("x"), F.col("k").alias("y")),
        F.struct(F.lit("divide").alias("op"), F.col("x").alias("x"), (F.col("k") % 5).alias("y")),
        F.struct(F.lit("power").alias("op"), F.col("x").alias("x"), F.col("k").alias("y")),
    )
    results = F.transform(
        calls,
        lambda c: value_or_error(
            calculator_error(c["op"], c["y"]), number_text(calculator_value(c["op"], c["x"], c["y"]))
        ),
    )
    text = F.array_join(F.concat(F.array("event_type"), results), " ")
    return rows.select("event_id", text.alias("output_text"))


@query(
    "eval_run",
    f"""WITH p AS (SELECT lang, len({sql_words('text')}) AS n, toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
        m AS (SELECT lang, count(*)::VARCHAR AS n_rows,
            CAST(CAST(round(sum(n) / count(*), 6) AS DECIMAL(38,6)) AS VARCHAR) AS mean_answer,
            sum(toxic)::VARCHAR AS n_toxic FROM p GROUP BY lang)
        SELECT lang AS run_id, 'n_rows' AS key, n_rows AS value FROM m
        UNION ALL SELECT lang, 'mean_answer', mean_answer FROM m
        UNION ALL SELECT lang, 'n_toxic', n_toxic FROM m""",
)
def eval_run(spark, sf_dir):
    """Score the evaluation set, measure the answers, store the metrics, read them back."""
    rows = load_spread(spark, sf_dir, "documents", "doc_id").select("doc_id", "lang", F.col("text").alias("prompt"))
    scored = batch_predict(rows, "prompt", word_count_model).select(
        "doc_id", "lang", F.regexp_extract("prediction", "^words=([0-9]+)", 1).cast("bigint").alias("answer")
    )
    marked = scored.join(load(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    metrics = marked.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_rows"), mean("answer").alias("mean_answer"), F.sum("toxic").alias("n_toxic")
    )
    path = fresh_path(spark, "run-log")
    append_log(long_form(metrics, "lang", ["n_rows", "mean_answer", "n_toxic"]), path)
    return read_log(spark, path)


@query(
    "prompt_search",
    f"""WITH {SQL_SCORED}, {SQL_REGISTRY},
        b AS (SELECT name, round(sum(score) / count(*), 6) AS s FROM scored GROUP BY name ORDER BY s DESC, name LIMIT 1),
        w AS (SELECT template FROM cand_p JOIN b ON b.name = cand_p.name),
        g AS (SELECT name, version, template FROM registry UNION ALL
              SELECT 'Brand#7', (SELECT max(version) + 1 FROM registry WHERE name = 'Brand#7'), template FROM w)
        SELECT name, max(version) AS version, arg_max(template, version) AS template FROM g GROUP BY name""",
)
def prompt_search(spark, sf_dir):
    """The best candidate becomes the next version of its prompt."""
    candidates = candidate_prompts(spark, sf_dir)
    winner = best(mean_scores(candidate_scores(spark, sf_dir, candidates)))
    template = candidates.join(winner.select("name"), "name").select("template")
    return latest(with_new_version(prompt_registry(spark, sf_dir), F.lit("Brand#7"), template))


@query(
    "usage_report",
    """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events
       WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 2 DAY GROUP BY ALL""",
)
def usage_report(spark, sf_dir):
    """Usage by day and type over the last two days of the data."""
    events = load(spark, sf_dir, "events").select("ts", "event_type", "value")
    newest = events.agg(F.max("ts").alias("ts"))
    recent = events.where(F.col("ts") >= newest.select(F.expr("ts - INTERVAL 2 DAYS")).scalar())
    return recent.groupBy(F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd").alias("day"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")
    )


# Fixed value: how a transcribed question is asked.
ASK = "Magic 8 Ball please answer this question -  {question}"


@query(
    "transcribe_answer",
    """SELECT conv_id, turn, array_to_string(list_slice(string_split(
         'Magic 8 Ball please answer this question -  ' || text, ' '), 1, 128), ' ') AS raw,
         replace(raw, 'Magic 8 Ball', '') AS answer FROM conversations WHERE role = 'user'""",
)
def transcribe_answer(spark, sf_dir):
    """Bytes, payload, transcript, question, answer without the phrase."""
    users = load(spark, sf_dir, "conversations").where("role = 'user'")
    cell = one_line_base64(F.encode("text", "UTF-8"))
    frame = F.struct(
        F.array(F.lit(0)).alias("columns"), F.array(F.lit(0)).alias("index"), F.array(F.array(cell)).alias("data")
    )
    sent = users.select("conv_id", "turn", F.to_json(F.struct(frame.alias("dataframe_split"))).alias("payload"))
    heard = batch_predict(sent, "payload", transcript_model, "body")
    question, _ = first_prediction(F.lit(200), F.col("body"))
    asked = heard.select("conv_id", "turn", fill(ASK, {"question": question}).alias("prompt"))
    said = batch_predict(asked, "prompt", echo_model(128), "raw")
    return said.select("conv_id", "turn", "raw", without_phrase(F.col("raw"), "Magic 8 Ball").alias("answer"))
