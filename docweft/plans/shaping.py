"""Scalar functions and text, message and JSON shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweft.functions.messages import (
    chain_role,
    first_text,
    message,
    system_and_user,
)
from docweft.functions.text import (
    fill,
    function_name,
    lines,
    path_tail,
    preview,
    user_slug,
    without_phrase,
)
from docweft.functions.tools import calculator_error, calculator_value, register_sql_functions, value_or_error
from docweft.operators.citations import found_citations
from docweft.operators.conversations import history_pairs as pairs_of
from docweft.operators.conversations import request_texts
from docweft.operators.profile import schema_profile
from docweft.operators.tools import calculator_registry, dispatched
from docweft.plans.frames import (
    SQL_CALLS,
    SQL_PAPERS,
    SQL_REQUESTS,
    chat_requests,
    document_chunks,
    papers,
    sql_chunks,
    sql_error,
    sql_value,
    tool_calls,
)
from docweft.plans.lookups import SQL_DISPATCHED
from docweft.plans.registry import query
from docweft.sources.tables import load


@query("token_chunks", f"WITH {sql_chunks()} SELECT doc_id, chunk_no, text FROM chunk")
def token_chunks(spark, sf_dir):
    return document_chunks(spark, sf_dir).select("doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), "text")


@query("extract_citations", f"WITH {SQL_PAPERS} SELECT src, dst FROM found")
def extract_citations(spark, sf_dir):
    return found_citations(papers(spark, sf_dir), "paper", "text")


@query(
    "path_tail",
    "SELECT page_id, replace(list_extract(string_split(url || '.pdf', '/'), -1), '.pdf', '') AS name FROM pages",
)
def path_tails(spark, sf_dir):
    path = F.concat("url", F.lit(".pdf"))
    return load(spark, sf_dir, "pages").select("page_id", path_tail(path).alias("name"))


@query(
    "user_slug",
    """SELECT c_custkey, replace(split_part('first.last' || c_custkey || '@x.org', '@', 1), '.', '_') AS slug
       FROM customer""",
)
def user_slugs(spark, sf_dir):
    user = F.concat(F.lit("first.last"), F.col("c_custkey").cast("string"), F.lit("@x.org"))
    return load(spark, sf_dir, "customer").select("c_custkey", user_slug(user).alias("slug"))


@query(
    "tool_to_function_name",
    "SELECT p_partkey, 'main.' || replace(p_brand, '#', '.') || '.' || replace(p_name, ' ', '_') AS name FROM part",
)
def tool_to_function_name(spark, sf_dir):
    tool = F.concat_ws(
        "__", F.lit("main"), F.replace("p_brand", F.lit("#"), F.lit("__")), F.replace("p_name", F.lit(" "), F.lit("_"))
    )
    return load(spark, sf_dir, "part").select("p_partkey", function_name(tool).alias("name"))


EMPTY_PARAMETERS = '{"type": "object", "properties": {}}'


@query(
    "spec_normalise",
    f"""SELECT p_partkey, p_name AS name,
          coalesce(nullif(CASE WHEN p_size < 10 THEN '' WHEN p_size < 20 THEN NULL ELSE p_type END, ''),
            'Tool from ' || p_brand) AS description,
          CASE WHEN p_size < 30 THEN '{{"size": ' || p_size || '}}' ELSE '{EMPTY_PARAMETERS}' END AS parameters,
          FALSE AS has_strict FROM part""",
)
def spec_normalise(spark, sf_dir):
    given = F.when(F.col("p_size") < 10, "").when(F.col("p_size") >= 20, F.col("p_type"))
    parameters = F.when(
        F.col("p_size") < 30, F.concat(F.lit('{"size": '), F.col("p_size").cast("string"), F.lit("}"))
    )
    spec = F.struct(
        F.col("p_name").alias("name"),
        given.alias("description"),
        parameters.alias("parameters"),
        F.lit(True).alias("strict"),
    )
    specs = load(spark, sf_dir, "part").select("p_partkey", "p_brand", spec.alias("spec"))
    clean = (
        F.col("spec")
        .withField(
            "description",
            F.coalesce(F.nullif(F.col("spec.description"), F.lit("")), F.concat(F.lit("Tool from "), "p_brand")),
        )
        .withField("parameters", F.coalesce("spec.parameters", F.lit(EMPTY_PARAMETERS)))
        .dropFields("strict")
    )
    return specs.select("p_partkey", clean.alias("spec")).select(
        "p_partkey", "spec.*", F.contains(F.to_json("spec"), F.lit('"strict"')).alias("has_strict")
    )


@query(
    "preview",
    """SELECT doc_id, substr(text, 1, 100) || '...' AS short, substr(text, 1, 500) || '...' AS long,
         substr(source, 1, 8) || '...' AS source FROM documents""",
)
def previews(spark, sf_dir):
    return load(spark, sf_dir, "documents").select(
        "doc_id",
        preview(F.col("text"), 100).alias("short"),
        preview(F.col("text"), 500).alias("long"),
        preview(F.col("source"), 8).alias("source"),
    )


@query("response_clean", "SELECT doc_id, replace(text, 'the ', '') AS text FROM documents")
def response_clean(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", without_phrase(F.col("text"), "the ").alias("text"))


@query(
    "prompt_fill",
    """SELECT doc_id, 'Question from ' || source || ' {context}: ' || lang || chr(10) || text || ' {input}' AS prompt
       FROM documents""",
)
def prompt_fill(spark, sf_dir):
    """Values that hold braces themselves stay as they are."""
    values = {
        "who": F.concat("source", F.lit(" {context}")),
        "input": F.col("lang"),
        "context": F.concat("text", F.lit(" {input}")),
    }
    prompt = fill("Question from {who}: {input}\n{context}", values)
    return load(spark, sf_dir, "documents").select("doc_id", prompt.alias("prompt"))


@query(
    "message_array",
    """SELECT conv_id, turn, unnest([0, 1])::BIGINT AS pos, unnest(['system', 'user']) AS role,
         unnest(['You are helpful.', text]) AS content FROM conversations WHERE role = 'user'""",
)
def message_array(spark, sf_dir):
    users = load(spark, sf_dir, "conversations").where("role = 'user'")
    both = users.select("conv_id", "turn", F.posexplode(system_and_user(F.lit("You are helpful."), F.col("text"))).alias("pos", "m"))
    return both.select("conv_id", "turn", F.col("pos").cast("bigint").alias("pos"), "m.role", "m.content")


@query(
    "history_flatten",
    f"WITH {SQL_REQUESTS} SELECT conv_id, turn, pos, role, content FROM req_m",
)
def history_flatten(spark, sf_dir):
    """Every request as its whole list of messages, one per row."""
    return chat_requests(spark, sf_dir).select("conv_id", "turn", "pos", "role", "content")


@query(
    "role_map",
    """SELECT conv_id, turn, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'ai' END AS kind
       FROM conversations""",
)
def role_map(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", chain_role(F.col("role")).alias("kind"))


@query(
    "history_pairs",
    """SELECT conv_id, turn, text AS human, t1 AS ai FROM (
         SELECT *, lead(role) OVER w AS r1, lead(text) OVER w AS t1 FROM conversations
         WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND r1 = 'assistant'""",
)
def history_pairs(spark, sf_dir):
    return pairs_of(load(spark, sf_dir, "conversations"))


@query(
    "json_answer",
    """SELECT event_id, CASE WHEN event_type <> 'error' THEN event_type END AS response,
         CASE WHEN event_type <> 'error' THEN event_type = 'purchase' END AS tool_use, event_type = 'error' AS unreadable
       FROM events""",
)
def json_answer(spark, sf_dir):
    """Unreadable answers are marked, never dropped."""
    kind = F.col("event_type")
    used = F.when(kind == "purchase", "true").otherwise("false")
    said = F.when(kind == "error", "I cannot answer {").otherwise(
        F.concat(F.lit('{"response": "'), kind, F.lit('", "tool_use": '), used, F.lit("}"))
    )
    parsed = F.from_json(
        said,
        "response STRING, tool_use BOOLEAN, _corrupt_record STRING",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"},
    )
    return load(spark, sf_dir, "events").select("event_id", parsed.alias("a")).select(
        "event_id", "a.response", "a.tool_use", F.col("a._corrupt_record").isNotNull().alias("unreadable")
    )


@query("json_args", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_args(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.from_json("props", "k BIGINT").alias("a")).select("event_id", "a.k")


@query(
    "json_request",
    f"""WITH {SQL_REQUESTS} SELECT conv_id, turn, n_messages, n_answers AS n_agent, first_content, text AS last_content
        FROM req""",
)
def json_request(spark, sf_dir):
    """Requests with their whole history as JSON text, checked through the fields read back from it.

    The receiving service names the AI side ``agent``.
    """
    messages = request_texts(chat_requests(spark, sf_dir, "agent"), F.to_json(F.struct("role", "content")), ",")
    body = F.concat(F.lit('{"messages":['), "text", F.lit("]}"))
    rows = messages.select("conv_id", "turn", body.alias("body"))
    back = F.from_json("body", "messages array<struct<role:string,content:string>>")["messages"]
    return rows.select("conv_id", "turn", back.alias("m")).select(
        "conv_id",
        "turn",
        F.size("m").cast("bigint").alias("n_messages"),
        F.size(F.filter("m", lambda x: x["role"] == "agent")).cast("bigint").alias("n_agent"),
        F.try_element_at("m", F.lit(1))["content"].alias("first_content"),
        F.try_element_at("m", F.lit(-1))["content"].alias("last_content"),
    )


@query(
    "nested_select",
    """SELECT conv_id, turn, 'user' AS role, text AS question, t1 AS expected_response FROM (
         SELECT *, lead(role) OVER w AS r1, lead(text) OVER w AS t1 FROM conversations
         WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND r1 = 'assistant'""",
)
def nested_select(spark, sf_dir):
    pairs = pairs_of(load(spark, sf_dir, "conversations"))
    training = pairs.select(
        "conv_id",
        "turn",
        F.struct(F.struct(F.array(message("user", F.col("human"))).alias("messages")).alias("inputs")).alias("inputs"),
        F.struct(F.col("ai").alias("expected_response")).alias("expectations"),
    )
    first = F.try_element_at("inputs.inputs.messages", F.lit(1))
    return training.select(
        "conv_id",
        "turn",
        first["role"].alias("role"),
        first["content"].alias("question"),
        F.col("expectations.expected_response").alias("expected_response"),
    )


@query(
    "calculator",
    f"WITH {SQL_CALLS} SELECT call_id, name, round({sql_value()}, 6) AS value, {sql_error()} AS error FROM calls",
)
def calculator(spark, sf_dir):
    op, x, y = F.col("name"), F.col("x"), F.col("y")
    return tool_calls(spark, sf_dir).select(
        "call_id", "name", F.round(calculator_value(op, x, y), 6).alias("value"), calculator_error(op, y).alias("error")
    )


@query(
    "add_numbers",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_extendedprice + l_tax, 6) AS total FROM lineitem",
)
def add_numbers(spark, sf_dir):
    register_sql_functions(spark)
    return load(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "round(add_numbers(l_extendedprice, l_tax), 6) AS total"
    )


@query("add_two", "SELECT event_id, user_id + 2 AS result FROM events")
def add_two(spark, sf_dir):
    register_sql_functions(spark)
    return load(spark, sf_dir, "events").selectExpr("event_id", "add_two(user_id) AS result")


@query("value_or_error", f"WITH {SQL_DISPATCHED} SELECT call_id, coalesce(error, output) AS result FROM outputs")
def values_or_errors(spark, sf_dir):
    done = dispatched(tool_calls(spark, sf_dir), calculator_registry(spark))
    return done.select("call_id", value_or_error(F.col("error"), F.col("output")).alias("result"))


@query(
    "first_content_text",
    """SELECT conv_id, turn, CASE role WHEN 'user' THEN string_split(text, chr(10))[1] WHEN 'assistant' THEN text
         ELSE 'No response from tool' END AS content FROM conversations""",
)
def first_content_text(spark, sf_dir):
    """User messages come as parts, assistant ones raw, system ones empty."""
    parts = F.transform(lines(F.col("text")), lambda l: F.struct(F.lit("text").alias("type"), l.alias("text")))
    parts = F.when(F.col("role") == "user", parts).otherwise(F.array().cast("array<struct<type:string,text:string>>"))
    raw = F.when(F.col("role") == "assistant", F.col("text"))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", first_text(parts, raw).alias("content"))


@query(
    "infer_schema_profile",
    """SELECT 'doc_id' AS "column", 'bigint' AS type, TRUE AS nullable, count(*) AS n_rows, count(*) - count(doc_id) AS n_nulls
         FROM documents
       UNION ALL SELECT 'text', 'string', TRUE, count(*), count(*) - count(text) FROM documents
       UNION ALL SELECT 'lang', 'string', TRUE, count(*), count(*) - count(lang) FROM documents
       UNION ALL SELECT 'source', 'string', TRUE, count(*), count(*) - count(source) FROM documents
       UNION ALL SELECT 'n_chars', 'bigint', TRUE, count(*), count(*) - count(n_chars) FROM documents""",
)
def infer_schema_profile(spark, sf_dir):
    return schema_profile(load(spark, sf_dir, "documents"))
