"""Numbering, top rows, hold-back, and bag unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweft.functions.messages import STOPPED
from docweft.functions.text import lines
from docweft.operators.citations import found_citations
from docweft.operators.conversations import appended, last_messages, with_system
from docweft.operators.numbering import numbered, top_per_key
from docweft.operators.prompts import changes
from docweft.operators.signal import held_back
from docweft.operators.tools import MAX_ROUNDS, union_of
from docweft.plans.frames import SQL_PAPERS, SQL_REGISTRY, papers, prompt_registry
from docweft.plans.grouping import SQL_RESOURCES, resources
from docweft.plans.registry import query
from docweft.session import staged
from docweft.sources.tables import load


@query(
    "number_outputs",
    """SELECT conv_id, turn, 'input_prompt_' || n AS input_name, 'output_' || n || '.txt' AS output_name FROM (
         SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n
         FROM conversations WHERE role = 'user')""",
)
def number_outputs(spark, sf_dir):
    users = load(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn")
    rows = numbered(users, ["conv_id"], "turn", "n")
    return rows.select(
        "conv_id",
        "turn",
        F.format_string("input_prompt_%d", "n").alias("input_name"),
        F.format_string("output_%d.txt", "n").alias("output_name"),
    )


@query(
    "last_message",
    """SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, arg_max(text, turn) AS text
       FROM conversations GROUP BY conv_id""",
)
def last_message(spark, sf_dir):
    return last_messages(load(spark, sf_dir, "conversations"))


@query(
    "iteration_cap",
    f"""SELECT user_id, rk AS step, event_type AS item FROM (
          SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rk FROM events)
        WHERE rk <= {MAX_ROUNDS}
        UNION ALL SELECT user_id, {MAX_ROUNDS + 1}, '{STOPPED}' FROM events GROUP BY user_id
          HAVING count(*) >= {MAX_ROUNDS}""",
)
def iteration_cap(spark, sf_dir):
    """At most ten steps per request; whoever uses the tenth also gets the stop message."""
    events = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    steps = top_per_key(events, ["user_id"], [F.col("event_id")], MAX_ROUNDS, "step")
    stop = F.struct(F.lit(MAX_ROUNDS + 1).cast("bigint").alias("step"), F.lit(STOPPED).alias("item"))
    step = F.struct("step", F.col("event_type").alias("item"))
    items = F.when(F.col("step") == MAX_ROUNDS, F.array(step, stop)).otherwise(F.array(step))
    return steps.select("user_id", F.inline(items))


@query(
    "prompt_changed",
    f"""WITH {SQL_REGISTRY} SELECT name, version, template IS DISTINCT FROM
          lag(template) OVER (PARTITION BY name ORDER BY version) AS changed FROM registry""",
)
def prompt_changed(spark, sf_dir):
    return changes(staged(prompt_registry(spark, sf_dir), "registry"))


FLUSH_EVERY = 10
FLUSH_HELD = 3
SQL_FLUSHED = f"""SELECT event_id, user_id, least((i + 1 + {FLUSH_HELD} + {FLUSH_EVERY - 1}) // {FLUSH_EVERY},
    n // {FLUSH_EVERY} + 1) AS flush_no FROM (
  SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i,
    count(*) OVER (PARTITION BY user_id) AS n FROM events)"""


@query("holdback_window", SQL_FLUSHED)
def holdback_window(spark, sf_dir):
    events = load(spark, sf_dir, "events").select("event_id", "user_id")
    return held_back(events, ["user_id"], "event_id", FLUSH_EVERY, FLUSH_HELD)


@query(
    "first_n",
    """SELECT source || '/' || doc_id AS name, n_chars FROM documents ORDER BY name LIMIT 4""",
)
def first_n(spark, sf_dir):
    name = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    return load(spark, sf_dir, "documents").select(name.alias("name"), "n_chars").orderBy("name").limit(4)


@query(
    "top1_desc",
    f"""WITH {SQL_REGISTRY} SELECT name, version, template FROM registry WHERE name = 'Brand#7'
        ORDER BY version DESC LIMIT 1""",
)
def top1_desc(spark, sf_dir):
    registry = prompt_registry(spark, sf_dir, "Brand#7")
    return registry.select("name", "version", "template").orderBy(F.col("version").desc()).limit(1)


@query(
    "tool_union",
    """SELECT DISTINCT 'function' AS kind, p_brand AS name FROM part
       UNION ALL SELECT DISTINCT 'vector_search', source FROM documents
       UNION ALL SELECT DISTINCT 'external', c_name FROM customer
       UNION ALL SELECT DISTINCT 'managed', n_name FROM nation
       UNION ALL SELECT DISTINCT 'local', event_type FROM events""",
)
def tool_union(spark, sf_dir):
    def names(table, column):
        return load(spark, sf_dir, table).select(F.col(column).alias("name"))

    return union_of(
        {
            "function": names("part", "p_brand"),
            "vector_search": names("documents", "source"),
            "external": names("customer", "c_name"),
            "managed": names("nation", "n_name"),
            "local": names("events", "event_type"),
        }
    )


@query("manifest_union", f"WITH {SQL_RESOURCES} SELECT kind, name FROM resources")
def manifest_union(spark, sf_dir):
    return resources(spark, sf_dir)


@query("match_extend", f"WITH {SQL_PAPERS} SELECT src, dst FROM found UNION ALL SELECT src, dst FROM found")
def match_extend(spark, sf_dir):
    """Two pages per paper carry the same references; every match is kept."""
    pages = papers(spark, sf_dir).withColumn("text", F.concat_ws("\n", "text", "text"))
    per_page = pages.select("paper", F.explode(lines(F.col("text"))).alias("text"))
    return found_citations(per_page, "paper", "text")


@query(
    "message_append",
    """SELECT conv_id, turn, role, text FROM conversations
       UNION ALL SELECT conv_id, max(turn) + 1, 'assistant', 'Reply to: ' || arg_max(text, turn)
         FROM conversations GROUP BY conv_id HAVING arg_max(role, turn) = 'user'""",
)
def message_append(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations")
    open_ = last_messages(rows).where("role = 'user'")
    answers = open_.select("conv_id", "turn", F.lit("assistant").alias("role"), F.concat(F.lit("Reply to: "), "text").alias("text"))
    return appended(rows, answers)


SYSTEM_PROMPT = "Answer briefly."


@query(
    "system_prepend",
    f"""SELECT conv_id, turn + 1 AS turn, role, text FROM conversations
        UNION ALL SELECT conv_id, min(turn), 'system', '{SYSTEM_PROMPT}' FROM conversations GROUP BY conv_id""",
)
def system_prepend(spark, sf_dir):
    return with_system(load(spark, sf_dir, "conversations"), SYSTEM_PROMPT)
