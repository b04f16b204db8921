"""Tool registries, dispatch and the bounded tool loop."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.functions.messages import STOPPED
from docweft.functions.tools import (
    OPERATION_ERROR,
    OPERATIONS,
    calculator_error,
    calculator_value,
    number_text,
    value_or_error,
)
from docweft.operators.numbering import newest
from docweft.operators.scoring import Model, batch_predict
from docweft.operators.sizes import sent
from docweft.session import fresh_path

MAX_ROUNDS = 10


def union_of(kinds: dict[str, DataFrame]) -> DataFrame:
    """One registry ``(kind, name)`` from frames with a ``name`` column; names are distinct per kind."""
    parts = [df.select("name").distinct().select(F.lit(kind).alias("kind"), "name") for kind, df in kinds.items()]
    return reduce(DataFrame.unionByName, parts)


def last_wins(registry: DataFrame, order: str) -> DataFrame:
    """One row per tool name, the last one registered."""
    return newest(registry, ["name"], F.col(order).desc())


def dispatched(calls: DataFrame, registry: DataFrame) -> DataFrame:
    """Each call with its tool's output as text, or an error.

    ``calls`` has ``name, x, y``, ``registry`` has ``name``. A name the registry
    lacks becomes an error row, not a failed job. A tool may take any share of
    the calls: the registry is sent to them unless it is very large.
    """
    known = sent(registry.select("name", F.lit(True).alias("_known")))
    op, x, y = F.col("name"), F.col("x"), F.col("y")
    error = F.when(F.col("_known").isNull(), F.concat(F.lit("Unknown tool: "), op)).otherwise(calculator_error(op, y))
    joined = calls.join(known, "name", "left").withColumn("error", error)
    output = F.when(F.col("error").isNull(), number_text(calculator_value(op, x, y)))
    return joined.withColumn("output", output).drop("_known")


def calculator_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(op,) for op in OPERATIONS], "name STRING")


def listed_calls_planner() -> Model:
    """Stand-in: the request is a JSON list of calls; asks for the next one, answers with the last output."""
    import json

    def reply(conversation: str) -> str:
        messages = json.loads(conversation)
        listed = json.loads(messages[0].get("content") or "[]")
        outputs = [m.get("content") for m in messages if m["type"] == "function_call_output"]
        if len(outputs) < len(listed):
            return json.dumps(listed[len(outputs)])
        return json.dumps({"answer": f"Answer: {outputs[-1] if outputs else 'nothing to compute'}"})

    return lambda conversations: [reply(c) for c in conversations]


def tool_loop(
    requests: DataFrame, planner: Callable[[], Model], registry: DataFrame | None = None, max_rounds: int = MAX_ROUNDS
) -> DataFrame:
    """All requests, one step per round, until each is answered or the rounds are used up.

    ``requests`` has ``request_id, prompt, answered`` (its conversation already ends
    on an assistant message), ``registry`` has ``name``. Returns the items produced,
    ``(request_id, round, type, content)``.

    The planner is a model that is built once per task and sees each open request's
    messages, ``[{"type", "content"}]`` as JSON: the prompt, then calls and outputs. It
    replies ``{"name", "x", "y"}`` to call a tool or ``{"answer"}``; any other reply is
    itself the answer. So what it asks next may depend on what a tool gave.

    A round looks at the last message only: odd rounds plan, even rounds run tools, and
    both are one pass over the open requests. They are never shuffled: the registry is
    sent to them. State is one row per open request, kept as a table in the shared
    folder, so a lost executor costs a task, not the loop.
    """
    spark = requests.sparkSession
    root = fresh_path(spark, "tool-loop")
    known = sent((calculator_registry(spark) if registry is None else registry).select("name", F.lit(True).alias("known")).distinct())
    op, x, y = F.col("name"), F.col("x"), F.col("y")
    asked = F.concat(op, F.lit("("), number_text(x), F.lit(", "), number_text(y), F.lit(")"))
    result = F.when(F.col("known").isNull(), OPERATION_ERROR).otherwise(
        value_or_error(calculator_error(op, y), number_text(calculator_value(op, x, y)))
    )

    def message(type_, content):
        return F.struct(F.lit(type_).alias("type"), content.alias("content"))

    schema = "request_id BIGINT, asked STRING, output STRING, answer STRING, messages ARRAY<STRUCT<type: STRING, content: STRING>>"
    state = requests.where(~F.col("answered")).select("request_id", F.array(message("message", F.col("prompt"))).alias("messages"))
    for number in range(1, (max_rounds + 1) // 2 + 1):
        told = batch_predict(state.withColumn("conversation", F.to_json("messages")), "conversation", planner, "reply")
        plan = F.from_json("reply", "name STRING, x DOUBLE, y DOUBLE, answer STRING")
        step = told.withColumn("plan", plan).select("request_id", "messages", "reply", "plan.*").join(known, "name", "left")
        step = step.select(
            "request_id",
            "messages",
            F.when(op.isNotNull(), asked).alias("asked"),
            F.when(op.isNotNull(), result).alias("output"),
            F.when(op.isNull(), F.coalesce("answer", "reply", F.lit(""))).alias("answer"),
        )
        grown = F.concat("messages", F.array(message("function_call", F.col("asked")), message("function_call_output", F.col("output"))))
        path = f"{root}/number={number}"
        step.withColumn("messages", F.when(F.col("answer").isNull(), grown)).write.parquet(path)
        state = spark.read.schema(schema).parquet(path).where("answer IS NULL").select("request_id", "messages")
        if state.isEmpty():
            break
    done = spark.read.schema(f"{schema}, number BIGINT").parquet(root).drop("messages")

    def item(round_, type_, content):
        return F.struct(round_.cast("bigint").alias("round"), F.lit(type_).alias("type"), content.alias("content"))

    plan, run = 2 * F.col("number") - 1, 2 * F.col("number")
    answered = F.array(item(plan, "message", F.col("answer")))
    called = F.array(item(plan, "function_call", F.col("asked")), item(run, "function_call_output", F.col("output")))
    taken = F.filter(
        F.when(F.col("answer").isNotNull(), answered).otherwise(called), lambda i: i["round"] <= max_rounds
    )
    # Whoever uses the last round, even to answer, also gets the stop message.
    stop = F.array(item(F.lit(max_rounds + 1), "message", F.lit(STOPPED)))
    ends = F.exists(taken, lambda i: i["round"] == max_rounds)
    return done.select("request_id", F.inline(F.when(ends, F.concat(taken, stop)).otherwise(taken)))
