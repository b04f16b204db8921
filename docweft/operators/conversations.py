"""Conversations kept long: one row per (conv_id, turn), never one cell per conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.operators.numbering import with_neighbours

KEY = ["conv_id"]


def last_messages(conversations: DataFrame) -> DataFrame:
    """The final message per conversation: ``(conv_id, turn, role, text)``."""
    last = conversations.groupBy("conv_id").agg(F.max_by(F.struct("turn", "role", "text"), "turn").alias("m"))
    return last.select("conv_id", "m.turn", "m.role", "m.text")


def history_pairs(conversations: DataFrame) -> DataFrame:
    """User turns answered by the next turn: ``(conv_id, turn, human, ai)``."""
    paired = with_neighbours(conversations, KEY, "turn", ["role", "text"], ["after"], after=True)
    return paired.where((F.col("role") == "user") & (F.col("after.role") == "assistant")).select(
        "conv_id", "turn", F.col("text").alias("human"), F.col("after.text").alias("ai")
    )


BLOCK = 1024


def requests(conversations: DataFrame, assistant: str = "assistant") -> DataFrame:
    """The messages of every request, long: ``(conv_id, turn, pos, role, content)``.

    A request is the last user turn of a conversation and ``turn`` its number. All
    messages before it, whoever wrote them, are its history; ``pos`` is a message's
    own turn, that of the request comes last. The AI side is named ``assistant``. A null
    text is empty. Conversations without a user turn ask nothing.

    Messages meet their request per block of turns, so a conversation may hold any
    share of the rows.
    """
    rows = conversations.withColumn("_b", F.floor(F.col("turn") / BLOCK))
    asked = rows.where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("asked"))
    blocks = rows.groupBy("conv_id", "_b").agg(F.lit(1).alias("_one")).drop("_one").join(asked, "conv_id")
    messages = rows.join(blocks, ["conv_id", "_b"]).where(F.col("turn") <= F.col("asked"))
    role = F.when(F.col("role") == "assistant", assistant).otherwise(F.col("role"))
    return messages.select(
        "conv_id", F.col("asked").alias("turn"), F.col("turn").alias("pos"), role.alias("role"),
        F.coalesce("text", F.lit("")).alias("content"),
    )


def request_texts(messages: DataFrame, line: Column, separator: str = "\n") -> DataFrame:
    """One row per request, ``(conv_id, turn, text)``: ``line`` of its messages in order, put together per block first."""
    lines = messages.select("conv_id", "turn", "pos", F.concat(line, F.lit(separator)).alias("_line"))
    joined = joined_deltas(lines, ["conv_id", "turn"], "pos", "_line", BLOCK)
    whole = F.substring("text", F.lit(1), F.char_length("text") - len(separator))
    return joined.select("conv_id", "turn", whole.alias("text"))


TURNS = 1 << 32


def request_id() -> Column:
    """One number per (conversation, turn).

    Room for 2^31 conversations of 2^32 turns; beyond that the product
    overflows and the job stops.
    """
    return F.col("conv_id") * F.lit(TURNS) + F.col("turn")


def appended(conversations: DataFrame, answers: DataFrame) -> DataFrame:
    """Add one message per conversation after its last turn.

    ``answers`` has ``conv_id, turn`` (of the last message), ``role, text``.
    """
    new = answers.select("conv_id", (F.col("turn") + 1).alias("turn"), "role", "text")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(new)


def with_system(conversations: DataFrame, prompt: str) -> DataFrame:
    """Put a system message before the first turn of every conversation.

    With an empty prompt the conversations stay as they are.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    if not prompt:
        return rows
    shifted = rows.withColumn("turn", F.col("turn") + 1)
    first = rows.groupBy("conv_id").agg(F.min("turn").alias("turn"))
    system = first.select("conv_id", "turn", F.lit("system").alias("role"), F.lit(prompt).alias("text"))
    return shifted.unionByName(system)


def joined_deltas(deltas: DataFrame, keys: list[str], seq: str, delta: str, block: int = 1024) -> DataFrame:
    """Text deltas put together per item in order, first per block of deltas, then per item."""
    blocks = deltas.groupBy(*keys, F.floor(F.col(seq) / block).alias("_b")).agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct(seq, delta))), lambda d: d[delta]), ""
        ).alias("_part")
    )
    return blocks.groupBy(*keys).agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("_b", "_part"))), lambda d: d["_part"]), ""
        ).alias("text")
    )
