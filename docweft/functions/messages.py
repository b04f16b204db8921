"""Column expressions over chat messages, responses and JSON payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MESSAGES = "array<struct<role:string,content:string>>"
# Fixed values of the message protocol.
DONE = "response.output_item.done"
NO_RESPONSE = "No response from tool"
STOPPED = "Max iterations reached. Stopping."
DEFAULT_PROMPT = "You are a helpful AI assistant that can use tools when needed."


def message(role: str | Column, content: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), content.alias("content"))


def system_and_user(system: Column, user: Column) -> Column:
    return F.array(message("system", system), message("user", user))


def chain_role(role: Column) -> Column:
    """user is human, assistant is ai, anything else has no counterpart."""
    return F.when(role == "user", "human").when(role == "assistant", "ai")


def route(intent: Column) -> Column:
    """Ordered, case-sensitive test for the route words; general is the rest."""
    return (
        F.when(F.contains(intent, F.lit("research")), "research")
        .when(F.contains(intent, F.lit("reporting")), "reporting")
        .otherwise("general")
    )


def step_kind(role: Column, type_: Column) -> Column:
    """What the last message asks for: nothing more, a tool, or the model."""
    return F.when(role == "assistant", "final").when(type_ == "function_call", "tool").otherwise("llm")


def output_text(parts: Column) -> Column:
    """Texts of the output parts of a message, joined without a separator."""
    kept = F.filter(parts, lambda p: p["type"] == "output_text")
    return F.array_join(F.transform(kept, lambda p: F.coalesce(p["text"], F.lit(""))), "")


def first_text(parts: Column, raw: Column, otherwise: str = NO_RESPONSE) -> Column:
    """Text of the first part, else the raw response, else a fixed text."""
    return F.coalesce(F.try_element_at(parts, F.lit(1))["text"], raw, F.lit(otherwise))


def flattened_history(pairs: Column, current: Column) -> Column:
    """(human, ai) pairs as alternating messages, followed by the current one."""
    before = F.flatten(
        F.transform(pairs, lambda p: F.array(message("user", p["human"]), message("assistant", p["ai"])))
    )
    return F.concat(before, F.array(message("user", current)))


def with_history(history: Column, question: Column) -> Column:
    """The question itself without history, else history and question in lines.

    Stands in for a model that rewrites the question.
    """
    return F.when(F.size(history) == 0, question).otherwise(
        F.array_join(F.concat(history, F.array(question)), "\n")
    )


def one_line_base64(content: Column) -> Column:
    return F.regexp_replace(F.base64(content), "[\\r\\n]", "")
