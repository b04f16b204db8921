"""From ranked matches to filled prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweft.functions.text import fill

# The prompts the answers are built with.
RAG_SYSTEM = (
    "You are a helpful assistant designed to help customers undertake research on RAG models\n\n"
    "[Context]\n{rag_content}\n"
)
RAG_USER = "{user_input}"
# Our own words; only the placeholders and their order matter.
HISTORY_PROMPT = (
    "Question: {input}\nPassages: {context}\nEarlier messages: {chat_history}\nReply from the passages alone:"
)
QUERY_PROMPT = "Context information is below.\n{context}\nQuery: {input}\nAnswer:"


def joined_context(ranked: DataFrame, keys: list[str], rank: str = "rk", text: str = "text") -> DataFrame:
    """Texts of each question in rank order, a blank line between: ``(keys…, n_ctx, context)``.

    Groups hold the k rows a ranking kept.
    """
    listed = F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(text).alias("t"))))
    return ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_ctx"), F.array_join(F.transform(listed, lambda d: d["t"]), "\n\n").alias("context")
    )


def rag_messages(asked: DataFrame, question: str, context: str) -> DataFrame:
    """System and user text of the basic retrieval prompt."""
    return asked.withColumns(
        {
            "system": fill(RAG_SYSTEM, {"rag_content": F.col(context)}),
            "user": fill(RAG_USER, {"user_input": F.col(question)}),
        }
    )
