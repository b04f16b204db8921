"""Batch scoring with a model that is built once per task.

The shipped models are deterministic stand-ins; they say nothing about the
quality of a real model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Model = Callable[[list[str]], list[str]]


def batch_predict(df: DataFrame, prompt: str, factory: Callable[[], Model], output: str = "prediction") -> DataFrame:
    """Add a text column scored from ``prompt``, batch by batch.

    Only the prompts go to the model and only the answers come back.
    """
    if prompt not in df.columns:
        raise ValueError(f"no column {prompt}")

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = factory()
        for batch in batches:
            yield pa.array(model(batch.to_pylist()), pa.string())

    return df.withColumn(output, run(F.col(prompt)))


def word_count_model() -> Model:
    """Stand-in: how many words the prompt has and which comes first."""

    def answer(prompt: str) -> str:
        found = (prompt or "").split()
        return f"words={len(found)} first={found[0] if found else ''}"

    return lambda prompts: [answer(p) for p in prompts]


def keyword_intent_model() -> Model:
    """Stand-in: one-word intent from words that occur in the text."""

    def answer(prompt: str) -> str:
        padded = f" {prompt} "
        if " the " in padded:
            return "research"
        return "reporting" if " and " in padded else "general"

    return lambda prompts: [answer(p) for p in prompts]


def echo_model(max_tokens: int = 128) -> Callable[[], Model]:
    """Stand-in: the prompt itself, as far as the completion length allows."""

    def build() -> Model:
        return lambda prompts: [" ".join((p or "").split(" ")[:max_tokens]) for p in prompts]

    return build


def transcript_model() -> Model:
    """Stand-in for a transcription service: a split payload in, its first cell decoded out."""
    import base64
    import json

    def answer(payload: str) -> str:
        cell = json.loads(payload)["dataframe_split"]["data"][0][0]
        text = base64.b64decode(cell).decode("utf-8")
        return json.dumps({"predictions": [text]}, ensure_ascii=False)

    return lambda payloads: [answer(p) for p in payloads]
