"""Operators for preparing training text, with their queries and SQL."""

from docweft.llm import (  # noqa: F401
    bpe,
    divergence,
    exact_dedup,
    language,
    near_dedup,
    neighbours,
    packing,
    pii,
    quality,
    token_counts,
    toxicity,
    vector_codes,
    warc,
)
from docweft.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
