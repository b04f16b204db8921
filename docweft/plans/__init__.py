"""Runnable queries over the input tables, each next to its independent SQL check."""

from docweft.plans import (  # noqa: F401
    composed,
    grouping,
    lookups,
    ordering,
    routing,
    scoring,
    shaping,
    storage,
    streams,
)
from docweft.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
