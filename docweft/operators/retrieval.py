"""Projections onto the columns a retriever returns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mapped(df: DataFrame, renamed: Mapping[str, str], kept: Sequence[str] = ()) -> DataFrame:
    """Columns of a foreign table under the names the caller works with.

    ``renamed`` maps a new name to an existing column; all other columns except
    ``kept`` are dropped.
    """
    missing = [c for c in [*renamed.values(), *kept] if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    return df.select(*[F.col(old).alias(new) for new, old in renamed.items()], *kept)
