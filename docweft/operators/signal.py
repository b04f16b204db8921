"""Sample arrays and held-back emission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.operators.numbering import numbered

PEAK = 32767


def peak_normalised(samples: Column) -> Column:
    """A clip scaled by its loudest sample to 16 bits, truncated toward zero; silence stays silent."""
    values = F.transform(samples, lambda x: x.cast("double"))
    peak = F.array_max(F.transform(values, F.abs))
    return F.transform(
        values, lambda x: F.coalesce(F.try_divide(x, peak) * PEAK, F.lit(0.0)).cast("bigint").cast("smallint")
    )


def check_window(every: int, held: int) -> None:
    if not 1 <= held < every:
        raise ValueError("need 1 <= held < every")


def flush_number(index: Column, total: Column, every: int, held: int) -> Column:
    """Emission a row belongs to, by its 0-based index among ``total`` rows of its key.

    Each time ``every`` more rows have arrived all but the last ``held`` go out;
    the end flushes the rest.
    """
    regular = F.ceil((index + 1 + held) / every)
    return F.least(regular, F.floor(total / every) + 1).cast("bigint")


def held_back(rows: DataFrame, keys: list[str], order: str, every: int, held: int) -> DataFrame:
    """Add ``flush_no`` to every row."""
    check_window(every, held)
    counted = numbered(rows, keys, order, "_rn", "_total")
    return counted.withColumn(
        "flush_no", flush_number(F.col("_rn") - 1, F.col("_total"), every, held)
    ).drop("_rn", "_total")
