"""Request payloads of a scoring service, and what comes back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAYLOAD = "dataframe_split struct<columns:array<int>,index:array<int>,data:array<array<string>>>"


def split_payloads(rows: DataFrame, order: str, value: str, batch_rows: int) -> DataFrame:
    """One JSON request per batch of at most ``batch_rows`` rows: ``(batch_id, payload)``.

    Batches are ranges of a unique integer key, so none grows with the data.
    """
    batch = F.floor(F.col(order) / batch_rows).cast("bigint")
    lists = rows.groupBy(batch.alias("batch_id")).agg(
        F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("rows")
    )
    frame = F.struct(
        F.array(F.lit(0)).alias("columns"),
        F.sequence(F.lit(0), F.size("rows") - 1).alias("index"),
        F.transform("rows", lambda r: F.array(r["v"])).alias("data"),
    )
    return lists.select("batch_id", F.to_json(F.struct(frame.alias("dataframe_split"))).alias("payload"))


def payload_cells(payloads: DataFrame) -> DataFrame:
    """Read payloads back: ``(batch_id, idx, value)``."""
    parsed = payloads.select("batch_id", F.from_json("payload", PAYLOAD).alias("p")).select("batch_id", "p.dataframe_split.*")
    cells = F.explode(F.arrays_zip(F.col("index").alias("i"), F.col("data").alias("d")))
    return parsed.select("batch_id", cells.alias("c")).select(
        "batch_id", F.col("c.i").cast("bigint").alias("idx"), F.try_element_at("c.d", F.lit(1)).alias("value")
    )


def first_prediction(status: Column, body: Column) -> tuple[Column, Column]:
    """(prediction, error): a failed status or an unreadable body gives the error."""
    predictions = F.from_json(body, "predictions array<string>")["predictions"]
    prediction = F.when(status == 200, F.try_element_at(predictions, F.lit(1)))
    failed = F.concat(F.lit("Request failed with status "), status.cast("string"), F.lit(", "), body)
    error = F.when(status != 200, failed).when(predictions.isNull(), F.concat(F.lit("Unreadable response: "), body))
    return prediction, error
