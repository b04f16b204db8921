"""Streams, each with the batch form it must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweft.operators.conversations import joined_deltas, request_id
from docweft.operators.embedding import DIM
from docweft.plans.frames import CHUNK_OVERLAP, CHUNK_TOKENS, sql_chunks
from docweft.plans.ordering import FLUSH_EVERY, FLUSH_HELD, SQL_FLUSHED
from docweft.plans.registry import query
from docweft.plans.routing import completed, stream_events
from docweft.session import fresh_path
from docweft.sources.index import VectorIndex, index_rows
from docweft.sources.tables import SCHEMAS, load, table_path
from docweft.streaming.deltas import completed_items
from docweft.streaming.holdback import HeldBackSink
from docweft.streaming.runs import collect, drain, file_stream


def _stream(spark, sf_dir, table):
    return file_stream(spark, table_path(sf_dir, table), SCHEMAS[table])


def deltas(conversations):
    """Each message as its tokens: ``(item_id, seq, delta, last)``."""
    tokens = F.split("text", "(?<= )")
    cut = conversations.select(request_id().alias("item_id"), tokens.alias("t")).select(
        "item_id", F.size("t").alias("n"), F.posexplode("t").alias("seq", "delta")
    )
    return cut.select(
        "item_id", F.col("seq").cast("bigint").alias("seq"), "delta", (F.col("seq") == F.col("n") - 1).alias("last")
    )


SQL_ITEMS = "SELECT conv_id * 4294967296 + turn AS item_id, text FROM conversations"


@query("delta_aggregate", SQL_ITEMS)
def delta_aggregate(spark, sf_dir):
    return joined_deltas(deltas(load(spark, sf_dir, "conversations")), ["item_id"], "seq", "delta")


@query("delta_stream", SQL_ITEMS)
def delta_stream(spark, sf_dir):
    return collect(completed_items(deltas(_stream(spark, sf_dir, "conversations"))))


@query("holdback_stream", SQL_FLUSHED)
def holdback_stream(spark, sf_dir):
    sink = HeldBackSink(spark, fresh_path(spark, "held-back"), "user_id", "event_id", FLUSH_EVERY, FLUSH_HELD)
    drain(_stream(spark, sf_dir, "events").select("event_id", "user_id"), sink)
    return sink.finish("event_id BIGINT, user_id BIGINT")


@query("stream_collect", "SELECT event_id, user_id, props AS item FROM events WHERE event_type = 'purchase'")
def stream_collect(spark, sf_dir):
    """The streaming call drained: the same steps as the table form."""
    return collect(completed(stream_events(_stream(spark, sf_dir, "events"))))


@query("index_sync_stream", f"WITH {sql_chunks()} SELECT doc_id || '-' || chunk_no AS id, source, text FROM chunk")
def index_sync_stream(spark, sf_dir):
    """New documents are chunked, embedded and written under the batch number."""
    index = VectorIndex.open_or_create(spark, fresh_path(spark, "index"), DIM)

    def sync(batch, number):
        index.write(index_rows(batch, CHUNK_TOKENS, CHUNK_OVERLAP), number + 1, batch.select(F.col("doc_id").alias("doc")))

    drain(_stream(spark, sf_dir, "documents"), sync)
    return index.latest().select("id", "source", "text")
