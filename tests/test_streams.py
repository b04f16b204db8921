import random

import pytest
from pyspark.sql import functions as F

from docweft.operators.conversations import joined_deltas
from docweft.operators.signal import check_window, flush_number, held_back, peak_normalised
from docweft.session import fresh_path
from docweft.sources.index import VectorIndex, index_rows
from docweft.streaming.deltas import completed_items
from docweft.streaming.holdback import HeldBackSink
from docweft.streaming.runs import collect, drain, file_stream


def simulated(n, every, held):
    """Flush number per row of a sender that emits all but the last rows every so often."""
    out, sent, flush = {}, 0, 0
    for got in range(1, n + 1):
        if got % every == 0:
            flush += 1
            while sent < got - held:
                out[sent] = flush
                sent += 1
    while sent < n:
        out[sent] = flush + 1
        sent += 1
    return [out[i] for i in range(n)]


@pytest.mark.parametrize(("every", "held"), [(2, 1), (10, 3), (7, 6), (5, 1)])
def test_flush_formula(spark, every, held):
    for n in (1, 4, 5, 6, 10, 23, 50):
        i = F.col("id")
        got = [r[0] for r in spark.range(n).orderBy("id").select(flush_number(i, F.lit(n), every, held)).collect()]
        assert got == simulated(n, every, held)


def test_window_bounds():
    for every, held in ((5, 0), (5, 5), (1, 1)):
        with pytest.raises(ValueError):
            check_window(every, held)


def test_peaks(spark):
    clips = [([0.5, -1.0, 0.25],), ([0.0, 0.0],), ([],)]
    got = [r[0] for r in spark.createDataFrame(clips, "s array<double>").select(peak_normalised(F.col("s"))).collect()]
    assert got == [[16383, -32767, 8191], [0, 0], []]


def written(spark, df, files):
    path = fresh_path(spark, "input")
    for part in range(files):
        df.where(F.col("file") == part).drop("file").coalesce(1).write.mode("append").parquet(path)
    return path


def test_held_back_stream_equals_batch(spark):
    """Five batches, one key sending half of the rows."""
    rows = [(i, 0 if i % 2 else i % 13, i * 5 // 400) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, file int")
    path = written(spark, df, 5)
    schema = "event_id BIGINT, user_id BIGINT"
    root = fresh_path(spark, "out")
    sink = HeldBackSink(spark, root, "user_id", "event_id", 10, 3)
    batches = []

    def each(batch, number):
        batches.append(number)
        sink(batch, number)
        sink(batch, number)  # a repeated batch changes nothing

    drain(file_stream(spark, path, schema, 1), each)
    assert len(batches) == 5
    # A driver that starts anew finds everything in the tables.
    sink = HeldBackSink(spark, root, "user_id", "event_id", 10, 3)
    got = sorted(map(tuple, sink.finish(schema).collect()))
    batch = held_back(df.drop("file"), ["user_id"], "event_id", 10, 3)
    assert got == sorted(map(tuple, batch.select("event_id", "user_id", "flush_no").collect()))


def test_deltas_across_batches(spark):
    texts = {1: "to be or not to be", 2: "x", 3: "a b c d e f g h i j"}
    rows = []
    for item, text in texts.items():
        cut = text.split(" ")
        for seq, token in enumerate(cut):
            rows.append((item, seq, token + (" " if seq < len(cut) - 1 else ""), seq == len(cut) - 1))
    random.Random(5).shuffle(rows)
    rows = [(*r, n % 4) for n, r in enumerate(rows)]
    # The last delta of an unfinished item never comes.
    rows.append((4, 0, "open ", False, 0))
    df = spark.createDataFrame(rows, "item_id bigint, seq bigint, delta string, last boolean, file int")
    path = written(spark, df, 4)
    stream = file_stream(spark, path, "item_id BIGINT, seq BIGINT, delta STRING, last BOOLEAN", 1)
    assert {r.item_id: r.text for r in collect(completed_items(stream)).collect()} == texts
    for block in (1, 3, 1024):
        batch = joined_deltas(df.where("item_id < 4"), ["item_id"], "seq", "delta", block)
        assert {r.item_id: r.text for r in batch.collect()} == texts


def test_a_repeated_delta_counts_once(spark):
    rows = [(1, 0, "one ", False, 0), (1, 0, "one ", False, 0), (1, 0, "one ", False, 1), (1, 1, "two", True, 2), (1, 1, "two", True, 2)]
    rows += [(2, 1, "end", True, 0), (2, 1, "end", True, 1), (2, 0, "the ", False, 2)]
    df = spark.createDataFrame(rows, "item_id bigint, seq bigint, delta string, last boolean, file int")
    stream = file_stream(spark, written(spark, df, 3), "item_id BIGINT, seq BIGINT, delta STRING, last BOOLEAN", 1)
    assert sorted(map(tuple, collect(completed_items(stream)).collect())) == [(1, "one two"), (2, "the end")]


def test_index_follows_the_stream(spark, folder):
    docs = [(1, "a b c", "s", 0), (2, "d e", "s", 0), (1, "new text", "s", 1)]
    path = written(spark, spark.createDataFrame(docs, "doc_id bigint, text string, source string, file int"), 2)
    index = VectorIndex.open_or_create(spark, folder, 64)
    checkpoint = fresh_path(spark, "stream")

    def sync(batch, number):
        index.write(index_rows(batch), number + 1)

    schema = "doc_id BIGINT, text STRING, source STRING"
    for _ in range(2):
        drain(file_stream(spark, path, schema, 1), sync, checkpoint)
        assert {r.id: r.text for r in index.latest().collect()} == {"1-0": "new text", "2-0": "d e"}
    assert index.log().count() == 3
