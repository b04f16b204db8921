import base64
import os

import pytest
from pyspark.sql import functions as F
from test_queries import plan_of

from docweft.functions.messages import one_line_base64
from docweft.functions.text import page_text
from docweft.session import fresh_path, shared_dir, staged
from docweft.sources.catalog import ensure_namespace, ensure_table
from docweft.sources.files import extracted, list_files, read_binaries, read_texts
from docweft.sources.index import INDEX_SCHEMA, VectorIndex
from docweft.sources.payloads import first_prediction, payload_cells, split_payloads
from docweft.sources.runs import append_log, long_form, read_log, write_attempt


def rows(spark, *items):
    return spark.createDataFrame([(i, i, t, [1.0, 2.0], "s") for i, t in items], INDEX_SCHEMA)


def contents(index):
    return {r.id: (r.text, r.seq) for r in index.latest().collect()}


def test_index_keeps_the_newest_row(spark, folder):
    index = VectorIndex.open_or_create(spark, folder, 2)
    assert contents(index) == {}
    index.write(rows(spark, ("a", "1"), ("b", "1")), 1)
    index.write(rows(spark, ("b", "2"), ("c", "2")), 2)
    want = {"a": ("1", 1), "b": ("2", 2), "c": ("2", 2)}
    assert contents(index) == want
    # A repeated write replaces itself.
    index.write(rows(spark, ("b", "2"), ("c", "2")), 2)
    assert contents(index) == want and index.log().count() == 4
    again = VectorIndex.open_or_create(spark, folder, 2)
    assert contents(again) == want
    small = again.compact(fresh_path(spark, "compact"))
    assert small.log().count() == 3 and {i: t for i, (t, _) in contents(small).items()} == {"a": "1", "b": "2", "c": "2"}


def chunk_rows(spark, *items):
    """Rows named document-chunk, as chunks of a document are."""
    return spark.createDataFrame([(i, i.split("-")[0], t, [1.0, 2.0], "s") for i, t in items], INDEX_SCHEMA)


def test_a_shorter_rewrite_leaves_no_stale_chunk(spark, folder):
    index = VectorIndex.open_or_create(spark, folder, 2)
    index.write(chunk_rows(spark, ("a-0", "1"), ("a-1", "1"), ("a-2", "1"), ("b-0", "1"), ("c-0", "1")), 1)
    index.write(chunk_rows(spark, ("a-0", "2")), 2)
    want = {"a-0": ("2", 2), "b-0": ("1", 1), "c-0": ("1", 1)}
    assert contents(index) == want
    index.write(chunk_rows(spark, ("b-0", "3"), ("b-1", "3")), 3)
    index.delete(spark.createDataFrame([("c",), ("unknown",)], "doc string"), 4)
    want = {"a-0": ("2", 2), "b-0": ("3", 3), "b-1": ("3", 3)}
    assert contents(index) == want
    index.write(chunk_rows(spark, ("c-0", "5")), 5)
    assert contents(index) == want | {"c-0": ("5", 5)}
    # Repeating an earlier write, in full or with other rows, doesn't bring it back.
    index.write(chunk_rows(spark, ("a-0", "1"), ("a-1", "1"), ("b-0", "1"), ("c-0", "1")), 1)
    assert contents(index) == want | {"c-0": ("5", 5)}
    assert {i: t for i, (t, _) in contents(index.compact(fresh_path(spark, "compact"))).items()} == {"a-0": "2", "b-0": "3", "b-1": "3", "c-0": "5"}


def test_reading_the_newest_versions_moves_no_text(spark, folder):
    index = VectorIndex.open_or_create(spark, folder, 2)
    index.write(chunk_rows(spark, ("a-0", "1"), ("a-1", "1"), ("b-0", "1")), 1)
    index.write(chunk_rows(spark, ("a-0", "2")), 2)
    plan = plan_of(index.latest())
    exchanged = [x.split("\n")[1] for x in plan.split(") Exchange")[1:]]
    assert "BroadcastHashJoin" in plan and exchanged and not any("text" in x for x in exchanged)


def test_index_refuses_other_dimensions(spark, folder):
    index = VectorIndex.open_or_create(spark, folder, 3)
    with pytest.raises(Exception, match="not of dimension 3"):
        index.write(rows(spark, ("a", "1")), 1)
    other = fresh_path(spark, "index")
    VectorIndex.open_or_create(spark, other, 2).write(rows(spark, ("a", "1")), 1)
    with pytest.raises(ValueError, match="dimension 2, not 3"):
        VectorIndex.open_or_create(spark, other, 3)


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "b.html").write_text("<p>three</p>")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "c.txt").write_text("four")
    names = {r.name: r.length for r in list_files(spark, str(tmp_path), "*.txt").collect()}
    assert names == {"a.txt": 8, "c.txt": 4}
    assert "content" not in list_files(spark, str(tmp_path)).columns
    assert sorted(r.text for r in read_texts(spark, str(tmp_path)).collect()) == ["four", "one\ntwo\n"]
    files = read_binaries(spark, str(tmp_path)).withColumn("content", F.col("content").cast("string"))
    got = {r.ext: (r.extractor, r.text) for r in extracted(files, "source", "content", {"html": page_text}).collect()}
    assert got["html"] == ("html", "three") and got["txt"][0] == "plain"


def test_base64_has_no_line_breaks(spark):
    data = os.urandom(500)
    got = spark.createDataFrame([(bytearray(data),)], "b binary").select(one_line_base64(F.col("b"))).first()[0]
    assert got == base64.b64encode(data).decode()


def test_payloads(spark):
    df = spark.createDataFrame([(i, f'"{i}\n') for i in (0, 1, 4, 5, 6)], "o bigint, v string")
    cells = sorted(map(tuple, payload_cells(split_payloads(df, "o", "v", 4)).collect()))
    assert cells == [(0, 0, '"0\n'), (0, 1, '"1\n'), (1, 0, '"4\n'), (1, 1, '"5\n'), (1, 2, '"6\n')]


def test_responses(spark):
    sent = [(200, '{"predictions": ["a", "b"]}'), (500, "down"), (200, "{oops"), (200, '{"predictions": []}')]
    df = spark.createDataFrame(sent, "s int, b string")
    prediction, error = first_prediction(df.s, df.b)
    assert [tuple(r) for r in df.select(prediction, error).collect()] == [
        ("a", None),
        (None, "Request failed with status 500, down"),
        (None, "Unreadable response: {oops"),
        (None, None),
    ]


def test_run_log(spark, folder):
    wide = spark.createDataFrame([("r1", 2, 0.5), ("r2", 3, 1.0 / 3)], "run string, n bigint, m double")
    append_log(long_form(wide, "run", ["n", "m"]), folder)
    append_log(long_form(wide.where("run = 'r1'").withColumn("run", F.lit("r3")), "run", ["n"]), folder)
    got = sorted(map(tuple, read_log(spark, folder).collect()))
    assert got == [("r1", "m", "0.500000"), ("r1", "n", "2"), ("r2", "m", "0.333333"), ("r2", "n", "3"), ("r3", "n", "2")]


def test_run_log_shows_committed_attempts_only(spark, folder):
    rows = spark.createDataFrame([("r1", "n", "1"), ("r1", "m", "2"), ("", "n", "3"), (None, "n", "4")], "run_id string, key string, value string")
    assert read_log(spark, folder).count() == 0
    write_attempt(rows, folder)
    assert read_log(spark, folder).count() == 0
    for _ in range(2):
        append_log(rows, folder)
    both = {("r1", "n", "1"), ("r1", "m", "2"), ("", "n", "3"), (None, "n", "4")}
    got = list(map(tuple, read_log(spark, folder).collect()))
    assert len(got) == 4 and set(got) == both
    write_attempt(rows.where("run_id = 'r1'").withColumn("value", F.lit("lost")), folder)
    append_log(rows.where("run_id = 'r1' AND key = 'n'").withColumn("value", F.lit("9")), folder)
    got = list(map(tuple, read_log(spark, folder).collect()))
    assert len(got) == 3 and set(got) == {("r1", "n", "9"), ("", "n", "3"), (None, "n", "4")}
    append_log(rows.limit(0), folder)
    assert read_log(spark, folder).count() == 3


def test_catalog_calls_are_idempotent(spark, folder):
    name = "ns_" + folder[-8:]
    for n in (1, 2):
        ensure_namespace(spark, name, folder)
        table = ensure_table(spark, name, "t", spark.createDataFrame([(n,)], "n int"))
    assert [r.n for r in table.collect()] == [1]


def test_shared_folder_is_the_one_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or shared_dir(spark) == named
    df = staged(spark.range(5), "x")
    assert df.count() == 5 and "Range" not in df._jdf.queryExecution().toString()
