import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docweft.functions.messages import chain_role, first_text, output_text, route, step_kind, with_history
from docweft.functions.text import (
    blank_tokens,
    chunk_array,
    citations,
    extension,
    fill,
    fill_column,
    function_name,
    page_text,
    path_tail,
    preview,
    user_slug,
    without_phrase,
)


def values(spark, items, column, schema="t string"):
    return [r[0] for r in spark.createDataFrame([(i,) for i in items], schema).select(column).collect()]


@settings(max_examples=15, deadline=None)
@given(texts=st.lists(st.text(alphabet="ab \n", max_size=60), min_size=1, max_size=20), size=st.integers(2, 9), data=st.data())
def test_chunks_rebuild_the_text(spark, texts, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", blank_tokens(F.col("t")).alias("k"))
    for row in df.select("t", chunk_array(F.col("k"), size, overlap).alias("c")).collect():
        tokens, step = row.t.split(" "), size - overlap
        assert row.c == [
            " ".join(tokens[s : s + size]) for s in range(0, max(len(tokens) - overlap - 1, 0) + 1, step)
        ]
        rebuilt = row.c[0].split(" ") + [t for c in row.c[1:] for t in c.split(" ")[overlap:]]
        assert rebuilt == tokens


def test_chunk_limits():
    with pytest.raises(ValueError):
        chunk_array(F.lit(None), 5, 5)


def test_names(spark):
    assert values(spark, ["a/b/c.pdf", "x.pdf", "a/"], path_tail(F.col("t"))) == ["c", "x", ""]
    assert values(spark, ["a.b@x.org", "plain"], user_slug(F.col("t"))) == ["a_b", "plain"]
    assert values(spark, ["a__b__c", "a_b"], function_name(F.col("t"))) == ["a.b.c", "a_b"]
    assert values(spark, ["a/b.PDF", "a.b/c", "x.tar.gz"], extension(F.col("t"))) == ["pdf", "", "gz"]
    assert values(spark, ["abc", "abcdef"], preview(F.col("t"), 4)) == ["abc...", "abcd..."]
    assert values(spark, ["Magic 8 Ball, Magic 8 Ball yes"], without_phrase(F.col("t"), "Magic 8 Ball")) == [",  yes"]


def test_page_text(spark):
    html = "<html><style>p{}</style><SCRIPT a='1'>if (a<b) {}\n</SCRIPT><p>One&amp;  two</p>\n<b>three</b>"
    assert values(spark, [html], page_text(F.col("t"))) == ["One&amp; two three"]


def test_citations(spark):
    text = "see arXiv:2312.00001v2, ARXIV:1706.03762. and arxiv:12 but arXiv:2401.1x"
    assert values(spark, [text], citations(F.col("t"))) == [["2312.00001v2", "1706.03762"]]


def test_fill_happens_once(spark):
    made = fill("{a} and {b} {c} {a}", {"a": F.col("t"), "b": F.lit("{a}")})
    assert values(spark, ["{b}", None], made) == ["{b} and {a} {c} {b}", " and {a} {c} "]
    by_row = fill_column(F.lit("{a} and {b} {c} {a}"), {"a": F.col("t"), "b": F.lit("{a}")})
    assert values(spark, ["{b}", None], by_row) == ["{b} and {a} {c} {b}", " and {a} {c} "]


def test_routes_are_ordered_and_case_sensitive(spark):
    said = ["reporting on research", "reporting", "Research", ""]
    assert values(spark, said, route(F.col("t"))) == ["research", "reporting", "general", "general"]


def test_roles(spark):
    assert values(spark, ["user", "assistant", "system", "agent"], chain_role(F.col("t"))) == ["human", "ai", None, None]
    kinds = values(spark, ["assistant", "user"], step_kind(F.col("t"), F.lit("function_call")))
    assert kinds == ["final", "tool"]
    assert values(spark, ["user"], step_kind(F.col("t"), F.lit("message"))) == ["llm"]


def test_parts(spark):
    parts = [("output_text", "a"), ("reasoning", "b"), ("output_text", None), ("output_text", "c")]
    schema = "t array<struct<type:string,text:string>>"
    assert values(spark, [parts, []], output_text(F.col("t")), schema) == ["ac", ""]
    assert values(spark, [parts, []], first_text(F.col("t"), F.lit(None)), schema) == ["a", "No response from tool"]
    assert values(spark, [[]], first_text(F.col("t"), F.lit("raw")), schema) == ["raw"]
    assert values(spark, [[]], first_text(F.col("t"), F.lit(None), ""), schema) == [""]


def test_history_passes_through(spark):
    got = values(spark, [[], ["a", "b"]], with_history(F.col("t"), F.lit("q")), "t array<string>")
    assert got == ["q", "a\nb\nq"]
