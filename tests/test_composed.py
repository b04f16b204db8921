import pytest
from pyspark.sql import functions as F

from docweft.operators.citations import citation_edges, two_hops
from docweft.operators.conversations import appended, history_pairs, last_messages, request_texts, requests, with_system
from docweft.operators.evaluation import percentiles
from docweft.operators.prompts import (
    best,
    candidate_matrix,
    changes,
    latest,
    mean_scores,
    resolved,
    versions,
    with_new_version,
    within_budget,
)
from docweft.operators.retrieval import mapped
from docweft.operators.scoring import batch_predict

CHAT = [
    (1, 0, "system", "s"),
    (1, 1, "user", "u1"),
    (1, 2, "assistant", "a1"),
    (1, 3, "user", "u2"),
    (1, 4, "user", "u3"),
    (1, 5, "assistant", "a3"),
    (1, 6, "user", "u4"),
    (2, 0, "user", "v1"),
]


@pytest.fixture(scope="module")
def chat(spark):
    return spark.createDataFrame(CHAT, "conv_id bigint, turn bigint, role string, text string")


def test_history(chat):
    assert sorted(map(tuple, history_pairs(chat).collect())) == [(1, 1, "u1", "a1"), (1, 4, "u3", "a3")]
    got = sorted(map(tuple, requests(chat, "agent").collect()))
    first = [(1, 6, pos, "agent" if role == "assistant" else role, text) for conv, pos, role, text in CHAT if conv == 1]
    assert got == [*first, (2, 0, 0, "user", "v1")]
    asked = {r.conv_id: r.text for r in request_texts(requests(chat), F.col("content")).collect()}
    assert asked == {1: "s\nu1\na1\nu2\nu3\na3\nu4", 2: "v1"}


def test_history_after_the_question_and_without_one(spark):
    rows = [(1, 0, "user", None), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (2, 0, "assistant", "hello")]
    chat = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert sorted(map(tuple, requests(chat).collect())) == [(1, 1, 0, "user", ""), (1, 1, 1, "user", "q")]
    assert requests(chat.where("conv_id > 2")).count() == 0


def test_long_history_is_whole(spark):
    n = 200_001
    role = F.when(F.col("turn") % 2 == 0, "user").otherwise("assistant")
    long = spark.range(n).select(F.lit(7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"))
    chat = long.select("conv_id", "turn", role.alias("role"), F.col("turn").cast("string").alias("text"))
    assert requests(chat).count() == n
    text = request_texts(requests(chat), F.col("content")).first().text
    assert text == "\n".join(map(str, range(n)))


def test_messages(chat):
    assert sorted((r.conv_id, r.text) for r in last_messages(chat).collect()) == [(1, "u4"), (2, "v1")]
    more = appended(chat, last_messages(chat).withColumn("role", F.lit("assistant")))
    assert more.count() == 10 and more.where("conv_id = 2 AND turn = 1").first().text == "v1"
    framed = with_system(chat, "be brief")
    assert sorted(map(tuple, framed.where("conv_id = 2").collect())) == [(2, 0, "system", "be brief"), (2, 1, "user", "v1")]
    assert with_system(chat, "").count() == 8


def test_prompts(spark):
    rows = spark.createDataFrame(
        [("a", 10, "x"), ("a", 20, "x"), ("a", 30, "y"), ("b", 5, "z")], "name string, ord bigint, template string"
    )
    registry = versions(rows, "name", "ord", "template")
    assert {r.name: (r.version, r.template) for r in latest(registry).collect()} == {"a": (3, "y"), "b": (1, "z")}
    changed = {(r.name, r.version): r.changed for r in changes(registry).collect()}
    assert changed == {("a", 1): True, ("a", 2): False, ("a", 3): True, ("b", 1): True}
    names = spark.createDataFrame([("a", None), ("b", "given"), ("c", None)], "name string, candidate string")
    got = {r.name: (r.version, r.template) for r in resolved(names, registry, "default").collect()}
    assert got == {"a": (3, "y"), "b": (1, "given"), "c": (1, "default")}
    new = with_new_version(registry, F.lit("a"), spark.createDataFrame([("best",)], "template string"))
    assert {r.name: (r.version, r.template) for r in latest(new).collect()}["a"] == (4, "best")
    first = with_new_version(registry, F.lit("n"), spark.createDataFrame([("best",)], "template string"))
    assert first.where("name = 'n'").first().version == 1


def test_candidate_matrix_is_whole_either_way(spark, monkeypatch):
    import docweft.operators.prompts as prompts

    examples = spark.range(50).withColumnRenamed("id", "ex")
    candidates = spark.createDataFrame([(f"c{i:02}", f"t{i}") for i in range(9)], "name string, template string")
    want = sorted((e, f"c{i:02}", f"t{i}") for e in range(50) for i in range(9))
    assert sorted(map(tuple, candidate_matrix(examples, candidates).collect())) == want
    monkeypatch.setattr(prompts, "MAX_CANDIDATES", 3)
    monkeypatch.setattr(prompts, "CANDIDATE_BLOCK", 2)
    blocked = candidate_matrix(examples, candidates)
    assert sorted(map(tuple, blocked.collect())) == want
    assert candidate_matrix(examples, candidates.where("name > 'x'")).count() == 0
    scored = blocked.withColumn("score", F.length("template") + F.col("ex") % 2)
    assert best(mean_scores(scored)).first().name == "c00"
    assert [r.ex for r in within_budget(blocked, ["ex", "name"], 10).select("ex").collect()] == [0] * 9 + [1]


def test_citations(spark):
    texts = spark.createDataFrame(
        [
            ("2312.00001", "arXiv:2312.00002v1 arXiv:2312.00001v3 arxiv:2312.00003"),
            ("2312.00002", "arXiv:2312.00003v2 arXiv:2312.00004"),
            ("2312.00004", "arXiv:2312.00009"),
        ],
        "paper string, text string",
    )
    edges = citation_edges(texts, "paper", "text")
    assert ("2312.00001", "2312.00001") not in set(map(tuple, edges.collect()))
    seeds = spark.createDataFrame([("2312.00001",)], "paper string")
    got = dict(map(tuple, two_hops(edges, seeds).collect()))
    assert got == {"2312.00002": 1, "2312.00003": 1, "2312.00004": 2}
    stored = spark.createDataFrame([("2312.00003",)], "paper string")
    assert set(r.paper for r in two_hops(edges, seeds, stored).collect()) == {"2312.00002", "2312.00004"}


def test_batch_predict(spark):
    def factory():
        return lambda prompts: [p.upper() for p in prompts]

    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, prompt string")
    assert [tuple(r) for r in batch_predict(df, "prompt", factory).orderBy("id").collect()] == [(1, "a", "A"), (2, "b", "B")]
    with pytest.raises(ValueError):
        batch_predict(df.withColumnRenamed("prompt", "prompts"), "prompt", factory)


def test_mapped_columns(spark):
    df = spark.createDataFrame([(1, "x", "drop")], "a int, b string, c string")
    assert mapped(df, {"id": "a"}, ["b"]).columns == ["id", "b"]
    with pytest.raises(ValueError):
        mapped(df, {"id": "z"})


def test_percentiles(spark):
    df = spark.createDataFrame([("r", v) for v in (1, 2, 2, 10)], "run string, v int")
    assert percentiles(df, "run", "v", {"p50": 0.5, "p90": 0.9}).first() == ("r", 2.0, 7.6)
