"""Inputs several queries share, derived from the tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.operators.conversations import request_id, requests
from docweft.operators.embedding import embed
from docweft.operators.prompts import versions
from docweft.sources.index import chunks
from docweft.sources.tables import load, load_spread

CHUNK_TOKENS = 1024
CHUNK_OVERLAP = 20
NEIGHBOURS = 4


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(qid, text, embedding)`` from the benchmark items."""
    rows = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return rows.withColumn("embedding", embed(F.col("text")))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_spread(spark, sf_dir, "documents", "doc_id").select(F.col("doc_id").alias("id"), "text", "source")


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(load_spread(spark, sf_dir, "documents", "doc_id"), CHUNK_TOKENS, CHUNK_OVERLAP)


def embedded(corpus: DataFrame) -> DataFrame:
    return corpus.select("id", embed(F.col("text")).alias("embedding"))


def chat_requests(spark: SparkSession, sf_dir: str, assistant: str = "assistant") -> DataFrame:
    """The messages of every conversation's last user turn and of its whole history, numbered by ``qid``."""
    return requests(load(spark, sf_dir, "conversations"), assistant).withColumn("qid", request_id())


def paper_id(number: str | Column) -> Column:
    """A ten-character paper id from a number; the form has room for 10^9 papers and refuses more."""
    n = F.col(number) if isinstance(number, str) else number
    high = F.floor(n / 100000).cast("string")
    made = F.concat(F.lpad(high, 4, "0"), F.lit("."), F.lpad((n % 100000).cast("string"), 5, "0"))
    return F.when(n < 10**9, made).otherwise(F.raise_error(F.lit("paper number has more than nine digits")))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(paper, text)``: every document as a paper whose whole text ends in a line citing two earlier ones, some itself."""
    rows = load_spread(spark, sf_dir, "documents", "doc_id").select("doc_id", "text")
    first, second = F.floor(F.col("doc_id") / 2), F.floor(F.col("doc_id") / 3) + 1
    text = F.concat(
        F.coalesce("text", F.lit("")), F.lit("\nsee arXiv:"), paper_id(first), F.lit("v2 and ARXIV:"), paper_id(second), F.lit(".")
    )
    return rows.select("doc_id", paper_id("doc_id").alias("paper"), text.alias("text"))


def prompt_registry(spark: SparkSession, sf_dir: str, name: str | None = None) -> DataFrame:
    """Versions of one prompt per brand, in part order; of one brand only if named."""
    parts = load(spark, sf_dir, "part")
    if name is not None:
        parts = parts.where(F.col("p_brand") == name)
    return versions(parts, "p_brand", "p_partkey", "p_name")


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One calculator call per order line, some unknown, some dividing by zero."""
    n = F.col("l_linenumber") % 6
    op = (
        F.when(n.isin(0, 5), "add")
        .when(n == 1, "subtract")
        .when(n == 2, "multiply")
        .when(n == 3, "divide")
        .otherwise("power")
    )
    return load(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("bigint")).alias("call_id"),
        F.col("l_orderkey").alias("request_id"),
        op.alias("name"),
        F.col("l_quantity").alias("x"),
        F.when(F.col("l_linenumber") % 2 == 1, F.lit(0.0)).otherwise(F.col("l_discount")).alias("y"),
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
    )


# ---- the same inputs in SQL -------------------------------------------------


def sql_words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '[ \\t\\r\\n]+'), lambda w: w <> '')"


def sql_vectors(name: str, rows: str, key: str, text: str) -> str:
    """CTEs ending in ``<name>(key, b, w)``: hashed word vectors in long form."""
    return f"""
{name}_tok AS (SELECT {key} AS key, unnest({sql_words(text)}) AS tok FROM {rows}),
{name}_cnt AS (SELECT key, ('0x' || substr(md5(tok), 1, 6))::BIGINT % 64 AS b, count(*)::DOUBLE AS c
  FROM {name}_tok GROUP BY ALL),
{name} AS (SELECT key, b, c / sqrt(sum(c * c) OVER (PARTITION BY key)) AS w FROM {name}_cnt)"""


def sql_nearest(name: str, asked: str, corpus: str, k: int | None = None) -> str:
    """CTE ``<name>(qid, id, score, rk)``: cosine neighbours of long-form vectors, all of them without a ``k``."""
    return f"""
{name}_s AS (SELECT q.key AS qid, d.key AS id, round(sum(q.w * d.w), 6) AS score
  FROM {asked} q JOIN {corpus} d ON q.b = d.b GROUP BY q.key, d.key),
{name} AS (SELECT * FROM (SELECT qid, id, score,
    row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rk FROM {name}_s){f" WHERE rk <= {k}" if k else ""})"""


def sql_chunks(name: str = "chunk", size: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP) -> str:
    """CTE ``<name>(id, doc_id, chunk_no, text, source)``."""
    step = size - overlap
    return f"""
{name}_t AS (SELECT doc_id, source, string_split(text, ' ') AS toks FROM documents),
{name}_p AS (SELECT doc_id, source, toks,
    unnest(range(0, greatest(len(toks) - {overlap + 1}, 0) + 1, {step})) AS s FROM {name}_t),
{name} AS (SELECT doc_id * 4194304 + s // {step} AS id, doc_id, s // {step} AS chunk_no,
    array_to_string(list_slice(toks, s + 1, s + {size}), ' ') AS text, source FROM {name}_p)"""


SQL_REQUESTS = """
req_t AS (SELECT conv_id, max(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY conv_id),
req_m AS (SELECT r.conv_id, r.turn, r.conv_id * 4294967296 + r.turn AS qid, c.turn AS pos, c.role, coalesce(c.text, '') AS content
  FROM req_t r JOIN conversations c ON c.conv_id = r.conv_id AND c.turn <= r.turn),
req AS (SELECT conv_id, turn, qid, count(*) AS n_messages, arg_min(content, pos) AS first_content,
    arg_max(content, pos) AS text, string_agg(content, chr(10) ORDER BY pos) AS question,
    count(*) FILTER (role = 'assistant') AS n_answers,
    coalesce(string_agg(CASE role WHEN 'user' THEN 'Human: ' WHEN 'assistant' THEN 'AI: ' ELSE 'System: ' END || content,
      chr(10) ORDER BY pos) FILTER (pos < turn), '') AS said
  FROM req_m GROUP BY conv_id, turn, qid)"""

SQL_REGISTRY = """
registry AS (SELECT p_brand AS name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS version,
    p_name AS template FROM part)"""


def sql_paper(number: str) -> str:
    return f"lpad((({number}) // 100000)::VARCHAR, 4, '0') || '.' || lpad((({number}) % 100000)::VARCHAR, 5, '0')"


SQL_PAPERS = f"""
papers AS (SELECT doc_id, {sql_paper('doc_id')} AS paper,
    coalesce(text, '') || chr(10) || 'see arXiv:' || {sql_paper('doc_id // 2')} || 'v2 and ARXIV:' || {sql_paper('doc_id // 3 + 1')} || '.' AS text
  FROM documents),
found AS (SELECT paper AS src,
    unnest(regexp_extract_all(text, '(?i)arXiv:(\\d+\\.\\d+\\d*(?:v\\d+)?)\\b', 1)) AS dst FROM papers),
edges AS (SELECT DISTINCT src, regexp_replace(dst, 'v[0-9]+$', '') AS dst FROM found
  WHERE substr(src, 1, 10) <> substr(dst, 1, 10))"""

SQL_CALLS = """
calls AS (SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity::BIGINT) AS call_id, l_orderkey AS request_id,
    CASE WHEN l_linenumber % 6 IN (0, 5) THEN 'add' WHEN l_linenumber % 6 = 1 THEN 'subtract'
      WHEN l_linenumber % 6 = 2 THEN 'multiply' WHEN l_linenumber % 6 = 3 THEN 'divide' ELSE 'power' END AS name,
    l_quantity AS x, CASE WHEN l_linenumber % 2 = 1 THEN 0.0 ELSE l_discount END AS y,
    l_linenumber, l_partkey, l_suppkey FROM lineitem)"""


def sql_value(op: str = "name", x: str = "x", y: str = "y") -> str:
    return (
        f"CASE {op} WHEN 'add' THEN {x} + {y} WHEN 'subtract' THEN {x} - {y} WHEN 'multiply' THEN {x} * {y} "
        f"WHEN 'divide' THEN CASE WHEN {y} = 0 THEN NULL ELSE {x} / {y} END END"
    )


def sql_error(op: str = "name", y: str = "y") -> str:
    return (
        f"CASE WHEN {op} NOT IN ('add', 'subtract', 'multiply', 'divide') THEN 'Error: Unknown operation' "
        f"WHEN {op} = 'divide' AND {y} = 0 THEN 'Error: Division by zero' END"
    )


def sql_number(value: str) -> str:
    return f"CAST(CAST(round({value}, 4) AS DECIMAL(38,4)) AS VARCHAR)"
