"""Batch scoring, embedding, completion, and functions callable from SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweft.functions.tools import register_sql_functions
from docweft.operators.embedding import embed
from docweft.operators.scoring import batch_predict, echo_model, word_count_model
from docweft.plans.frames import NEIGHBOURS, SQL_CALLS, sql_value, sql_vectors, tool_calls
from docweft.plans.lookups import SQL_KNN, knn
from docweft.plans.registry import query
from docweft.sources.tables import load, load_spread

SQL_PREDICTION = (
    "'words=' || len(list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda w: w <> '')) || ' first=' || "
    "coalesce(list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda w: w <> '')[1], '')"
)


@query("batch_predict", f"SELECT doc_id, {SQL_PREDICTION} AS prediction FROM documents")
def predictions(spark, sf_dir):
    rows = load_spread(spark, sf_dir, "documents", "doc_id").select("doc_id", F.col("text").alias("prompt"))
    return batch_predict(rows, "prompt", word_count_model).select("doc_id", "prediction")


@query(
    "embed",
    f"""WITH {sql_vectors('dv', 'documents', 'doc_id', 'text')}
        SELECT key AS doc_id, b AS bucket, round(w, 6) AS weight FROM dv""",
)
def embeddings(spark, sf_dir):
    rows = load_spread(spark, sf_dir, "documents", "doc_id").select("doc_id", F.posexplode(embed(F.col("text"))).alias("b", "w"))
    return rows.where("w > 0").select("doc_id", F.col("b").cast("bigint").alias("bucket"), F.round("w", 6).alias("weight"))


MAX_TOKENS = 128


@query(
    "complete",
    f"""SELECT conv_id, turn, array_to_string(list_slice(string_split(text, ' '), 1, {MAX_TOKENS}), ' ') AS answer
        FROM conversations WHERE role = 'user'""",
)
def complete(spark, sf_dir):
    """The stand-in echoes the prompt up to the completion length, which is the model's own limit."""
    users = load(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    return batch_predict(users, "text", echo_model(MAX_TOKENS), "answer").select("conv_id", "turn", "answer")


@query("sql_function", f"WITH {SQL_CALLS} SELECT call_id, name, round({sql_value()}, 6) AS value FROM calls")
def sql_function(spark, sf_dir):
    register_sql_functions(spark)
    return tool_calls(spark, sf_dir).selectExpr("call_id", "name", "round(calculate(name, x, y), 6) AS value")


def find_similar(spark, sf_dir, k):
    """The ``k`` most similar vectors of every vector; as a function of that name it takes any number up to ``k``."""
    knn(spark, sf_dir, k).createOrReplaceTempView("retrieved")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION find_similar(k BIGINT) "
        "RETURNS TABLE (qid BIGINT, id BIGINT, score DOUBLE, rk BIGINT) "
        f"COMMENT 'The k most similar vectors of every vector; more than {k} is an error' "
        "RETURN SELECT qid, id, score, rk FROM retrieved "
        f"WHERE rk <= IF(k <= {k}, k, raise_error('find_similar was set up for {k} rows per question'))"
    )
    return spark.sql(f"SELECT * FROM find_similar({k})")


@query("retriever_table_function", f"WITH {SQL_KNN} SELECT qid, id, score, rk FROM knn_r WHERE rk <= {NEIGHBOURS}")
def retriever_table_function(spark, sf_dir):
    """Retrieval under a name, described, and called with the number of rows wanted."""
    return find_similar(spark, sf_dir, NEIGHBOURS)
