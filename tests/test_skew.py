"""All queries once more over tables in which one key holds a third of the rows.

Blocks are made tiny and broadcasts refused, so that the ways meant for large
data run: groups spanning many blocks, block-wise search, shuffled lookups.
"""

import pytest
from oracle import check, connect

import __spark_entry__ as entry_points
from docweft.sources.tables import SCHEMAS

QUERIES = entry_points.queries()
ORACLES = entry_points.oracle_sql()

# A third of each table falls on one conversation, user, text, vector, brand or order.
CHANGES = {
    "conversations": """SELECT CASE WHEN hot THEN 0 ELSE conv_id + 1 END AS conv_id,
        CASE WHEN hot THEN row_number() OVER (PARTITION BY hot ORDER BY conv_id, turn) - 1 ELSE turn END AS turn, role, text
        FROM (SELECT *, conv_id % 3 = 0 AS hot FROM {t})""",
    "events": "SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN 8 ELSE user_id END AS user_id, event_type, value, props FROM {t}",
    "documents": """SELECT doc_id, CASE WHEN doc_id = 5 THEN '' WHEN doc_id % 3 = 0 THEN first(text) OVER (ORDER BY doc_id)
        ELSE text END AS text, CASE WHEN doc_id % 3 = 0 THEN 'en' ELSE lang END AS lang,
        CASE WHEN doc_id % 3 = 0 THEN 'src0' ELSE source END AS source, n_chars FROM {t}""",
    "embeddings": """SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN first(embedding) OVER (ORDER BY vec_id) ELSE embedding END
        AS embedding, label FROM {t}""",
    "part": """SELECT p_partkey, p_name, CASE WHEN p_partkey % 3 = 0 THEN 'Brand#7' ELSE p_brand END AS p_brand, p_type, p_size,
        p_retailprice FROM {t}""",
    "lineitem": """SELECT DISTINCT ON (l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity) * REPLACE (
        CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE l_orderkey END AS l_orderkey) FROM {t}""",
}


@pytest.fixture(scope="module")
def skewed(sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    con = connect(sf_dir)
    for table in SCHEMAS:
        sql = CHANGES.get(table, "SELECT * FROM {t}").format(t=table)
        con.execute(f"COPY ({sql}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.fixture(scope="module")
def duck(skewed):
    return connect(skewed)


@pytest.fixture
def tight(spark, monkeypatch):
    """The settings of large data: small blocks, nothing broadcast."""
    import docweft.operators.citations as citations
    import docweft.operators.keywords as keywords
    import docweft.operators.matching as matching
    import docweft.operators.numbering as numbering
    import docweft.operators.prompts as prompts
    import docweft.operators.tools as tools

    def never(df, *args, **kwargs):
        return None

    for module in (keywords, matching, numbering, prompts):
        monkeypatch.setattr(module, "fits", never)
    for module in (tools, keywords, citations):
        monkeypatch.setattr(module, "sent", lambda df, *args: df)
    for function in (numbering.numbered, numbering.with_neighbours):
        values = tuple(7 if v == numbering.BLOCK else v for v in function.__defaults__)
        monkeypatch.setattr(function, "__defaults__", values)
    values = matching.best_matches.__defaults__
    assert values[-2:] == (matching.QUESTION_BLOCK, matching.CORPUS_BLOCK)
    monkeypatch.setattr(matching.best_matches, "__defaults__", (*values[:-2], 20, 60))
    monkeypatch.setattr(prompts, "CANDIDATE_BLOCK", 2)
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name in names:
        spark.conf.unset(name)


# Scalar rows never meet other rows, so skew cannot touch them; these do meet.
MEETING = [
    "agent_step_kind", "best_candidate", "call_output_pair", "candidate_matrix", "citation_hop2", "dedupe_registry",
    "delta_aggregate", "delta_stream", "eval_compare", "eval_run", "eval_text_metrics", "expectation_join",
    "filtered_retrieval", "format_docs", "history_flatten", "history_pairs", "history_passthrough", "history_rag",
    "history_rerank", "holdback_stream", "holdback_window", "hybrid_topk", "index_from_nodes", "index_sync_stream",
    "index_upsert", "ingest_documents", "iteration_cap", "json_request", "knn_topk", "last_message", "latest_prompt",
    "manifest_counts", "message_append", "nested_select", "number_outputs", "payload_build", "prompt_changed",
    "prompt_search", "query_engine", "rag_prompt", "rerank", "retriever_table_function", "routed_answer", "run_counts",
    "skip_existing", "source_listing", "system_prepend", "tool_dispatch", "tool_loop", "tool_union", "tool_used_flag",
    "top1_desc", "value_or_error",
]


@pytest.mark.parametrize("name", MEETING)
def test_query_under_skew(spark, skewed, duck, tight, name):
    check(QUERIES[name](spark, skewed), duck, ORACLES[name])
