"""Aggregations: contexts, counts, latest versions, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweft.functions.messages import DEFAULT_PROMPT, output_text
from docweft.functions.text import lines, n_words, words
from docweft.operators.context import joined_context
from docweft.operators.embedding import dimension_profile
from docweft.operators.evaluation import compared, mean, sentences
from docweft.operators.prompts import best, mean_scores, resolved
from docweft.operators.signal import peak_normalised
from docweft.operators.tools import last_wins, union_of
from docweft.plans.frames import (
    NEIGHBOURS,
    SQL_REGISTRY,
    prompt_registry,
    questions,
    sql_chunks,
    sql_nearest,
    sql_vectors,
    sql_words,
)
from docweft.plans.lookups import SQL_SCORED, candidate_scores
from docweft.plans.registry import query
from docweft.plans.stored import chunk_index
from docweft.sources.tables import load, load_spread

SQL_RETRIEVED = f"""{sql_vectors('qv', 'benchmark', 'item_id', 'text')}, {sql_chunks()},
{sql_vectors('cv', 'chunk', 'id', 'text')}, {sql_nearest('hit', 'qv', 'cv', NEIGHBOURS)},
ctx AS (SELECT h.qid, count(*) AS n_ctx, string_agg(c.text, chr(10) || chr(10) ORDER BY h.rk) AS context
  FROM hit h JOIN chunk c ON c.id = h.id GROUP BY h.qid)"""


def contexts(spark, sf_dir, asked):
    """Context of every question from its nearest chunks: ``(qid, n_ctx, context)``."""
    index = chunk_index(spark, sf_dir)
    return joined_context(index.fetched(index.nearest(asked, NEIGHBOURS), "text"), ["qid"])


@query("format_docs", f"WITH {SQL_RETRIEVED} SELECT qid, n_ctx, context FROM ctx")
def format_docs(spark, sf_dir):
    return contexts(spark, sf_dir, questions(spark, sf_dir))


@query(
    "join_output_text",
    """SELECT conv_id, turn, CASE WHEN role = 'system' THEN text ELSE coalesce(
         array_to_string(list_filter(string_split(text, chr(10)), lambda l: length(l) % 2 = 0), ''), '') END AS content
       FROM conversations""",
)
def join_output_text(spark, sf_dir):
    """Lines as parts, the even-length ones output text; system messages are bare strings."""
    type_ = lambda l: F.when(F.length(l) % 2 == 0, "output_text").otherwise("reasoning")
    parts = F.transform(lines(F.col("text")), lambda l: F.struct(type_(l).alias("type"), l.alias("text")))
    content = F.when(F.col("role") == "system", F.col("text")).otherwise(output_text(parts))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", content.alias("content"))


@query(
    "tool_used_flag",
    "SELECT user_id, bool_or(event_type = 'purchase') AS tool_used, count(*) AS n_items FROM events GROUP BY user_id",
)
def tool_used_flag(spark, sf_dir):
    type_ = F.when(F.col("event_type") == "purchase", "function_call").otherwise("message")
    return load(spark, sf_dir, "events").groupBy("user_id").agg(
        F.bool_or(type_ == "function_call").alias("tool_used"), F.count(F.lit(1)).alias("n_items")
    )


@query(
    "latest_prompt",
    f"""WITH {SQL_REGISTRY}, l AS (SELECT name, max(version) AS version, arg_max(template, version) AS template
          FROM registry GROUP BY name),
        n AS (SELECT DISTINCT p_brand AS name, NULL AS candidate FROM part UNION ALL
              SELECT DISTINCT p_type, CASE WHEN p_type = 'SMALL' THEN 'given' END FROM part)
        SELECT n.name, coalesce(l.version, 1) AS version, coalesce(n.candidate, l.template,
          'You are a helpful AI assistant that can use tools when needed.') AS template
        FROM n LEFT JOIN l ON l.name = n.name""",
)
def latest_prompt(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    brands = part.select(F.col("p_brand").alias("name"), F.lit(None).cast("string").alias("candidate"))
    types = part.select(F.col("p_type").alias("name"), F.when(F.col("p_type") == "SMALL", "given").alias("candidate"))
    return resolved(brands.unionByName(types).distinct(), prompt_registry(spark, sf_dir), DEFAULT_PROMPT)


def resources(spark, sf_dir):
    """Typed resources an agent depends on: ``(kind, name)``."""
    return union_of(
        {
            "function": load(spark, sf_dir, "part").select(F.col("p_brand").alias("name")),
            "vector_search_index": load(spark, sf_dir, "documents").select(F.col("source").alias("name")),
            "serving_endpoint": load(spark, sf_dir, "supplier").select(F.col("s_name").alias("name")),
        }
    )


SQL_RESOURCES = """
resources AS (SELECT DISTINCT 'function' AS kind, p_brand AS name FROM part
  UNION ALL SELECT DISTINCT 'vector_search_index', source FROM documents
  UNION ALL SELECT DISTINCT 'serving_endpoint', s_name FROM supplier)"""


@query(
    "manifest_counts",
    f"""WITH {SQL_RESOURCES} SELECT kind, count(*) AS n FROM resources GROUP BY kind
        UNION ALL SELECT 'total', count(*) FROM resources""",
)
def manifest_counts(spark, sf_dir):
    counted = resources(spark, sf_dir).rollup("kind").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.coalesce("kind", F.lit("total")).alias("kind"), "n")


@query(
    "run_counts",
    "SELECT conv_id, count(*) AS n_prompts FROM conversations WHERE role = 'user' GROUP BY conv_id",
)
def run_counts(spark, sf_dir):
    users = load(spark, sf_dir, "conversations").where("role = 'user'")
    return users.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_prompts"))


@query(
    "eval_text_metrics",
    f"""SELECT lang AS run, count(*) AS n_rows, round(sum(n) / count(*), 6) AS mean_words,
          round(quantile_cont(n, 0.5), 6) AS p50_words, round(quantile_cont(n, 0.9), 6) AS p90_words,
          round(sum(s) / count(*), 6) AS mean_sentences, round(sum(toxic)::DOUBLE / count(toxic), 6) AS toxic_rate
        FROM (SELECT lang, len({sql_words('text')}) AS n, len(regexp_extract_all(text, '[.!?]+')) AS s, toxic
              FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) GROUP BY lang""",
)
def eval_text_metrics(spark, sf_dir):
    texts = load_spread(spark, sf_dir, "documents", "doc_id").select(
        "doc_id", F.col("lang").alias("run"), n_words(F.col("text")).alias("n"), sentences(F.col("text")).alias("s")
    )
    marked = texts.join(load(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    # One shuffle: rows are counted per (run, length), everything else follows from the counts.
    cells = marked.groupBy("run", "n").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("s").alias("s"),
        F.sum("toxic").alias("toxic"),
        F.count("toxic").alias("labelled"),
    )
    at = lambda p: F.round(F.percentile(F.col("n"), F.lit(p), F.col("rows")), 6)
    return cells.groupBy("run").agg(
        F.sum("rows").alias("n_rows"),
        F.round(F.sum(F.col("n") * F.col("rows")) / F.sum("rows"), 6).alias("mean_words"),
        at(0.5).alias("p50_words"),
        at(0.9).alias("p90_words"),
        F.round(F.sum("s") / F.sum("rows"), 6).alias("mean_sentences"),
        F.round(F.sum("toxic") / F.sum("labelled"), 6).alias("toxic_rate"),
    )


RUNS = ["base", "distinct", "long"]


@query(
    "eval_compare",
    f"""WITH m AS (SELECT lang, len({sql_words('text')}) AS base, len(list_distinct({sql_words('text')})) AS dist,
            len(list_filter({sql_words('text')}, lambda w: length(w) > 6)) AS lng FROM documents),
          a AS (SELECT lang, round(sum(base) / count(*), 6) AS base, round(sum(dist) / count(*), 6) AS "distinct",
                round(sum(lng) / count(*), 6) AS "long" FROM m GROUP BY lang)
        SELECT lang, base, "distinct", "long", round("distinct" - base, 6) AS distinct_minus_base,
          round("long" - base, 6) AS long_minus_base FROM a""",
)
def eval_compare(spark, sf_dir):
    """The same texts under three stand-in runs, side by side."""
    found = load_spread(spark, sf_dir, "documents", "doc_id").select("lang", words(F.col("text")).alias("w"))
    scores = F.array(
        F.struct(F.lit("base").alias("run"), F.size("w").alias("score")),
        F.struct(F.lit("distinct").alias("run"), F.size(F.array_distinct("w")).alias("score")),
        F.struct(F.lit("long").alias("run"), F.size(F.filter("w", lambda w: F.length(w) > 6)).alias("score")),
    )
    long = found.select("lang", F.inline(scores))
    means = long.groupBy("lang", "run").agg(mean("score").alias("score"))
    return compared(means, "lang", "run", "score", RUNS)


@query(
    "best_candidate",
    f"""WITH {SQL_SCORED} SELECT name, count(*) AS n, round(sum(score) / count(*), 6) AS mean_score FROM scored
        GROUP BY name ORDER BY mean_score DESC, name LIMIT 1""",
)
def best_candidate(spark, sf_dir):
    return best(mean_scores(candidate_scores(spark, sf_dir)))


@query(
    "peak_normalise",
    """WITH s AS (SELECT vec_id AS clip, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
         p AS (SELECT clip, max(abs(x)) AS m FROM s GROUP BY clip)
       SELECT s.clip, i, trunc(x / nullif(m, 0) * 32767)::BIGINT AS sample FROM s JOIN p ON p.clip = s.clip""",
)
def peak_normalise(spark, sf_dir):
    """A clip is one array cell, so its peak needs no shuffle."""
    rows = load(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("clip"), F.posexplode(peak_normalised(F.col("embedding"))).alias("i", "sample")
    )
    return rows.select("clip", F.col("i").cast("bigint").alias("i"), F.col("sample").cast("bigint").alias("sample"))


@query(
    "dedupe_registry",
    "SELECT p_name AS name, max(p_partkey) AS ord, arg_max(p_brand, p_partkey) AS kind FROM part GROUP BY p_name",
)
def dedupe_registry(spark, sf_dir):
    rows = load(spark, sf_dir, "part").select(
        F.col("p_name").alias("name"), F.col("p_partkey").alias("ord"), F.col("p_brand").alias("kind")
    )
    return last_wins(rows, "ord")


@query(
    "emb_dim_check",
    """SELECT min(d)::BIGINT AS min_dim, max(d)::BIGINT AS max_dim, max(d)::BIGINT AS expected_dim, count(*) AS n_vectors,
         count(*) FILTER (WHERE d <> (SELECT max(len(embedding)) FROM embeddings)) AS n_violations
       FROM (SELECT len(embedding) AS d FROM embeddings)""",
)
def emb_dim_check(spark, sf_dir):
    return dimension_profile(load(spark, sf_dir, "embeddings"), "embedding")
