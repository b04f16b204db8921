"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweft.functions.messages import one_line_base64
from docweft.functions.text import lines, page_text
from docweft.operators.embedding import DIM, embed
from docweft.operators.evaluation import mean
from docweft.plans.frames import CHUNK_OVERLAP, CHUNK_TOKENS, sql_chunks, vectors
from docweft.plans.registry import query
from docweft.session import fresh_path
from docweft.sources.catalog import ensure_namespace, ensure_table
from docweft.sources.files import extracted, list_files
from docweft.sources.index import VectorIndex, index_rows
from docweft.sources.payloads import first_prediction, payload_cells, split_payloads
from docweft.sources.runs import append_log, long_form, read_log
from docweft.sources.tables import load, load_spread


@query("scan_listing")
def scan_listing(spark, sf_dir):
    return list_files(spark, sf_dir, "*.parquet").select("name", "length")


@query("scan_documents", "SELECT doc_id, source, lang, text FROM documents")
def scan_documents(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")


@query(
    "scan_lines",
    """SELECT doc_id, (unnest(range(len(l))) + 1) AS line_no, unnest(l) AS line
       FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""",
)
def scan_lines(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(lines(F.col("text"))).alias("pos", "line"))
    return rows.select("doc_id", (F.col("pos") + 1).cast("bigint").alias("line_no"), "line")


SQL_PAGE = (
    "trim(regexp_replace(regexp_replace(regexp_replace(html, "
    "'(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), "
    "'[ \\t\\r\\n]+', ' ', 'g'))"
)


@query("page_text", f"SELECT page_id, url, {SQL_PAGE} AS text FROM pages")
def pages_as_text(spark, sf_dir):
    return load_spread(spark, sf_dir, "pages", "page_id").select("page_id", "url", page_text(F.col("html")).alias("text"))


@query(
    "scan_by_extension",
    f"""SELECT 'pages/' || page_id || '.HTML' AS path, 'html' AS ext, 'html' AS extractor, {SQL_PAGE} AS text FROM pages
        UNION ALL SELECT source || '/' || doc_id || '.' || lang, lang, 'plain', text FROM documents""",
)
def scan_by_extension(spark, sf_dir):
    pages = load(spark, sf_dir, "pages").select(
        F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".HTML")).alias("path"),
        F.col("html").alias("content"),
    )
    texts = load(spark, sf_dir, "documents").select(
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("path"),
        F.col("text").alias("content"),
    )
    files = pages.unionByName(texts)
    return extracted(files, "path", "content", {"html": page_text}).select("path", "ext", "extractor", "text")


@query(
    "skip_existing",
    "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
)
def skip_existing(spark, sf_dir):
    stored = load(spark, sf_dir, "labels").select("doc_id")
    return load(spark, sf_dir, "documents").select("doc_id", "source").join(stored, "doc_id", "left_anti")


def _vector_rows(spark, sf_dir, source):
    return vectors(spark, sf_dir).select(
        F.col("id").cast("string").alias("id"),
        F.concat(F.lit("label "), F.col("label").cast("string")).alias("text"),
        F.col("embedding").cast("array<double>").alias("text_vector"),
        F.lit(source).alias("source"),
        "label",
    )


@query(
    "index_create",
    """SELECT count(*) AS n_rows, min(len(embedding))::BIGINT AS min_dim, max(len(embedding))::BIGINT AS max_dim
       FROM embeddings""",
)
def index_create(spark, sf_dir):
    path = fresh_path(spark, "index")
    VectorIndex.open_or_create(spark, path, DIM).write(_vector_rows(spark, sf_dir, "first"), 1)
    again = VectorIndex.open_or_create(spark, path, DIM)
    size = F.size("text_vector").cast("bigint")
    return again.latest().agg(F.count(F.lit(1)).alias("n_rows"), F.min(size).alias("min_dim"), F.max(size).alias("max_dim"))


@query(
    "index_append",
    """SELECT vec_id::VARCHAR AS id, 'label ' || label AS text, 'first' AS source, len(embedding)::BIGINT AS dim
       FROM embeddings UNION ALL
       SELECT 'd' || doc_id, text, source, 64 FROM documents""",
)
def index_append(spark, sf_dir):
    index = VectorIndex.open_or_create(spark, fresh_path(spark, "index"), DIM)
    index.write(_vector_rows(spark, sf_dir, "first"), 1)
    whole = load_spread(spark, sf_dir, "documents", "doc_id").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), "text", "source"
    )
    index.write(whole.select(F.col("doc_id").alias("id"), "text", embed(F.col("text")).alias("text_vector"), "source"), 2)
    return index.log().select("id", "text", "source", F.size("text_vector").cast("bigint").alias("dim"))


@query(
    "index_upsert",
    """SELECT vec_id::VARCHAR AS id, CASE WHEN label >= 5 THEN 'second' ELSE 'first' END AS source,
         CASE WHEN label >= 5 THEN 2 ELSE 1 END::BIGINT AS seq, 'label ' || label AS text FROM embeddings""",
)
def index_upsert(spark, sf_dir):
    index = VectorIndex.open_or_create(spark, fresh_path(spark, "index"), DIM)
    index.write(_vector_rows(spark, sf_dir, "first"), 1)
    index.write(_vector_rows(spark, sf_dir, "second").where("label >= 5"), 2)
    return index.latest().select("id", "source", "seq", "text")


@query(
    "index_from_nodes",
    f"""WITH {sql_chunks()} SELECT doc_id || '-' || chunk_no AS id, text, source, 64::BIGINT AS dim FROM chunk""",
)
def index_from_nodes(spark, sf_dir):
    index = VectorIndex.open_or_create(spark, fresh_path(spark, "index"), DIM)
    index.write(index_rows(load_spread(spark, sf_dir, "documents", "doc_id"), CHUNK_TOKENS, CHUNK_OVERLAP), 1)
    return index.latest().select("id", "text", "source", F.size("text_vector").cast("bigint").alias("dim"))


REWRITE_TOKENS = 50
REWRITE_CHUNK, REWRITE_OVERLAP = 64, 8
SQL_REWRITTEN = f"""
now AS (SELECT d.doc_id, d.source, CASE WHEN quality = 0 THEN array_to_string(list_slice(string_split(text, ' '), 1, {REWRITE_TOKENS}), ' ') ELSE text END AS text,
    CASE WHEN quality = 0 THEN 2 ELSE 1 END::BIGINT AS seq
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE coalesce(toxic, 0) <> 1),
{sql_chunks(size=REWRITE_CHUNK, overlap=REWRITE_OVERLAP).replace("FROM documents", "FROM now").strip()}"""


@query(
    "index_rewrite",
    f"""WITH {SQL_REWRITTEN} SELECT c.doc_id || '-' || c.chunk_no AS id, now.seq, c.text FROM chunk c JOIN now ON now.doc_id = c.doc_id""",
)
def index_rewrite(spark, sf_dir):
    """All documents are indexed, those of low quality rewritten shorter, toxic ones deleted; what is left."""
    index = VectorIndex.open_or_create(spark, fresh_path(spark, "index"), DIM)
    documents = load_spread(spark, sf_dir, "documents", "doc_id")
    labels = load(spark, sf_dir, "labels")
    index.write(index_rows(documents, REWRITE_CHUNK, REWRITE_OVERLAP), 1)
    short = F.array_join(F.slice(F.split("text", " "), 1, REWRITE_TOKENS), " ")
    poor = documents.join(labels.where("quality = 0").select("doc_id"), "doc_id", "left_semi").withColumn("text", short)
    index.write(index_rows(poor, REWRITE_CHUNK, REWRITE_OVERLAP), 2)
    index.delete(labels.where("toxic = 1").select(F.col("doc_id").alias("doc")), 3)
    return index.latest().select("id", "seq", "text")


@query("catalog_bootstrap", "SELECT source, count(*) AS n_docs FROM documents GROUP BY source")
def catalog_bootstrap(spark, sf_dir):
    location = fresh_path(spark, "namespace")
    name = location.rstrip("/").rsplit("/", 1)[-1].replace("-", "_")
    for _ in range(2):
        ensure_namespace(spark, name, location)
        counts = load(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))
        table = ensure_table(spark, name, "sources", counts)
    return table


@query("source_listing", "SELECT DISTINCT source FROM documents")
def source_listing(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("source").distinct()


@query("binary_base64", "SELECT doc_id, base64(encode(text)) AS payload FROM documents")
def binary_base64(spark, sf_dir):
    content = F.encode("text", "UTF-8")
    return load(spark, sf_dir, "documents").select("doc_id", one_line_base64(content).alias("payload"))


@query(
    "payload_build",
    """SELECT doc_id // 32 AS batch_id, row_number() OVER (PARTITION BY doc_id // 32 ORDER BY doc_id) - 1 AS idx,
         base64(encode(text)) AS value FROM documents""",
)
def payload_build(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select("doc_id", one_line_base64(F.encode("text", "UTF-8")).alias("cell"))
    return payload_cells(split_payloads(rows, "doc_id", "cell", 32))


@query(
    "payload_parse",
    """SELECT event_id, CASE WHEN event_type NOT IN ('error', 'signup') THEN event_type END AS prediction,
         CASE WHEN event_type = 'error' THEN 'Request failed with status 500, no ' || event_id
              WHEN event_type = 'signup' THEN 'Unreadable response: {"predictions": [' END AS error FROM events""",
)
def payload_parse(spark, sf_dir):
    kind = F.col("event_type")
    responses = load(spark, sf_dir, "events").select(
        "event_id",
        F.when(kind == "error", 500).otherwise(200).alias("status"),
        F.when(kind == "error", F.concat(F.lit("no "), F.col("event_id").cast("string")))
        .when(kind == "signup", F.lit('{"predictions": ['))
        .otherwise(F.concat(F.lit('{"predictions": ["'), kind, F.lit('", "other"]}')))
        .alias("body"),
    )
    prediction, error = first_prediction(F.col("status"), F.col("body"))
    return responses.select("event_id", prediction.alias("prediction"), error.alias("error"))


@query(
    "run_log_write",
    """WITH m AS (SELECT lang, count(*)::VARCHAR AS n_docs,
           CAST(CAST(round(sum(n_chars) / count(*), 6) AS DECIMAL(38,6)) AS VARCHAR) AS mean_chars
         FROM documents GROUP BY lang)
       SELECT lang AS run_id, 'n_docs' AS key, n_docs AS value FROM m
       UNION ALL SELECT lang, 'mean_chars', mean_chars FROM m""",
)
def run_log_write(spark, sf_dir):
    path = fresh_path(spark, "run-log")
    wide = load(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_docs"), mean("n_chars").alias("mean_chars")
    )
    append_log(long_form(wide, "lang", ["n_docs", "mean_chars"]), path)
    return read_log(spark, path)
