"""Queries of jobs, extraction, indexing, query expansion, answers and evaluation runs.

The driver's tables hold none of these, so frames stand for them, each written once in SQL that both engines read: in it
``{orders}`` names a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers as A
from ..operators import expansion as X
from ..operators import extraction as P
from ..operators import generation as G
from ..operators import indexing as I
from ..operators import jobs as J
from ..operators import relational as R
from ..operators import runs as N
from ..operators import vectors as V
from ..sources import tables as S
from ..streaming import limits as L
from .catalog import _DENSE, _FUSED, _POSTINGS, _SPARSE, query, questions, read, rrf_fuse

FRAMES = {
    "uploads": """SELECT 'u' || CAST(c_custkey AS STRING) AS id, c_name AS filename, CAST(CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE c_custkey % 90 END AS INT) AS page_count,
  CASE c_custkey % 3 WHEN 0 THEN CAST('2024-01-01 00:00:00' AS TIMESTAMP) WHEN 1 THEN CAST('2024-01-02 00:00:00' AS TIMESTAMP) ELSE CAST('2024-01-03 00:00:00' AS TIMESTAMP) END AS created_at FROM {customer}""",
    "jobs": """SELECT 'j' || CAST(o_orderkey AS STRING) AS id, 'u' || CAST(o_custkey AS STRING) AS upload_id,
  CASE o_orderkey % 5 WHEN 0 THEN 'initial' WHEN 1 THEN 'layout' WHEN 2 THEN 'metadata' WHEN 3 THEN 'chunking' ELSE 'indexing' END AS kind,
  CASE o_orderkey % 7 WHEN 0 THEN 'uploaded' WHEN 1 THEN 'queued' WHEN 2 THEN 'failed' WHEN 3 THEN 'indexed' WHEN 6 THEN 'chunking' ELSE 'completed' END AS status,
  o_orderpriority AS current_step, CAST(o_orderkey % 101 AS INT) AS progress_percent, CAST(NULL AS STRING) AS error_message,
  o_orderdate AS created_at, o_orderdate AS started_at, CAST(NULL AS TIMESTAMP) AS finished_at, o_orderdate AS updated_at FROM {orders}""",
    "errors": """SELECT CAST(event_id AS STRING) AS id, 'j' || CAST(user_id AS STRING) AS job_id, event_type AS step, props AS message, CAST(NULL AS STRING) AS details, ts AS created_at FROM {events}""",
    "pages": """SELECT 'j' || CAST(l_orderkey AS STRING) AS job_id, l_linenumber AS page_number, CAST(l_quantity AS BIGINT) * 90 AS char_count, l_quantity > 3 AS has_text, CAST(l_partkey % 9 AS INT) AS block_count,
  CAST(l_suppkey % 3 AS INT) AS image_count, CAST(l_suppkey % 4 AS INT) AS drawing_count, l_discount * 4.7123 AS confidence FROM {lineitem}""",
    "blocks": """SELECT 'j' || CAST(l_orderkey AS STRING) AS job_id, CASE l_partkey % 4 WHEN 0 THEN 'header' WHEN 1 THEN 'main' WHEN 2 THEN 'footnote' END AS region, l_linenumber AS page_number, l_partkey AS block_index, l_suppkey AS reading_order FROM {lineitem}""",
    "chunks": """SELECT 'c' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS chunk_id, 'j' || CAST(l_orderkey AS STRING) AS job_id,
  'b' || CAST(l_partkey % 60 AS STRING) AS book_id, 'e' || CAST(l_partkey % 60 AS STRING) AS edition_id, 'v' || CAST(l_partkey % 60 AS STRING) || '-' || CAST(l_suppkey % 3 AS STRING) AS volume_id, 'text ' || CAST(l_partkey AS STRING) AS raw_text,
  CAST(l_suppkey % 40 AS INT) AS printed_page_start, CAST(l_suppkey % 40 + l_partkey % 3 AS INT) AS printed_page_end, l_linenumber AS pdf_page_start, CAST(l_linenumber + l_partkey % 2 AS INT) AS pdf_page_end,
  l_returnflag AS kitab, l_linestatus AS bab, CAST(NULL AS STRING) AS fasl, 'topic' AS topic, 'main' AS region, 'en' AS lang, l_linestatus = 'F' AS verified, CAST(l_quantity AS INT) AS token_count FROM {lineitem}""",
    "documents_of": """SELECT 'd' || CAST(o_orderkey AS STRING) AS id, 'j' || CAST(o_orderkey AS STRING) AS job_id, CAST(o_orderkey % 30 AS INT) AS page_count, 'latin' AS numbering_system, CAST(o_orderkey % 97 AS DOUBLE) / 97 AS confidence FROM {orders} WHERE o_orderkey % 5 = 2""",
    "fields": """SELECT 'd' || CAST(l_orderkey AS STRING) AS document_id, CASE l_linenumber WHEN 1 THEN 'title' WHEN 2 THEN 'author' WHEN 3 THEN 'volume' WHEN 4 THEN 'publisher' WHEN 5 THEN 'edition' ELSE 'publication_year' END AS field, CAST(l_partkey AS STRING) AS value FROM {lineitem} WHERE l_orderkey % 5 = 2""",
    "books": "SELECT 'b' || CAST(p_partkey AS STRING) AS id, p_name AS title, p_brand AS author, CASE WHEN p_size % 2 = 0 THEN 'published' ELSE 'draft' END AS status FROM {part}",
    "editions": "SELECT 'e' || CAST(p_partkey AS STRING) AS id, 'b' || CAST(p_partkey AS STRING) AS book_id FROM {part}",
    "volumes": "SELECT 'v' || CAST(p_partkey AS STRING) || '-' || CAST(s_suppkey AS STRING) AS id, 'e' || CAST(p_partkey AS STRING) AS edition_id, CAST(s_suppkey AS INT) AS volume_number FROM {part} JOIN {supplier} ON s_suppkey < 3",
    "citations": """SELECT CAST(item_id AS STRING) AS item_id, CASE WHEN item_id % 3 = 0 THEN 'b' || CAST(item_id AS STRING) END AS book_id, CASE WHEN item_id % 5 = 4 THEN 'no such book' ELSE lower(p_name) END AS book,
  CASE item_id % 4 WHEN 0 THEN '1' WHEN 1 THEN ' 2 ' WHEN 2 THEN 'two' END AS volume, CAST(CASE WHEN item_id % 7 > 0 THEN item_id % 40 END AS INT) AS page FROM {benchmark} JOIN {part} ON p_partkey = item_id""",
    "asked": """SELECT o_orderkey AS q_id, a || ' ' || b || ' ' || c AS original, a || ' ' || b || ' ' || c AS canonical FROM (SELECT o_orderkey,
  CASE o_orderkey % 5 WHEN 0 THEN 'ثبوت' WHEN 1 THEN 'الصلاه' WHEN 2 THEN 'book' WHEN 3 THEN 'زكاه' ELSE 'من' END AS a,
  CASE o_orderkey % 7 WHEN 0 THEN 'ماء' WHEN 1 THEN 'طلاق' WHEN 2 THEN 'عباده' WHEN 3 THEN 'حول' ELSE 'of' END AS b,
  CASE o_orderkey % 3 WHEN 0 THEN 'طهور' WHEN 1 THEN 'الماء' ELSE 'water' END AS c FROM {orders}) x""",
    "replays": """SELECT 'r' || CAST(o_orderkey % 7 AS STRING) AS run_id, CAST(o_orderkey % 10 AS DOUBLE) / 10 AS recall_5, CAST(o_orderkey % 11 AS DOUBLE) / 10 AS recall_10, CAST(o_orderkey % 12 AS DOUBLE) / 10 AS recall_20, CAST(o_orderkey % 13 AS DOUBLE) / 10 AS mrr,
  CAST(o_orderkey % 9 AS DOUBLE) / 10 AS ndcg_10, CAST(o_orderkey % 6 AS DOUBLE) / 5 AS citation_accuracy, CAST(o_orderkey % 8 AS DOUBLE) / 7 AS groundedness, CAST(o_orderkey % 4 AS DOUBLE) / 30 AS hallucination_rate, CAST(o_orderkey % 3 AS DOUBLE) AS answer_accuracy,
  o_custkey % 4 = 0 AS expect_refusal, o_custkey % 5 = 0 AS refusal_given, CASE WHEN o_custkey % 9 > 0 THEN o_totalprice END AS latency_ms FROM {orders}""",
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = FRAMES[name]
    return spark.sql(sql, **{t: read(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", sql))})


def _with(*names: str) -> str:
    """The same frames as common table expressions."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({re.sub(r'{(\w+)}', r'\1', FRAMES[n])})" for n in names)


def _frames(spark, sf_dir, *names):
    return [frame(spark, sf_dir, n) for n in names]


# --- jobs and their status ---------------------------------------------------------------------------------------

_LATEST = "latest AS (SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY upload_id, kind ORDER BY created_at DESC, id DESC) = 1)"
_FLIGHT = "('uploaded', 'queued', 'processing', 'sanitizing', 'extracting', 'ocr', 'ocr_correcting', 'structuring', 'chunking', 'embedding')"
_PIPELINE = "pipeline AS (SELECT * FROM jobs WHERE kind NOT IN ('layout', 'metadata', 'chunking', 'indexing') QUALIFY row_number() OVER (PARTITION BY upload_id ORDER BY created_at DESC, id DESC) = 1)"
_NEWEST = "newest AS (SELECT job_id, count(*) AS n_errors, arg_max(step, (created_at, id)) AS last_step FROM (SELECT * FROM errors QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, id DESC) <= 5) GROUP BY 1)"
_SUMMARY = """summary AS (SELECT job_id, count(*) AS pages, sum(char_count) AS char_count, sum(block_count) AS block_count, sum(image_count) AS image_count, sum(drawing_count) AS drawing_count, count(*) FILTER (has_text) AS text_pages, avg(confidence) AS confidence FROM pages GROUP BY 1)"""


def _counted(status: DataFrame, *columns: str) -> DataFrame:
    """A status with its list of errors as a count and the newest one's step."""
    return status.select("job_id", "upload_id", "status", "progress_percent", *columns, F.size("errors").cast("long").alias("n_errors"), F.get("errors", 0)["step"].alias("last_step"))


@query(f"{_with('jobs')} SELECT id, kind, status, created_at FROM jobs WHERE status NOT IN ('indexed', 'failed') ORDER BY created_at DESC, id DESC LIMIT 50")
def active_jobs(spark, sf_dir):
    return J.active(frame(spark, sf_dir, "jobs")).select("id", "kind", "status", "created_at")


@query(f"{_with('jobs')}, {_PIPELINE} SELECT upload_id, id, status FROM pipeline")
def pipeline_jobs(spark, sf_dir):
    return J.pipeline_jobs(frame(spark, sf_dir, "jobs")).select("upload_id", "id", "status")


@query(f"{_with('jobs')} SELECT upload_id, id, CAST(row_number() OVER (PARTITION BY upload_id ORDER BY created_at DESC, id DESC) AS INTEGER) AS place FROM jobs WHERE status IN {_FLIGHT}")
def jobs_in_flight(spark, sf_dir):
    return J.in_flight(frame(spark, sf_dir, "jobs")).select("upload_id", "id", "place")


@query(f"""{_with('uploads', 'jobs', 'documents_of', 'chunks')}, {_LATEST}, {_PIPELINE}, kinds AS (SELECT unnest(['layout', 'metadata', 'chunking', 'indexing']) AS stage)
SELECT u.id AS upload_id, stage, CASE WHEN EXISTS (SELECT 1 FROM latest l WHERE l.upload_id = u.id AND l.kind = stage AND l.status IN {_FLIGHT}) THEN 'already running'
  WHEN stage <> 'indexing' AND NOT EXISTS (SELECT 1 FROM pipeline p WHERE p.upload_id = u.id AND p.status = 'completed') THEN 'no completed extraction'
  WHEN stage = 'chunking' AND NOT EXISTS (SELECT 1 FROM latest l JOIN documents_of d ON d.job_id = l.id WHERE l.upload_id = u.id AND l.kind = 'metadata') THEN 'no metadata document'
  WHEN stage = 'indexing' AND NOT EXISTS (SELECT 1 FROM latest l JOIN chunks c ON c.job_id = l.id WHERE l.upload_id = u.id AND l.kind = 'chunking') THEN 'no chunks' END AS refusal FROM uploads u, kinds""")
def stage_refusals(spark, sf_dir):
    return J.refusals(*_frames(spark, sf_dir, "uploads", "jobs", "documents_of", "chunks"))


@query(f"""{_with('jobs')}, why AS (SELECT upload_id, min(current_step) AS message FROM jobs WHERE status = 'failed' GROUP BY 1)
SELECT id, CASE WHEN message IS NOT NULL AND status IN {_FLIGHT} THEN 'failed' ELSE status END AS status, CASE WHEN message IS NOT NULL AND status IN {_FLIGHT} THEN message ELSE error_message END AS error_message FROM jobs LEFT JOIN why USING (upload_id)""")
def sibling_jobs_failed(spark, sf_dir):
    jobs = frame(spark, sf_dir, "jobs")
    failures = jobs.filter("status = 'failed'").select("upload_id", F.col("current_step").alias("message"))
    return J.siblings_failed(jobs, failures, F.to_timestamp(F.lit("2024-02-02 00:00:00"))).select("id", "status", "error_message")


@query(f"""{_with('jobs')}, now AS (SELECT *, CASE WHEN status = 'uploaded' THEN 'queued' ELSE status END AS s FROM jobs),
c AS (SELECT id, CASE WHEN progress_percent > 90 THEN 'no status' WHEN progress_percent > 60 THEN 'indexed' ELSE 'embedding' END AS to_status, progress_percent + 1 AS p FROM jobs WHERE progress_percent > 50)
SELECT j.id, CASE WHEN to_status IS NULL OR to_status = 'no status' THEN s ELSE to_status END AS status, CASE WHEN to_status IS NULL OR to_status = 'no status' THEN progress_percent ELSE p END AS progress_percent, CASE WHEN to_status = 'indexed' THEN TIMESTAMP '2024-02-02 00:00:00' END AS finished_at FROM now j LEFT JOIN c USING (id)""")
def job_transitions(spark, sf_dir):
    jobs = J.queued(frame(spark, sf_dir, "jobs"))
    to = F.when(F.col("progress_percent") > 90, "no status").when(F.col("progress_percent") > 60, "indexed").otherwise("embedding")
    changes = jobs.filter("progress_percent > 50").select("id", to.alias("status"), (F.col("progress_percent") + 1).alias("progress_percent"), F.lit(None).cast("string").alias("current_step"), F.lit(None).cast("string").alias("error_message"))
    return J.moved(jobs, changes, F.to_timestamp(F.lit("2024-02-02 00:00:00"))).select("id", "status", "progress_percent", "finished_at")


@query(f"""{_with('uploads', 'jobs')}, now AS (SELECT upload_id, arg_max(id, (created_at, id)) AS job_id, arg_max(status, (created_at, id)) AS status FROM jobs GROUP BY 1)
SELECT u.id AS upload_id, filename, job_id, status FROM (SELECT * FROM uploads ORDER BY created_at DESC, id DESC LIMIT 40 OFFSET 20) u LEFT JOIN now ON u.id = now.upload_id""")
def upload_list(spark, sf_dir):
    uploads, jobs = _frames(spark, sf_dir, "uploads", "jobs")
    logs = jobs.select("upload_id", F.col("kind").alias("action"), F.col("status").alias("details"), "created_at")
    return J.upload_list(uploads, jobs, logs, 20, 40).select("upload_id", "filename", "latest_job.job_id", "latest_job.status")


@query(f"""{_with('jobs', 'uploads', 'errors', 'pages')}, {_NEWEST}, {_SUMMARY}
SELECT j.id AS job_id, upload_id, status, progress_percent, CAST(coalesce(nullif(page_count, 0), pages, 0) AS BIGINT) AS page_count, coalesce(pages, 0) AS pages_extracted, coalesce(text_pages, 0) > 0 AS has_text_layer, round_even(coalesce(s.confidence, 0), 4) AS confidence,
  CAST(coalesce(char_count, 0) AS BIGINT) AS char_count, CAST(coalesce(block_count, 0) AS BIGINT) AS block_count, CAST(coalesce(image_count, 0) AS BIGINT) AS image_count, CAST(coalesce(drawing_count, 0) AS BIGINT) AS drawing_count, coalesce(n_errors, 0) AS n_errors, last_step
FROM jobs j LEFT JOIN uploads u ON u.id = upload_id LEFT JOIN summary s ON s.job_id = j.id LEFT JOIN newest n ON n.job_id = j.id WHERE kind = 'initial'""")
def extraction_status(spark, sf_dir):
    out = J.extraction_status(*_frames(spark, sf_dir, "jobs", "uploads", "errors", "pages"))
    return _counted(out, "page_count", "pages_extracted", "has_text_layer", F.col("extraction_confidence").alias("confidence"), "char_count", "block_count", "image_count", "drawing_count")


@query(f"""{_with('jobs', 'uploads', 'errors', 'pages', 'blocks')}, {_NEWEST}, {_SUMMARY}, r AS (SELECT job_id, count(*) FILTER (region = 'main') AS main, count(*) FILTER (region = 'footnote') AS footnote, count(*) FILTER (region = 'header') AS header FROM blocks GROUP BY 1)
SELECT j.id AS job_id, upload_id, status, progress_percent, coalesce(pages, 0) AS pages_processed, CAST(coalesce(block_count, 0) AS BIGINT) AS block_count, nullif(main, 0) AS main, nullif(footnote, 0) AS footnote, nullif(header, 0) AS header, coalesce(n_errors, 0) AS n_errors, last_step
FROM jobs j LEFT JOIN uploads u ON u.id = upload_id LEFT JOIN summary s ON s.job_id = j.id LEFT JOIN newest n ON n.job_id = j.id LEFT JOIN r ON r.job_id = j.id WHERE kind = 'layout'""")
def layout_status(spark, sf_dir):
    out = J.layout_status(*_frames(spark, sf_dir, "jobs", "uploads", "errors", "pages", "blocks"))
    return _counted(out, "pages_processed", "block_count", *[F.try_element_at("region_counts", F.lit(c)).alias(c) for c in ("main", "footnote", "header")])


@query(f"""{_with('jobs', 'uploads', 'errors', 'documents_of', 'fields')}, {_NEWEST}, f AS (SELECT document_id, count(*) AS n, string_agg(field || '=' || value, ',' ORDER BY field, value) AS listed FROM fields GROUP BY 1)
SELECT j.id AS job_id, upload_id, status, progress_percent, coalesce(nullif(u.page_count, 0), d.page_count, 0) AS page_count, coalesce(d.page_count, 0) AS pages_mapped, CAST(coalesce(f.n, 0) AS INTEGER) AS fields_count, coalesce(numbering_system, 'none') AS numbering_system, round_even(coalesce(d.confidence, 0), 4) AS confidence, listed, coalesce(n_errors, 0) AS n_errors, last_step
FROM jobs j LEFT JOIN uploads u ON u.id = upload_id LEFT JOIN newest n ON n.job_id = j.id LEFT JOIN documents_of d ON d.job_id = j.id LEFT JOIN f ON f.document_id = d.id WHERE kind = 'metadata'""")
def metadata_status(spark, sf_dir):
    jobs, uploads, errors, documents, fields = _frames(spark, sf_dir, "jobs", "uploads", "errors", "documents_of", "fields")
    none = [S.empty_table(spark, t) for t in ("metadata_pages", "metadata_structures")]
    out = J.metadata_status(jobs, uploads, errors, documents, fields, *none)
    listed = F.array_join(F.transform(F.array_sort("fields"), lambda f: F.concat_ws("=", f["field"], f["value"])), ",")
    return _counted(out, "page_count", "pages_mapped", "fields_count", "numbering_system", "confidence", listed.alias("listed"))


@query(f"""{_with('jobs', 'uploads', 'errors', 'chunks')}, {_NEWEST}, t AS (SELECT job_id, count(*) AS n, sum(token_count) AS tokens FROM chunks GROUP BY 1), p AS (SELECT job_id, count(DISTINCT page) AS pages FROM (SELECT job_id, pdf_page_start AS page FROM chunks UNION ALL SELECT job_id, pdf_page_end FROM chunks) GROUP BY 1)
SELECT j.id AS job_id, upload_id, status, progress_percent, coalesce(nullif(page_count, 0), 0) AS page_count, coalesce(t.n, 0) AS chunks_count, coalesce(pages, 0) AS pages_covered, CAST(coalesce(tokens, 0) AS BIGINT) AS tokens_count, coalesce(n_errors, 0) AS n_errors, last_step
FROM jobs j LEFT JOIN uploads u ON u.id = upload_id LEFT JOIN newest n ON n.job_id = j.id LEFT JOIN t ON t.job_id = j.id LEFT JOIN p ON p.job_id = j.id WHERE kind = 'chunking'""")
def chunking_status(spark, sf_dir):
    return _counted(J.chunking_status(*_frames(spark, sf_dir, "jobs", "uploads", "errors", "chunks")), "page_count", "chunks_count", "pages_covered", "tokens_count")


@query(f"""{_with('jobs', 'uploads', 'errors', 'chunks')}, {_NEWEST}, {_LATEST}, t AS (SELECT upload_id, count(*) AS n FROM latest JOIN chunks ON chunks.job_id = latest.id WHERE kind = 'chunking' GROUP BY 1)
SELECT j.id AS job_id, j.upload_id, status, progress_percent, coalesce(t.n, 0) AS chunks_count, CASE WHEN status = 'indexed' THEN coalesce(t.n, 0) ELSE 0 END AS vectors_indexed, coalesce(n_errors, 0) AS n_errors, last_step
FROM jobs j LEFT JOIN newest n ON n.job_id = j.id LEFT JOIN t ON t.upload_id = j.upload_id WHERE kind = 'indexing'""")
def indexing_status(spark, sf_dir):
    return _counted(J.indexing_status(*_frames(spark, sf_dir, "jobs", "uploads", "errors", "chunks")), "chunks_count", "vectors_indexed")


@query(f"{_with('books')} SELECT id, title FROM books WHERE status = 'published' ORDER BY title, id LIMIT 30 OFFSET 10")
def published_books(spark, sf_dir):
    return J.published(frame(spark, sf_dir, "books"), 10, 30).select("id", "title")


@query(f"{_with('chunks')} SELECT chunk_id, printed_page_start FROM chunks WHERE volume_id = 'v7-1' ORDER BY printed_page_start, chunk_id")
def chunks_of_volume(spark, sf_dir):
    return J.children_in_order(frame(spark, sf_dir, "chunks"), "volume_id", "v7-1", ["printed_page_start", "chunk_id"]).select("chunk_id", "printed_page_start")


@query(f"{_with('books')} SELECT id, status FROM books WHERE title = (SELECT min(title) FROM books) AND author = (SELECT min(author) FROM books WHERE title = (SELECT min(title) FROM books))")
def book_lookup(spark, sf_dir):
    books = frame(spark, sf_dir, "books")
    first = books.agg(F.min(F.struct("title", "author")).alias("k")).first().k
    return J.found_by(books, title=first.title, author=first.author).select("id", "status")


# --- extraction ---------------------------------------------------------------------------------------------------

_SPANS = """raw AS (SELECT 'j' || l_orderkey % 50 AS job_id, CAST(l_orderkey AS INTEGER) AS page_number, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k, *,
  CASE WHEN l_partkey % 11 = 0 THEN '' ELSE 'w' || l_partkey END AS t1, CASE WHEN l_suppkey % 3 = 0 OR l_partkey % 11 = 0 THEN '' ELSE ' x' || l_suppkey END AS t2, CAST(8 + l_suppkey % 8 AS DOUBLE) AS z1, CAST(8 + l_partkey % 8 AS DOUBLE) AS z2, CASE WHEN l_partkey % 4 = 0 THEN '' ELSE 'f' || l_partkey % 4 END AS f2 FROM lineitem),
kept AS (SELECT *, CAST(row_number() OVER (PARTITION BY page_number ORDER BY k) - 1 AS INTEGER) AS block_index FROM raw WHERE l_partkey % 7 > 0 AND l_partkey % 11 > 0 AND l_orderkey % 23 > 0)"""


def nested_pages(spark, sf_dir) -> DataFrame:
    """Pages of blocks of two lines each, made from ``lineitem``, as a parser would give them."""
    l = read(spark, sf_dir, "lineitem")
    part, supp, empty = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_partkey") % 11 == 0
    text = lambda mark, of, when: F.when(when, "").otherwise(F.concat(F.lit(mark), of.cast("string")))
    zero = [F.lit(0.0).alias(c) for c in ("x0", "y0", "x1", "y1")]
    span = lambda t, font, size: F.struct(t.alias("text"), font.alias("font"), size.cast("double").alias("size"), *zero, F.lit(0).alias("flags"))
    one, two = span(text("w", part, empty), F.lit("serif"), 8 + supp % 8), span(text(" x", supp, empty | (supp % 3 == 0)), text("f", part % 4, part % 4 == 0), 8 + part % 8)
    kind = F.when(part % 7 == 0, 1).otherwise(0)
    at = [F.col("l_linenumber").cast("double").alias("x0"), part.cast("double").alias("y0"), supp.cast("double").alias("x1"), F.col("l_quantity").alias("y1")]
    order = [F.col(c).alias(f"o{i}") for i, c in enumerate(("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))]
    block = F.struct(kind.alias("kind"), *at, F.array(F.array(one), F.array(two)).alias("lines"))
    image = F.when(supp % 5 == 0, F.struct(*at, (part % 3).cast("int").alias("width"), (part % 4).cast("int").alias("height"), (part % 2).cast("int").alias("xref")))
    drawing = F.when(supp % 4 == 0, F.struct(*at, F.col("l_returnflag").alias("kind"), F.col("l_tax").alias("stroke_width")))
    held = F.array_sort(F.collect_list(F.struct(*order, block.alias("b"), image.alias("i"), drawing.alias("d"))))
    pages = l.groupBy("l_orderkey").agg(held.alias("h"))
    some = lambda c: F.filter(F.transform("h", lambda x: x[c]), lambda x: x.isNotNull())
    return pages.select(F.concat(F.lit("j"), (F.col("l_orderkey") % 50).cast("string")).alias("job_id"), F.col("l_orderkey").cast("int").alias("page_number"), F.lit(595.0).alias("width"), F.lit(842.0).alias("height"), F.lit(0).alias("rotation"),
                        some("b").alias("blocks"), some("i").alias("images"), some("d").alias("drawings"), F.when(F.col("l_orderkey") % 23 == 0, "broken page").alias("error"))


_PAGE_ROWS = f"""{_SPANS}, b AS (SELECT page_number, count(*) AS blocks, sum(len(t1 || t2)) AS chars FROM kept GROUP BY 1),
page_rows AS (SELECT r.job_id, r.page_number, CAST(coalesce(chars, 0) AS BIGINT) AS char_count, coalesce(chars, 0) >= 20 AS has_text, CAST(coalesce(blocks, 0) AS INTEGER) AS block_count, CAST(count(*) FILTER (l_suppkey % 5 = 0 AND l_orderkey % 23 > 0) AS INTEGER) AS image_count,
  CAST(count(*) FILTER (l_suppkey % 4 = 0 AND l_orderkey % 23 > 0) AS INTEGER) AS drawing_count, CASE WHEN coalesce(chars, 0) >= 20 THEN least(1, chars / 4000) ELSE 0 END AS confidence, CASE WHEN any_value(l_orderkey) % 23 = 0 THEN 'broken page' END AS error_message
  FROM raw r LEFT JOIN b USING (page_number) GROUP BY r.job_id, r.page_number, chars, blocks)"""


@query(f"WITH {_PAGE_ROWS} SELECT * FROM page_rows")
def extraction_pages(spark, sf_dir):
    return P.fanned_out(nested_pages(spark, sf_dir))["pages"].drop("width", "height", "rotation")


@query(f"WITH {_PAGE_ROWS} SELECT job_id, count(*) AS page_count, CAST(sum(char_count) AS BIGINT) AS total_chars, bool_or(has_text) AS has_text_layer, round(avg(confidence), 9) AS confidence FROM page_rows GROUP BY 1")
def extraction_summary(spark, sf_dir):
    return P.document_summary(P.fanned_out(nested_pages(spark, sf_dir))["pages"]).withColumn("confidence", F.round("confidence", 9))


@query(f"""WITH {_SPANS} SELECT job_id, page_number, block_index, t1 || t2 AS text, CASE WHEN t2 <> '' AND z2 > z1 THEN nullif(f2, '') ELSE 'serif' END AS font, CASE WHEN t2 <> '' THEN greatest(z1, z2) ELSE z1 END AS font_size, CASE WHEN t2 <> '' THEN 2 ELSE 1 END AS span_count FROM kept""")
def extraction_blocks(spark, sf_dir):
    return P.fanned_out(nested_pages(spark, sf_dir))["blocks"].drop("x0", "y0", "x1", "y1")


@query(f"""WITH {_SPANS} SELECT job_id, page_number, block_index, 0 AS span_index, t1 AS text, 'serif' AS font, z1 AS font_size FROM kept UNION ALL SELECT job_id, page_number, block_index, 1, t2, f2, z2 FROM kept WHERE t2 <> ''""")
def extraction_spans(spark, sf_dir):
    return P.fanned_out(nested_pages(spark, sf_dir))["spans"].drop("x0", "y0", "x1", "y1", "flags")


@query(f"""WITH {_SPANS} SELECT job_id, page_number, CAST(row_number() OVER (PARTITION BY page_number ORDER BY k) - 1 AS INTEGER) AS image_index, CAST(l_linenumber AS DOUBLE) AS x0, CAST(nullif(l_partkey % 3, 0) AS INTEGER) AS width, CAST(nullif(l_partkey % 4, 0) AS INTEGER) AS height, CAST(nullif(l_partkey % 2, 0) AS INTEGER) AS xref FROM raw WHERE l_suppkey % 5 = 0 AND l_orderkey % 23 > 0""")
def extraction_images(spark, sf_dir):
    return P.fanned_out(nested_pages(spark, sf_dir))["images"].drop("y0", "x1", "y1")


@query(f"""WITH {_SPANS} SELECT job_id, page_number, CAST(row_number() OVER (PARTITION BY page_number ORDER BY k) - 1 AS INTEGER) AS drawing_index, CAST(l_partkey AS DOUBLE) AS y0, l_returnflag AS kind, l_tax AS stroke_width FROM raw WHERE l_suppkey % 4 = 0 AND l_orderkey % 23 > 0""")
def extraction_drawings(spark, sf_dir):
    return P.fanned_out(nested_pages(spark, sf_dir))["drawings"].drop("x0", "x1", "y1")


@query(f"""{_with('pages')}, old AS (SELECT job_id, page_number, min(char_count) AS char_count FROM pages GROUP BY ALL), new AS (SELECT job_id, page_number, char_count + 1 AS char_count FROM old WHERE char_count % 4 = 0)
SELECT o.job_id, o.page_number, coalesce(n.char_count, o.char_count) AS char_count FROM old o LEFT JOIN new n USING (job_id, page_number)""")
def extraction_resumed(spark, sf_dir):
    old = frame(spark, sf_dir, "pages").groupBy("job_id", "page_number").agg(F.min("char_count").alias("char_count"))
    return P.resumed(old, old.filter("char_count % 4 = 0").withColumn("char_count", F.col("char_count") + 1))


# --- indexing ---------------------------------------------------------------------------------------------------------

_UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + CAST(('0x' || substr(h, 17, 1)) AS INTEGER) % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"
_POINTS = f"""{_with('jobs', 'chunks', 'documents_of', 'fields')}, {_LATEST}, wide AS (SELECT document_id, max(value) FILTER (field = 'title') AS book_name, max(value) FILTER (field = 'author') AS author, max(value) FILTER (field = 'volume') AS volume, max(value) FILTER (field = 'publisher') AS publisher, max(value) FILTER (field = 'publication_year') AS year FROM fields GROUP BY 1),
meta AS (SELECT upload_id, w.* FROM latest l JOIN documents_of d ON d.job_id = l.id LEFT JOIN wide w ON w.document_id = d.id WHERE kind = 'metadata'),
points AS (SELECT {_UUID} AS point_id, * FROM (SELECT sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(chunk_id)) AS h, c.*, m.book_name, m.author, m.volume, m.publisher, m.year, m.upload_id FROM chunks c JOIN latest l ON l.id = c.job_id AND l.kind = 'chunking' JOIN meta m ON m.upload_id = l.upload_id))"""


def _points(spark, sf_dir):
    return I.payloads(*_frames(spark, sf_dir, "chunks", "jobs", "documents_of", "fields"))


@query(f"{_POINTS} SELECT point_id, chunk_id, raw_text AS text, book_id, book_name, author, volume, printed_page_start, printed_page_end, pdf_page_start, pdf_page_end, kitab, bab, fasl, topic, region, lang, edition_id, publisher, year, verified, upload_id, job_id FROM points")
def index_payload(spark, sf_dir):
    return _points(spark, sf_dir)


@query(f"""{_POINTS}, one AS (SELECT * FROM points QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY chunk_id DESC) = 1), old AS (SELECT point_id, upload_id, chunk_id FROM one WHERE printed_page_start % 2 = 0),
new AS (SELECT point_id, upload_id, 'new ' || chunk_id AS chunk_id FROM one WHERE printed_page_end % 3 = 0)
SELECT * FROM old WHERE upload_id NOT IN (SELECT upload_id FROM new) AND point_id NOT IN (SELECT point_id FROM new) UNION ALL SELECT * FROM new""")
def index_replaced(spark, sf_dir):
    one = R.latest(_points(spark, sf_dir), ["point_id"], [F.desc("chunk_id")])
    some = lambda c: one.filter(c).select("point_id", "upload_id", "chunk_id")
    return I.reindexed(some("printed_page_start % 2 = 0"), some("printed_page_end % 3 = 0").withColumn("chunk_id", F.concat(F.lit("new "), "chunk_id")))


@query(f"{_POINTS} SELECT point_id, chunk_id FROM points WHERE NOT coalesce(region = 'main' AND verified AND volume = '17', false)")
def index_deleted(spark, sf_dir):
    return I.deleted(_points(spark, sf_dir), region="main", verified=True, volume="17").select("point_id", "chunk_id")


@query(f"{_POINTS} SELECT DISTINCT point_id FROM points")
def index_point_ids(spark, sf_dir):
    return I.point_ids(_points(spark, sf_dir))


@query(f"""{_POINTS}, n AS (SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY point_id) AS i, count(*) OVER (PARTITION BY job_id) AS n FROM (SELECT DISTINCT job_id, point_id FROM points))
SELECT job_id, max(i) AS points, CAST(least(99, floor(max(i) / any_value(n) * 100)) AS INTEGER) AS percent FROM n GROUP BY job_id, (i - 1) // 2""")
def indexing_progress(spark, sf_dir):
    """How far each job was after every write of points, two at a time, by the table that was written."""
    points = _points(spark, sf_dir).select("job_id", "point_id").distinct()
    return I.written_progress(S.stored(I.in_writes(points, 2), "points"))


@query("""SELECT user_id, event_id AS id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS place FROM events WHERE value > 20""")
def open_sessions(spark, sf_dir):
    """Sessions of every user that weren't revoked: a small value stands for a revocation."""
    sessions = read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.when(F.col("value") <= 20, F.col("ts")).alias("revoked_at"))
    return J.open_sessions(sessions).select("user_id", "id", F.col("place").cast("int").alias("place"))


@query(f"""{_with('jobs')} SELECT id, CASE WHEN kind = 'layout' AND status = 'queued' THEN 'layout' ELSE status END AS status, CASE WHEN kind = 'layout' AND status = 'queued' THEN 'layout' ELSE current_step END AS current_step,
CAST(CASE WHEN kind = 'layout' AND status = 'queued' THEN 0 ELSE progress_percent END AS INTEGER) AS progress_percent FROM jobs""")
def stage_begun(spark, sf_dir):
    """All queued layout jobs as the stage begins with them, beside all other jobs."""
    jobs = frame(spark, sf_dir, "jobs")
    mine = (F.col("kind") == "layout") & (F.col("status") == "queued")
    begun = J.begun(jobs.filter(mine), "layout", F.to_timestamp(F.lit("2024-02-02 00:00:00")))
    columns = ["id", "status", "current_step", "progress_percent"]
    return begun.select(columns).unionByName(jobs.filter(~mine).select(columns))


@query("""WITH c AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS id FROM documents), p AS (SELECT DISTINCT CAST(doc_id * 2 AS VARCHAR) AS id FROM labels), u AS (SELECT id FROM c WHERE id NOT IN (SELECT id FROM p)),
d AS (SELECT trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
SELECT (SELECT count(*) FROM p) AS point_count, (SELECT count(*) FROM c) AS chunk_count, (SELECT count(*) FROM p WHERE id NOT IN (SELECT id FROM c)) AS orphan_points_count, (SELECT count(*) FROM u) AS never_indexed_count,
  (SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT id FROM u ORDER BY id LIMIT 100)) AS never_indexed, (SELECT count(*) FROM d) AS duplicates_count, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT * FROM d ORDER BY text LIMIT 100)) AS duplicate_rows""")
def index_health_report(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    chunks = docs.select(F.col("doc_id").cast("string").alias("chunk_id"))
    points = read(spark, sf_dir, "labels").select(T.uuid5_url((F.col("doc_id") * 2).cast("string")).alias("point_id")).distinct()
    out = I.health_report(chunks, points, R.index_health(chunks, points), R.repeated_texts(docs, T.one_space(F.col("text"))))
    rows = F.aggregate("duplicates", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    return out.select("point_count", "chunk_count", "orphan_points_count", "never_indexed_count", F.array_join("never_indexed", ",").alias("never_indexed"), "duplicates_count", rows.alias("duplicate_rows"))


# --- expansion and search ------------------------------------------------------------------------------------------

_TERMS = ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(X.SYNONYMS.items()))
_SEEDS = ", ".join(f"('{a}', '{b}', '{r}', {c})" for a, b, r, c in X.SEEDS)


@query(f"""{_with('asked')}, terms AS (SELECT * FROM (VALUES {_TERMS}) v(i, term, other)), edges AS (SELECT * FROM (VALUES {_SEEDS}) v(p, r, relation, confidence)),
ways AS (SELECT p AS term, r AS neighbour, relation, confidence FROM edges UNION ALL SELECT r, p, relation, confidence FROM edges WHERE p <> r),
w AS (SELECT q_id, canonical, unnest(string_split(canonical, ' ')) AS t FROM asked),
probes AS (SELECT q_id, canonical, t FROM w WHERE regexp_matches(t, '[؀-ۿ]') UNION SELECT q_id, canonical, substr(t, 3) FROM w WHERE starts_with(t, 'ال') AND len(t) > 3 UNION SELECT q_id, canonical, term FROM asked, terms WHERE contains(canonical, term)),
met AS (SELECT q_id, canonical, t, neighbour, relation, confidence FROM probes JOIN ways ON t = term QUALIFY row_number() OVER (PARTITION BY q_id, neighbour ORDER BY t, confidence DESC, relation) = 1),
kg AS (SELECT q_id, row_number() OVER (PARTITION BY q_id ORDER BY t, confidence DESC, neighbour, relation) AS n, regexp_replace(canonical, t, neighbour) AS text FROM met WHERE regexp_replace(canonical, t, neighbour) <> canonical),
every AS (SELECT q_id, 0 AS k, 0 AS n, original AS text FROM asked UNION ALL SELECT q_id, 1, 0, canonical FROM asked UNION ALL SELECT q_id, 2, i, regexp_replace(canonical, term, other) FROM asked, terms WHERE contains(canonical, term) UNION ALL SELECT q_id, 3, n, text FROM kg),
one AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY q_id, text ORDER BY k, n) = 1)
SELECT q_id, CAST(row_number() OVER (PARTITION BY q_id ORDER BY k, n) - 1 AS INTEGER) AS candidate, CASE k WHEN 0 THEN 'original' WHEN 1 THEN 'canonical' WHEN 2 THEN 'synonym' ELSE 'kg' END AS kind, text FROM one QUALIFY candidate < 5""")
def expand_candidates(spark, sf_dir):
    edges = spark.createDataFrame(X.SEEDS, S.SCHEMAS["term_relations"])
    return X.candidates(frame(spark, sf_dir, "asked"), edges)


_CANDIDATES = _POSTINGS.replace("q_tok AS (SELECT item_id AS q_id, unnest(regexp_extract_all(lower(text), '\\S+')) AS t FROM benchmark)", "q_str AS (SELECT item_id * 2 + c AS q_id, CASE WHEN c = 0 THEN text ELSE substr(text, 1, 100) END AS text FROM benchmark, (VALUES (0), (1)) v(c)),\nq_tok AS (SELECT q_id, unnest(regexp_extract_all(lower(text), '\\S+')) AS t FROM q_str)")


@query(f"""WITH {_CANDIDATES},{_SPARSE},{_DENSE},{_FUSED},
best AS (SELECT q_id // 2 AS item_id, doc_id, score, dense_score FROM fused QUALIFY row_number() OVER (PARTITION BY q_id // 2, doc_id ORDER BY score DESC, q_id) = 1),
merged AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM best QUALIFY rank <= 40),
sets AS (SELECT f.*, d.text, d.source, list_distinct(regexp_extract_all(lower(b.text), '\\S+')) AS q, list_distinct(regexp_extract_all(lower(d.text), '\\S+')) AS t FROM merged f JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id)),
reranked AS (SELECT *, round(greatest(coalesce(CAST(len(list_intersect(q, t)) AS DOUBLE) / len(list_distinct(list_concat(q, t))), 0), dense_score, 0), 9) AS rerank_score FROM sets),
once AS (SELECT *, row_number() OVER (PARTITION BY item_id, coalesce(source, '') || ':' || substr(text, 1, 200) ORDER BY rerank_score DESC, rank, doc_id) AS n FROM reranked WHERE rerank_score >= 0.05),
placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rerank_score DESC, rank, doc_id) AS place FROM once WHERE n = 1 QUALIFY place <= 8)
SELECT item_id AS q_id, CAST(place AS INTEGER) AS place, doc_id, rerank_score FROM placed""")
def multi_candidate_search(spark, sf_dir):
    q = questions(spark, sf_dir)
    strings = q.select("q_id", F.posexplode(F.array("text", F.substring("text", 1, 100))).alias("candidate", "text"))
    return X.multi_candidate_search(q, strings, read(spark, sf_dir, "documents"))


@query(f"{_with('asked')} SELECT q_id, canonical AS text, false AS translated, CAST(1 AS DOUBLE) AS confidence FROM asked")
def passthrough_translation(spark, sf_dir):
    return frame(spark, sf_dir, "asked").select("q_id", X.passthrough(F.col("canonical")).alias("t")).select("q_id", "t.text", "t.translated", "t.confidence")


_SEED_ROWS = _SEEDS.replace("0.9)", "CAST(0.9 AS DOUBLE))").replace("1.0)", "CAST(1 AS DOUBLE))").replace("0.8)", "CAST(0.8 AS DOUBLE))")


@query(f"""{_with('asked')}, old AS (SELECT DISTINCT string_split(canonical, ' ')[1] AS primary_term, string_split(canonical, ' ')[2] AS related_term, 'related' AS relation, CAST(0.5 AS DOUBLE) AS confidence FROM asked),
seeds AS (SELECT * FROM (VALUES {_SEED_ROWS}) v(primary_term, related_term, relation, confidence))
SELECT * FROM (SELECT * FROM old o WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.primary_term = o.primary_term AND s.related_term = o.related_term AND s.relation = o.relation) UNION ALL SELECT * FROM seeds) WHERE primary_term <> 'طلاق'""")
def edges_seeded(spark, sf_dir):
    """The seeds laid twice over the edges between neighbouring terms of all questions, and the edges of one term deleted."""
    words = F.split("canonical", " ")
    old = frame(spark, sf_dir, "asked").select(words[0].alias("primary_term"), words[1].alias("related_term"), F.lit("related").alias("relation"), F.lit(0.5).alias("confidence")).distinct()
    seeds = spark.createDataFrame(X.SEEDS, S.SCHEMAS["term_relations"])
    keys = ["primary_term", "related_term", "relation"]
    return R.upsert(R.upsert(old, seeds, keys), seeds, keys).filter("primary_term <> 'طلاق'")


# --- answers ------------------------------------------------------------------------------------------------------

_RANKED = f"""WITH {_POSTINGS},{_SPARSE},{_DENSE},{_FUSED},
ranked AS (SELECT q_id, rank, CAST(doc_id AS VARCHAR) AS chunk_id, text, source AS book_name, CASE WHEN doc_id % 5 > 0 THEN CAST(doc_id % 5 AS VARCHAR) END AS volume, CAST(doc_id % 300 AS INTEGER) AS page, lang AS topic, CASE WHEN doc_id % 3 = 0 THEN 'Kitab: a' || chr(10) || 'Topic : b' || chr(10) ELSE '' END || text AS own FROM fused JOIN documents USING (doc_id) WHERE rank <= 7)"""
_STOP = ", ".join(f"'{w}'" for w in A.STOPWORDS)
_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


def evidence(spark, sf_dir) -> DataFrame:
    """The fused hits of all questions as evidence; every third text begins with lines that name where it stands."""
    d = read(spark, sf_dir, "documents")
    head = F.when(F.col("doc_id") % 3 == 0, "Kitab: a\nTopic : b\n").otherwise("")
    chunks = rrf_fuse(spark, sf_dir).filter(F.col("rank") <= G.MOST_CHUNKS).join(d, "doc_id").select(
        "q_id", "rank", F.col("doc_id").cast("string").alias("chunk_id"), F.concat(head, "text").alias("text"), F.col("source").alias("book_name"), F.when(F.col("doc_id") % 5 > 0, (F.col("doc_id") % 5).cast("string")).alias("volume"),
        (F.col("doc_id") % 300).cast("int").alias("printed_page_start"), F.col("lang").alias("topic"), F.lit("").alias("kitab"), F.lit(None).cast("string").alias("bab"), F.lit("main").alias("region"), (F.col("doc_id") % 2 == 0).alias("verified"), (F.col("score") * 30).alias("rerank_score"),
    )
    q = questions(spark, sf_dir).select("q_id", F.col("text").alias("query"), F.lit("en").alias("language"), (F.col("q_id") % 2 == 0).alias("translated"), (F.col("q_id") % 4 > 0).alias("evidence_sufficient"))
    # What answers are made of is read many times by their plans, and is a few rows for each question.
    return S.stored(q.join(G.gathered(chunks), "q_id"), "evidence")


_LABEL = "concat_ws(', ', nullif(book_name, ''), 'vol. ' || volume, 'p. ' || page)"


@query(f"""{_RANKED}, body AS (SELECT *, {_STRIP.format("regexp_replace(text, '\\s+', ' ', 'g')")} AS body FROM ranked WHERE rank <= 2),
s AS (SELECT r.*, list_distinct(regexp_extract_all(lower(b.text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')) AS q, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS i FROM (SELECT *, list_filter(list_transform(string_split(regexp_replace(body, '([।.?؟])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS parts FROM body) r JOIN benchmark b ON item_id = q_id),
best AS (SELECT q_id, rank, sentence FROM (SELECT *, len(list_filter(regexp_extract_all(lower(sentence), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda w: list_contains(q, w) AND NOT list_contains([{_STOP}], w))) AS hits FROM s) QUALIFY row_number() OVER (PARTITION BY q_id, rank ORDER BY hits DESC, i) = 1),
two AS (SELECT q_id, max(sentence) FILTER (rank = 1) AS one, max(sentence) FILTER (rank = 2) AS two FROM best GROUP BY 1),
cut AS (SELECT q_id, CASE WHEN len(one) <= 280 THEN one ELSE rtrim(substr(one, 1, 280)) || '…' END AS one, CASE WHEN two <> one THEN CASE WHEN len(two) <= 200 THEN two ELSE rtrim(substr(two, 1, 200)) || '…' END END AS two FROM two)
SELECT q_id, '<p><b>Answer:</b> ' || concat_ws(' ', one, two) || '</p>' || chr(10) || '<p>Source: <cite>' || {_LABEL} || '</cite></p>' AS html FROM cut JOIN ranked USING (q_id) WHERE rank = 1""")
def synthesized_answer(spark, sf_dir):
    return G.synthesised(evidence(spark, sf_dir).filter("query IS NOT NULL")).select("q_id", "html")


@query(f"""{_RANKED}, c AS (SELECT q_id, rank, {_STRIP.format('own')} AS t FROM ranked WHERE rank <= 2), x AS (SELECT q_id, string_agg('<p><i>' || CASE WHEN len(t) <= 300 THEN t ELSE rtrim(substr(t, 1, 300), ' ' || chr(9) || chr(10)) || '…' END || '</i></p>', chr(10) ORDER BY rank) AS listed FROM c WHERE t <> '' GROUP BY 1)
SELECT q_id, '<p>Not enough evidence was found in the available corpus to answer this question. You may rephrase the question or narrow its scope.</p>' || chr(10) || '<p><b>Closest evidence found:</b></p>' || chr(10) || listed AS html, 'insufficient_evidence' AS refusal_reason FROM x""")
def refusal_answer(spark, sf_dir):
    return G.refused(evidence(spark, sf_dir), F.lit("insufficient_evidence")).select("q_id", "html", "refusal_reason")


@query(f"""{_RANKED} SELECT q_id, rank AS place, chunk_id, known, CASE WHEN known THEN book_name END AS book, CASE WHEN known THEN volume END AS volume, CASE WHEN known THEN CAST(page AS VARCHAR) END AS page, CASE WHEN known THEN topic END AS chapter
FROM (SELECT *, rank % 3 > 0 AS known FROM (SELECT * REPLACE (CASE WHEN rank % 3 > 0 THEN chunk_id ELSE 'x' || chunk_id END AS chunk_id, CAST(rank AS INTEGER) AS rank) FROM ranked))""")
def citation_rebuild(spark, sf_dir):
    """Citations of known and of unknown chunks, rebuilt from what is known."""
    chunks = evidence(spark, sf_dir).select("q_id", F.explode("chunks").alias("c")).select("q_id", "c.*")
    named = chunks.select("q_id", F.col("rank").alias("place"), F.when(F.col("rank") % 3 > 0, F.col("chunk_id")).otherwise(F.concat(F.lit("x"), "chunk_id")).alias("chunk_id"))
    return G.rebuilt_citations(named, chunks)


@query(f"""{_RANKED} SELECT q_id, 'Q: ' || any_value(b.text) || ' (en)' || chr(10) || string_agg('[EVIDENCE_' || rank || ']' || chr(10) || 'SOURCE: ' || coalesce(nullif(book_name, ''), 'Unknown Book') || ', vol ' || coalesce(volume, '?') || ', p. ' || CASE WHEN page = 0 THEN '?' ELSE CAST(page AS VARCHAR) END || ' (chunk ' || chunk_id || ')' || chr(10) || 'TOPIC: ' || coalesce(topic, 'General') || chr(10) || 'CONTENT:' || chr(10) || own || chr(10) || '[/EVIDENCE_' || rank || ']' || chr(10) || chr(10), '' ORDER BY rank) AS prompt
FROM ranked JOIN benchmark b ON item_id = q_id GROUP BY 1""")
def evidence_prompt(spark, sf_dir):
    return G.prompts(evidence(spark, sf_dir), "Q: {query} ({language})\n{evidence}")


@query()
def chat_answers(spark, sf_dir):
    """Synthesised answers and refusals of all questions, by whether their evidence suffices."""
    return G.answers(evidence(spark, sf_dir)).select("q_id", "branch", "html", F.to_json("quotes").alias("quotes"), F.to_json("citations").alias("citations"), "confidence.level", "confidence.score", "confidence.rationale", "refusal_reason", F.to_json("related").alias("related"))


@query()
def chat_events(spark, sf_dir):
    """The framed events of all answers."""
    rows = evidence(spark, sf_dir)
    return G.event_stream(G.answers(rows), rows)


@query("""WITH k AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations)
SELECT conv_id, turn, 'embedding:v1:1024:' || sha256(t) AS embedding_key, 'chunk:v1:' || sha256('[' || CAST(to_json(t) AS VARCHAR) || ', ' || CASE WHEN turn % 2 = 0 THEN '"b' || conv_id || '"' ELSE 'null' END || ', null, "main", true, 8]') AS chunk_key,
  'qa:v1:' || sha256('[' || CAST(to_json(t) AS VARCHAR) || ', ' || CASE WHEN turn % 2 = 0 THEN '"b' || conv_id || '"' ELSE 'null' END || ', null, "main", true, 8, "en"]') AS qa_key FROM k""")
def cache_keys(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    scope = [(t, "string"), (F.when(F.col("turn") % 2 == 0, F.concat(F.lit("b"), F.col("conv_id").cast("string"))), "string"), (F.lit(None).cast("string"), "string"), (F.lit("main"), "string"), (F.lit(True), "boolean"), (F.lit(8), "number")]
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", G.embedding_key(t, 1024).alias("embedding_key"), G.cache_key("chunk", scope).alias("chunk_key"), G.cache_key("qa", [*scope, (F.lit("en"), "string")]).alias("qa_key"))


@query("""WITH a AS (SELECT conv_id % 50 AS key FROM conversations), c AS (SELECT DISTINCT conv_id % 50 AS key FROM conversations WHERE conv_id % 3 = 0 AND conv_id % 50 % 2 = 0)
SELECT CAST(a.key AS VARCHAR) AS key, CASE WHEN c.key IS NULL THEN 'made ' ELSE 'kept ' END || a.key AS value, c.key IS NOT NULL AS hit FROM a LEFT JOIN c ON a.key = c.key""")
def cache_got_or_set(spark, sf_dir):
    conv = read(spark, sf_dir, "conversations").withColumn("key", (F.col("conv_id") % 50).cast("string"))
    times = [F.to_timestamp(F.lit(f"2024-01-0{d} 00:00:00")) for d in (1, 2, 3)]
    live = conv.filter("conv_id % 3 = 0 AND conv_id % 50 % 2 = 0").select("key").distinct().select("key", F.concat(F.lit("kept "), "key").alias("value"), times[2].alias("expires_at"))
    dead = conv.select("key").distinct().select("key", F.lit("old").alias("value"), times[0].alias("expires_at"))
    return S.got_or_set(conv.select("key"), live.union(dead), lambda misses: misses.select("key", F.concat(F.lit("made "), "key").alias("value")), times[1])[0]


@query("""SELECT conv_id, turn, coalesce(text, '') AS query, 'answer ' || turn AS html, turn AS n FROM conversations WHERE turn % 3 <> 1 AND conv_id % 5 <> 0""")
def cached_turns(spark, sf_dir):
    """Turns written as cache values and read back; some entries are cut off, some hold something else."""
    conv = read(spark, sf_dir, "conversations").withColumn("key", F.concat_ws("/", "conv_id", "turn"))
    t = F.coalesce("text", F.lit(""))
    none = F.lit(None).cast("string")
    chunks = F.array(F.struct(F.lit("c").alias("chunk_id"), t.alias("text"), none.alias("book_name"), none.alias("volume"), F.col("turn").cast("int").alias("printed_page_start"), F.lit(0.5).alias("rerank_score")))
    retrieval = F.struct(t.alias("query"), t.alias("canonical"), F.lit("en").alias("language"), F.lit(False).alias("translated"), F.array(t).alias("candidates"), F.lit(True).alias("evidence_sufficient"), chunks.alias("chunks"))
    value = G.cache_value(retrieval, F.struct(F.lit("en").alias("answer_language"), F.concat(F.lit("answer "), F.col("turn").cast("string")).alias("html"), none.alias("refusal_reason")))
    broken = F.when(F.col("turn") % 3 == 1, F.substring(value, F.lit(1), F.length(value) - 9)).when(F.col("conv_id") % 5 == 0, '{"other": 1}').otherwise(value)
    back = G.cached_turns(conv.select("key", broken.alias("value")))
    key = F.split("key", "/")
    return back.select(key[0].cast("long").alias("conv_id"), key[1].cast("long").alias("turn"), "retrieval.query", "answer.html", F.col("retrieval.chunks")[0]["printed_page_start"].cast("long").alias("n"))


@query(f"{_with('jobs')} SELECT id, status FROM jobs WHERE kind = 'chunking' ORDER BY started_at DESC, id DESC LIMIT 10")
def latest_runs(spark, sf_dir):
    return J.latest_runs(frame(spark, sf_dir, "jobs").filter("kind = 'chunking'")).select("id", "status")


# --- evaluation runs ----------------------------------------------------------------------------------------------

@query(f"""{_with('citations', 'books', 'editions', 'volumes', 'chunks')}, b AS (SELECT c.*, CASE WHEN c.book_id IS NOT NULL THEN (SELECT id FROM books WHERE id = c.book_id) ELSE (SELECT min(id) FROM books WHERE title ILIKE '%' || c.book || '%') END AS own FROM citations c),
n AS (SELECT *, coalesce(TRY_CAST(trim(volume) AS INTEGER), 0) AS number FROM b WHERE own IS NOT NULL),
v AS (SELECT n.*, CASE WHEN volume IS NOT NULL THEN (SELECT min(v.id) FROM volumes v JOIN editions e ON e.id = v.edition_id WHERE e.book_id = own AND volume_number = number) END AS vol FROM n)
SELECT DISTINCT item_id, chunk_id FROM v JOIN chunks c ON c.book_id = own WHERE (volume IS NULL OR vol = c.volume_id) AND (page IS NULL OR page BETWEEN printed_page_start AND printed_page_end)""")
def gold_resolution(spark, sf_dir):
    return N.resolved(*_frames(spark, sf_dir, "citations", "books", "editions", "volumes", "chunks"))


@query(f"{_with('citations', 'books')} SELECT DISTINCT book AS title FROM citations WHERE book NOT IN (SELECT title FROM books)")
def gold_books_missing(spark, sf_dir):
    return N.missing_books(*_frames(spark, sf_dir, "citations", "books"))


_MEASURES = f"""{_with('replays')}, agg AS (SELECT run_id, avg(recall_5) AS recall_5, avg(recall_10) AS recall_10, avg(recall_20) AS recall_20, avg(mrr) AS mrr, avg(ndcg_10) AS ndcg_10, avg(citation_accuracy) AS citation_accuracy, avg(groundedness) AS groundedness, avg(hallucination_rate) AS hallucination_rate, avg(answer_accuracy) AS answer_accuracy,
  count(*) FILTER (expect_refusal AND refusal_given) / count(*) FILTER (refusal_given) AS refusal_precision, count(*) FILTER (expect_refusal AND refusal_given) / count(*) FILTER (expect_refusal) AS refusal_recall, median(latency_ms) AS latency_p50,
  list_sort(list(latency_ms) FILTER (latency_ms IS NOT NULL))[1 + least(count(latency_ms) - 1, CAST(floor(count(latency_ms) * CAST(0.95 AS DOUBLE)) AS BIGINT))] AS latency_p95 FROM replays GROUP BY 1),
measures AS (SELECT run_id, metric, round(actual, 6) AS actual FROM (UNPIVOT agg ON COLUMNS(* EXCLUDE run_id) INTO NAME metric VALUE actual))"""


@query(f"{_MEASURES} SELECT * FROM measures")
def eval_run_measures(spark, sf_dir):
    return N.run_measures(frame(spark, sf_dir, "replays")).withColumn("actual", F.round("actual", 6))


@query(f"""{_MEASURES}, t AS (SELECT * FROM (VALUES ('recall_10', 0.49), ('groundedness', 0.5), ('hallucination_rate', 0.05), ('unknown', 0.1)) v(metric, threshold)), w AS (SELECT run_id, t.metric, threshold, actual FROM (SELECT DISTINCT run_id FROM measures) CROSS JOIN t LEFT JOIN measures USING (run_id, metric))
SELECT run_id, CASE WHEN bool_or(actual IS NULL OR CASE WHEN metric = 'hallucination_rate' THEN actual > threshold ELSE actual < threshold END) THEN 'failed' ELSE 'passed' END AS status, count(*) FILTER (actual IS NULL OR CASE WHEN metric = 'hallucination_rate' THEN actual > threshold ELSE actual < threshold END) AS n FROM w GROUP BY 1""")
def eval_run_verdicts(spark, sf_dir):
    measures = eval_run_measures(spark, sf_dir)
    return N.verdicts(measures, {"recall_10": 0.49, "groundedness": 0.5, "hallucination_rate": 0.05, "unknown": 0.1}).select("run_id", "status", F.size("violations").cast("long").alias("n"))


@query("""SELECT r.l_orderkey AS a_id, r.l_linenumber AS rank, CAST(r.l_partkey AS VARCHAR) AS chunk_id FROM lineitem r WHERE EXISTS (SELECT 1 FROM lineitem c WHERE c.l_orderkey = r.l_orderkey AND c.l_partkey = r.l_partkey AND c.l_suppkey % 2 = 0)""")
def cited_texts(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("a_id"), F.col("l_linenumber").alias("rank"), F.col("l_partkey").cast("string").alias("chunk_id"), "l_suppkey")
    return N.cited_texts(l.select("a_id", "rank", "chunk_id"), l.filter("l_suppkey % 2 = 0").select("a_id", "chunk_id")).select("a_id", "rank", "chunk_id")


# --- sinks and state ----------------------------------------------------------------------------------------------

@query(f"{_with('chunks')}, new AS (SELECT * REPLACE ('new ' || raw_text AS raw_text) FROM chunks WHERE job_id IN ('j3', 'j4') AND verified) SELECT chunk_id, job_id, raw_text FROM chunks WHERE job_id NOT IN (SELECT job_id FROM new) UNION ALL SELECT chunk_id, job_id, raw_text FROM new")
def chunks_replaced(spark, sf_dir):
    """What a sink that replaces a job's chunks leaves behind."""
    chunks = frame(spark, sf_dir, "chunks").select("chunk_id", "job_id", "raw_text", "verified")
    new = chunks.filter("job_id IN ('j3', 'j4') AND verified").withColumn("raw_text", F.concat(F.lit("new "), "raw_text"))
    return S.without(chunks, new, "job_id").select(*chunks.columns).unionByName(new).drop("verified")


@query(f"{_with('jobs', 'pages', 'errors')}, gone AS (SELECT id FROM jobs WHERE status = 'failed') SELECT 'pages' AS name, count(*) AS n FROM pages WHERE job_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'errors', count(*) FROM errors WHERE job_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'jobs', count(*) FROM jobs WHERE id NOT IN (SELECT id FROM gone)")
def jobs_deleted(spark, sf_dir):
    """Rows left in each table once failed jobs are deleted with all that hangs on them."""
    jobs, pages, errors = _frames(spark, sf_dir, "jobs", "pages", "errors")
    left = S.cascade({"pages": (pages, "job_id"), "errors": (errors, "job_id"), "jobs": (jobs, "id")}, jobs.filter("status = 'failed'"), "id")
    parts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""{_with('blocks')}, one AS (SELECT job_id, page_number, block_index, min(region) AS region, CAST(min(reading_order) AS BIGINT) AS reading_order FROM blocks GROUP BY ALL)
SELECT job_id, page_number, block_index, CASE WHEN block_index % 2 = 0 THEN 'margin' ELSE region END AS region, CASE WHEN block_index % 2 = 0 THEN reading_order + 1 ELSE reading_order END AS reading_order FROM one""")
def layout_written_back(spark, sf_dir):
    keys = ["job_id", "page_number", "block_index"]
    one = frame(spark, sf_dir, "blocks").groupBy(*keys).agg(F.min("region").alias("region"), F.min("reading_order").alias("reading_order"))
    news = one.filter("block_index % 2 = 0").withColumn("region", F.lit("margin")).withColumn("reading_order", F.col("reading_order") + 1)
    return S.updated(one, news, keys, ["region", "reading_order"])


_LINED = "lined AS (SELECT event_type, event_id, epoch_us(ts) AS t, value > 30 AS ok, CAST(floor(value) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events)"


@query(f"""WITH RECURSIVE {_LINED}, fold AS (SELECT event_type, i, event_id, CASE WHEN ok THEN 0 ELSE 1 END AS failures, CAST(NULL AS BIGINT) AS opened, true AS allowed FROM lined WHERE i = 1 UNION ALL
SELECT l.event_type, l.i, l.event_id, CASE WHEN f.opened IS NOT NULL AND l.t - f.opened <= 300000000 THEN f.failures WHEN l.ok THEN 0 ELSE f.failures + 1 END, CASE WHEN f.opened IS NOT NULL AND l.t - f.opened <= 300000000 THEN f.opened WHEN l.ok THEN NULL WHEN f.opened IS NOT NULL OR f.failures + 1 >= 3 THEN l.t END,
  NOT (f.opened IS NOT NULL AND l.t - f.opened <= 300000000) FROM fold f JOIN lined l ON l.event_type = f.event_type AND l.i = f.i + 1)
SELECT event_type, event_id, allowed, CASE WHEN opened IS NULL THEN 'closed' ELSE 'open' END AS state FROM fold""")
def circuit_breaker_fold(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_type", "ts", (F.col("value") > 30).alias("ok"), "event_id")
    return L.breaker_states(events, "event_type", "ts", "ok", "event_id").drop("at")


@query(f"""WITH RECURSIVE {_LINED}, fold AS (SELECT event_type, i, event_id, t AS minute_at, t AS day_at, CAST(1 AS BIGINT) AS mr, coalesce(tokens, 0) AS mt, CAST(1 AS BIGINT) AS dr, coalesce(tokens, 0) AS dt FROM lined WHERE i = 1 UNION ALL
SELECT l.event_type, l.i, l.event_id, CASE WHEN l.t - day_at >= 86400000000 OR l.t - minute_at >= 60000000 THEN l.t ELSE minute_at END, CASE WHEN l.t - day_at >= 86400000000 THEN l.t ELSE day_at END, CASE WHEN l.t - day_at >= 86400000000 OR l.t - minute_at >= 60000000 THEN 1 ELSE mr + 1 END,
  coalesce(l.tokens, 0) + CASE WHEN l.t - day_at >= 86400000000 OR l.t - minute_at >= 60000000 THEN 0 ELSE mt END, CASE WHEN l.t - day_at >= 86400000000 THEN 1 ELSE dr + 1 END, coalesce(l.tokens, 0) + CASE WHEN l.t - day_at >= 86400000000 THEN 0 ELSE dt END FROM fold f JOIN lined l ON l.event_type = f.event_type AND l.i = f.i + 1)
SELECT event_type, event_id, mr AS minute_requests, CAST(mt AS BIGINT) AS minute_tokens, dr AS day_requests, CAST(dt AS BIGINT) AS day_tokens, mr > 2 OR mt > 60 OR dr > 300 OR dt > 6000 AS exceeded FROM fold""")
def quota_counters(spark, sf_dir):
    events = read(spark, sf_dir, "events").withColumn("tokens", F.floor("value"))
    return L.quota_states(events, "event_type", "ts", "tokens", "event_id", {"requests_per_minute": 2, "tokens_per_minute": 60, "requests_per_day": 300, "tokens_per_day": 6000})
