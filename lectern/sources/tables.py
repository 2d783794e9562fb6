"""Tables as sinks: rows that replace a key's, appended rows, deletions, updates, and intermediate tables written once."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows that a task sorts at once where a table is dealt out by its number of rows.
ROWS_EACH = 300_000
#: The tables that the operators read and write, as DDL.
SCHEMAS = {
    "uploads": "id string, filename string, sha256 string, size long, mime string, page_count int, status string, created_at timestamp",
    "ingestion_jobs": "id string, upload_id string, kind string, status string, current_step string, progress_percent int, error_message string, retries int, created_at timestamp, started_at timestamp, finished_at timestamp, updated_at timestamp",
    "ingestion_errors": "id string, job_id string, step string, message string, details string, created_at timestamp",
    "page_extractions": "job_id string, page_number int, width double, height double, rotation int, has_text boolean, char_count long, block_count int, image_count int, drawing_count int, confidence double, error_message string",
    "page_blocks": "job_id string, page_number int, block_index int, x0 double, y0 double, x1 double, y1 double, text string, font string, font_size double, span_count int, region string, reading_order int, region_confidence double",
    "page_spans": "job_id string, page_number int, block_index int, span_index int, text string, font string, font_size double, x0 double, y0 double, x1 double, y1 double, flags int",
    "page_images": "job_id string, page_number int, image_index int, x0 double, y0 double, x1 double, y1 double, width int, height int, xref int",
    "page_drawings": "job_id string, page_number int, drawing_index int, x0 double, y0 double, x1 double, y1 double, kind string, stroke_width double",
    "metadata_documents": "id string, job_id string, page_count int, numbering_system string, confidence double",
    "metadata_fields": "document_id string, field string, value string, confidence double, source string",
    "metadata_pages": "document_id string, pdf_page int, printed_page string, printed_page_numeric int, numbering_system string, page_number_uncertain boolean, confidence double, source string, kitab string, bab string, fasl string",
    "metadata_structures": "document_id string, level string, name string, page_start int, page_end int, confidence double, source string",
    "books": "id string, title string, author string, status string",
    "editions": "id string, book_id string, publisher string, edition_number int",
    "volumes": "id string, edition_id string, volume_number int",
    "chunks": "chunk_id string, job_id string, book_id string, edition_id string, volume_id string, page_start_id string, page_end_id string, printed_page_start int, printed_page_end int, pdf_page_start int, pdf_page_end int, kitab string, bab string, fasl string, topic string, context_heading string, order_index int, region string, lang string, raw_text string, normalized_text string, token_count int, verified boolean, needs_review boolean",
    "term_relations": "primary_term string, related_term string, relation string, confidence double",
    "chat_history": "question string, normalized_query string, answer_language string, answer string, sources string, confidence string, refusal string, created_at timestamp",
    "upload_logs": "upload_id string, action string, details string, created_at timestamp",
    "eval_runs": "id string, label string, git_sha string, gold_set_version string, status string, total_items int, started_at timestamp, completed_at timestamp",
    "eval_results": "run_id string, gold_item_id string, language string, question string, category string, difficulty string, expect_refusal boolean, refusal_given boolean, latency_ms double, error string",
    "users": "id string, email string, password_hash string, full_name string, is_active boolean, role_id string, created_at timestamp, updated_at timestamp",
    "sessions": "id string, user_id string, refresh_token_hash string, expires_at timestamp, revoked_at timestamp, ip_address string, user_agent string, created_at timestamp, updated_at timestamp",
    "pages": "id string, volume_id string, printed_page int, pdf_page int, arabic_char_count int, confidence double, page_number_uncertain boolean, status string",
    "cache": "key string, value string, expires_at timestamp",
}


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], StructType.fromDDL(SCHEMAS[name]))


@functools.cache
def _local_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="lectern-")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; only a local session may go without that setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        folder = _local_folder()
    return f"{folder.rstrip('/')}/lectern-{name}-{uuid.uuid4().hex}"


def tasks(spark: SparkSession, rows: int = 0) -> int:
    """Into how many partitions short rows are dealt that stand for much work: more than the cluster works on at once.

    With a number of ``rows``, none gets more than about ``ROWS_EACH``: by their bytes, which compress well, Spark lays too many together.
    """
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_EACH))


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once to the shared folder and read back.

    What several parts of a plan need is worked out once so, and no lost executor brings it back.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def write_for_key(df: DataFrame, path: str, key: str) -> None:
    """Rows of a table that is partitioned by a key replace all earlier ones of the keys that they have; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace_children(document: DataFrame, children: dict[str, DataFrame], path: str, key: str = "job_id") -> None:
    """One document of a key with its child tables, each replaced for that key: the children first, so that a document that
    is there has all of them."""
    for name, rows in children.items():
        write_for_key(rows, f"{path}/{name}", key)
    write_for_key(document, f"{path}/documents", key)


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows whose key isn't among those that are deleted; rows without a key stay."""
    return df.join(gone.select(key).distinct(), key, "left_anti")


def cascade(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """What is left of the tables, each with the name of its key column, once the rows of some keys are deleted."""
    keys = gone.select(F.col(key).alias("_gone")).distinct()
    return {name: df.join(keys, F.col(own) == F.col("_gone"), "left_anti") for name, (df, own) in tables.items()}


def updated(df: DataFrame, news: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``df`` with some columns taken from the rows of ``news`` with the same keys; other rows stay as they are."""
    found = news.select(*keys, F.struct(*columns).alias("_new"))
    joined = df.join(found, keys, "left")
    for c in columns:
        joined = joined.withColumn(c, F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)))
    return joined.drop("_new").select(*df.columns)


def got_or_set(asked: DataFrame, cache: DataFrame, compute, now: Column) -> tuple[DataFrame, DataFrame]:
    """(key, value, hit) of every row asked for (key and what ``compute`` needs), and the (key, value) that are new.

    Only distinct keys without a live entry are computed; equal keys get equal values. An entry without a value is none.
    """
    live = cache.filter((F.col("expires_at") > now) & F.col("value").isNotNull()).select("key", "value")
    known = asked.join(live, "key", "left")
    misses = known.filter("value IS NULL").drop("value").dropDuplicates(["key"])
    new = stored(compute(misses).select("key", "value"), "computed")
    found = known.join(new.withColumnRenamed("value", "_new"), "key", "left")
    return found.select("key", F.coalesce("value", "_new").alias("value"), F.col("value").isNotNull().alias("hit")), new
