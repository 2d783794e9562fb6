"""Jobs and their stages: what runs, what a stage may begin with, how a job moves on, and what is told of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import tasks
from .relational import latest
from .temporal import micros, ranged, running_totals

# Statuses, kinds of jobs that only analyse what a pipeline job extracted, and the errors that are told.
STATUSES = (
    "uploaded", "queued", "processing", "sanitizing", "extracting", "ocr", "ocr_correcting", "structuring", "chunking", "embedding", "completed", "indexed", "failed",
)
ENDED, ANALYSES = ("indexed", "completed", "failed"), ("layout", "metadata", "chunking", "indexing")
IN_FLIGHT = STATUSES[:10]
TOLD_ERRORS, RETRIES, FIRST_WAIT, LONGEST_WAIT = 5, 3, 10, 120
BACKOFF = 0.5
_TOLD = ("status", "current_step", "progress_percent", "error_message", "started_at", "finished_at", "created_at", "updated_at")


def active(jobs: DataFrame, limit: int = 50) -> DataFrame:
    """Jobs that are neither indexed nor failed, the newest first; ``completed`` ones count as active."""
    return jobs.filter(~F.col("status").isin("indexed", "failed")).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def in_flight(jobs: DataFrame) -> DataFrame:
    """Queued and running jobs, with their ``place`` in their upload, the newest first."""
    return latest(jobs.filter(F.col("status").isin(*IN_FLIGHT)), ["upload_id"], [F.desc("created_at"), F.desc("id")], 1 << 30)


def pipeline_jobs(jobs: DataFrame) -> DataFrame:
    """Each upload's latest job that extracts; a job without a kind is none."""
    return latest(jobs.filter(~F.col("kind").isin(*ANALYSES)), ["upload_id"], [F.desc("created_at"), F.desc("id")]).drop("place")


def refusals(uploads: DataFrame, jobs: DataFrame, documents: DataFrame, chunks: DataFrame, kinds: tuple[str, ...] = ANALYSES) -> DataFrame:
    """(upload_id, stage, refusal) of every upload and stage: why the stage can't begin, null if it can.

    A stage that runs isn't begun again. Layout and metadata need a completed extraction, chunking a metadata document
    too, and indexing a chunk. An upload's latest jobs of all kinds are found at once; tables are dealt out by their numbers of rows.
    """
    spark = uploads.sparkSession
    known = tuple(dict.fromkeys((*kinds, "metadata", "chunking")))
    n = tasks(spark, max(jobs.count(), uploads.count()))
    newest = lambda which: F.max(F.when(which, F.struct("created_at", "id", "status")))
    latest_of = [newest(F.col("kind") == k).alias(k) for k in known]
    held = jobs.repartition(n, "upload_id").groupBy("upload_id").agg(*latest_of, newest(~F.col("kind").isin(*ANALYSES)).alias("_pipeline"))
    needs = {"metadata": documents, "chunking": chunks}
    wanted = held.select("upload_id", F.explode(F.array(*[F.struct(F.lit(k).alias("need"), F.col(k)["id"].alias("job_id")) for k in needs])).alias("w")).select("upload_id", "w.*").filter("job_id IS NOT NULL")
    there = documents.select(F.lit("metadata").alias("need"), "job_id").union(chunks.select(F.lit("chunking").alias("need"), "job_id"))
    m = tasks(spark, documents.count() + chunks.count())
    met = wanted.repartition(m, "need", "job_id").join(there.repartition(m, "need", "job_id"), ["need", "job_id"], "left_semi")
    found = met.repartition(n, "upload_id").groupBy("upload_id").agg(*[F.max(F.col("need") == k).alias(f"_has_{k}") for k in needs])
    rows = uploads.select(F.col("id").alias("upload_id")).repartition(n, "upload_id").join(held, "upload_id", "left").join(found, "upload_id", "left")
    lacks = lambda c: ~F.coalesce(c, F.lit(False))

    def refusal(kind: str) -> Column:
        out = F.when(F.col(kind)["status"].isin(*IN_FLIGHT), "already running")
        if kind in ("layout", "metadata", "chunking"):
            out = out.when(lacks(F.col("_pipeline")["status"] == "completed"), "no completed extraction")
        if kind == "chunking":
            out = out.when(lacks(F.col("_has_metadata")), "no metadata document")
        if kind == "indexing":
            out = out.when(lacks(F.col("_has_chunking")), "no chunks")
        return out

    return rows.select("upload_id", F.explode(F.array(*[F.struct(F.lit(k).alias("stage"), refusal(k).alias("refusal")) for k in kinds])).alias("r")).select("upload_id", "r.*")


def refusals_to_start(uploads: DataFrame, jobs: DataFrame, documents: DataFrame, chunks: DataFrame, kind: str) -> DataFrame:
    """(upload_id, refusal) of every upload for one stage."""
    return refusals(uploads, jobs, documents, chunks, (kind,)).drop("stage")


def begun(jobs: DataFrame, status: str, now: Column) -> DataFrame:
    """Jobs as a stage begins with them: its status as the step, no progress, and the time."""
    return jobs.withColumns({"status": F.lit(status), "current_step": F.lit(status), "progress_percent": F.lit(0), "error_message": F.lit(None).cast("string"), "started_at": now, "finished_at": F.lit(None).cast("timestamp")})


def moved(jobs: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Jobs after status changes (id, status and maybe null progress_percent, current_step, error_message): what is null stays,
    an end sets the time, and a status that isn't known changes nothing."""
    names = ("progress_percent", "current_step", "error_message")
    met = jobs.join(changes.filter(F.col("status").isin(*STATUSES)).select("id", F.struct("status", *names).alias("_c")), "id", "left")
    for c in names:
        met = met.withColumn(c, F.coalesce(F.col(f"_c.{c}"), F.col(c)))
    ended = F.col("_c.status").isin(*ENDED)
    return met.withColumn("finished_at", F.when(ended, now).otherwise(F.col("finished_at"))).withColumn("status", F.coalesce("_c.status", "status")).drop("_c").select(*jobs.columns)


def queued(jobs: DataFrame) -> DataFrame:
    """Jobs that were only uploaded are queued; others stay as they are."""
    return jobs.withColumn("status", F.when(F.col("status") == "uploaded", "queued").otherwise(F.col("status")))


def siblings_failed(jobs: DataFrame, failures: DataFrame, now: Column) -> DataFrame:
    """Jobs after failures (upload_id, message): all queued or running jobs of these uploads fail with the message."""
    why = failures.groupBy("upload_id").agg(F.min(F.col("message")).alias("_why"))
    met = jobs.join(why, "upload_id", "left").withColumn("_hit", F.col("_why").isNotNull() & F.col("status").isin(*IN_FLIGHT))
    new = {"status": F.lit("failed"), "error_message": F.col("_why"), "finished_at": now}
    return met.withColumns({c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in new.items()}).drop("_why", "_hit").select(*jobs.columns)


def retries(attempts: DataFrame) -> DataFrame:
    """``attempts`` (job_id, attempt from 0, failed) with ``retry`` and ``wait`` in seconds, doubled each time up to a bound."""
    again = F.col("failed") & (F.col("attempt") < RETRIES)
    return attempts.withColumn("retry", again).withColumn("wait", F.when(again, F.least(F.lit(float(FIRST_WAIT)) * F.pow(F.lit(2.0), F.col("attempt")), F.lit(float(LONGEST_WAIT))).cast("int")))


def attempts(events: DataFrame, job: str, at: str, order: str, failed: str) -> DataFrame:
    """``events`` with ``attempt``: how many failures in a row came before it since the job's last success, by time, ties by ``order``."""
    cut = ranged(events.withColumn("_at", micros(events, at)), "_at")
    in_runs = running_totals(cut, [job], ["_at", order], {"_run": F.when(F.col(failed), 0).otherwise(1).cast("long")})
    counted = running_totals(in_runs, [job, "_run"], ["_at", order], {"_failures": F.when(F.col(failed), 1).otherwise(0).cast("long")})
    return counted.withColumn("attempt", F.greatest(F.lit(0).cast("long"), F.col("_failures") - 1)).drop("_at", "_range", "_run", "_failures")


def last_errors(errors: DataFrame, n: int = TOLD_ERRORS) -> DataFrame:
    """(job_id, errors): the newest errors of each job, newest first."""
    few = latest(errors, ["job_id"], [F.desc("created_at"), F.desc("id")], n)
    one = F.struct("place", "step", "message", "details", "created_at")
    return few.groupBy("job_id").agg(F.array_sort(F.collect_list(one)).alias("errors"))


def _told(jobs: DataFrame, kinds: Column, uploads: DataFrame, errors: DataFrame) -> DataFrame:
    """Jobs with what every status tells: their state, their upload's pages and their last errors."""
    rows = jobs.filter(kinds).select(F.col("id").alias("job_id"), "upload_id", *_TOLD)
    rows = rows.join(uploads.select(F.col("id").alias("upload_id"), F.nullif("page_count", F.lit(0)).alias("_pages")), "upload_id", "left")
    return rows.join(last_errors(errors), "job_id", "left").withColumn("errors", F.coalesce("errors", F.expr("cast(array() as array<struct<place:int,step:string,message:string,details:string,created_at:timestamp>>)")))


def extraction_summary(pages: DataFrame) -> DataFrame:
    """One row on the page rows of each job."""
    total = lambda c: F.sum(c).cast("long").alias(c)
    return pages.groupBy("job_id").agg(F.count("*").alias("pages"), *map(total, ("char_count", "block_count", "image_count", "drawing_count")), F.count_if("has_text").alias("text_pages"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"))


def extraction_status(jobs: DataFrame, uploads: DataFrame, errors: DataFrame, pages: DataFrame) -> DataFrame:
    rows = _told(jobs, ~F.col("kind").isin(*ANALYSES), uploads, errors).join(extraction_summary(pages), "job_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return rows.select("job_id", "upload_id", *_TOLD, F.coalesce("_pages", "pages", F.lit(0)).cast("long").alias("page_count"), F.coalesce("pages", F.lit(0)).alias("pages_extracted"),
                       (F.coalesce("text_pages", F.lit(0)) > 0).alias("has_text_layer"), F.bround(F.coalesce("confidence", F.lit(0.0)), 4).alias("extraction_confidence"), *map(n, ("char_count", "block_count", "image_count", "drawing_count")), "errors")


def region_counts(blocks: DataFrame) -> DataFrame:
    """(job_id, regions): how many blocks of each region a job has, as a map; blocks without a region aren't counted."""
    n = blocks.filter("region is not null").groupBy("job_id", "region").agg(F.count("*").alias("n"))
    return n.groupBy("job_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("region", "n")))).alias("region_counts"))


def layout_status(jobs: DataFrame, uploads: DataFrame, errors: DataFrame, pages: DataFrame, blocks: DataFrame) -> DataFrame:
    rows = _told(jobs, F.col("kind") == "layout", uploads, errors).join(extraction_summary(pages).select("job_id", "pages", "block_count"), "job_id", "left").join(region_counts(blocks), "job_id", "left")
    return rows.select("job_id", "upload_id", *_TOLD, F.coalesce("_pages", "pages", F.lit(0)).cast("long").alias("page_count"), F.coalesce("pages", F.lit(0)).alias("pages_processed"), F.coalesce("block_count", F.lit(0)).alias("block_count"),
                       F.coalesce("region_counts", F.expr("cast(map() as map<string,bigint>)")).alias("region_counts"), "errors")


def _children(rows: DataFrame, order: list[str], columns: list[str], name: str) -> DataFrame:
    """Each document's child rows as one array, in the order of some of their columns."""
    held = F.array_sort(F.collect_list(F.struct(*order, *[c for c in columns if c not in order])))
    return rows.groupBy("document_id").agg(held.alias(name))


def metadata_status(jobs: DataFrame, uploads: DataFrame, errors: DataFrame, documents: DataFrame, fields: DataFrame, pages: DataFrame, structures: DataFrame) -> DataFrame:
    own = documents.select(F.col("id").alias("document_id"), "job_id", F.col("page_count").alias("_own_pages"), "numbering_system", F.col("confidence").alias("_confidence"))
    rows = _told(jobs, F.col("kind") == "metadata", uploads, errors).join(own, "job_id", "left")
    for table, order, name in ((fields, ["field"], "fields"), (pages, ["pdf_page"], "page_mapping"), (structures, ["level", "page_start"], "structures")):
        rows = rows.join(_children(table, order, [c for c in table.columns if c != "document_id"], name), "document_id", "left")
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    return rows.select("job_id", "upload_id", *_TOLD, F.coalesce("_pages", "_own_pages", F.lit(0)).alias("page_count"), F.coalesce(F.nullif(size("page_mapping"), F.lit(0)), "_own_pages", F.lit(0)).alias("pages_mapped"),
                       size("fields").alias("fields_count"), size("structures").alias("structures_count"), F.coalesce("numbering_system", F.lit("none")).alias("numbering_system"),
                       F.bround(F.coalesce("_confidence", F.lit(0.0)), 4).alias("confidence"), "fields", "page_mapping", "structures", "errors")


def chunk_totals(chunks: DataFrame) -> DataFrame:
    """(job_id, chunks_count, pages_covered, tokens_count): pages are the distinct first and last ones of chunks."""
    pages = chunks.select("job_id", F.explode(F.array("pdf_page_start", "pdf_page_end")).alias("page")).groupBy("job_id").agg(F.count_distinct("page").alias("pages_covered"))
    return chunks.groupBy("job_id").agg(F.count("*").alias("chunks_count"), F.sum("token_count").cast("long").alias("tokens_count")).join(pages, "job_id")


def chunking_status(jobs: DataFrame, uploads: DataFrame, errors: DataFrame, chunks: DataFrame) -> DataFrame:
    rows = _told(jobs, F.col("kind") == "chunking", uploads, errors).join(chunk_totals(chunks), "job_id", "left")
    return rows.select("job_id", "upload_id", *_TOLD, F.coalesce("_pages", F.lit(0)).alias("page_count"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("chunks_count", "pages_covered", "tokens_count")], "errors")


def indexing_status(jobs: DataFrame, uploads: DataFrame, errors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks are those of the upload's latest chunking job; they count as indexed once the job is."""
    of = latest(jobs.filter(F.col("kind") == "chunking"), ["upload_id"], [F.desc("created_at"), F.desc("id")]).select("upload_id", F.col("id").alias("_chunking"))
    n = chunks.groupBy(F.col("job_id").alias("_chunking")).agg(F.count("*").alias("_n"))
    rows = _told(jobs, F.col("kind") == "indexing", uploads, errors).join(of.join(n, "_chunking").select("upload_id", "_n"), "upload_id", "left")
    count = F.coalesce("_n", F.lit(0))
    return rows.select("job_id", "upload_id", *_TOLD, F.coalesce("_pages", F.lit(0)).alias("page_count"), count.alias("chunks_count"), F.when(F.col("status") == "indexed", count).otherwise(0).alias("vectors_indexed"), "errors")


def upload_list(uploads: DataFrame, jobs: DataFrame, logs: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of uploads, the newest first, with their latest job and their log in order."""
    page = uploads.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)
    now = latest(jobs, ["upload_id"], [F.desc("created_at"), F.desc("id")]).select("upload_id", F.struct(F.col("id").alias("job_id"), "kind", "status").alias("latest_job"))
    log = logs.groupBy("upload_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "action", "details"))).alias("log"))
    rows = page.withColumnRenamed("id", "upload_id")
    return rows.join(now, "upload_id", "left").join(log, "upload_id", "left")


def run_status(violations: Column) -> Column:
    """The end of an evaluation run: ``failed`` with a violation, else ``passed``."""
    return F.when(F.size(violations) > 0, "failed").otherwise("passed")


def found_by(df: DataFrame, **keys) -> DataFrame:
    """The rows whose columns have the given values: a look-up by a key of one or several columns; a null finds rows without a
    value."""
    return df.filter(reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in keys.items()]))


def published(books: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    return books.filter(F.col("status") == "published").orderBy("title", "id").offset(offset).limit(limit)


def children_in_order(rows: DataFrame, key: str, value, order: list[str]) -> DataFrame:
    """The child rows of one parent in a total order, nulls last."""
    return rows.filter(F.col(key) == value).orderBy(*[F.col(c).asc_nulls_last() for c in order])


def open_sessions(sessions: DataFrame) -> DataFrame:
    """The sessions of each user that weren't revoked, with their ``place``, the newest first."""
    return latest(sessions.filter(F.col("revoked_at").isNull()), ["user_id"], [F.desc("created_at"), F.desc("id")], 1 << 30)


def latest_runs(runs: DataFrame, limit: int = 10) -> DataFrame:
    """The newest evaluation runs first."""
    return runs.orderBy(F.desc("started_at"), F.desc("id")).limit(limit)
