"""What a vector index holds: a point for each chunk with its payload, replaced, deleted and listed as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import uuid5_url
from .relational import latest

# Fields of a document's metadata and the names that payloads have for them; points of one write.
FIELDS = {"title": "book_name", "author": "author", "volume": "volume", "edition": "edition", "publisher": "publisher", "publication_year": "year"}
BATCH, WIDTH, INDEXED = 100, 1024, ("book_id", "volume", "region", "verified", "upload_id")
PAYLOAD = (
    "chunk_id", "text", "book_id", "book_name", "author", "volume", "printed_page_start", "printed_page_end", "pdf_page_start", "pdf_page_end", "kitab", "bab", "fasl", "topic",
    "region", "lang", "edition_id", "publisher", "year", "verified", "upload_id", "job_id",
)


def latest_rows(jobs: DataFrame, rows: DataFrame, kind: str) -> DataFrame:
    """The rows (job_id, ...) of each upload's latest job of a kind, with the ``upload_id``; ties to the greater job id."""
    now = latest(jobs.filter(F.col("kind") == kind), ["upload_id"], [F.desc("created_at"), F.desc("id")]).select("upload_id", F.col("id").alias("job_id"))
    return rows.join(now, "job_id")


def document_fields(fields: DataFrame) -> DataFrame:
    """One row for each document with the fields that payloads know; of a field that is there twice the greater value."""
    wide = fields.groupBy("document_id").pivot("field", list(FIELDS)).agg(F.max("value"))
    return wide.select("document_id", *[F.col(f).alias(name) for f, name in FIELDS.items()])


def payloads(chunks: DataFrame, jobs: DataFrame, documents: DataFrame, fields: DataFrame) -> DataFrame:
    """(point_id, ``PAYLOAD``) of the chunks of each upload's latest chunking job, with the metadata of its latest document.

    Uploads without a metadata document have no points, as they can't be indexed yet. The edition is no part of a payload.
    """
    own = latest_rows(jobs, chunks, "chunking")
    meta = latest_rows(jobs, documents.select(F.col("id").alias("document_id"), "job_id"), "metadata").select("upload_id", "document_id")
    meta = meta.join(document_fields(fields), "document_id", "left").drop("document_id", "edition")
    rows = own.join(meta, "upload_id").withColumn("text", F.col("raw_text"))
    return rows.select(uuid5_url(F.col("chunk_id")).alias("point_id"), *PAYLOAD)


def matches(**conditions) -> Column:
    """Whether a point's payload has all the given values; what it lacks doesn't match."""
    return F.coalesce(reduce(lambda a, b: a & b, [F.col(k) == v for k, v in conditions.items()]), F.lit(False))


def upserted(points: DataFrame, new: DataFrame) -> DataFrame:
    """The points with the new ones in the place of those with their ids; of new ones with one id the greatest chunk id."""
    one = latest(new, ["point_id"], [F.desc("chunk_id")]).drop("place")
    return points.join(one.select("point_id"), "point_id", "left_anti").unionByName(one)


def deleted(points: DataFrame, **conditions) -> DataFrame:
    if not conditions:
        raise ValueError("a deletion needs a condition")
    return points.filter(~matches(**conditions))


def reindexed(points: DataFrame, new: DataFrame) -> DataFrame:
    """All points of the uploads that the new ones are of replaced by them; doing it again changes nothing."""
    return upserted(points.join(new.select("upload_id").distinct(), "upload_id", "left_anti").select(*points.columns), new)


def point_ids(points: DataFrame) -> DataFrame:
    return points.select("point_id").distinct()


def point_key(payload_id: Column, point_id: Column) -> Column:
    """What names a hit: the payload's chunk id, or the point's where that is empty."""
    return F.coalesce(F.nullif(payload_id, F.lit("")), point_id.cast("string"))


def indexing_progress(totals: DataFrame, batch: int = BATCH) -> DataFrame:
    """(job_id, points, percent) after each write of a job (job_id, n); only the end is 100."""
    rows = totals.filter("n > 0").select("job_id", "n", F.explode(F.sequence(F.lit(1), F.ceil(F.col("n") / batch).cast("int"))).alias("i"))
    at = rows.withColumn("points", F.least(F.col("i") * batch, F.col("n")).cast("long"))
    return at.select("job_id", "points", F.least(F.lit(99), F.floor(F.col("points") / F.col("n") * 100)).cast("int").alias("percent"))


def in_writes(points: DataFrame, batch: int = BATCH) -> DataFrame:
    """Points (job_id, point_id) with ``write``: which write of its job a point goes with, ``batch`` to each, by id."""
    order = W.partitionBy("job_id").orderBy("point_id")
    return points.withColumn("write", F.floor((F.row_number().over(order) - 1) / batch))


def written_progress(written: DataFrame) -> DataFrame:
    """(job_id, points, percent) after each write of points (job_id, write) that was made; only the end of a job is 100."""
    each = written.groupBy("job_id", "write").agg(F.count("*").alias("_k"))
    upto = F.sum("_k").over(W.partitionBy("job_id").orderBy("write"))
    whole = F.sum("_k").over(W.partitionBy("job_id"))
    return each.select("job_id", upto.alias("points"), F.least(F.lit(99), F.floor(upto / whole * 100)).cast("int").alias("percent"))


def health_report(chunks: DataFrame, points: DataFrame, faults: DataFrame, repeats: DataFrame, most: int = 100) -> DataFrame:
    """One row of counts and samples: ``faults`` (kind, id) of the index's health and ``repeats`` (text, n). A sample holds
    the first ``most`` in order, which are found before any list is made."""
    def listed(df: DataFrame, by: str, value: Column, name: str) -> DataFrame:
        few = df.orderBy(by).limit(most).agg(F.array_sort(F.collect_list(F.struct(F.col(by).alias("k"), value.alias("v")))).alias("s"))
        return df.agg(F.count("*").alias(f"{name}_count")).crossJoin(few.select(F.transform("s", lambda x: x["v"]).alias(name)))

    counts = points.agg(F.count_distinct("point_id").alias("point_count")).crossJoin(chunks.agg(F.count_distinct("chunk_id").alias("chunk_count")))
    for kind, name in (("orphan", "orphan_points"), ("unindexed", "never_indexed")):
        counts = counts.crossJoin(listed(faults.filter(F.col("kind") == kind), "id", F.col("id"), name))
    return counts.crossJoin(listed(repeats, "text", F.struct("text", "n"), "duplicates"))
