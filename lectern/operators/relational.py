"""Queries of the corpus and job tables: look-ups, pages of rows, latest rows, summaries, set differences and joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import uuid5_url


def payload_filter(df: DataFrame, **conditions) -> DataFrame:
    """Rows that meet every condition that isn't None. It stands below any ranking, and so reaches the scan."""
    given = [F.col(k) == v for k, v in conditions.items() if v is not None]
    return df.filter(reduce(lambda a, b: a & b, given)) if given else df


def page_of_rows(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """Rows offset+1 to offset+limit in a total order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def latest(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in the given order, with their ``place``."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("place") <= n)


def either_key(left: DataFrame, right: DataFrame, first: str, second: str, key: str) -> DataFrame:
    """Rows of the left with those of the right whose key is one of two columns, each pair once.

    A disjunction in a join condition would compare all pairs; the distinct keys of each row are dealt out instead.
    """
    keys = F.array_distinct(F.filter(F.array(first, second), lambda x: x.isNotNull()))
    return left.withColumn(key, F.explode(keys)).join(right, key)


def ways(edges: DataFrame) -> DataFrame:
    """(term, neighbour, relation, confidence): every edge from both of its ends."""
    forth = edges.select(F.col("primary_term").alias("term"), F.col("related_term").alias("neighbour"), "relation", "confidence")
    back = edges.filter("primary_term <> related_term").select(F.col("related_term").alias("term"), F.col("primary_term").alias("neighbour"), "relation", "confidence")
    return forth.union(back)


def both_ways(edges: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, neighbour, relation, confidence): the edges of each term, whichever end it is."""
    return ways(edges).join(terms.select("term").distinct(), "term")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The old rows whose keys aren't among the new ones, and the new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def replace_for_key(old: DataFrame, new: DataFrame, key: str, value) -> DataFrame:
    """All rows of a key replaced by new ones."""
    return old.filter(~F.col(key).eqNullSafe(value)).unionByName(new)


def repeated_texts(df: DataFrame, text: Column) -> DataFrame:
    """(text, n) of texts that are there more than once. Digests are counted; only repeated texts themselves are moved, one for each task."""
    told = df.select(text.alias("text")).filter("text IS NOT NULL").withColumn("_digest", F.sha2("text", 256))
    repeated = told.groupBy("_digest").agg(F.count("*").alias("n")).filter("n > 1")
    return told.join(repeated, "_digest", "left_semi").groupBy("_digest").agg(F.any_value("text").alias("text")).join(repeated, "_digest").select("text", "n")


def index_health(chunks: DataFrame, points: DataFrame) -> DataFrame:
    """(kind, id) of points without a chunk (``orphan``) and chunks without a point (``unindexed``).

    ``chunks`` has chunk_id, ``points`` has point_id; a chunk's point is named by its version 5 UUID.
    """
    named = chunks.select("chunk_id", uuid5_url(F.col("chunk_id")).alias("point_id"))
    orphan = points.join(named, "point_id", "left_anti").select(F.lit("orphan").alias("kind"), F.col("point_id").alias("id"))
    return orphan.union(named.join(points, "point_id", "left_anti").select(F.lit("unindexed").alias("kind"), F.col("chunk_id").alias("id")))


def missing_pages(pages: DataFrame, totals: DataFrame) -> DataFrame:
    """(job_id, page) of the pages 1 to n of each job (job_id, n) that aren't in ``pages`` (job_id, page)."""
    wanted = totals.filter("n > 0").select("job_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long"))).alias("page"))
    return wanted.join(pages, ["job_id", "page"], "left_anti")


def containing_ranges(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, start: str, end: str) -> DataFrame:
    """Points with the ranges of their key that contain them: an equi-join with a condition on what is left."""
    return points.join(ranges, keys).filter(F.col(at).between(F.col(start), F.col(end)))


def job_summary(pages: DataFrame) -> DataFrame:
    """One row on the pages (job_id, n_chars, n_blocks, has_text, confidence) of each job."""
    return pages.groupBy("job_id").agg(
        F.count("*").alias("pages"), F.sum("n_chars").alias("chars"), F.sum("n_blocks").alias("blocks"),
        F.sum(F.col("has_text").cast("int")).alias("text_pages"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"),
    )


def eligible_for_stage(jobs: DataFrame, needed: dict[str, str]) -> DataFrame:
    """(upload_id) of uploads whose latest job of each kind has the status that the stage needs."""
    now = latest(jobs, ["upload_id", "kind"], [F.desc("created_at"), F.desc("id")])
    met = reduce(lambda a, b: a | b, [(F.col("kind") == k) & (F.col("status") == s) for k, s in needed.items()])
    return now.filter(met).groupBy("upload_id").agg(F.count("*").alias("n")).filter(F.col("n") == len(needed)).select("upload_id")
