"""Evaluation runs: gold citations resolved to chunks, the measures of every replayed question, and the run's verdict."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import evaluation as E

LANGUAGES = ("bn", "ar", "en")
MEANS = ("recall_5", "recall_10", "recall_20", "mrr", "ndcg_10", "citation_accuracy", "groundedness", "hallucination_rate", "answer_accuracy")


def folded_title(title: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(title, F.lit("")))), r"(?U)\s+", " ")


def int_or_0(value: Column) -> Column:
    return F.coalesce(F.trim(value.cast("string")).try_cast("int"), F.lit(0))


def gold_citations(items: DataFrame) -> DataFrame:
    """(item_id, book_id, book, volume, page) of items (id, book_id, expected_citations), each citation once."""
    c = F.explode("expected_citations").alias("c")
    return items.select(F.col("id").alias("item_id"), "book_id", c).select("item_id", "book_id", "c.book", F.col("c.volume").cast("string").alias("volume"), F.col("c.page").cast("int").alias("page")).distinct()


def books_named(titles: DataFrame, books: DataFrame) -> DataFrame:
    """(title, book): the first book by id whose title holds the given one, without regard to case.

    ``titles`` has the distinct titles of a gold set; signs of patterns in them count as such. Titles meet all books, a
    stated set of questions against all rows.
    """
    met = books.select(F.col("id").alias("_id"), F.col("title").alias("_title")).join(titles.select("title").distinct(), F.expr("_title ILIKE concat('%', title, '%')"))
    return met.groupBy("title").agg(F.min("_id").alias("book"))


def resolved(citations: DataFrame, books: DataFrame, editions: DataFrame, volumes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(item_id, chunk_id) of the chunks that gold citations (``gold_citations``) mean.

    The book is the item's own or the first whose title holds the cited one; the volume, where one is given, the first of
    that book with its number; the page, where one is given, lies in the chunk's printed pages. What can't be resolved
    gives nothing.
    """
    own = citations.filter("book_id IS NOT NULL").join(books.select(F.col("id").alias("book_id")), "book_id", "left_semi").withColumn("_book", F.col("book_id"))
    named = citations.filter("book_id IS NULL")
    titles = named.filter("book IS NOT NULL").select(F.col("book").alias("title")).distinct()
    named = named.join(books_named(titles, books).select(F.col("title").alias("book"), F.col("book").alias("_book")), "book")
    met = own.select("item_id", "_book", "volume", "page").unionByName(named.select("item_id", "_book", "volume", "page"))
    numbered = volumes.select(F.col("id").alias("_volume"), "edition_id", F.col("volume_number").alias("_number")).join(editions.select(F.col("id").alias("edition_id"), F.col("book_id").alias("_book")), "edition_id")
    numbered = numbered.groupBy("_book", "_number").agg(F.min("_volume").alias("_volume"))
    met = met.withColumn("_number", F.when(F.col("volume").isNotNull(), int_or_0(F.col("volume")))).join(numbered, ["_book", "_number"], "left")
    met = met.filter("_number IS NULL OR _volume IS NOT NULL")
    here = chunks.select(F.col("book_id").alias("_book"), F.col("volume_id").alias("_in"), "chunk_id", "printed_page_start", "printed_page_end")
    inside = F.col("page").isNull() | F.col("page").between(F.col("printed_page_start"), F.col("printed_page_end"))
    return met.join(here, "_book").filter((F.col("_volume").isNull() | (F.col("_volume") == F.col("_in"))) & inside).select("item_id", "chunk_id").distinct()


def missing_books(citations: DataFrame, books: DataFrame) -> DataFrame:
    """(title) of cited books that no book is named exactly as."""
    titles = citations.filter("book IS NOT NULL AND book <> ''").select(F.col("book").alias("title")).distinct()
    return titles.join(books.select("title"), "title", "left_anti")


def item_faults(items: DataFrame) -> DataFrame:
    """``items`` (id, category, expected_citations, expect_refusal) with ``fault``: questions that should be refused must expect
    it, all others must cite something."""
    refuse = F.col("category") == "should_refuse"
    none = F.coalesce(F.size("expected_citations"), F.lit(0)) <= 0
    return items.withColumn("fault", F.when(refuse & ~F.coalesce("expect_refusal", F.lit(False)), "refusal not expected").when(~F.coalesce(refuse, F.lit(False)) & none, "no citations"))


def answer_text(explanation: Column) -> Column:
    """The prose of an answer's explanation (html, text): the markup, or the text where there is none."""
    return F.coalesce(F.nullif(explanation["html"], F.lit("")), explanation["text"], F.lit(""))


def cited_texts(retrieved: DataFrame, citations: DataFrame) -> DataFrame:
    """The retrieved chunks (a_id, rank, chunk_id, text) that an answer (a_id, chunk_id) cites, still with their rank."""
    return retrieved.join(citations.filter("chunk_id <> ''").select("a_id", "chunk_id").distinct(), ["a_id", "chunk_id"], "left_semi")


def run_rows(replays: DataFrame, retrieved: DataFrame, gold: DataFrame, measures: list[DataFrame]) -> DataFrame:
    """One row for each replayed question (a_id, item_id, ...) with its retrieval measures and those of ``measures`` (a_id, ...).

    ``gold`` has (item_id, chunk_id). Items without a gold chunk, refusals too, score 0 in retrieval.
    """
    expected = replays.select(F.col("a_id").alias("q_id"), "item_id").join(gold, "item_id").select("q_id", "chunk_id")
    ranking = E.ranking_measures(retrieved.select(F.col("a_id").alias("q_id"), "chunk_id", "rank"), expected, "chunk_id").withColumnRenamed("q_id", "a_id")
    out = replays.join(ranking, "a_id", "left")
    for m in measures:
        out = out.join(m, "a_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in MEANS if c in out.columns})


def run_measures(rows: DataFrame) -> DataFrame:
    """(run_id, metric, actual): the means of all rows of a run, its rates of refusals and its latencies. A run without latencies
    has them as 0."""
    of = F.col("expect_refusal"), F.col("refusal_given")
    n = lambda c: F.count_if(c)
    means = [F.avg(c).alias(c) for c in MEANS if c in rows.columns]
    agg = rows.groupBy("run_id").agg(*means, n(of[0] & of[1]).alias("_tp"), n(~of[0] & of[1]).alias("_fp"), n(of[0] & ~of[1]).alias("_fn"))
    rate = lambda other: F.when(F.col("_tp") + F.col(other) > 0, F.col("_tp") / (F.col("_tp") + F.col(other))).otherwise(1.0)
    agg = agg.withColumn("refusal_precision", rate("_fp")).withColumn("refusal_recall", rate("_fn")).drop("_tp", "_fp", "_fn")
    times = E.latency(rows, "run_id", "latency_ms").select("run_id", F.col("p50").alias("latency_p50"), F.col("p95").alias("latency_p95"))
    agg = agg.join(times, "run_id", "left").fillna(0.0, ["latency_p50", "latency_p95"])
    names = [c for c in agg.columns if c != "run_id"]
    return agg.unpivot(["run_id"], names, "metric", "actual")


def verdicts(measures: DataFrame, thresholds: Mapping[str, float]) -> DataFrame:
    """(run_id, status, violations): each run's measures (run_id, metric, actual) against the thresholds; a measure that is missing
    violates its own."""
    limits = measures.sparkSession.createDataFrame([(k, float(v)) for k, v in thresholds.items()], "metric string, threshold double")
    wanted = measures.select("run_id").distinct().join(F.broadcast(limits))
    rows = wanted.join(measures, ["run_id", "metric"], "left")
    a, t = F.col("actual"), F.col("threshold")
    ceiling = F.col("metric").isin(*E.CEILINGS)
    why = (
        F.when(a.isNull(), F.concat("metric", F.lit(": missing from metrics")))
        .when(ceiling & (a > t), F.concat_ws(" ", F.concat("metric", F.lit(":")), a.cast("string"), F.lit("> ceiling"), t.cast("string")))
        .when(~ceiling & (a < t), F.concat_ws(" ", F.concat("metric", F.lit(":")), a.cast("string"), F.lit("< floor"), t.cast("string")))
    )
    out = rows.groupBy("run_id").agg(F.array_sort(F.collect_list(why)).alias("violations"))
    return out.select("run_id", F.when(F.size("violations") > 0, "failed").otherwise("passed").alias("status"), "violations")
