"""Candidate strings of a query: as it was asked, folded, with synonyms and with related terms, and their common search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SCRIPTS, normalise_arabic, stripped, tokens
from ..sources.tables import stored, tasks
from . import vectors as V
from .relational import ways

MOST = 5
# Terms and the term that may stand for each, in the order in which they are tried.
SYNONYMS = {"ثبوت": "وجوب", "وجوب": "ثبوت", "صلاه": "عباده", "عباده": "صلاه", "ماء": "طهور", "طهور": "ماء"}
# The first related terms (primary, related, relation, confidence).
SEEDS = (
    ("ثبوت", "وجوب", "synonym", 1.0), ("وجوب", "ثبوت", "synonym", 1.0), ("صلاه", "عباده", "synonym", 0.9), ("عباده", "صلاه", "synonym", 0.9), ("ماء", "طهور", "synonym", 1.0),
    ("طهور", "ماء", "synonym", 1.0), ("طلاق", "عده", "related", 1.0), ("طلاق", "نكاح", "related", 0.8), ("زكاه", "نصاب", "related", 1.0), ("زكاه", "حول", "related", 1.0),
)
KINDS = ("original", "canonical", "synonym", "kg", "llm")
ARTICLE = "ال"


def replaced_once(text: Column, old: Column, new: Column) -> Column:
    """A text with the first occurrence of a string replaced."""
    at = F.instr(text, old)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(old), F.length(text)))).otherwise(text)


def synonym_variants(canonical: Column) -> Column:
    """The text with each term that it holds replaced once, in the terms' order."""
    variants = [F.when(F.contains(canonical, F.lit(term)), replaced_once(canonical, F.lit(term), F.lit(other))) for term, other in SYNONYMS.items()]
    return F.array_distinct(F.filter(F.array(*variants), lambda v: v.isNotNull() & (v != canonical)))


def probe_terms(canonical: Column) -> Column:
    """The words in Arabic letters, also without the article, and the known terms that the text holds; sorted."""
    words = F.filter(F.regexp_extract_all(canonical, F.lit(r"(?U)\S+"), F.lit(0)), lambda w: w.rlike(f"[{SCRIPTS['ar']}]"))
    bare = F.transform(F.filter(words, lambda w: F.startswith(w, F.lit(ARTICLE)) & (F.length(w) > 3)), lambda w: F.substring(w, F.lit(3), F.length(w)))
    known = F.filter(F.array(*map(F.lit, SYNONYMS)), lambda t: F.contains(canonical, t))
    return F.array_sort(F.array_distinct(F.concat(words, bare, known)))


def first_of_each(items: Column, name: str) -> Column:
    """The items of a sorted array without those whose field is that of an earlier one."""
    return F.filter(items, lambda x, i: F.array_position(F.transform(items, lambda y: y[name]), x[name]) == i + 1)


def candidates(queries: DataFrame, edges: DataFrame, paraphrases: DataFrame | None = None, most: int = MOST) -> DataFrame:
    """(q_id, candidate, kind, text): at most ``most`` strings of each query (q_id, original, canonical), from 0, each text
    once, the first kind of ``KINDS`` winning. A related term counts for the first probe that leads to it. ``paraphrases``
    (q_id, n, text) may come from a model.

    Queries are read once, a row for each probe, and a query's few strings come together as arrays, in tasks of a bounded
    number of queries.
    """
    spark = queries.sparkSession
    n = tasks(spark, queries.count())
    if queries.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        queries = queries.repartition(n, "q_id")
    folded = queries.select("q_id", "original", normalise_arabic(F.col("canonical")).alias("canonical"))
    one = lambda kind, n, text: F.struct(F.lit(KINDS.index(kind)).alias("k"), n.cast("int").alias("n"), text.alias("text"))
    own = F.array(one("original", F.lit(0), F.col("original")), one("canonical", F.lit(0), F.col("canonical")))
    variants = F.transform(synonym_variants(F.col("canonical")), lambda v, i: one("synonym", i, v))
    probed = folded.select("q_id", "original", "canonical", F.posexplode_outer(probe_terms(F.col("canonical"))).alias("place", "term")).join(stored(ways(edges), "ways"), "term", "left")
    # The first probe's rows bring the query's own strings; related terms sort by the probes' places, then by falling confidence.
    first = F.coalesce("place", F.lit(0)) == 0
    said = F.when(first, F.concat(own, F.coalesce(variants, F.slice(own, 1, 0))))
    sure, text = F.col("confidence"), replaced_once(F.col("canonical"), F.col("term"), F.col("neighbour"))
    order = ["place", sure.isNull().alias("unsure"), (~F.isnan(sure)).alias("known"), (-sure).alias("confidence"), "neighbour", "relation"]
    met = F.when(F.col("neighbour").isNotNull(), F.struct(*order, text.alias("text"), (text != F.col("canonical")).alias("new")))
    every = probed.select("q_id", said.alias("said"), met.alias("met"))
    if paraphrases is not None:
        every = every.unionByName(paraphrases.select("q_id", F.array(one("llm", F.col("n"), F.col("text"))).alias("said")), allowMissingColumns=True)
    held = every.repartition(n, "q_id").groupBy("q_id").agg(F.flatten(F.collect_list("said")).alias("said"), F.array_sort(F.collect_list("met")).alias("met"))
    related = F.transform(F.filter("met", lambda m: m["new"]), lambda m, i: one("kg", i, m["text"]))
    named = held.withColumn("met", first_of_each(F.col("met"), "neighbour")).withColumn("said", F.concat("said", related))
    clean = F.transform("said", lambda x: F.struct(x["k"].alias("k"), x["n"].alias("n"), stripped(F.coalesce(x["text"], F.lit(""))).alias("text")))
    placed = named.select("q_id", F.array_sort(clean).alias("said")).select("q_id", F.filter("said", lambda x: x["text"] != "").alias("said"))
    few = placed.select("q_id", F.posexplode(F.slice(first_of_each(F.col("said"), "text"), 1, max(1, most))).alias("candidate", "s"))
    return few.select("q_id", "candidate", F.element_at(F.array(*map(F.lit, KINDS)), F.col("s.k") + 1).alias("kind"), "s.text")


def multi_candidate_search(queries: DataFrame, strings: DataFrame, docs: DataFrame, id: str = "doc_id", scope: str = "source", n: int = V.TOP) -> DataFrame:
    """(q_id, place, id, rerank_score): every candidate string of ``strings`` (q_id, candidate, text) is searched, each
    document keeps its best fused score, and the merged hits are reranked against the query (q_id, text) as it was asked."""
    named = strings.withColumn("_c", F.struct("q_id", "candidate"))
    asked = named.select(F.col("_c").alias("q_id"), "text")
    hits = V.search(V.postings(asked, "q_id", "text"), docs, id).select(F.col("q_id.q_id").alias("q_id"), F.col("q_id.candidate").alias("candidate"), id, "score", "dense_score")
    merged = stored(V.merge_best(hits, id), "merged")
    ranked = V.rerank(merged, queries, docs.select(id, "text", scope), id)
    return V.compress(ranked, id, F.coalesce(scope, F.lit("")), n).select("q_id", "place", id, "rerank_score")


def passthrough(text: Column) -> Column:
    """A translation that changes nothing: (text, translated, confidence)."""
    return F.struct(text.alias("text"), F.lit(False).alias("translated"), F.lit(1.0).alias("confidence"))
