"""Measures of retrieval, citation, grounding, refusal and latency, and the gate over them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import sentences_for_grounding

#: Marks and joiners that don't count in grounding tokens, and the tokens' pattern.
GROUNDING_MARKS = "[ً-ْٰ‌‍ﹰ-﻿]"
JUDGE_MARKS = "[ً-ْٰ‌‍]"
WORD = r"(?U)[\w؀-ۿঀ-৿]+"
#: Floors of the measures, and the ceiling of the one that should be small.
THRESHOLDS = {"recall@10": 0.8, "mrr": 0.6, "ndcg@10": 0.7, "citation_accuracy": 0.9, "groundedness": 0.8, "hallucination_rate": 0.05, "refusal_precision": 0.8, "refusal_recall": 0.8}
CEILINGS = ("hallucination_rate",)


def word_set(text: Column, marks: str = GROUNDING_MARKS) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(F.lower(text), marks, ""), F.lit(WORD), F.lit(0)))


def ranking_measures(ranked: DataFrame, expected: DataFrame, id: str = "doc_id") -> DataFrame:
    """(q_id, recall_5, recall_10, recall_20, mrr, ndcg_10) for each q_id of ``expected`` (q_id, id).

    ``ranked`` is (q_id, id, rank). Recall is whether anything expected is among the first k. Ranked rows without an
    expectation don't count; a query with nothing retrieved scores 0.
    """
    wanted = expected.select("q_id", id).distinct()
    sizes = wanted.groupBy("q_id").agg(F.count("*").alias("n"))
    hits = ranked.join(wanted, ["q_id", id]).groupBy("q_id").agg(F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= 10, 1 / F.log2(F.col("rank") + 1.0))).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(10)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    found = lambda k: F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0)).alias(f"recall_{k}")
    return sizes.join(hits, "q_id", "left").select(
        "q_id", found(5), found(10), found(20), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), F.coalesce(F.round(F.col("dcg") / ideal, 9), F.lit(0.0)).alias("ndcg_10")
    )


def citation_accuracy(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(item_id, accuracy) from (item_id, book, volume, page) of both: the share of expected citations that some actual
    one matches. Books match without regard to case and space, volumes where both are given, pages within one."""
    fold = lambda c: F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"(?U)\s+", " ")
    # A citation is known by its values, so that no lost executor numbers it anew; repeated ones count each.
    e = expected.withColumn("_e", F.to_json(F.struct("book", "volume", "page"))).groupBy("item_id", "book", "volume", "page", "_e").agg(F.count("*").alias("_n")).withColumn("_book", fold(F.col("book")))
    a = actual.select("item_id", fold(F.col("book")).alias("_book"), F.col("volume").alias("a_volume"), F.col("page").alias("a_page"), F.trim(F.col("page").cast("string")).try_cast("int").alias("a_number"))
    near = (
        (F.col("volume").isNull() | F.col("a_volume").isNull() | (F.trim(F.col("volume").cast("string")) == F.trim(F.col("a_volume").cast("string"))))
        & (F.col("page").isNull() | F.col("a_page").isNull() | F.coalesce(F.abs(F.col("a_number") - F.col("page")) <= 1, F.lit(False)))
    )
    met = e.join(a, ["item_id", "_book"]).filter(near).select("item_id", "_e").distinct().withColumn("_hit", F.lit(1.0))
    return e.join(met, ["item_id", "_e"], "left").groupBy("item_id").agg((F.sum(F.coalesce("_hit", F.lit(0.0)) * F.col("_n")) / F.sum("_n")).alias("accuracy"))


def grounding(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """(a_id, n_sentences, groundedness, hallucination_rate) of answers (a_id, text) against evidence (a_id, text).

    A sentence is grounded if it shares two words with one piece of evidence. Sentences meet evidence on their answer,
    so the work of an answer is that of its sentences times its evidence.
    """
    sentence = answers.select("a_id", F.posexplode_outer(sentences_for_grounding(F.col("text"))).alias("pos", "sentence")).withColumn("words", word_set(F.col("sentence")))
    held = evidence.groupBy("a_id").agg(F.collect_list(word_set(F.col("text"))).alias("sets"))
    judged = sentence.join(held, "a_id", "left").withColumn("ok", F.exists(F.coalesce("sets", F.array().cast("array<array<string>>")), lambda s: F.size(F.array_intersect(s, F.col("words"))) >= 2))
    some = F.col("n_sentences") > 0
    counted = judged.groupBy("a_id").agg(F.count("sentence").alias("n_sentences"), F.sum(F.when(F.col("sentence").isNotNull() & F.col("ok"), 1).otherwise(0)).alias("good"), F.max(F.col("sets").isNotNull()).alias("any"))
    return counted.select(
        "a_id", "n_sentences", F.when(some, F.col("good") / F.col("n_sentences")).otherwise(F.when(F.col("any"), 0.0).otherwise(1.0)).alias("groundedness"),
        F.when(~some, 0.0).when(~F.col("any"), 1.0).otherwise((F.col("n_sentences") - F.col("good")) / F.col("n_sentences")).alias("hallucination_rate"),
    )


def lexical_grade(given: Column, expected: Column) -> Column:
    """2, 1 or 0 by the F1 of the two texts' sets of words: at least a half, at least a fifth, or less."""
    a, b = word_set(given, JUDGE_MARKS), word_set(expected, JUDGE_MARKS)
    both = F.size(F.array_intersect(a, b))
    f1 = F.when(both > 0, 2 * both / (F.size(a) + F.size(b))).otherwise(0.0)
    return F.when(f1 >= 0.5, 2).when(f1 >= 0.2, 1).otherwise(0)


def judge_score(raw: Column) -> Column:
    """The score that a judge's reply names, 0 if it names none."""
    found = F.regexp_extract(raw, '"?score"?\\s*[:=]\\s*([012])', 1)
    return F.coalesce(F.when(found != "", found).try_cast("int"), F.when(F.btrim(raw, F.lit(' "')).isin("0", "1", "2"), F.btrim(raw, F.lit(' "'))).try_cast("int"), F.lit(0))


def refusal_matrix(pairs: DataFrame) -> DataFrame:
    """One row of counts and rates from (expected, given) booleans; rates without cases are 1, their F1 is 0 at worst."""
    e, g = F.col("expected"), F.col("given")
    n = pairs.agg(F.count_if(e & g).alias("tp"), F.count_if(~e & g).alias("fp"), F.count_if(e & ~g).alias("fn"), F.count_if(~e & ~g).alias("tn"))
    rate = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))).otherwise(1.0)
    p, r = F.col("precision"), F.col("recall")
    return n.withColumn("precision", rate("tp", "fp")).withColumn("recall", rate("tp", "fn")).withColumn("f1", F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)))


#: How far from a quantile its bounds are asked for, and the accuracy of the bounds.
NEAR, ACCURACY = 0.002, 10_000


def at_places(df: DataFrame, keys: list[str], value: str, places: dict[str, tuple[float, Column]]) -> DataFrame:
    """(keys, one column for each place): of each key's sorted values the one at a place from 0, exactly.

    ``places`` has for each name a quantile near the place, and the place as an expression of the number ``n``. Approximate
    quantiles bound the few values that may stand there; only those are ordered, equal ones as one, so that no task sees
    all values of a key.
    """
    known = df.filter(F.col(value).isNotNull())
    names = list(places)
    asked = [f for q, _ in places.values() for f in (max(0.0, q - NEAR), min(1.0, q + NEAR))]
    bounds = known.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx(value, asked, ACCURACY).alias("_b"))
    # For each place the values between its bounds, and one null that counts the values below them: a row of counts for each task.
    near = [F.struct(F.lit(i).alias("i"), F.col("_b")[2 * i].alias("low"), F.col("_b")[2 * i + 1].alias("high"), place.cast("long").alias("place")) for i, (_, place) in enumerate(places.values())]
    at = bounds.select(*keys, "n", F.array(*near).alias("_near"))
    own = F.col(value)
    met = known.select(*keys, own).join(at, keys).select(*keys, "n", own, F.explode(F.filter("_near", lambda b: own <= b["high"])).alias("_at"))
    few = met.groupBy(*keys, "n", F.col("_at.i").alias("_i"), F.col("_at.place").alias("_place"), F.when(own >= F.col("_at.low"), own).alias("_v")).agg(F.count("*").alias("_k"))
    upto = F.sum("_k").over(W.partitionBy(*keys, "_i").orderBy(F.col("_v").asc_nulls_first()))
    found = few.withColumn("_upto", upto).filter((F.col("_upto") > F.col("_place")) & (F.col("_upto") - F.col("_k") <= F.col("_place")))
    return found.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("_i") == i, F.col("_v"))).alias(name) for i, name in enumerate(names)])


def latency(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, p50, p95): the median, and of the sorted values the one at floor(0.95 n), the last at most."""
    n = F.col("n")
    places = {"_a": (0.5, F.floor((n - 1) / 2)), "_b2": (0.5, F.floor(n / 2)), "p95": (0.95, F.least(n - 1, F.floor(n * 0.95)))}
    return at_places(df, [key], value, places).select(key, "n", ((F.col("_a") + F.col("_b2")) / 2).alias("p50"), "p95")


def gate(measures: DataFrame, thresholds: Mapping[str, float] = THRESHOLDS) -> DataFrame:
    """(metric, actual, threshold, violation) for each threshold, from rows (metric, actual): a measure that is missing,
    below its floor, or above its ceiling violates the gate."""
    wanted = measures.sparkSession.createDataFrame(list(thresholds.items()), "metric string, threshold double")
    a, t = F.col("actual"), F.col("threshold")
    bad = a.isNull() | F.when(F.col("metric").isin(*CEILINGS), a > t).otherwise(a < t)
    return wanted.join(measures, "metric", "left").select("metric", "actual", "threshold", bad.alias("violation"))
