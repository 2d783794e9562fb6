"""A corpus pipeline: five of the operators in ``lectern.llm``, one after another, over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, jaccard, mixing, substring, toxicity
from lectern.llm.common import materialise, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: The mix of the pipeline: four fifths of the tokens that reach it, no document twice.
MIX = {"share": 0.8, "epochs": 1, "seed": 29, "weights": {"language": {"*": 1, "en": 2}}}


#: Characters of a run of texts in the last stage.
RUN_CHARS = 6_000_000


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    scorer = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score_texts(docs, scorer, COLUMNS).filter("score < 0.5").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents the one with the smallest id stays; rows with a null id all stay.

    The ids that go are written first; Spark broadcasts them where they are few and deals both sides out where not.
    """
    classes = jaccard.jaccard_classes(docs)
    gone = materialise(classes.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "copies")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines and sentences stay where they occur first; documents keep what is left."""
    left = substring.deduplicate(docs.select(*COLUMNS))
    n_chars = F.when(F.col("_removed").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return left.withColumn("n_chars", n_chars).select(*COLUMNS)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each leaf of the tree of domains, languages and sources keeps the documents that its budget holds."""
    return mixing.mix(docs, **MIX).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids) of the documents left."""
    # Shorter runs than the operator's own need more room on disk, of which a pipeline has more, and less memory.
    encoded = bpe.encode(docs.select("doc_id", "text", "lang", "source"), run_chars=RUN_CHARS)
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", toxic_documents), ("near_duplicates", near_duplicates), ("substring", repeated_passages),
    ("mixing", mixed_sources), ("bpe", token_ids),
]

#: A trained model and a tokenizer aren't SQL; tests hold the stages against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
