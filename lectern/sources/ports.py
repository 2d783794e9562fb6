"""Ports to models: embedders, rerankers, judges and providers of replies are functions of lists that are called in batches.

A port asks only for what isn't known yet, once for each distinct input, and joins what it hears back to every row that asked.
The functions that stand here need no model.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import DENSE_SIZE
from .tables import got_or_set, tasks

#: Inputs of one call.
BATCH = 128
VECTOR = "array<struct<idx:int,tf:bigint>>"

Model = Callable[[list[tuple]], list]


def batched(model: Model, inputs: list[str], kind: str, batch: int = BATCH) -> Callable[[DataFrame], DataFrame]:
    """Rows (key, ``inputs``) to (key, value): the model is called with lists of ``batch`` inputs, and answers in their order.

    If a call fails, its inputs are asked for one by one, and those that fail again have no value. A model that answers with
    another number of values is an error, since nobody could tell which is which.
    """

    def asked(df: DataFrame) -> DataFrame:
        schema = StructType([df.schema["key"], *StructType.fromDDL(f"value {kind}").fields])
        arrow = to_arrow_schema(schema)

        def each(rows: list[tuple]) -> list:
            try:
                out = model(rows)
            except Exception:  # the model's own failures; those of single inputs are found below
                out = []
                for row in rows:
                    try:
                        out += model([row])
                    except Exception:  # an input that can't be answered has no value
                        out.append(None)
            if len(out) != len(rows):
                raise ValueError(f"{len(out)} answers to {len(rows)} inputs")
            return out

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []
            for b in batches:
                held += zip(*(c.to_pylist() for c in b.columns))
                while len(held) >= batch:
                    yield told(held[:batch])
                    held = held[batch:]
            if held:
                yield told(held)

        def told(rows: list[tuple]) -> pa.RecordBatch:
            values = each([r[1:] for r in rows])
            return pa.RecordBatch.from_pylist([{"key": r[0], "value": v} for r, v in zip(rows, values)], arrow)

        return df.select("key", *inputs).repartition(tasks(df.sparkSession), "key").mapInArrow(run, schema)

    return asked


def ask(rows: DataFrame, model: Model, inputs: list[str], key: Column, kind: str, cache: DataFrame | None = None, now: Column | None = None, failed: Column | None = None, batch: int = BATCH) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``value``, and the (key, value) that the model was asked for, which a cache may keep.

    ``key`` says which rows are equal, and names entries of ``cache`` (key, value, expires_at) that are live at ``now``. Where the model has no value, or
    null came, ``value`` is ``failed``.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("key", key)
    known = spark.createDataFrame([], f"key string, value {kind}, expires_at timestamp") if cache is None else cache
    found, new = got_or_set(keyed.select("key", *inputs).dropDuplicates(["key"]), known, batched(model, inputs, kind, batch), F.current_timestamp() if now is None else now)
    value = F.col("value") if failed is None else F.coalesce("value", failed)
    return keyed.join(found.select("key", value.alias("value")), "key", "left").drop("key"), new


def digest(*columns: str) -> Column:
    """A key of some columns, by which nulls differ from empty strings."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


@functools.lru_cache(500_000)
def _bucket(token: str) -> int:
    return int(hashlib.md5(token.encode()).hexdigest()[11:16], 16) % DENSE_SIZE


def hashed_embedder(rows: list[tuple]) -> list[list[dict]]:
    """Counts of hashed tokens of texts: the embedder that needs no model."""
    out = []
    for (text,) in rows:
        counts: Counter[int] = Counter()
        for token in re.findall(r"\S+", (text or "").lower()):
            counts[_bucket(token)] += 1
        out.append([{"idx": i, "tf": n} for i, n in sorted(counts.items())])
    return out


def embedded(texts: DataFrame, id: str, text: str, model: Model = hashed_embedder, cache: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """(id, idx, tf): the vectors of texts by an embedder, as postings. Each distinct text is embedded once; a text that fails has none."""
    return vectors(texts, id, text, model, cache, now).select(id, F.inline("value"))


def vectors(texts: DataFrame, id: str, text: str, model: Model = hashed_embedder, cache: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """(id, value): the same with one row for each text and its vector as an array."""
    rows, _ = ask(texts.select(F.col(id).alias("_id"), F.col(text).alias("_text")), model, ["_text"], digest("_text"), VECTOR, cache, now)
    return rows.select(F.col("_id").alias(id), "value")


def word_overlap(rows: list[tuple]) -> list[float]:
    """The share of the words of a question and a text that both have: the reranker that needs no model."""
    out = []
    for question, text in rows:
        q, t = (set(re.findall(r"\S+", (s or "").lower())) for s in (question, text))
        out.append(len(q & t) / len(q | t) if q and t else 0.0)
    return out


def reranked(pairs: DataFrame, model: Model = word_overlap) -> DataFrame:
    """``pairs`` (with ``query`` and ``text``) with ``score``, 0 where the model fails."""
    rows, _ = ask(pairs, model, ["query", "text"], digest("query", "text"), "double", failed=F.lit(0.0))
    return rows.withColumnRenamed("value", "score")


def judged(answers: DataFrame, model: Model) -> DataFrame:
    """``answers`` (with ``expected`` and ``answer``) with ``grade``, 0 where the judge fails."""
    rows, _ = ask(answers, model, ["expected", "answer"], digest("expected", "answer"), "double", failed=F.lit(0.0))
    return rows.withColumnRenamed("value", "grade")


def replies(prompts: DataFrame, model: Model, attempts: int = 2) -> DataFrame:
    """(q_id, attempt, reply) of prompts (q_id, prompt): the provider is asked ``attempts`` times for each question; null replies are calls that failed.

    A provider gets (q_id, attempt, prompt) and is asked for each row: equal prompts of two questions are two calls.
    """
    each = prompts.select("q_id", F.explode(F.sequence(F.lit(1), F.lit(attempts))).alias("attempt"), "prompt")
    rows, _ = ask(each, model, ["q_id", "attempt", "prompt"], F.concat_ws("/", F.col("q_id").cast("string"), "attempt"), "string", batch=1)
    return rows.select("q_id", "attempt", F.col("value").alias("reply"))
