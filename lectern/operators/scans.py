"""Ranked search without pairs: documents are scored where they lie, against all questions at once.

A document's counts of hashed tokens are one row. Rows are scored many at a time as a product of matrices, and every partition hands
on only what may be among a question's best, so that what is shuffled grows with partitions and questions and not with their pairs
with documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import DENSE_SIZE, SPARSE_SIZE, one_space
from ..sources.tables import stored, tasks

#: Documents and questions that are multiplied at once.
ROWS, ASKED = 512, 256
#: Numbers of the questions' vectors that may go to every task; more questions meet documents in a join.
MOST_ASKED = 5_000_000
#: Tokens whose buckets a task remembers.
REMEMBERED = 500_000
#: By how much a score may lie below another to which it is equal once both are rounded to nine places.
SLACK = {"sparse": 0.0, "dense": 2e-9}


def vectors(df: DataFrame, id: str, idx: str = "idx", tf: str = "tf") -> DataFrame:
    """Postings (id, idx, tf) as one row for each id: (id, idx, tf) with arrays."""
    held = df.groupBy(id).agg(F.collect_list(F.struct(F.col(idx).cast("int").alias("idx"), F.col(tf).cast("long").alias("tf"))).alias("_p"))
    return held.select(id, F.col("_p.idx").alias("idx"), F.col("_p.tf").alias("tf"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, words with one space between) to (id, idx, tf)."""
    known: dict[str, int] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            said = [t.split(" ") if t else [] for t in part.column(1).to_pylist()]
            if len(known) > REMEMBERED:
                known.clear()
            for t in set().union(*said).difference(known):
                known[t] = int(hashlib.md5(t.encode()).hexdigest()[11:16], 16)
            row = np.repeat(np.arange(len(said)), [len(w) for w in said])
            key, n = np.unique(row * SPARSE_SIZE + np.fromiter((known[t] for w in said for t in w), np.int64, len(row)), return_counts=True)
            cut = pa.array(np.searchsorted(key, np.arange(len(said) + 1) * SPARSE_SIZE), pa.int32())
            lists = [pa.ListArray.from_arrays(cut, pa.array(x, kind)) for x, kind in ((key % SPARSE_SIZE, pa.int32()), (n, pa.int64()))]
            yield pa.RecordBatch.from_arrays([part.column(0), *lists], ["id", "idx", "tf"])


def counted(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, idx, tf): counts of hashed tokens of every row, as arrays; rows that repeat an id aren't added up."""
    if docs.rdd.getNumPartitions() < docs.sparkSession.sparkContext.defaultParallelism:
        docs = docs.select(id, text).repartition(tasks(docs.sparkSession))
    kind = T.StructType([docs.schema[id]]).add("idx", T.ArrayType(T.IntegerType())).add("tf", T.ArrayType(T.LongType()))
    return docs.select(id, one_space(F.lower(text))).mapInArrow(_counted, kind)


def _best(q: np.ndarray, score: np.ndarray, id: np.ndarray, none: np.ndarray, k: int, slack: float) -> np.ndarray:
    """Places of the rows that may be among the k best of their q, ties by id and nulls first, once scores are rounded."""
    order = np.lexsort((id, ~none, -score, q))
    a, s = q[order], score[order]
    begin = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    group = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(a)]))
    kth = s[np.minimum(begin + k, np.r_[begin[1:], len(a)]) - 1]
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (s[1:] != s[:-1])])
    tied = np.arange(len(a)) - np.repeat(new, np.diff(np.r_[new, len(a)]))
    return order[(s >= kth[group] - slack) & (tied < k)]


class _Questions:
    """Vectors of some questions as a matrix over the buckets that they have."""

    def __init__(self, idx: list[np.ndarray], tf: list[np.ndarray], size: int):
        bucket, column = np.concatenate(idx) % size, np.repeat(np.arange(len(idx)), [len(x) for x in idx])
        self.known, at = np.unique(bucket, return_inverse=True)
        self.matrix = np.zeros((len(self.known), len(idx)))
        np.add.at(self.matrix, (at, column), np.concatenate(tf))
        self.norm = np.sqrt((self.matrix**2).sum(axis=0))

    def dots(self, row: np.ndarray, bucket: np.ndarray, tf: np.ndarray, rows: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, bucket), len(self.known) - 1)
        has = self.known[at] == bucket
        v = len(self.known)
        return np.bincount(row[has] * v + at[has], tf[has], rows * v).reshape(rows, v) @ self.matrix


def _scored(asked: pa.Table, kinds: tuple[str, ...], k: int):
    size = {"sparse": SPARSE_SIZE, "dense": DENSE_SIZE}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, idx, tf) to (kind, q_id, id, score): what may be among a partition's best of each question."""
        table = asked.value if hasattr(asked, "value") else asked
        names = table.column(0).combine_chunks()
        idx, tf = ([np.asarray(x.values) for x in table.column(c)] for c in ("idx", "tf"))
        groups = [(kind, at, _Questions(idx[at : at + ASKED], tf[at : at + ASKED], size[kind])) for kind in kinds for at in range(0, len(idx), ASKED)]
        held = {(kind, at): [] for kind, at, _ in groups}
        least = {(kind, at): np.zeros(len(g.norm)) for kind, at, g in groups}

        def pruned(kind: str, at: int) -> None:
            columns = [np.concatenate(c) for c in zip(*held[kind, at])]
            keep = _best(*columns, k, SLACK[kind])
            q, score = columns[0][keep], columns[1][keep]
            # A question that has k rows needs none below the k-th.
            order = np.lexsort((-score, q))
            begin = np.searchsorted(q[order], np.arange(len(least[kind, at]) + 1))
            full = np.flatnonzero(np.diff(begin) >= k)
            least[kind, at][full] = score[order][begin[full] + k - 1]
            held[kind, at] = [tuple(c[keep] for c in columns)]

        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                n = part.num_rows
                none = np.asarray(part.column(0).is_null())
                id = part.column(0).fill_null(0).to_numpy()
                lists = [c.flatten().to_numpy() for c in part.columns[1:]]
                row = np.repeat(np.arange(n), part.column(1).value_lengths().fill_null(0).to_numpy())
                if "dense" in kinds:
                    whole = np.bincount(row * DENSE_SIZE + lists[0] % DENSE_SIZE, lists[1], n * DENSE_SIZE).reshape(n, -1)
                    norm = np.sqrt((whole**2).sum(axis=1))
                for kind, at, g in groups:
                    score = g.dots(row, lists[0] % size[kind], lists[1], n)
                    if kind == "dense":
                        score[none] = 0
                        score = np.divide(score, norm[:, None] * g.norm, out=np.zeros_like(score), where=score > 0)
                    kth = np.partition(score, n - k, axis=0)[n - k] if n > k else np.zeros(score.shape[1])
                    i, j = np.nonzero((score > 0) & (score >= np.maximum(kth, least[kind, at]) - SLACK[kind]))
                    if len(i):
                        held[kind, at].append((j, score[i, j], id[i], none[i]))
                    if sum(len(c[0]) for c in held[kind, at]) > 8 * k * score.shape[1]:
                        pruned(kind, at)
        for (kind, at), rest in held.items():
            if rest:
                pruned(kind, at)
                q, score, id, none = held[kind, at][0]
                for i in range(0, len(q), 100_000):
                    j = slice(i, i + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(q[j])), names.take(pa.array(q[j] + at)), pa.array(id[j], mask=none[j]), pa.array(score[j])], ["kind", "q_id", "id", "score"])

    return rows


def fits(asked: DataFrame, docs: DataFrame, id: str) -> bool:
    """Whether postings of questions are few enough to go to every task, and ids are whole numbers."""
    return isinstance(docs.schema[id].dataType, T.IntegralType) and asked.count() <= MOST_ASKED


def scanned(asked: DataFrame, rows: DataFrame, ids: DataFrame, id: str, kinds: tuple[str, ...], k: int) -> DataFrame:
    """(kind, q_id, id, score): by each of ``kinds`` the rows that may be among the k best of each question, written once.

    ``asked`` are postings (q_id, idx, tf), ``rows`` have (id, idx, tf) with arrays, ``ids`` has their ids. ``sparse`` is the dot product, ``dense`` the
    cosine of the dense postings; rows that share no bucket with a question aren't there. Rows that repeat an id are added up first.
    """
    spark, own = rows.sparkSession, rows.schema[id].dataType
    table = vectors(asked, "q_id").toArrow()
    schema = T.StructType().add("kind", "string").add("q_id", asked.schema["q_id"].dataType).add(id, own).add("score", "double")
    if not table.num_rows:
        return spark.createDataFrame([], schema)
    again = stored(ids.groupBy(id).count().filter("count > 1").select(F.col(id).alias("_again")), "again")
    parts = [rows]
    if not again.isEmpty():
        same = F.col(id).eqNullSafe(F.col("_again"))
        each = rows.join(again, same, "left_semi").select(id, F.explode(F.arrays_zip("idx", "tf")).alias("_p"))
        parts = [rows.join(again, same, "left_anti"), vectors(each.groupBy(id, F.col("_p.idx").alias("idx")).agg(F.sum("_p.tf").alias("tf")), id)]
    shared = spark.sparkContext.broadcast(table)
    out = [p.select(id, "idx", "tf").mapInArrow(_scored(shared, kinds, k), schema) for p in parts]
    return stored(out[0] if len(out) == 1 else out[0].unionByName(out[1]), "scanned")
