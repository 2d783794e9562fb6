"""Tables of vectors laid out by nearness, so that an exact filtered search reads only the files that can matter.

Vectors are scaled to length one and dealt to cells by their nearest centre; each cell is written by itself. For every cell the table keeps its centre, its radius and the
least and greatest value of each payload column. By the triangle inequality nothing in a cell is nearer to a question than its
centre less its radius.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .tables import stored

#: Vectors of a cell, on average, and how many cells there are at most: their centres go to every task.
ROWS, MOST_CELLS = 100_000, 4096
#: Vectors that travel as one block, and questions of one block.
BLOCK = 2048
#: By how much roundings may move a distance of vectors of length one.
SLACK = 1e-9


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width)


def usable(vector: Column) -> Column:
    """Vectors with a direction: not null, no null or non-finite component, not all zero."""
    return F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)


def unit(vector: Column) -> Column:
    """A vector of doubles of length one; the length is worked out once."""
    doubles = vector.cast("array<double>")
    length = F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda s, x: s + x * x))
    return F.get(F.transform(F.array(F.struct(doubles.alias("v"), length.alias("n"))), lambda p: F.transform(p["v"], lambda x: x / p["n"])), 0)


def write_cells(vectors: DataFrame, path: str, id: str, vector: str, payload: list[str], cells: int | None = None) -> None:
    """Lays usable vectors of one length out below ``path``: ``rows`` (id, v, payload, by cell) and ``cells`` (what is known of each).

    Centres are the vectors whose hashes of their ids are least, as many as cells: a bounded sample, on which only speed depends. Vectors of another length than the first
    centre's are an error.
    """
    kept = vectors.filter(usable(F.col(vector))).select(F.col(id).alias("id"), unit(F.col(vector)).alias("v"), *payload)
    n = kept.count()
    cells = cells or max(1, min(MOST_CELLS, math.ceil(n / ROWS)))
    centres = np.array([r["v"] for r in kept.orderBy(F.xxhash64("id"), "id").select("v").limit(cells).collect()])
    schema = StructType([*kept.schema.fields]).add("cell", T.IntegerType()).add("away", T.DoubleType())
    width = centres.shape[1] if len(centres) else 0

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if set(np.unique(np.diff(batch.column(1).offsets.to_numpy()))) - {width}:
                raise ValueError(f"a vector hasn't {width} components")
            v = _matrix(batch.column(1), width)
            cell = (v @ centres.T).argmax(axis=1)
            away = np.sqrt(((v - centres[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(away)], schema.names)

    placed = kept.mapInArrow(dealt, schema)
    # A cell that has too much of all vectors splits into more files.
    placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/rows")
    spark = vectors.sparkSession
    rows = spark.read.schema(schema).parquet(f"{path}/rows")
    spans = [f(c).alias(f"{side}_{c}") for c in payload for side, f in (("low", F.min), ("high", F.max))]
    found = rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"), *spans)
    known = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    found.join(F.broadcast(known), "cell").coalesce(1).write.parquet(f"{path}/cells")


def _blocks(rows: DataFrame, id: str, vector: str) -> DataFrame:
    """(cell, ids, block): rows that follow each other in a partition by cell, in blocks of ``BLOCK`` at most."""
    schema = StructType.fromDDL("cell int, ids array<bigint>, block array<double>")
    arrow = to_arrow_schema(schema)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, ids = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            vectors = batch.column(2)
            cuts = np.r_[0, np.flatnonzero(np.diff(cells)) + 1, len(cells)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                for i in range(a, b, BLOCK):
                    j = min(i + BLOCK, b)
                    part = vectors.slice(i, j - i).flatten()
                    yield pa.RecordBatch.from_arrays([pa.array([cells[i]], pa.int32()), pa.array([ids[i:j]], arrow.field(1).type), pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part)], arrow.names)

    return rows.select("cell", F.col(id).cast("long"), F.col(vector)).sortWithinPartitions("cell").mapInArrow(packed, schema)


def met(asked: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(q_id, id, score): of each pair of blocks of a cell the ``k`` best of every question; ``asked`` has (cell, q_id, q)."""
    q = _blocks(asked.repartition("cell"), "q_id", "q").select("cell", F.col("ids").alias("q_ids"), F.col("block").alias("q_block"))
    pairs = q.join(_blocks(rows, "id", "v"), "cell").select("q_ids", "q_block", "ids", "block")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q_block, ids, block in zip(*batch.columns):
                q_ids, ids = np.array(q_ids.as_py()), np.array(ids.as_py())
                a = q_block.values.to_numpy().reshape(len(q_ids), -1)
                b = block.values.to_numpy().reshape(len(ids), -1)
                score = a @ b.T
                # All that may be among the best once scores are rounded come along; ties are broken later.
                least = np.partition(score, len(ids) - min(k, len(ids)), axis=1)[:, len(ids) - min(k, len(ids))]
                i, j = np.nonzero(score >= least[:, None] - 1e-6)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(ids[j]), pa.array(score[i, j])], ["q_id", "id", "score"])

    return pairs.mapInArrow(scored, "q_id bigint, id bigint, score double")


def best(scored: DataFrame, k: int) -> DataFrame:
    rounded = scored.withColumn("score", F.round("score", 6))
    return rounded.withColumn("rank", F.row_number().over(W.partitionBy("q_id").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)


def search_cells(queries: DataFrame, path: str, k: int = 10, where: dict | None = None) -> tuple[DataFrame, dict]:
    """((q_id, id, score, rank) of the ``k`` nearest by cosine to each question (q_id, q) among rows whose payload equals ``where``, report).

    Exact, up to the rounding of scores to six places; ties go to smaller ids. First each question looks into the nearest cell that can hold what is asked for; how
    good its ``k``-th row there is tells which other cells could hold better ones, and only those are read. The report says how many cells there are, how many
    the payload ruled out, how many were read at all, and how many meetings of a question and a cell there were of how many.
    """
    spark, where = queries.sparkSession, where or {}
    known = spark.read.parquet(f"{path}/cells").collect()
    can = [c for c in known if all(c[f"low_{p}"] is not None and c[f"low_{p}"] <= v <= c[f"high_{p}"] for p, v in where.items())]
    told = {"cells": len(known), "ruled_out": len(known) - len(can), "read": 0, "meetings": 0, "of": 0}
    asked = queries.filter(usable(F.col("q"))).select("q_id", unit(F.col("q")).alias("q"))
    if not can:
        return spark.createDataFrame([], "q_id long, id long, score double, rank int"), told
    centres, radii, names = np.array([c["centre"] for c in can]), np.array([c["radius"] for c in can]), np.array([c["cell"] for c in can])
    rows = spark.read.parquet(f"{path}/rows").select("id", "v", "cell", *where)
    for p, v in where.items():
        rows = rows.filter(F.col(p) == v)
    schema = StructType([asked.schema["q_id"], asked.schema["q"]]).add("cells", T.ArrayType(T.IntegerType())).add("least", T.ArrayType(T.DoubleType()))
    arrow = to_arrow_schema(schema)

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each question all cells, the nearest centre first, with the least distance that anything in them can have."""
        for batch in batches:
            q = _matrix(batch.column(1), centres.shape[1])
            far = np.sqrt(np.maximum(2 - 2 * q @ centres.T, 0))
            order = far.argsort(axis=1, kind="stable")
            least = np.maximum(np.take_along_axis(far - radii, order, 1) - SLACK, 0)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1) * len(names), pa.int32()), pa.array(x.ravel(), t)) for x, t in ((names[order], pa.int32()), (least, pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], arrow.names)

    placed = stored(asked.mapInArrow(bounds, schema), "bounds")
    first = stored(best(met(placed.select("q_id", "q", F.col("cells")[0].alias("cell")), rows, k), k), "nearest")
    kth = first.filter(F.col("rank") == k).select("q_id", F.col("score").alias("_kth"))
    # The distance of the k-th row so far, a little more for its score's rounding.
    reach = F.when(F.col("_kth").isNotNull(), F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * (F.col("_kth") - 1e-6))) + SLACK)
    others = placed.join(kth, "q_id", "left").select("q_id", "q", reach.alias("_reach"), F.explode(F.slice(F.arrays_zip("cells", "least"), F.lit(2), F.greatest(F.size("cells") - 1, F.lit(1)))).alias("c"))
    more = stored(others.filter(F.col("_reach").isNull() | (F.col("c.least") <= F.col("_reach"))).select("q_id", "q", F.col("c.cells").alias("cell")), "others")
    read = {r[0] for r in more.select("cell").distinct().collect()} | {r[0] for r in placed.select(F.col("cells")[0]).distinct().collect()}
    n = placed.count()
    told |= {"read": len(read), "meetings": n + more.count(), "of": n * len(known)}
    wanted = rows.filter(F.col("cell").isin([int(c) for c in read]))
    return best(met(more, wanted, k).unionByName(first.drop("rank")), k), told
