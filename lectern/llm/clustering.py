"""Centroids of whole-number vectors by rounds of assignment and averaging, with Elkan's bounds.

Every vector keeps an upper bound on the distance to its centroid and a lower one for each centroid. Half the distance
between two centroids, and how far they moved, tell which distances need no calculation. Bounds are rounded away from
the truth and prune only where they are strictly apart, so that ties are always seen; what is calculated is exact.
A round reads and writes the table of vectors and bounds once; centroids and their sums are all that the driver holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialise, packed, tidied, unpacked

#: Whole numbers up to this leave room for the square of a distance of ``WIDEST`` components in 63 bits.
MOST, WIDEST = 1 << 26, 1 << 9
UP, DOWN = np.float32(np.inf), np.float32(-np.inf)


def whole(column: pa.Array, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors, those with exactly ``width`` finite components, and floor(scale * x) of their components."""
    at = np.flatnonzero(np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), width), False)))
    flat = pc.list_flatten(column.take(pa.array(at))).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), width)
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.floor(scale * flat)
        good = (np.abs(x) <= MOST).all(axis=1)
    return at[good], x[good].astype(np.int64)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of two equal shapes."""
    away = x - c
    return np.einsum("ij,ij->i", away, away)


def above(square: np.ndarray) -> np.ndarray:
    """Roots rounded up to a float."""
    root = np.sqrt(square.astype(np.float64)) * (1 + 1e-15)
    out = root.astype(np.float32)
    return np.where(out < root, np.nextafter(out, UP), out)


def below(square: np.ndarray) -> np.ndarray:
    """Roots rounded down to a float."""
    root = np.sqrt(square.astype(np.float64)) * (1 - 1e-15)
    out = root.astype(np.float32)
    return np.where(out > root, np.nextafter(out, DOWN), out)


def first_bounds(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper, lower) with all distances calculated; ties go to the smaller number."""
    square = np.stack([squares(x, c) for c in centroids], axis=1)
    cluster = square.argmin(axis=1)
    return cluster.astype(np.int32), above(square[np.arange(len(x)), cluster]), below(square)


def moved_bounds(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, drift: np.ndarray):
    """(cluster, upper, lower, calculated) after the centroids moved by ``drift``: squared distances from where they were."""
    rows, far = np.arange(len(x)), above(drift)
    upper = np.nextafter(upper + far[cluster], UP)
    lower = np.maximum(np.nextafter(lower - far, DOWN), 0).astype(np.float32)
    apart = np.nextafter(below(np.stack([squares(centroids, c) for c in centroids])) / np.float32(2), DOWN)
    np.fill_diagonal(apart, UP)
    own = np.arange(len(centroids)) == cluster[:, None]
    # Strictly nearer than half the way, or strictly nearer than the lower bound: neither nearer nor tied.
    open_ = ~own & (upper[:, None] >= lower) & (upper[:, None] >= apart[cluster])
    asked = open_.any(axis=1)
    at = np.flatnonzero(asked)
    best, calculated = np.full(len(x), np.iinfo(np.int64).max), len(at)
    best[at] = squares(x[at], centroids[cluster[at]])
    upper, old = upper.copy(), cluster
    upper[at] = above(best[at])
    lower[at, old[at]] = below(best[at])
    open_[at] &= (upper[at, None] >= lower[at]) & (upper[at, None] >= apart[old[at]])
    cluster = old.copy()
    for c in range(len(centroids)):
        i = np.flatnonzero(open_[:, c])
        if len(i):
            square = squares(x[i], centroids[c])
            calculated += len(i)
            lower[i, c] = below(square)
            nearer = (square < best[i]) | ((square == best[i]) & (c < cluster[i]))
            best[i[nearer]], cluster[i[nearer]] = square[nearer], c
    changed = cluster != old
    upper[changed] = above(best[changed])
    return cluster.astype(np.int32), upper.astype(np.float32), lower, calculated


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), kind))


def _told(k: int, width: int, cluster: np.ndarray, x: np.ndarray, sign: int, into: np.ndarray) -> None:
    """Counts and sums of the rows of each cluster, added to ``into`` (k, width + 1)."""
    for c in np.unique(cluster):
        here = cluster == c
        into[c, 0] += sign * int(here.sum())
        into[c, 1:] += sign * x[here].sum(axis=0)


def _round(columns: int, width: int, scale: int, centroids: np.ndarray, drift: np.ndarray | None):
    """Rows of one round: (columns, x, cluster, upper, lower, part), with numbers of a row packed; the last row of a partition has only ``part``.

    ``part`` holds by how much counts and sums of each cluster changed, then how many distances were calculated.
    """
    k = len(centroids)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change, calculated, kinds = np.zeros((k, width + 1), dtype=np.int64), 0, None
        for batch in batches:
            kinds = [c.type for c in batch.columns[:columns]]
            if drift is None:
                at, x = whole(batch.column(columns), width, scale)
                kept = [c.take(pa.array(at)) for c in batch.columns[:columns]]
                cluster, upper, lower = first_bounds(x, centroids)
                _told(k, width, cluster, x, 1, change)
                calculated += len(x) * k
            else:
                kept = batch.columns[:columns]
                x = unpacked(batch.column(columns), np.int32, width).astype(np.int64)
                old, upper = batch.column(columns + 1).to_numpy(), batch.column(columns + 2).to_numpy()
                lower = unpacked(batch.column(columns + 3), np.float32, k)
                cluster, upper, lower, more = moved_bounds(x, old, upper, lower, centroids, drift)
                calculated += more
                to = cluster != old
                _told(k, width, cluster[to], x[to], 1, change)
                _told(k, width, old[to], x[to], -1, change)
            yield pa.RecordBatch.from_arrays(
                [*kept, packed(x.astype(np.int32)), pa.array(cluster, pa.int32()), pa.array(upper, pa.float32()), packed(lower.astype(np.float32)), pa.nulls(len(x), pa.list_(pa.int64()))], names
            )
        if kinds is not None:
            empty = [pa.nulls(1, t) for t in (*kinds, pa.binary(), pa.int32(), pa.float32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*empty, pa.array([[*change.ravel().tolist(), calculated]], pa.list_(pa.int64()))], names)

    names = [*(f"c{i}" for i in range(columns)), "x", "cluster", "upper", "lower", "part"]
    return rows


def first_centroids(vectors: DataFrame, id: str, vector: str, k: int, width: int, scale: int, seed: int) -> np.ndarray:
    """The ``k`` usable vectors with the smallest sha256 of ``seed:id`` in hex, in that order, ties by their components; a null id is empty."""
    at = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit(""))), 256)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, x = whole(batch.column(1), width, scale)
            hashes = batch.column(0).take(pa.array(found))
            least = pc.sort_indices(hashes)[:k] if len(x) and not pc.count_distinct(hashes).as_py() < len(x) else pa.array(np.arange(len(x)))
            yield pa.RecordBatch.from_arrays([hashes.take(least), _lists(x[least.to_numpy()], pa.int32())], ["hash", "x"])

    found = vectors.select(at.alias("hash"), F.col(vector).alias("v")).mapInArrow(rows, "hash string, x array<int>")
    return np.array([r["x"] for r in found.orderBy("hash", "x").limit(k).collect()], dtype=np.int64).reshape(-1, width)


def averages(counts: list[int], sums: list[list[int]], centroids: np.ndarray) -> np.ndarray:
    """Floors of exact means; a centroid without vectors stays."""
    return np.array([[s // n for s in total] if n else list(c) for n, total, c in zip(counts, sums, centroids.tolist())], dtype=np.int64)


def cluster(vectors: DataFrame, columns: list[str], vector: str = "embedding", id: str = "vec_id", k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, seed: int = 3):
    """(rows, centroids, calculated): ``columns``, ``cluster`` and ``distance`` of every usable vector; centroids; distances calculated in each round.

    ``distance`` is the exact square to the vector's centroid; columns mustn't be called ``cluster`` or ``distance``.

    Vectors are usable that have exactly ``width`` components (512 at most), none null, NaN or infinite, and none whose floor(scale * x)
    is beyond 2^26. Others have no rows; repeated rows count each. With fewer usable vectors than ``k`` there are as many
    centroids, and without any there are none. Rounds end early once no centroid moves: all later rounds would say the same.
    Tables of earlier rounds are deleted from the shared folder when the next is written.
    """
    if width > WIDEST:
        raise ValueError(f"vectors of more than {WIDEST} components")
    centroids = first_centroids(vectors, id, vector, k, width, scale, seed)
    k, calculated = len(centroids), []
    kept = [vectors.schema[c].dataType for c in columns]
    named = T.StructType([T.StructField(f"c{i}", t) for i, t in enumerate(kept)])
    schema = T.StructType([*named.fields, *T._parse_datatype_string("x binary, cluster int, upper float, lower binary, part array<bigint>").fields])
    back = [F.col(f"c{i}").alias(c) for i, c in enumerate(columns)]
    told = T.StructType([vectors.schema[c] for c in columns]).add("cluster", T.IntegerType()).add("distance", T.LongType())
    if not k:
        return vectors.sparkSession.createDataFrame([], told), centroids, calculated
    counts, sums = [0] * k, [[0] * width for _ in range(k)]
    state = vectors.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(columns)), F.col(vector).alias("v"))
    drift, written = None, None
    for _ in range(rounds + 1):
        before = written
        written = materialise(state.mapInArrow(tidied(_round(len(columns), width, scale, centroids, drift)), schema), "clusters")
        # Only the last row of each partition of the round has a part, and no other column is read for it.
        parts = written.filter("part IS NOT NULL").select(F.posexplode("part").alias("place", "value"))
        change = {r[0]: int(r[1]) for r in parts.groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)"))).collect()}
        if before is not None:
            discard(before)
        calculated.append(change[k * (width + 1)])
        for c in range(k):
            counts[c] += change[c * (width + 1)]
            sums[c] = [s + change[c * (width + 1) + 1 + i] for i, s in enumerate(sums[c])]
        state = written.filter("x IS NOT NULL").drop("part")
        if len(calculated) > rounds:
            break
        moved = averages(counts, sums, centroids)
        drift = squares(moved, centroids)
        if not drift.any():
            break
        centroids = moved
    return _distances(state.select(*back, "x", "cluster"), centroids, told), centroids, calculated


def _distances(rows: DataFrame, centroids: np.ndarray, schema: T.StructType) -> DataFrame:
    """The last table's rows (columns, x, cluster) with exact squared distances in the place of their numbers."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *kept, x, where = batch.columns
            numbers = unpacked(x, np.int32, centroids.shape[1]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*kept, where, pa.array(squares(numbers, centroids[where.to_numpy()]))], schema.names)

    return rows.mapInArrow(each, schema)


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def inertias(spark: SparkSession, told: DataFrame, centroids: np.ndarray) -> DataFrame:
    """A row for each centroid, of which there are few: its digest, the sum of its rows' distances and that of all."""
    found = {r[0]: int(r[1]) for r in told.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    rows = [(i, Decimal(found.get(i, 0)), Decimal(sum(found.values())), centroid_digest(c)) for i, c in enumerate(centroids)]
    return spark.createDataFrame(rows, "cluster int, cluster_inertia decimal(38,0), inertia decimal(38,0), centroid_sha256 string")


def assignments(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector; sums that a long can't hold are null."""
    told, centroids, _ = cluster(vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).alias("_v")), ["vec_id"], "_v", "vec_id")
    of_clusters = inertias(vectors.sparkSession, told, centroids)
    sums = [F.col(c).try_cast("long").alias(c) for c in ("cluster_inertia", "inertia")]
    return told.join(F.broadcast(of_clusters), "cluster").select("vec_id", "cluster", "distance", *sums, "centroid_sha256")


def sql(vectors: str, k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """DuckDB: the same rounds with all distances calculated, each round a step over the table."""
    usable = f"len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM {vectors} WHERE {usable}),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) AS INTEGER) - 1 AS cluster, x AS c FROM kept
  QUALIFY cluster < {k})"""
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, x, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (
  SELECT n, vec_id, x, cluster, CAST(list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM (SELECT row_number() OVER () AS n, * FROM kept), c{i}
) GROUP BY n, vec_id, x)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT c{i}.cluster, coalesce(m.c, c{i}.c) AS c FROM c{i} LEFT JOIN (
  SELECT cluster, list(v ORDER BY place) AS c FROM (
    SELECT cluster, place, CAST(floor_div AS BIGINT) AS v FROM (
      SELECT cluster, place, (sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS floor_div FROM (SELECT cluster, unnest(x) AS v, unnest(range(1, {width + 1})) AS place FROM a{i}) GROUP BY cluster, place))
  GROUP BY cluster) m ON m.cluster = c{i}.cluster)""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, a.cluster, a.distance, CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.cluster = c.cluster"""
