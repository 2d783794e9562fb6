"""Whitening of vectors onto their leading principal components, by a matrix-free block Lanczos iteration.

The covariance is never built: a pass over the vectors gives its product with a narrow block. Entries are whole numbers
x = floor(scale * c) + shift, so that sums and deviations are exact, and x - mean is taken as (x - q) - r / n, where the
sum of x is q * n + r: the difference is exact whatever the shift and the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialise, packed, tidied, unpacked

#: Whole numbers beyond this aren't exact as doubles.
MOST = 1 << 52


@dataclass(frozen=True)
class Whitening:
    """Fitted components (columns of ``vectors``), falling eigenvalues, and what rows are centred by."""

    n: int
    width: int
    scale: int
    shift: int
    quotients: np.ndarray
    rests: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    passes: int
    identity_error: float

    def shares(self) -> np.ndarray:
        return self.values / self.trace


def whole(column: pa.Array, width: int, scale: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors of ``width`` components in a column of lists, and their whole numbers."""
    long_enough = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), width), False))
    at = np.flatnonzero(long_enough)
    flat = pc.list_flatten(column.take(pa.array(at))).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), width)
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.floor(scale * flat) + shift
        # Nulls have become NaN here, which no comparison lets through.
        good = (np.abs(x) <= MOST).all(axis=1)
    return at[good], x[good].astype(np.int64)


def _summed(df: DataFrame, rows: Callable) -> dict[int, float]:
    """Sums by place of the arrays that ``rows`` yields for each partition."""
    parts = df.mapInArrow(tidied(rows), "part array<double>")
    return {r[0]: r[1] for r in parts.select(F.posexplode("part").alias("place", "value")).groupBy("place").agg(F.sum("value")).collect()}


def _part(values: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([values.ravel().tolist()], pa.list_(kind))], ["part"])


def _numbers(column: DataFrame, scale: int, shift: int) -> DataFrame:
    """(width, x, part) of all usable vectors of a column, written once: their whole numbers packed, and for each partition and width a row with only ``part``.

    ``part`` holds how many vectors there are, and sums of each component's upper and lower halves of 26 bits, which stay exact for 2^36 rows of a partition.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, names = (pa.int32(), pa.binary(), pa.list_(pa.int64())), ["width", "x", "part"]
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = np.asarray(pc.fill_null(pc.list_value_length(batch.column(0)), 0))
            for width in map(int, np.unique(sizes[sizes > 0])):
                _, x = whole(batch.column(0), width, scale, shift)
                if len(x):
                    total = totals.setdefault(width, np.zeros(2 * width + 1, dtype=np.int64))
                    total += np.concatenate([[len(x)], (x >> 26).sum(axis=0), (x & (1 << 26) - 1).sum(axis=0)])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), width), kinds[0]), packed(x), pa.nulls(len(x), kinds[2])], names)
        for width, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([width], kinds[0]), pa.nulls(1, kinds[1]), pa.array([total.tolist()], kinds[2])], names)

    return materialise(column.mapInArrow(tidied(rows), "width int, x binary, part array<bigint>"), "vectors")


def _centred(x: np.ndarray, quotients: np.ndarray, rests: np.ndarray, n: int) -> np.ndarray:
    return (x - quotients).astype(np.float64) - rests / n


def block_lanczos(product: Callable[[np.ndarray], np.ndarray], width: int, k: int, block: int = 16, tolerance: float = 1e-13, most: int = 256, seed: int = 11, passes: int = 500):
    """(values, vectors, passes): the ``k`` largest eigenpairs of the symmetric matrix whose products ``product`` gives.

    Every block is orthogonalised twice against the whole basis. Directions that break down are replaced by random ones; the basis,
    once it has ``most`` columns, is begun again with the leading Ritz vectors. It ends when all residuals are below ``tolerance`` x the largest
    value, when the basis spans the space, or when residuals below 1e-9 of it stop falling.
    """
    k, block = min(k, width), min(block, width)
    rng = np.random.default_rng(seed)
    basis, images = np.zeros((width, 0)), np.zeros((width, 0))
    fresh = np.linalg.qr(rng.standard_normal((width, block)))[0]
    best, stale = np.inf, 0
    for done in range(1, passes + 1):
        basis, images = np.hstack([basis, fresh]), np.hstack([images, product(fresh)])
        small = basis.T @ images
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, of_ritz = basis @ turn, images @ turn
        top = min(k, ritz.shape[1])
        scale = max(abs(values[0]), np.finfo(float).tiny)
        rest = np.linalg.norm(of_ritz[:, :top] - ritz[:, :top] * values[:top], axis=0).max() / scale
        stale = 0 if rest < best / 2 else stale + 1
        best = min(best, rest)
        if basis.shape[1] >= width or (top == k and (rest <= tolerance or (rest <= 1e-9 and stale >= 3))):
            return values[:top], ritz[:, :top], done
        # The next block is what is left of the last product beside the whole basis; only then may the basis shrink.
        fresh = _orthogonal(images[:, -fresh.shape[1] :], basis, min(block, width - basis.shape[1]), scale, rng)
        if basis.shape[1] + block > max(most, 3 * k + block):
            basis, images = ritz[:, : 2 * k], of_ritz[:, : 2 * k]
    raise RuntimeError(f"residual {best:.1e} after {passes} passes")


def _orthogonal(block: np.ndarray, basis: np.ndarray, columns: int, scale: float, rng: np.random.Generator) -> np.ndarray:
    """``columns`` directions orthogonal to the basis: those of the block that are left, then random ones."""
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    left, sizes, _ = np.linalg.svd(block, full_matrices=False)
    out = left[:, sizes > 1e-12 * scale][:, :columns]
    while True:
        for _ in range(2):
            out = out - basis @ (basis.T @ out)
            out = np.linalg.qr(out)[0]
        if out.shape[1] == columns:
            return out
        more = rng.standard_normal((len(basis), columns - out.shape[1]))
        both = np.hstack([basis, out])
        for _ in range(2):
            more = more - both @ (both.T @ more)
        out = np.hstack([out, np.linalg.qr(more)[0]])


def fit(vectors: DataFrame, vector: str = "embedding", k: int = 8, scale: int = 1024, shift: int = 100_000, block: int = 16) -> Whitening | None:
    """Components of the usable vectors of the commonest length (of equally common ones the longest); None where there are none.

    Vectors are usable that aren't null or empty and hold no null, NaN or infinite component, nor one whose whole number is beyond 2^52.
    Repeated rows count each. Components without variance (1e-12 of the largest) can't be whitened and are left out. A pass
    sends a block of ``width`` x ``block`` numbers to the tasks and gets one for each partition back, added up by Spark.
    """
    table = _numbers(vectors.select(F.col(vector).alias("v")), scale, shift)
    parts = table.filter("part IS NOT NULL").select("width", "part")
    most = parts.groupBy("width").agg(F.sum(F.col("part")[0]).alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if most is None:
        return None
    width, n = most["width"], int(most["n"])
    exact = F.sum(F.col("value").cast("decimal(38,0)"))
    found = {r[0]: int(r[1]) for r in parts.filter(F.col("width") == width).select(F.posexplode("part").alias("place", "value")).groupBy("place").agg(exact).collect()}
    both = [divmod((found[1 + i] << 26) + found[1 + width + i], n) for i in range(width)]
    quotients, rests = np.array([q for q, _ in both]), np.array([float(r) for _, r in both])
    column = table.filter((F.col("width") == width) & F.col("x").isNotNull()).select("x")
    trace = [0.0]

    def product(q: np.ndarray) -> np.ndarray:
        first = not trace[0]

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, spread = np.zeros(q.shape), 0.0
            for batch in batches:
                x = _centred(unpacked(batch.column(0), np.int64, width), quotients, rests, n)
                total += x.T @ (x @ q)
                spread += float(np.einsum("ij,ij->", x, x)) if first else 0.0
            yield _part(np.append(total.ravel(), spread), pa.float64())

        found = _summed(column, rows)
        trace[0] = trace[0] or found[q.size] / n
        return np.array([found[i] for i in range(q.size)]).reshape(q.shape) / n

    values, found_vectors, passes = block_lanczos(product, width, k, block)
    varied = values > 1e-12 * max(values[0], np.finfo(float).tiny)
    model = Whitening(n, width, scale, shift, quotients, rests, found_vectors[:, varied], values[varied], trace[0], passes, 0.0)
    model = replace(model, identity_error=_identity_error(column, model))
    discard(table)
    return model


def _whitened(x: np.ndarray, model: Whitening) -> np.ndarray:
    return _centred(x, model.quotients, model.rests, model.n) @ (model.vectors / np.sqrt(model.values))


def _identity_error(column: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity; 0 without components."""
    k = len(model.values)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square, total = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            w = _whitened(unpacked(batch.column(0), np.int64, model.width), model)
            square, total = square + w.T @ w, total + w.sum(axis=0)
        yield _part(np.append(square.ravel(), total), pa.float64())

    found = _summed(column, rows)
    values = np.array([found[i] for i in range(k * k + k)]) / model.n
    mean = values[k * k :]
    return float(np.abs(values[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def deviations(x: np.ndarray, model: Whitening) -> pa.Array:
    """decimal(38, 0): sums over components of (n * x - sum)^2, exact."""
    away = x - model.quotients
    most = int(np.abs(away).max(initial=0)) * model.n + model.n
    if model.width * most * most < 1 << 63:
        exact = ((model.n * away - model.rests.astype(np.int64)) ** 2).sum(axis=1)
        return pa.array(exact).cast(pa.decimal128(38, 0))
    rests = [int(r) for r in model.rests]
    exact = [sum((model.n * a - r) ** 2 for a, r in zip(row, rests)) for row in away.tolist()]
    return pa.array([Decimal(e) if e < 10**38 else None for e in exact], pa.decimal128(38, 0))


def whiten(vectors: DataFrame, model: Whitening, columns: list[str], vector: str = "embedding") -> DataFrame:
    """``columns`` (which mustn't be called ``whitened`` or ``deviation``), ``deviation`` and ``whitened`` of every usable vector of the model's length.

    ``deviation`` is decimal(38, 0), null where it has more digits; ``whitened`` has an entry for each component. Other rows aren't returned.
    """
    if {"whitened", "deviation"} & {c.lower() for c in columns}:
        raise ValueError("columns mustn't be called whitened or deviation")
    kept = vectors.select(*columns, F.col(vector).alias("_vector"))
    schema = T.StructType(kept.schema.fields[:-1]).add("deviation", T.DecimalType(38, 0)).add("whitened", T.ArrayType(T.DoubleType()))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = whole(batch.column(len(columns)), model.width, model.scale, model.shift)
            w = _whitened(x, model)
            told = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
            took = [c.take(pa.array(at)) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*took, deviations(x, model), told], [*columns, "deviation", "whitened"])

    return kept.mapInArrow(tidied(rows), schema)


def components(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = 8) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component.

    Unusable vectors, and those of another length than the commonest, have no rows. A deviation that a long can't hold is null.
    """
    model = fit(vectors, vector, k)
    if model is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    told = whiten(vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).alias("_v")), model, ["vec_id"], "_v")
    each = told.select("vec_id", "deviation", F.posexplode("whitened").alias("_place", "whitened"))
    explained = F.get(F.array(*[F.lit(float(s)) for s in model.shares()]).cast("array<double>"), F.col("_place"))
    return each.select(
        "vec_id", (F.col("_place") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), F.col("deviation").try_cast("long").alias("deviation"),
        "whitened", explained.alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
