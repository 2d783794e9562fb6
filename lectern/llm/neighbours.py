"""Nearest neighbours by a block matrix join.

Queries and candidates are dealt to blocks, and every tile of a query block and a candidate block is one unit of work.
In a tile, the product of int8 codes gives distances with bounds on their error. What the bounds leave is recomputed in
double precision, and heaps merge the tiles' nearest. The result is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied

#: Components of a block of candidates or queries, on average: as few blocks as memory allows, since each is copied for
#: every block of the other side. While blocks have more than ``LEAST_ROWS`` candidates, there are ``BLOCKS`` at least.
BLOCK_CELLS, LEAST_ROWS, BLOCKS = 1 << 22, 2048, 64
#: Queries and candidates whose distances are held at once.
STEP_QUERIES, STEP_CANDIDATES = 256, 4096


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of doubles as int8 codes, their scales, and the length of what the codes leave out of each row."""
    scale = np.abs(x).max(axis=1) / 127
    # A row so small that its scale vanishes has codes of zero, and all of it is error.
    safe = np.where(scale > 0, scale, 1.0)
    q = np.rint(x / safe[:, None]).astype(np.int8)
    error = np.sqrt(((x - safe[:, None] * q) ** 2).sum(axis=1))
    return q, safe, error


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of two equal shapes, added up from the first component to the last."""
    return np.sqrt(np.add.accumulate((x - y) ** 2, axis=1)[:, -1])


def tile(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """(query, candidate, distance) of the k nearest of a tile's candidates to each of its queries."""
    (a, sa, ea), (b, sb, eb) = codes(q), codes(c)
    # Sums of products of codes are whole numbers that the float type holds exactly.
    kind = np.float32 if q.shape[1] <= 1000 else np.float64
    product = (a.astype(kind) @ b.astype(kind).T).astype(np.float64)
    na, nb = ((sa[:, None] * a) ** 2).sum(axis=1), ((sb[:, None] * b) ** 2).sum(axis=1)
    square = na[:, None] + nb[None, :] - 2 * sa[:, None] * sb[None, :] * product
    # Rounding in doubles moves the square by far less than this share of the lengths.
    slack = 1e-12 * (na[:, None] + nb[None, :])
    error = ea[:, None] + eb[None, :]
    low = np.sqrt(np.maximum(square - slack, 0)) - error
    high = np.sqrt(np.maximum(square, 0) + slack) + error
    own = qid[:, None] == cid[None, :]
    high[own] = np.inf
    low[own] = np.inf
    least = np.partition(high, min(k, len(cid)) - 1, axis=1)[:, min(k, len(cid)) - 1]
    for i in range(len(qid)):
        at = np.flatnonzero((low[i] <= least[i] * (1 + 1e-9)) & ~own[i])
        d = distances(np.broadcast_to(q[i], (len(at), q.shape[1])), c[at])
        for score, vec in heapq.nsmallest(k, zip(d.tolist(), cid[at].tolist())):
            yield int(qid[i]), vec, score


def whole_tile(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """The same for a tile of any size, step by step, with a heap for each query."""
    for i in range(0, len(qid), STEP_QUERIES):
        best: dict[int, list] = {}
        for j in range(0, len(cid), STEP_CANDIDATES):
            to, upto = i + STEP_QUERIES, j + STEP_CANDIDATES
            for query, vec, score in tile(qid[i:to], q[i:to], cid[j:upto], c[j:upto], k):
                heap = best.setdefault(query, [])
                (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (-score, -vec))
        yield from ((query, -v, -s) for query, heap in best.items() for s, v in heap)


def _tiles(k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (tile, query, vec_id, vector), sorted by tile: one tile is held at a time."""
        now, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                is_query = np.concatenate([h[0] for h in held])
                ids = np.concatenate([h[1] for h in held])
                x = np.concatenate([h[2] for h in held])
                if is_query.any() and not is_query.all():
                    found = list(whole_tile(ids[is_query], x[is_query], ids[~is_query], x[~is_query], k))
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

        for batch in batches:
            tiles = np.array(batch.column(0).to_pylist(), dtype=object)
            is_query, ids = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
            cut = np.r_[0, np.flatnonzero(tiles[1:] != tiles[:-1]) + 1, len(tiles)]
            for s, e in zip(cut[:-1], cut[1:]):
                if e > s:
                    if tiles[s] != now:
                        yield from done()
                        now, held = tiles[s], []
                    vectors = batch.column(3).slice(s, e - s)
                    held.append((is_query[s:e].astype(bool), ids[s:e], vectors.flatten().to_numpy().reshape(e - s, -1).astype(np.float64)))
        yield from done()

    return rows


def _merged(k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k nearest of each query: a heap for each, with the farthest on top."""
        heaps: dict[int, list] = {}
        for batch in batches:
            for query, vec, score in zip(*(c.to_pylist() for c in batch.columns)):
                heap = heaps.setdefault(query, [])
                if len(heap) < k:
                    heapq.heappush(heap, (-score, -vec))
                else:
                    heapq.heappushpop(heap, (-score, -vec))
        out = [(query, i, -v, -s) for query, heap in heaps.items() for i, (s, v) in enumerate(sorted(heap, reverse=True), 1)]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ([],) * 4, kinds)], ["query_id", "rank", "vec_id", "score"])

    return rows


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` the ``k`` rows of ``vectors`` of least distance.

    Both have the columns ``id`` and ``vector``; others aren't read. The nearest come first, ties by smaller id. Rows with
    the query's id are its own and no candidates; other repeated rows are candidates each. Of repeated queries the
    smallest vector counts. Null ids, and vectors that are null, empty, zero, or hold nulls or non-finite numbers, take
    no part; vectors of different lengths don't meet. A query without candidates has no rows.
    """
    x = F.col(vector)
    usable = F.col(id).isNotNull() & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    all_ = vectors.filter(usable).select(F.col(id).cast("long").alias("vec_id"), x.cast("array<double>").alias("v"))
    asked = queries.filter(usable).select(F.col(id).cast("long").alias("vec_id"), x.cast("array<double>").alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))
    seen = all_.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("width")).first()
    rows = max(1, BLOCK_CELLS // seen.width)
    columns = max(1, -(-seen.n // rows), min(seen.n // LEAST_ROWS, BLOCKS))
    lines = max(1, -(-asked.count() // rows))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = all_.select(F.lit(False).alias("query"), "vec_id", "v", block(columns).alias("column"), each(lines).alias("line"))
    asking = asked.select(F.lit(True).alias("query"), "vec_id", "v", each(columns).alias("column"), block(lines).alias("line"))
    dealt = candidates.unionByName(asking).select(F.concat_ws("/", F.size("v"), "line", "column").alias("tile"), "query", "vec_id", "v")
    found = dealt.repartition("tile").sortWithinPartitions("tile").mapInArrow(tidied(_tiles(k)), "query_id long, vec_id long, score double")
    return found.repartition("query_id").mapInArrow(tidied(_merged(k)), "query_id long, rank int, vec_id long, score double")
