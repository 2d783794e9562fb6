"""Byte-level BPE by public rank files, with every distinct pre-token of the corpus encoded once.

Texts are cut into pre-tokens, run by run of texts. Each run's distinct pre-tokens, and for every position in its texts
which of them stands there, are written once. The pre-tokens are then dealt out by hash, so that all occurrences of one
meet: it is encoded there once and its ids are joined back to every run that has it. The ids go back to their runs, and
the texts are put together by position.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .common import give_back, input_bytes, materialise, slices, tidied

#: Characters of a run of texts. A longer text is a run by itself.
RUN_CHARS = 16_000_000
#: Bytes of input for each bucket of pre-tokens, and the bounds of the buckets' number as powers of two.
BUCKET_BYTES, BUCKET_BITS = 8 << 20, (6, 14)
#: Positions that are packed or put together at once, and chunks whose pre-tokens a run remembers.
BLOCK, TOGETHER, REMEMBERED = 1 << 18, 1 << 18, 300_000

_TWO_SPACES = re.compile(r"\s\s")


@functools.cache
def default_rank_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=4)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@functools.lru_cache(maxsize=4)
def _bytes_of(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in _ranks(path).items()}


@functools.cache
def _pattern():
    import public_tokenizers

    return regex.compile(public_tokenizers.PATTERN)


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: the adjacent pair of lowest rank is merged, the leftmost first, until none has a rank."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) > 200:
        return _encode_long(piece, ranks)
    none = 1 << 60
    rank = ranks.get
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [rank(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pairs and (best := min(pairs)) < none:
        i = pairs.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = rank(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = rank(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _encode_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for long pieces, with a heap of pairs instead of repeated scans."""
    import heapq

    parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(r, i, parts[i] + parts[i + 1]) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if parts[i] is None or j >= len(parts) or parts[i] + parts[j] != pair:
            continue
        parts[i], parts[j], after[i] = pair, None, after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < len(parts) and (r := ranks.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (r, a, parts[a] + parts[b]))
    return [ranks[p] for p in parts if p is not None]


def chunks(text: str) -> tuple[str, list[str]]:
    """Parts of a text whose pre-tokens don't depend on one another: the first as it is, the others without the space
    that each begins with.

    If no two white spaces meet, a space always begins a pre-token, so that the text may be cut there. Another text is
    one part.
    """
    if _TWO_SPACES.search(text):
        return text, []
    parts = text.split(" ")
    return parts[0], parts[1:]


def pre_tokens(chunk: str) -> list[str]:
    """The pre-tokens of a part that a space begins; letters, maybe before one mark, need no pattern."""
    if chunk.isalpha():
        return [" " + chunk]
    if chunk[-1:] in {".", ",", "!", "?", ";", ":"} and chunk[:-1].isalpha():
        return [" " + chunk[:-1], chunk[-1]]
    return _pattern().findall(" " + chunk)


class Run:
    """The pre-tokens of a run of texts: each distinct one, and which of them stands at every position."""

    def __init__(self):
        self.words: dict[str, int] = {}
        self.chunks: dict[str, int] = {}
        # The words of all chunks one after another, and the first and the number of each chunk's.
        self.flat, self.first, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.positions: list[np.ndarray] = []
        self.lengths: list[int] = []
        self.chars = 0

    def _numbered(self, words: list[str]) -> list[int]:
        return [self.words.setdefault(w, len(self.words)) for w in words]

    def add(self, texts: list[str]) -> None:
        cut = [chunks(t) for t in texts]
        asked = set().union(*(parts for _, parts in cut)) if cut else set()
        missing = asked.difference(self.chunks)
        if len(self.chunks) + len(missing) > REMEMBERED:
            self.chunks, missing = {}, asked
            self.flat, self.first, self.size = self.flat[:0], self.first[:0], self.size[:0]
        self.chunks.update(zip(missing, range(len(self.chunks), len(self.chunks) + len(missing))))
        words = [self._numbered(pre_tokens(c)) for c in missing]
        size = np.fromiter(map(len, words), np.int64, len(words))
        self.first = np.r_[self.first, len(self.flat) + np.cumsum(size) - size]
        self.size = np.r_[self.size, size]
        self.flat = np.r_[self.flat, np.fromiter(chain.from_iterable(words), np.int32, int(size.sum()))]
        number = self.chunks.__getitem__
        for text, (head, parts) in zip(texts, cut):
            own = np.fromiter(map(number, parts), np.int64, len(parts))
            begin = np.array(self._numbered(_pattern().findall(head)), np.int32)
            self.positions.append(np.r_[begin, spread(self.flat, self.first[own], self.size[own])].astype(np.int32, copy=False))
            self.lengths.append(len(self.positions[-1]))
            self.chars += len(text)

    def packed(self, bits: int) -> tuple[list[tuple[int, bytes]], bytes, bytes, bytes]:
        """The words of each bucket, most frequent first and by their bytes; then, packed, the bucket of every word, the
        positions as ranks of words by frequency, and the texts' lengths in positions."""
        # The run is done: what only its making needs goes first.
        self.chunks.clear()
        self.flat, self.first, self.size = self.flat[:0].copy(), self.first[:0].copy(), self.size[:0].copy()
        words = [w.encode("utf-8", "surrogatepass") for w in self.words]
        self.words.clear()
        at = np.concatenate(self.positions) if self.positions else np.zeros(0, np.int32)
        self.positions.clear()
        count = np.bincount(at, minlength=len(words)).tolist()
        # Words of one count stand in order, since neighbours that begin alike pack well.
        order = sorted(range(len(words)), key=lambda i: (-count[i], words[i]))
        rank = np.empty(len(words), np.int32)
        rank[order] = np.arange(len(words))
        body = [words[i] for i in order]
        bucket = np.array([xxhash.xxh64_intdigest(w, 42) & ((1 << bits) - 1) for w in body], np.uint16)
        by = np.argsort(bucket, kind="stable")
        cut = np.flatnonzero(np.r_[True, np.diff(bucket[by].astype(np.int64)) > 0, True][: len(by) + 1]) if len(by) else np.zeros(1, np.int64)
        pack = zstandard.ZstdCompressor(level=6).compress
        rows = [(int(bucket[by[i]]), pack(_joined([body[k] for k in by[i:j].tolist()]))) for i, j in zip(cut[:-1], cut[1:])]
        np.take(rank, at, out=at)
        return rows, pack(bucket.tobytes()), coded(at), pack(np.array(self.lengths, np.int64).tobytes())


def coded(ranks: np.ndarray) -> bytes:
    """Ranks of words, most of them small, in few bytes: of each number its length and first three bits after the first as
    a symbol, all packed together, and the other bits as they are, block by block."""
    symbols, rest = [], []
    for i in range(0, len(ranks), BLOCK):
        v = ranks[i : i + BLOCK].astype(np.int64) + 1
        length = np.frexp(v.astype(np.float64))[1] - 1
        extra = np.maximum(length - 3, 0)
        symbols.append(np.where(length < 3, v, 8 * (length - 2) + (v >> extra) - 8).astype(np.uint8).tobytes())
        rest += [np.packbits(v[extra > k] >> k & 1).tobytes() for k in range(int(extra.max()))]
    head = zstandard.ZstdCompressor(level=3).compress(b"".join(symbols))
    return len(head).to_bytes(8, "little") + head + b"".join(rest)


def decoded(body: bytes) -> np.ndarray:
    """The ranks that ``coded`` packed."""
    n = int.from_bytes(body[:8], "little")
    symbols = np.frombuffer(zstandard.ZstdDecompressor().decompress(body[8 : 8 + n]), np.uint8)
    out = np.empty(len(symbols), np.int32)
    at = 8 + n
    for i in range(0, len(symbols), BLOCK):
        symbol = symbols[i : i + BLOCK].astype(np.int64)
        extra = np.maximum((symbol >> 3) - 1, 0)
        v = np.where(symbol < 8, symbol, ((symbol & 7) + 8) << extra)
        for k in range(int(extra.max())):
            some = np.flatnonzero(extra > k)
            size = -(-len(some) // 8)
            v[some] |= np.unpackbits(np.frombuffer(body, np.uint8, size, at), count=len(some)).astype(np.int64) << k
            at += size
        out[i : i + BLOCK] = v - 1
    return out


def spread(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The pieces of ``flat`` that begin at ``first`` and have the given sizes, one after another."""
    ends = np.cumsum(size)
    return flat[np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


def _joined(items: list[bytes]) -> bytes:
    """Their number, the bytes of a length, the lengths, and the items."""
    size = np.fromiter(map(len, items), np.int64, len(items))
    kind = np.uint8 if size.max(initial=0) < 256 else np.uint32
    return np.array([len(items), kind().itemsize], np.uint32).tobytes() + size.astype(kind).tobytes() + b"".join(items)


def _sizes(body: bytes) -> tuple[np.ndarray, int]:
    """The lengths of joined items, and where the first one begins."""
    n, width = np.frombuffer(body, np.uint32, 2).tolist()
    return np.frombuffer(body, np.uint8 if width == 1 else np.uint32, n, 8).astype(np.int64), 8 + n * width


def _split(body: bytes) -> list[bytes]:
    size, at = _sizes(body)
    ends = (np.cumsum(size) + at).tolist()
    return [body[i:j] for i, j in zip([at, *ends], ends)]


def id_type(ranks: dict[bytes, int]) -> type:
    """The narrowest type of whole numbers that holds the ids of a rank file."""
    return np.uint16 if max(ranks.values(), default=0) < 1 << 16 else np.int32


def bucket_bits(docs: DataFrame) -> int:
    """Bits of a bucket of pre-tokens, by Spark's estimate of the input: a task holds one bucket's distinct pre-tokens."""
    return min(max(BUCKET_BITS[0], (input_bytes(docs) // BUCKET_BYTES).bit_length()), BUCKET_BITS[1])


def _runs(bits: int, n: int, run_chars: int):
    """Rows (n other columns, text) to rows of two kinds: a bucket of a run's pre-tokens (run, bucket, words), and a run
    (run, the rows' other columns, the packed places of their pre-tokens)."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        number, run, held = 0, Run(), []

        def done() -> Iterator[pa.RecordBatch]:
            key = part << 32 | number
            buckets, place, positions, lengths = run.packed(bits)
            k = len(buckets)
            if k:
                yield pa.RecordBatch.from_arrays([pa.array([key] * k), pa.array([b for b, _ in buckets], pa.int32()), pa.array([w for _, w in buckets], pa.binary()), pa.nulls(k, kind), *[pa.nulls(k, pa.binary())] * 3], names)
            every = pa.chunked_array(held).combine_chunks()
            rest = pa.ListArray.from_arrays(pa.array([0, len(every)], pa.int32()), every)
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), rest, *(pa.array([x], pa.binary()) for x in (place, positions, lengths))], names)

        names = ["run", "bucket", "words", "rows", "place", "positions", "lengths"]
        kind = None
        for batch in slices(batches, 512):
            inner = pa.StructArray.from_arrays(batch.columns[:n], [f"c{i}" for i in range(n)]) if n else pa.StructArray.from_arrays([pa.nulls(batch.num_rows, pa.int32())], ["c0"])
            kind = pa.list_(inner.type)
            texts = batch.column(n).to_pylist()
            at = 0
            while at < len(texts):
                # A run ends before it would hold too many characters.
                to, chars = at, run.chars
                while to < len(texts) and (chars + len(texts[to]) <= run_chars or (to == at and not run.lengths)):
                    chars += len(texts[to])
                    to += 1
                if to > at:
                    run.add(texts[at:to])
                    held.append(inner.slice(at, to - at))
                    at = to
                if at < len(texts):
                    yield from done()
                    number, run, held = number + 1, Run(), []
                    give_back()
        if run.lengths:
            yield from done()

    return rows


def _encoded(path: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(run, bucket, words), sorted by bucket, to (run, bucket, ids): each distinct word is encoded once, and its ids
        are joined to every run that has it."""
        ranks = _ranks(path)
        kind = id_type(ranks)
        pack, unpack = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress
        now, known = None, {}
        for batch in batches:
            out = []
            for bucket, body in zip(batch.column(1).to_pylist(), batch.column(2)):
                if bucket != now:
                    now, known = bucket, {}
                words = _split(unpack(body.as_buffer()))
                for w in words:
                    if w not in known:
                        known[w] = np.array(encode_piece(w, ranks), kind).tobytes()
                out.append(pack(_joined([known[w] for w in words])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["run", "bucket", "ids"])

    return rows


def _put_together(names: list[str], path: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs with the ids of their words, (rows, place, positions, lengths, buckets), to the rows with their ids."""
        unpack = zstandard.ZstdDecompressor().decompress
        kind = id_type(_ranks(path))
        width = kind().itemsize
        for batch in batches:
            for i in range(batch.num_rows):
                inner = batch.column(0)[i].values
                place, lengths = (np.frombuffer(unpack(batch.column(k)[i].as_buffer()), t) for k, t in ((1, np.uint16), (3, np.int64)))
                positions = decoded(batch.column(2)[i].as_py())
                found = batch.column(4)[i]
                size, body = np.zeros(len(place), np.int64), []
                buckets = sorted(zip(found.values.field(0).to_pylist(), range(len(found.values)))) if found.is_valid else []
                if len(buckets) != len(np.unique(place)):
                    raise ValueError("a run's pre-tokens haven't all come back")
                for _, k in buckets:
                    got = unpack(found.values.field(1)[k].as_buffer())
                    own, at = _sizes(got)
                    body.append((own // width, np.frombuffer(got, kind, -1, at)))
                by = np.argsort(place, kind="stable")
                size[by] = np.concatenate([s for s, _ in body]) if body else 0
                flat = np.concatenate([f for _, f in body]).astype(np.int32) if body else np.zeros(0, np.int32)
                first = np.zeros(len(place), np.int64)
                first[by] = np.cumsum(size[by]) - size[by]
                ends = np.r_[0, np.cumsum(lengths)]
                at = 0
                while at < len(lengths):
                    to = max(at + 1, int(np.searchsorted(ends, ends[at] + TOGETHER, "right")) - 1)
                    own = positions[ends[at] : ends[to]]
                    ids, cut = spread(flat, first[own], size[own]), np.r_[0, np.cumsum(size[own])]
                    offsets = pa.array(cut[ends[at : to + 1] - ends[at]].astype(np.int32))
                    columns = [inner.field(k).slice(at, to - at) for k in range(len(names))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], [*names, "ids"])
                    at = to
                give_back()

    return rows


def encode(docs: DataFrame, text: str = "text", path: str | None = None, run_chars: int = RUN_CHARS) -> DataFrame:
    """``docs`` without the text, with ``ids``: the array of token ids of each whole text.

    Null and empty texts have no ids. Repeated rows each come back. Special tokens are ordinary text. Any other columns
    pass through, whatever their names, but for ``ids``. An empty table gives an empty one.
    """
    path = path or default_rank_file()
    others = [c for c in docs.columns if c != text]
    keyed = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(others)], F.coalesce(F.col(text), F.lit("")).alias("_text"))
    row = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.select(*[f"`{c}`" for c in others]).schema)]) if others else StructType().add("c0", "integer")
    shape = StructType().add("run", "long").add("bucket", "integer").add("words", "binary").add("rows", ArrayType(row)).add("place", "binary").add("positions", "binary").add("lengths", "binary")
    # Written once, so that a run is the same run for both that read it, whatever is lost.
    runs = materialise(keyed.mapInArrow(tidied(_runs(bucket_bits(docs), len(others), run_chars)), shape), "runs")
    words = runs.filter("bucket is not null").select("run", "bucket", "words")
    ids = words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidied(_encoded(path)), "run long, bucket int, ids binary")
    back = ids.groupBy("run").agg(F.collect_list(F.struct("bucket", "ids")).alias("buckets"))
    met = runs.filter("bucket is null").select("run", "rows", "place", "positions", "lengths").join(back, "run", "left")
    kept = StructType([*docs.select(*[f"`{c}`" for c in others]).schema, StructField("ids", ArrayType(IntegerType()))])
    return met.select("rows", "place", "positions", "lengths", "buckets").mapInArrow(tidied(_put_together(others, path)), kept)


def decode(encoded: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """``encoded`` with ``decoded``: the bytes of the ids, from the token-byte table, whose size the rank file fixes.

    Null ids give null, no ids give no bytes; an id that the table doesn't have is an error.
    """
    path = path or default_rank_file()
    names = [*encoded.columns, "decoded"]
    at = names.index(ids)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _bytes_of(path)
        tokens = [table.get(i) for i in range(max(table) + 1)]
        for batch in slices(batches):
            out = []
            for x in batch.column(at):
                out.append(None if not x.is_valid else b"".join(map(tokens.__getitem__, x.values.to_numpy(zero_copy_only=False).tolist())))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names)

    return encoded.mapInArrow(tidied(rows), encoded.select("*").schema.add("decoded", "binary"))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    both = decode(encode(docs.select("doc_id", "text"), path=path), path=path)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
