"""A bitwise context-mixing model of text, in numpy.

A text is its words, A-Z in lower case, with one space between them and one end mark. Each byte is a walk down a prefix
code that depends on the byte before it, so that a byte costs about three binary decisions instead of eight. At every
decision several predictors look up a slot by a hash of their context and the place in the code; a slot holds how often
the decision went either way in the training texts. Their logits are mixed by weights that a gate chooses by how much
the predictors have seen, and the weights are refined online, from segment to segment of each text.

What the predictors see of a byte is the four bytes before it and the word so far. So a text is a row of units whose
decisions depend on nothing else: a word's first four bytes together with the four before them, its head, and the rest of the
word. Units that occur again and again are worked out once.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard

END = 10
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: The hashed predictors and the least bits of their slots: the last two bytes, the last four, and the word so far.
CONTEXTS = (("order 2", 18), ("order 4", 21), ("word", 24))
#: Slots for each distinct pair of a context and its next byte: on half of check_s a pair has 2.2 (order 4) or 2.5 (word) decisions.
SLOTS_EACH = 3
#: Bytes before a byte that the predictors see, and as many end marks.
REACH, MARKS = 4, b"\n" * 4
#: Least hashes of pairs from which the distinct ones are counted.
LEAST = 1024
#: Decisions of a text's first segment and of its longest ones, to which they double, and the rate of the online refinement.
FIRST, SEGMENT, RATE = 256, 4096, 0.1
#: Passes that fit the mixer's weights at most, the share of the loss that another must promise, the pull towards the start, and the length of a gate's longest step.
PASSES, PROMISE, PULL, STRIDE = 8, 1e-3, 1.0, 1.0
#: Loss (in nats) by which a part of the units tells where a gate's weights begin.
ENOUGH = 1000.0
#: Units that are worked out at once, and texts whose decisions are laid out at once.
UNITS, RUN = 8192, 16


def bytes_of(column: pa.Array) -> list[bytes]:
    """The values of a binary column, much faster than by ``to_pylist``; what stands for null ones isn't said."""
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return [b""] * len(column)
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    body, at = data.slice(int(at[0]), int(at[-1] - at[0])).to_pybytes(), (at - at[0]).tolist()
    return [body[a:b] for a, b in zip(at, at[1:])]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def joined(words: list[bytes]) -> bytes:
    """The bytes that the model sees, without the end mark."""
    return b" ".join(words)


def _lengths(counts: np.ndarray) -> list[tuple[int, ...]]:
    """Paths of a Huffman code: for each byte its decisions, as 2 * node + bit."""
    heap: list = [(int(c), i, (i,)) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    left: dict[int, tuple] = {}
    node = 0
    paths: list[list[int]] = [[] for _ in range(256)]
    tie = 256
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        for s in x:
            paths[s].append(2 * node)
        for s in y:
            paths[s].append(2 * node + 1)
        heapq.heappush(heap, (a + b, tie, x + y))
        tie += 1
        node += 1
    return [tuple(reversed(p)) for p in paths]


class Code:
    """One prefix code for each byte that may come before; nodes are numbered through all codes."""

    def __init__(self, pairs: np.ndarray):
        """``pairs``: counts of (byte before, byte), 256 x 256. Every byte can be coded: each counts once more."""
        flat, start, length = [], np.zeros(65536, np.int64), np.zeros(65536, np.int64)
        for before in range(256):
            seen = pairs[before].sum() > 0
            paths = _lengths(pairs[before] * 64 + 1) if seen or before == 0 else None
            if paths is None:
                start[before * 256 : before * 256 + 256], length[before * 256 : before * 256 + 256] = start[:256], length[:256]
                continue
            for b, path in enumerate(paths):
                start[before * 256 + b], length[before * 256 + b] = len(flat), len(path)
                flat += [before * 512 + s for s in path]
        self.steps, self.start, self.length = np.array(flat, np.int32), start, length
        self.nodes = 256 * 256

    def walk(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For pairs (before * 256 + byte): each decision's byte position, node and bit; the ends of the bytes' walks."""
        n = self.length[pair]
        ends = np.cumsum(n)
        at = np.repeat(np.arange(len(pair)), n)
        step = self.steps[np.arange(len(at)) + (self.start[pair] - (ends - n))[at]]
        return at, step, ends


def contexts(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The byte before each byte, and the hashes of the other contexts, of texts laid end to end.

    Before a text stand end marks. ``begins`` has the texts' first positions.
    """
    n = len(data)
    x = data.astype(np.uint64)
    place = np.arange(n) - np.repeat(begins, np.diff(np.r_[begins, n]))
    back = []
    for k in range(1, 5):
        b = np.full(n, END, np.uint64)
        b[k:] = x[:-k]
        b[place < k] = END
        back.append(b)
    one = back[0]
    two = one | back[1] << np.uint64(8)
    four = two | back[2] << np.uint64(16) | back[3] << np.uint64(24)
    # The word so far: a rolling sum from the word's first byte on, which doesn't depend on what stands before it.
    fresh = (data == 32) | (data == END)
    first = np.zeros(n, np.int64)
    after = np.flatnonzero(fresh) + 1
    first[after[after < n]] = after[after < n]
    first[begins] = begins
    first = np.maximum.accumulate(first)
    return one.astype(np.int64), [_hashed(k, h) for k, h in enumerate((two, four, _rolled(data, np.arange(n), first)))]


def _rolled(data: np.ndarray, now: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rolling sums of the bytes from the positions ``first`` on and before the positions ``now``."""
    n = len(data)
    power = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data + np.uint64(ROLLED)) * power[0][:n], out=total[1:])
    return (total[now] - total[first]) * power[1][first] + (now - first).astype(np.uint64)


def _hashed(k: int, context: np.ndarray) -> np.ndarray:
    """Hashes of the contexts of the hashed predictor ``k``."""
    h = (context + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h


#: What the rolling sum adds to a byte, and its base.
ROLLED, BASE = 0x51ED27, 0xD1342543DE82EF95
_POWER: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    if not _POWER or len(_POWER[0]) < n:
        size = 1 << max(20, int(n).bit_length())
        base, inverse = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
        base[0] = inverse[0] = 1
        _POWER[:] = [np.multiply.accumulate(base), np.multiply.accumulate(inverse)]
    return _POWER


def slots(h: np.ndarray, at: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    """The slot of each decision: a product of the context's hash with the node's."""
    place = h.take(at)
    place += node
    place *= np.uint64(0xBF58476D1CE4E5B9)
    place >>= np.uint64(64 - bits)
    return place.view(np.int64)


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts end to end with their end marks, and their first positions."""
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return np.frombuffer(b"".join(t + b"\n" for t in texts), np.uint8), np.cumsum(lengths) - lengths


def count_pairs(texts: list[bytes]) -> np.ndarray:
    data, begins = laid_out(texts)
    before = np.r_[np.uint8(END), data[:-1]].astype(np.int64)
    before[begins] = END
    return np.bincount(before * 256 + data, minlength=65536)


_KEPT = np.array([(1 << 8 * (REACH + n)) - 1 for n in range(REACH)] + [(1 << 64) - 1], np.uint64)


class Words:
    """Words of texts, each with what ends it: a space, or end marks at the text's end, of which the model codes the first.

    ``kinds`` are the distinct ones, ``kind`` tells which of them each is, ``begins`` where each text's first one stands (with the number
    of all). ``heads`` has of each word the bytes before it and its first ones as a number. A text without words has an empty one.
    """

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(MARKS + b"".join(t + MARKS for t in texts) + bytes(REACH), np.uint8)
        stop = np.cumsum(np.fromiter((len(t) + REACH for t in texts), np.int64, len(texts))) + REACH
        first = np.r_[REACH, stop]
        n = int(first[-1])
        fresh = np.zeros(n + 1, bool)
        np.equal(data[:n], 32, out=fresh[1:])
        fresh[first] = True
        bounds = np.flatnonzero(fresh)
        self.begins = np.searchsorted(bounds, first)
        starts, ends = bounds[:-1], bounds[1:]
        lengths = ends - starts - (data[ends - 1] == END) * (REACH - 1)
        around = np.ndarray(n - REACH, "<u8", data, 0, (1,))
        self.heads = around[starts - REACH] & _KEPT[np.minimum(lengths, REACH)]
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])
        coded = words.dictionary_encode()
        self.kind, self.kinds = coded.indices.to_numpy(), bytes_of(coded.dictionary)

    def tokens(self) -> tuple[list[bytes], np.ndarray]:
        """The kinds without their ends, and whether each ends a text."""
        last = np.fromiter((w.endswith(MARKS) for w in self.kinds), bool, len(self.kinds))
        return [w[:-REACH] if z else w[:-1] for w, z in zip(self.kinds, last)], last


@dataclass
class Units:
    """Units' own bytes: each with the one before it as a pair (before * 256 + byte), the other contexts' hashes, and where each unit's begin, with the number of all."""

    pair: np.ndarray
    hashes: list[np.ndarray]
    bounds: np.ndarray


def _own_bytes(heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Heads as rows of bytes, and how many of the last REACH ones are a head's own."""
    b = heads.astype("<u8").view(np.uint8).reshape(-1, 2 * REACH)
    stop = (b[:, REACH:] == 32) | (b[:, REACH:] == END)
    return b, np.where(stop.any(axis=1), stop.argmax(axis=1) + 1, REACH)


def head_pairs(heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs and bounds of heads, as in ``Units``."""
    b, n = _own_bytes(heads)
    own = np.arange(REACH) < n[:, None]
    return b[:, REACH - 1 : -1][own] * np.int64(256) + b[:, REACH:][own], np.r_[0, np.cumsum(n)]


def head_units(heads: np.ndarray) -> Units:
    """Heads as units. Their words begin after the first REACH bytes, so that the contexts are parts of the number, and sums of few bytes."""
    b, n = _own_bytes(heads)
    own = np.arange(REACH) < n[:, None]
    turned = heads.astype(np.uint64).byteswap()
    four = np.stack([turned >> np.uint64(8 * (REACH - j)) & np.uint64(0xFFFFFFFF) for j in range(REACH)], axis=1)[own]
    word = np.zeros((len(heads), REACH), np.uint64)
    for j in range(1, REACH):
        word[:, j] = word[:, j - 1] + (b[:, REACH + j - 1] + np.uint64(ROLLED)) * np.uint64(pow(BASE, j - 1, 1 << 64)) + np.uint64(1)
    pair = (four & np.uint64(255)).astype(np.int64) * 256 + b[:, REACH:][own]
    return Units(pair, [_hashed(k, h) for k, h in enumerate((four & np.uint64(0xFFFF), four, word[own]))], np.r_[0, np.cumsum(n)])


def word_bytes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with one byte that ends each, laid end to end, their lengths, and the first positions of the words that the bytes are of."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer(b"".join(words), np.uint8), n, np.repeat(np.cumsum(n) - n, n)


def _rest(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words' bytes, the positions of those after the first REACH of each, the first positions of their words, and where each word's begin among them."""
    data, n, first = word_bytes(words)
    own = np.flatnonzero(np.arange(len(data)) - first >= REACH)
    return data, own, first[own], np.r_[0, np.cumsum(np.maximum(n - REACH, 0))]


def word_pairs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs and bounds of words, as in ``Units``."""
    data, own, _, bounds = _rest(words)
    return data[own - 1] * np.int64(256) + data[own], bounds


def word_units(words: list[bytes]) -> Units:
    """The rests of words after their heads as units; those of shorter words are empty."""
    data, own, first, bounds = _rest(words)
    around = np.ndarray(max(len(data) - REACH + 1, 0), "<u4", data, 0, (1,))
    four = around[own - REACH].byteswap().astype(np.uint64)
    pair = (four & np.uint64(255)).astype(np.int64) * 256 + data[own]
    return Units(pair, [_hashed(k, h) for k, h in enumerate((four & np.uint64(0xFFFF), four, _rolled(data, own, first)))], bounds)


class Distinct:
    """The least hashes of the pairs (context, next byte) of each hashed predictor; those of parts give those of a corpus."""

    def __init__(self):
        self.least = [np.zeros(0, np.uint64) for _ in CONTEXTS]

    def add(self, texts: list[bytes]) -> None:
        data, begins = laid_out(texts)
        self.add_bytes(data, contexts(data, begins)[1])

    def add_bytes(self, data: np.ndarray, hashes: list[np.ndarray]) -> None:
        for k, h in enumerate(hashes):
            old = self.least[k]
            pair = (h + data) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(1)
            if len(old) == LEAST:
                pair = pair[pair < old[-1]]
            if len(pair):
                self.least[k] = np.unique(np.r_[old, pair])[:LEAST]


def slot_bits(k: int, least: np.ndarray) -> int:
    """Bits of the slots of a hashed predictor, by the least hashes of the corpus's pairs; they grow with the corpus."""
    distinct = len(least) if len(least) < LEAST else (LEAST - 1) * 2.0**63 / float(least[LEAST - 1])
    return max(CONTEXTS[k][1], math.ceil(math.log2(max(1, SLOTS_EACH * distinct))))


def word_decisions(words: list[bytes], inside: np.ndarray, after: np.ndarray, mark: bytes, code: Code, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of counts of the predictor of words, as 2 * slot + bit, with the counts of distinct words and of a mark after them. Counts may have several columns."""
    data, lengths, first = word_bytes([w + mark for w in words])
    now = np.arange(len(data))
    before = np.where(now == first, np.uint8(32), np.r_[np.uint8(32), data[:-1]])
    weight = np.repeat(inside, lengths, axis=0)
    weight[np.cumsum(lengths) - 1] = after
    at, step, _ = code.walk(before * np.int64(256) + data)
    weight = weight.take(at, axis=0)
    some = weight.reshape(len(weight), -1).any(axis=1)
    node, bit = (step >> 1).astype(np.uint64), step & 1
    index = slots(_hashed(len(CONTEXTS) - 1, _rolled(data, now, first)), at, node, bits) * 2 + bit
    return index[some], np.minimum(weight[some], 1 << 30)


def word_counts(words: list[bytes], times: np.ndarray, ends: np.ndarray, code: Code, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Decisions of distinct words that occur ``times``, ``ends`` of which at a text's end; both may have several columns."""
    if not words:
        return
    yield word_decisions(words, times, times - ends, b" ", code, bits)
    last = np.flatnonzero(ends.reshape(len(words), -1).any(axis=1))
    if len(last):
        yield word_decisions([words[i] for i in last], np.zeros_like(ends[last]), ends[last], b"\n", code, bits)


@dataclass
class Counts:
    """How often a slot's decision was 0 and 1: of each node of the code, and of each hashed predictor's slots."""

    bits: tuple[int, ...] = tuple(b for _, b in CONTEXTS)

    direct: np.ndarray = field(default_factory=lambda: np.zeros(2 * 65536, np.int32))
    hashed: list[np.ndarray] = field(init=False)

    def __post_init__(self):
        self.hashed = [np.zeros(2 << bits, np.int32) for bits in self.bits]

    def add(self, texts: list[bytes], code: Code) -> None:
        """Texts for all predictors but that of words."""
        data, begins = laid_out(texts)
        one, hashes = contexts(data, begins)
        at, step, _ = code.walk(one * 256 + data)
        self.direct += np.bincount(step, minlength=len(self.direct)).astype(np.int32)
        node, bit = (step >> 1).astype(np.uint64), (step & 1).astype(np.int64)
        for count, h, bits in zip(self.hashed, hashes[:-1], self.bits):
            np.add.at(count, slots(h, at, node, bits) * 2 + bit, np.int32(1))

    def add_words(self, words: list[bytes], times: np.ndarray, code: Code, end: float | np.ndarray) -> None:
        """Distinct words with their counts for the predictor of words, which sees nothing else of a text: ``end`` has
        how many of each are followed by the end mark, or is the share that is; the others are followed by a space."""
        ends = end if isinstance(end, np.ndarray) else np.floor(times * end + 0.5).astype(np.int64)
        for index, weight in word_counts(words, times, ends, code, self.bits[-1]):
            np.add.at(self.hashed[-1], index, weight.astype(np.int32))

    def parts(self) -> list[np.ndarray]:
        return [self.direct, *self.hashed]


def packed_logits(count: np.ndarray) -> np.ndarray:
    """A slot as one number: the logit in steps of 1/256 above two bits that tell how much the slot has seen."""
    n0, n1 = count[0::2].astype(np.float32), count[1::2].astype(np.float32)
    logit = np.log((n1 + np.float32(0.1)) / (n0 + np.float32(0.1)))
    seen = np.digitize(n0 + n1, (1, 4, 32)).astype(np.int16)
    return (np.clip(np.rint(logit * 256), -8000, 8000).astype(np.int16) << 2 | seen).astype(np.int16)


class Fit:
    """Weights of gates that lessen a loss: Newton steps by sums over all decisions, halved for a gate whose loss grew. They begin at ``begin`` and are pulled to ``start``."""

    def __init__(self, start: np.ndarray, begin: np.ndarray | None = None):
        begin = start if begin is None else begin
        self.start, self.best, self.next = start.astype(np.float64), begin.astype(np.float64), begin.astype(np.float64)
        self.loss = np.full(len(start), np.inf)

    def take(self, sums: np.ndarray) -> bool:
        """Takes the sums (``Model.sums``) under the weights ``next``; whether another pass is worth while. If not, the last small steps are taken as well."""
        k = self.start.shape[1]
        away = self.next - self.start
        loss = sums[:, 0] + PULL / 2 * (away**2).sum(axis=1)
        better = loss <= self.loss
        worse = np.where(better, 0, loss - self.loss).sum()
        self.best[better], self.loss[better] = self.next[better], loss[better]
        slope = sums[:, 1 : k + 1] + PULL * away
        step = -np.linalg.solve(sums[:, k + 1 :].reshape(-1, k, k) + PULL * np.eye(k), slope[:, :, None])[:, :, 0]
        promised = np.where(better, -(slope * step).sum(axis=1) / 2, 0).sum()
        # A gate with few decisions, all of them sure, would take a step far beyond them.
        step *= np.minimum(1, STRIDE / np.maximum(np.linalg.norm(step, axis=1, keepdims=True), 1e-9))
        more = bool(promised + worse > PROMISE * self.loss.sum())
        self.next = np.where(better[:, None], self.next + step, (self.best + self.next) / 2 if more else self.best)
        if not more:
            self.best = self.next
        return more

    def begin(self) -> np.ndarray:
        """Where a fit over more units begins: at the best weights of gates that lost ENOUGH here."""
        return np.where(self.loss[:, None] >= ENOUGH, self.best, self.start)


class Model:
    """The predictors' slots and the mixer's weights: one row for each gate."""

    GATES = 4 ** len(CONTEXTS)

    def __init__(self, code: Code, tables: list[np.ndarray]):
        self.code, self.tables = code, tables
        self.weights = np.full((self.GATES, len(tables)), 1 / len(tables), np.float32)

    def __getstate__(self) -> dict:
        """Tables travel packed: most of their slots are empty."""
        pack = zstandard.ZstdCompressor(level=1)
        return self.__dict__ | {"tables": [pack.compress(t) for t in self.tables]}

    def __setstate__(self, state: dict) -> None:
        unpack = zstandard.ZstdDecompressor()
        self.__dict__.update(state, tables=[np.frombuffer(unpack.decompress(t), np.int16) for t in state["tables"]])

    def _looked_up(self, at: np.ndarray, step: np.ndarray, hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Logits (predictor x decision) and gates of decisions at bytes with these hashes."""
        node = (step >> 1).astype(np.uint64)
        logits = np.empty((len(self.tables), len(step)), np.float32)
        packed = self.tables[0].take(step >> 1)
        logits[0] = packed >> 2
        gate = np.zeros(len(step), np.int16)
        for k, h in enumerate(hashes, 1):
            packed = self.tables[k].take(slots(h, at, node, len(self.tables[k]).bit_length() - 1))
            logits[k] = packed >> 2
            gate <<= 2
            gate |= packed & 3
        logits *= np.float32(1 / 256)
        return logits, gate

    def _inputs(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Logits (predictor x decision), gates and bits of all decisions, and where each text's begin."""
        data, begins = laid_out(texts)
        one, hashes = contexts(data, begins)
        at, step, ends = self.code.walk(one * 256 + data)
        logits, gate = self._looked_up(at, step, hashes)
        return logits, gate, step & 1, np.r_[0, ends][begins]

    def sums(self, logits: np.ndarray, gate: np.ndarray, bit: np.ndarray, times: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each gate the loss, its slope and its curvature by the weights, over decisions that occur ``times``."""
        k = len(self.tables)
        order = np.argsort(gate, kind="stable")
        cut = np.searchsorted(gate[order], np.arange(self.GATES + 1))
        x, n = np.take(logits, order, axis=1), np.diff(cut)
        x *= (1 - 2 * bit[order]).astype(np.float32)
        z = sum(np.repeat(weights[:, i].astype(np.float32), n) * x[i] for i in range(k))
        e = np.exp(np.minimum(z, np.float32(80)))
        one, times = e + np.float32(1), times[order].astype(np.float32)
        slope = times * e / one
        bend, loss = slope / one, times * np.log(one)
        out = np.zeros((self.GATES, 1 + k + k * k))
        for g in np.flatnonzero(n):
            own = x[:, cut[g] : cut[g + 1]]
            out[g, 0] = loss[cut[g] : cut[g + 1]].sum()
            out[g, 1 : k + 1] = own @ slope[cut[g] : cut[g + 1]]
            out[g, k + 1 :] = ((own * bend[cut[g] : cut[g + 1]]) @ own.T).ravel()
        return out

    def unit_sums(self, units: Units, times: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The same over units, each of which occurs ``times``."""
        at, step, _ = self.code.walk(units.pair)
        return self.sums(*self._looked_up(at, step, units.hashes), step & 1, np.repeat(times, np.diff(units.bounds))[at], weights)

    def train(self, texts: list[bytes]) -> None:
        """The weights that fit some texts best."""
        fit = Fit(self.weights)
        for _ in range(PASSES):
            sums = np.zeros((self.GATES, 1 + len(self.tables) * (1 + len(self.tables))))
            for i in range(0, len(texts), 16):
                logits, gate, bit, _ = self._inputs(texts[i : i + 16])
                sums += self.sums(logits, gate, bit, np.ones(len(bit)), fit.next)
            if not fit.take(sums):
                break
        self.weights = fit.best.astype(np.float32)

    def _lengths(self, pair: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Each unit's number of decisions."""
        return np.diff(np.r_[0, np.cumsum(self.code.length[pair])][bounds])

    def _signed(self, units: Units, out: np.ndarray) -> None:
        """Of each decision of units the mixed logit, in the first two places, and the predictors' in steps of 1/256, all with the sign of what didn't happen."""
        at, step, _ = self.code.walk(units.pair)
        logits, gate = self._looked_up(at, step, units.hashes)
        logits *= (1 - 2 * (step & 1)).astype(np.float32)
        gate = gate.astype(np.int64)
        mixed = np.zeros(len(gate), np.float32)
        for x, w in zip(logits, np.ascontiguousarray(self.weights.T)):
            mixed += w.take(gate) * x
        out[:, :2].view(np.float32)[:, 0] = mixed
        logits *= np.float32(256)
        out[:, 2:] = logits.T

    def log10(self, texts: list[bytes]) -> np.ndarray:
        """log10 of the probability of each text with its end mark."""
        return self.scores(Words(texts)) if texts else np.zeros(0)

    def scores(self, words: Words) -> np.ndarray:
        """``log10`` of the texts that the words come from."""
        coded = pa.array(words.heads).dictionary_encode()
        heads = coded.dictionary.to_numpy()
        # Short words have no unit of their own besides the head: theirs is empty.
        kinds = [w if len(w) <= REACH else w[: 1 - REACH] if w.endswith(MARKS) else w for w in words.kinds]
        parts = [(head_pairs, head_units, heads[i : i + UNITS]) for i in range(0, len(heads), UNITS)] + [(word_pairs, word_units, kinds[i : i + UNITS]) for i in range(0, len(kinds), UNITS)]
        length = np.concatenate([self._lengths(*pairs(some)) for pairs, _, some in parts])
        last = np.r_[0, np.cumsum(length)]
        table, i = np.empty((last[-1], 2 + len(self.tables)), np.int16), 0
        for _, units, some in parts:
            self._signed(units(some), table[last[i] : last[i + len(some)]])
            i += len(some)
        # Units' rows are copied as blocks of bytes, which is much faster than to pick decisions one by one.
        blocks = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(last * (table.shape[1] * table.itemsize)), pa.py_buffer(table)])
        unit = np.stack([coded.indices.to_numpy(), words.kind + len(heads)], axis=1).ravel()
        begins = words.begins * 2
        after = np.r_[0, np.cumsum(length[unit])][begins]
        out = np.zeros(len(begins) - 1)
        for a in range(0, len(out), RUN):
            b = min(a + RUN, len(out))
            taken = np.frombuffer(blocks.take(pa.array(unit[begins[a] : begins[b]])).buffers()[2], np.int16).reshape(-1, table.shape[1])
            out[a:b] = self._refined(taken, after[a : b + 1] - after[a])
        return out / np.log(10)

    def _refined(self, rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probabilities of texts, whose decisions (``_signed``) begin at ``bounds``; their segments of one place are worked out together."""
        mixed, out = rows[:, :2].view(np.float32)[:, 0], np.zeros(len(bounds) - 1)
        # The weights' moves and their steps are for logits in steps of 1/256.
        moves = np.zeros((len(out), rows.shape[1] - 2), np.float32)
        lo, size, live = bounds[:-1].copy(), FIRST, np.arange(len(out))
        while len(live):
            first, stop = lo[live], bounds[live + 1]
            hi = np.minimum(first + size, stop)
            cut = np.r_[0, np.cumsum(hi - first)]
            z, inputs = np.empty(cut[-1], np.float32), {}
            for t, a, b, i, j in zip(live.tolist(), first.tolist(), hi.tolist(), cut.tolist(), cut[1:].tolist()):
                z[i:j] = mixed[a:b]
                if size > FIRST or b < bounds[t + 1]:
                    inputs[t] = x = np.ascontiguousarray(rows[a:b, 2:].T, np.float32)
                    if size > FIRST:
                        z[i:j] += moves[t] @ x
            e = np.exp(np.minimum(z, np.float32(80), out=z), out=z)
            one = e + np.float32(1)
            e /= one
            out[live] -= np.add.reduceat(np.log(one, out=one), cut[:-1], dtype=np.float64)
            more = hi < stop
            for t, i, j in zip(live[more].tolist(), cut[:-1][more].tolist(), cut[1:][more].tolist()):
                moves[t] -= np.float32(RATE / size / 65536) * (inputs[t] @ e[i:j])
            lo[live] = hi
            live, size = live[more], min(2 * size, SEGMENT)
        return out
