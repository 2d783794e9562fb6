"""Scores of whole texts under a bitwise context-mixing model and under word counts, both learned from a corpus.

All that the model learns comes from counts over the whole corpus: of its tokens and of the heads of its words (``mixing_model.Words``).
Texts are made of these units, so they give the counts of byte pairs that the model's prefix codes are made from, the number of
distinct contexts, by which the predictors' tables are sized, the counts in their slots, and the sums by which the mixer's weights are
fitted on all documents. Documents are dealt to two folds for that: each fold's decisions are met by the slots of the other one's
documents alone, so that the weights see texts that are new to the predictors. The model that scores has the slots of all.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .common import give_back, materialise, slices, tidied
from .mixing_model import CONTEXTS, LEAST, PASSES, REACH, Code, Distinct, Fit, Model, Units, Words, bytes_of, head_units, joined, packed_logits, slot_bits, slots, word_counts, word_units, words_of

END_TOKEN = b"\n"
#: Bytes of texts whose distinct units are worked out together, and units of the corpus that are taken at once.
TOGETHER, UNITS = 6_000_000, 8192
#: Rows of counts that a task holds before it adds them up, and units, about, whose passes find where the fit over all begins.
HELD, PART = 1_000_000, 250_000
#: Counts of a piece of the slots' table, and decisions that are gathered before they are packed into pieces.
PIECE, GATHERED = 1 << 20, 2_000_000
#: Tokens in the broadcast table of counts (twelve bytes each), and tokens that a worker remembers.
FREQUENT, REMEMBERED = 2_500_000, 300_000


def _together(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows whose texts, in column ``text``, have about TOGETHER bytes, with what the model sees of them."""
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch.column(text).cast(pa.binary())).fill_null(0).to_numpy(zero_copy_only=False))
        cut = [*np.flatnonzero(np.diff(size // TOGETHER, prepend=0)).tolist(), batch.num_rows]
        for a, b in zip([0, *cut], cut):
            if a < b:
                part = batch.slice(a, b - a)
                yield part, [joined(words_of(t)) for t in part.column(text).to_pylist()]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, fold) to (token, head, n, last, n1, last1): counts of tokens, also of those at a text's end, and of heads with a null token; n1 and last1 are of fold 1.

    Counts are added up over HELD rows before they travel.
    """
    names = ["n", "last", "n1", "last1"]
    held: dict[str, list[pa.Table]] = {"token": [], "head": []}

    def added() -> Iterator[pa.RecordBatch]:
        for key, tables in held.items():
            rows = pa.concat_tables(tables).group_by(key, use_threads=False).aggregate([(c, "sum") for c in names])
            tables.clear()
            empty = pa.nulls(rows.num_rows, pa.int64() if key == "token" else pa.binary())
            both = {"token": empty, "head": empty, key: rows[key]}
            yield from pa.table([*both.values(), *(rows[f"{c}_sum"] for c in names)], ["token", "head", *names]).to_batches(1 << 16)

    for part, texts in _together(batches, 0):
        found = Words(texts)
        fold = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        of = np.repeat(fold, np.diff(found.begins))
        count = lambda kind, n: np.bincount(kind * 2 + of, minlength=2 * n).reshape(n, 2)
        tokens, last = found.tokens()
        some = np.fromiter(map(bool, tokens), bool, len(tokens))
        n = np.r_[count(found.kind, len(tokens))[some], np.bincount(fold, minlength=2)[None]]
        coded = pa.array(found.heads).dictionary_encode()
        heads = coded.dictionary.to_numpy().view(np.int64)
        for key, values, n, last in (("token", pa.array([*filter(None, tokens), END_TOKEN], pa.binary()), n, np.r_[last[some], False]), ("head", pa.array(heads), count(coded.indices.to_numpy(), len(heads)), np.zeros(len(heads), bool))):
            whole, n1 = n.sum(axis=1), n[:, 1]
            held[key].append(pa.table([values, *(pa.array(x) for x in (whole, whole * last, n1, n1 * last))], [key, *names]))
        if sum(t.num_rows for tables in held.values() for t in tables) > HELD:
            yield from added()
    if held["token"]:
        yield from added()


def _units(batches: Iterator[pa.RecordBatch], fold: int | None = None) -> Iterator[tuple[Units, np.ndarray]]:
    """Counted tokens and heads to units, and how often each occurs in either fold. Words that are all in their heads have none; with a ``fold`` only its own."""
    for batch in slices(batches, UNITS):
        whole, all_last, n1, last1 = (c.to_numpy() for c in batch.columns[2:])
        n, last = np.c_[whole - n1, n1], np.c_[all_last - last1, last1]
        token = np.asarray(batch.column(0).is_valid())
        if not token.all():
            yield head_units(batch.column(1).filter(pa.array(~token)).to_numpy()), n[~token]
        words, at = bytes_of(batch.column(0)), np.flatnonzero(pc.binary_length(batch.column(0)).fill_null(0).to_numpy(zero_copy_only=False) >= REACH)
        for mark, times in ((b" ", n - last), (b"\n", last)):
            some = at[times[at].any(axis=1) if fold is None else times[at, fold] > 0]
            if len(some):
                yield word_units([words[i] + mark for i in some.tolist()]), times[some]


def _surveyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units to (context, pair, n): how often byte pairs occur, and of each predictor the partition's least hashes of contexts and next bytes."""
    distinct, pairs = Distinct(), np.zeros(65536, np.int64)
    for units, times in _units(batches):
        np.add.at(pairs, units.pair, np.repeat(times.sum(axis=1), np.diff(units.bounds)))
        distinct.add_bytes((units.pair & 255).astype(np.uint64), units.hashes)
    seen = np.flatnonzero(pairs)
    for k, key, n in ((-1, seen, pairs[seen]), *((k, x.astype(np.int64), np.ones(len(x), np.int64)) for k, x in enumerate(distinct.least))):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), k, np.int32)), pa.array(key), pa.array(n)], ["context", "pair", "n"])


def _packed(predictor: int, index: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts of both folds at ascending places of a predictor's table to pieces: the places' steps and the counts, packed."""
    pack = zstandard.ZstdCompressor(level=1)
    cut = np.searchsorted(index, np.arange(0, (int(index[-1]) // PIECE + 2) * PIECE, PIECE)) if len(index) else []
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(cut, cut[1:])) if a < b]
    body = [pack.compress(np.diff(index[a:b] - i * PIECE, prepend=0).astype(np.int32).tobytes() + count[:, a:b].astype(np.int32).tobytes()) for i, a, b in rows]
    yield pa.RecordBatch.from_arrays([pa.array([predictor << 20 | i for i, _, _ in rows], pa.int64()), pa.array(body, pa.binary())], ["piece", "body"])


def _slotted(code: Code, bits: list[int]):
    def packed(predictor: int, gathered: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        index, times = (np.concatenate(x) for x in zip(*gathered))
        gathered.clear()
        # Both folds' counts as one complex number, exact below 2 ** 53, which is added up much faster than rows of two.
        times = times.astype(np.float64).view(np.complex128)[:, 0]
        # Places and their order in one number, which sorts faster than places alone can be put in order.
        room = len(index).bit_length()
        key = np.sort(index << room | np.arange(len(index)))
        index, times = key >> room, times.take(key & (1 << room) - 1)
        new = np.flatnonzero(np.r_[True, index[1:] != index[:-1]][: len(index)])
        if len(new):
            yield from _packed(predictor, index[new], np.minimum(np.add.reduceat(times, new).view(np.float64).reshape(-1, 2), 1 << 30).T)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Units to pieces of the counts in the slots of all predictors. That of words takes whole tokens, each as if a space stood before it."""
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {k: [] for k in range(1, len(bits) + 1)}
        direct = np.zeros((2, 2 * code.nodes), np.int64)

        def full(least: int) -> Iterator[pa.RecordBatch]:
            for k, gathered in held.items():
                if gathered and sum(len(i) for i, _ in gathered) > least:
                    yield from packed(k, gathered)

        for batch in slices(batches, UNITS):
            for units, times in _units([batch]):
                at, step, _ = code.walk(units.pair)
                node, bit = (step >> 1).astype(np.uint64), step & 1
                often = np.repeat(times, np.diff(units.bounds), axis=0).take(at, axis=0)
                for fold in (0, 1):
                    direct[fold] += np.bincount(step, often[:, fold], direct.shape[1]).astype(np.int64)
                for k, h in enumerate(units.hashes[:-1]):
                    held[k + 1].append((slots(h, at, node, bits[k]) * 2 + bit, often))
            some = pc.and_(batch.column(0).is_valid(), pc.not_equal(batch.column(0), pa.scalar(END_TOKEN, pa.binary()))).fill_null(False)
            words = batch.filter(some)
            n, last, n1, last1 = (c.to_numpy() for c in words.columns[2:])
            for index, weight in word_counts(bytes_of(words.column(0)), np.c_[n - n1, n1], np.c_[last - last1, last1], code, bits[-1]):
                held[len(bits)].append((index, weight))
            yield from full(GATHERED)
        yield from full(0)
        some = np.flatnonzero(direct.any(axis=0))
        yield from _packed(0, some, np.minimum(direct[:, some], 1 << 30))

    return rows


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces to the packed logits of their sums: ``fit0`` and ``fit1`` of either fold's counts, and ``body`` of all."""
    held: dict[int, np.ndarray] = {}
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for k, body in zip(batch.column(0).to_pylist(), batch.column(1)):
            step, *count = np.frombuffer(unpack.decompress(body.as_buffer()), np.int32).reshape(3, -1)
            if k not in held:
                held[k] = np.zeros((2, PIECE), np.int64)
            at = np.cumsum(step)
            for fold, n in enumerate(count):
                held[k][fold, at] += n
    for k in list(held):
        sums = held.pop(k)
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), *(pa.array([packed_logits(x).tobytes()], pa.binary()) for x in (*sums, sums.sum(axis=0)))], ["piece", "fit0", "fit1", "body"])


def _fitted(units: DataFrame, models: list, start: np.ndarray) -> np.ndarray:
    """The weights that fit all units best, those of a fold met by the other's model; ``models`` are broadcast.

    Passes over some PART units find where the passes over all begin, which then are few; when these end is told by all units.
    """
    def sums(weights: np.ndarray, fold: int):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, total = models[1 - fold].value, 0
            for found, times in _units(batches, fold):
                total = total + model.unit_sums(found, times[:, fold], weights)
            value = np.ravel(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(value))), pa.array(value.astype(np.float64))], ["place", "value"])

        return rows

    shares, begin = max(1, units.count() // PART), start
    for some in [units.filter(F.pmod(F.xxhash64("token", "head"), F.lit(shares)) == 0), units] if shares > 1 else [units]:
        fit = Fit(start, begin)
        for _ in range(PASSES):
            parts = [some.filter("n > n1" if fold == 0 else "n1 > 0").mapInArrow(tidied(sums(fit.next, fold)), "place long, value double") for fold in (0, 1)]
            found = parts[0].unionByName(parts[1]).groupBy("place").agg(F.sum("value").alias("value")).toArrow()
            k = start.shape[1]
            total = np.zeros(start.shape[0] * (1 + k + k * k))
            place = found.column(0).to_numpy()
            total[place[place < len(total)]] = found.column(1).to_numpy()[place < len(total)]
            if not fit.take(total.reshape(start.shape[0], -1)):
                break
        begin = fit.begin()
    return fit.best.astype(np.float32)


def learn_model(units: DataFrame, pairs: np.ndarray, bits: list[int]) -> Model:
    """The model of the corpus whose tokens and heads are counted in ``units``, with 2 ** ``bits`` slots for the hashed predictors."""
    code = Code(pairs.reshape(256, 256))
    context = units.sparkSession.sparkContext
    slots = materialise(units.mapInArrow(tidied(_slotted(code, bits)), "piece long, body binary").repartition("piece").mapInArrow(tidied(_summed), "piece long, fit0 binary, fit1 binary, body binary"), "slots")
    empty = packed_logits(np.zeros(2, np.int32))[0]

    def filled(column: str) -> Model:
        model = Model(code, [np.full(n, empty, np.int16) for n in (65536, *[1 << b for b in bits])])
        for k, body in slots.select("piece", column).toLocalIterator():
            part = np.frombuffer(body, np.int16)
            at = (k & (1 << 20) - 1) * PIECE // 2
            table = model.tables[k >> 20]
            table[at : at + len(part)] = part[: len(table) - at]
        return model

    models = []
    for column in ("fit0", "fit1"):
        models.append(context.broadcast(filled(column)))
        give_back()
    start = np.full((Model.GATES, 1 + len(bits)), 1 / (1 + len(bits)))
    weights = _fitted(units, models, start)
    for m in models:
        m.destroy()
    model = filled("body")
    model.weights = weights
    return model


class TokenCounts:
    """Counts of tokens by their hashes: of all tokens that were counted ``least`` times or more."""

    def __init__(self, tokens: DataFrame):
        steps = tokens.groupBy(F.least(F.col("n"), F.lit(4096)).alias("n")).count().orderBy(F.desc("n")).collect()
        total, self.least = 0, 4097
        for r in steps:
            total += r["count"]
            if total > FREQUENT:
                break
            self.least = r.n

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = np.array([xxhash.xxh64_intdigest(t) for t in batch.column(0).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(codes), batch.column(1)], ["hash", "n"])

        got = tokens.filter(F.col("n") >= self.least).select("token", "n").mapInArrow(tidied(hashed), "hash long, n long").toArrow()
        hashes, n = (got.column(k).to_numpy() for k in (0, 1))
        order = np.argsort(hashes)
        self.hashes, self.n = hashes[order], n[order]

    def find(self, tokens: list[bytes]) -> np.ndarray:
        """The tokens' counts, -1 for those that aren't in the table."""
        if not len(self.hashes) or not tokens:
            return np.full(len(tokens), -1)
        asked = np.array([xxhash.xxh64_intdigest(t) for t in tokens], np.uint64).view(np.int64)
        order = np.argsort(asked)  # neighbours in the table are looked up one after another
        out = np.empty(len(asked), np.int64)
        near = asked[order]
        at = np.minimum(np.searchsorted(self.hashes, near), len(self.hashes) - 1)
        out[order] = np.where(self.hashes[at] == near, self.n[at], -1)
        return out


class Remembered:
    """Counts of tokens, of which those asked for again and again are kept."""

    def __init__(self, counts: TokenCounts):
        self.counts, self.memory = counts, {}

    def __call__(self, texts: list[list[bytes]]) -> dict[bytes, int]:
        asked = set().union(*texts) if texts else set()
        missing = [t for t in asked if t not in self.memory]
        if len(missing) + len(self.memory) > REMEMBERED:
            self.memory = {t: self.memory[t] for t in asked.difference(missing)}
        self.memory.update(zip(missing, self.counts.find(missing).tolist()))
        return self.memory


def score(docs: DataFrame, held_out, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    ``held_out`` is a boolean column; documents for which it is false or null are learned from. A text's tokens are its
    words, A-Z in lower case, and one end. ``base_score`` is the sum of log10((c + 1) / (N + V + 1)) over its tokens, c
    being a token's count, N all tokens and V the distinct ones learned from; ``score`` is the model's log10 probability
    of the text. Null and empty texts have their end only. Repeated rows count and come back each. An empty table gives
    an empty one; without a document to learn from, the model is uniform over its code.

    Counts come from a broadcast table of all tokens that occur often enough for its bound. What a token that it lacks was
    counted is known where the table lacks only those that occur once, and the document was learned from; it is 0 where
    it lacks none. Other occurrences are dealt out to their counts.
    """
    rows = docs.select(F.col(id).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    learned = rows.filter(~F.col("held_out")).select("text", F.pmod(F.xxhash64("id"), F.lit(2)).cast("int").alias("fold"))
    counts = [F.sum(c).alias(c) for c in ("n", "last", "n1", "last1")]
    units = materialise(learned.mapInArrow(tidied(_counted), "token binary, head long, n long, last long, n1 long, last1 long").groupBy("token", "head").agg(*counts), "units")
    tokens = units.filter("token is not null").select("token", "n", "last")
    survey = materialise(units.mapInArrow(tidied(_surveyed), "context int, pair long, n long").groupBy("context", "pair").agg(F.sum("n").alias("n")), "survey")
    pairs = np.zeros(65536, np.int64)
    for r in survey.filter("context = -1").collect():
        pairs[r.pair] = r.n
    least = [survey.filter(F.col("context") == k).select("pair").orderBy("pair").limit(LEAST).toArrow().column(0).to_numpy() for k in range(len(CONTEXTS))]
    bits = [slot_bits(k, x) for k, x in enumerate(least)]
    seen = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    share = float(np.log10(seen.n + seen.v + 1))
    table = TokenCounts(tokens)
    context = docs.sparkSession.sparkContext
    counts, model = context.broadcast(table), context.broadcast(learn_model(units, pairs, bits))
    least = table.least
    del table
    give_back()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Remembered(counts.value)
        for part, texts in _together(batches, 4):
            words = Words(texts)
            tokens, _ = words.tokens()
            found = find([tokens, [END_TOKEN]])
            of_kind = np.fromiter(map(found.__getitem__, tokens), np.int64, len(tokens))
            n, known, total, asked = [], [], [], []
            for own, a, b, held in zip(texts, words.begins, words.begins[1:], part.column(1).to_pylist()):
                c = np.r_[of_kind[words.kind[a:b]] if own else [], found[END_TOKEN]].astype(np.int64)
                rare: list[dict] = []
                missing = c < 0
                if missing.any():
                    if least <= 1 or (least == 2 and not held):
                        c[missing] = least - 1
                    else:
                        where = np.flatnonzero(missing)
                        own = own.split()
                        rare = [{"token": t, "times": k} for t, k in Counter(own[i] if i < len(own) else END_TOKEN for i in where).items()]
                        c[missing] = 0
                n.append(len(c))
                known.append(int((c > 0).sum()))
                total.append(float(np.log10(c + 1.0).sum()))
                asked.append(rare)
            del found
            columns = [pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(total, pa.float64()), pa.array(model.value.scores(words), pa.float64()), pa.array(asked, pa.list_(pa.struct([("token", pa.binary()), ("times", pa.int64())])))]
            yield pa.RecordBatch.from_arrays([*part.columns[:4], *columns], ["id", "held_out", "_k1", "_k2", "n_tokens", "known", "logs", "score", "rare"])

    keyed = rows.select("id", "held_out", F.xxhash64("id", "text").alias("_k1"), F.xxhash64("text", F.lit(1)).alias("_k2"), "text")
    rare_kind = ArrayType(StructType().add("token", "binary").add("times", "long"))
    schema = rows.select("id", "held_out").schema.add("_k1", "long").add("_k2", "long").add("n_tokens", "long").add("known", "long").add("logs", "double").add("score", "double").add("rare", rare_kind)
    main = keyed.mapInArrow(tidied(scored), schema)
    if least > 1:
        # One row for each token to look up, the first of a document standing for it; repeated rows are counted by it.
        parts = main.select("id", "held_out", "_k1", "_k2", "n_tokens", "known", "logs", "score", F.posexplode_outer("rare").alias("_pos", "_r"))
        met = parts.withColumn("token", F.col("_r.token")).join(tokens, "token", "left")
        times = F.coalesce(F.col("_r.times"), F.lit(0))
        one = F.count_if(F.coalesce("_pos", F.lit(0)) == 0)
        main = (
            met.groupBy("_k1", "_k2", "id", "held_out").agg(
                F.max("n_tokens").alias("n_tokens"), F.max("score").alias("score"), one.alias("_rows"),
                (F.max("known") + F.sum(F.when(F.col("n").isNotNull(), times).otherwise(0)) / one).cast("long").alias("known"),
                (F.max("logs") + F.sum(times * F.log10(F.coalesce("n", F.lit(0)) + 1.0)) / one).alias("logs"),
            ).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int"))))
        )
    base = F.col("logs") - F.col("n_tokens") * F.lit(share)
    return main.select(F.col("id").alias(id), "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(int(seen.n)).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
