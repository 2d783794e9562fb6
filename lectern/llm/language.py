"""Language identification by rank-order profiles of character n-grams and their out-of-place distance."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import least_hashed, materialise, tidied

#: N-grams of a profile, and documents of each language that a profile is learned from at most.
PROFILE, DOCUMENTS = 400, 2000
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of one to three characters as whole numbers, ascending, and their counts.

    Letters are lower-cased; a run of anything else is one space, also at the ends. A space alone is no n-gram, and
    three characters with a space in the middle are none, since they belong to two words.
    """
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes, letter = np.r_[32, np.where(letter, codes, 32), 32], np.r_[False, letter, False]
    keep = letter | np.r_[True, letter[:-1]]
    c, is_letter = codes[keep], letter[keep]
    two = c[:-1] << 21 | c[1:]
    three = (two[:-1] << 21 | c[2:])[is_letter[1:-1]]
    return np.unique(np.concatenate([c[is_letter], two, three]), return_counts=True)


def ranked(keys: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, ties by smaller key."""
    return keys[np.argsort(-counts, kind="stable")[:size]]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column(0).to_pylist()
        by: dict[str, list] = {}
        for lang, text in zip(langs, batch.column(1).to_pylist()):
            by.setdefault(lang, []).append(grams(text))
        for lang, got in by.items():
            keys, at = np.unique(np.concatenate([k for k, _ in got]), return_inverse=True)
            n = np.bincount(at, np.concatenate([c for _, c in got]), len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], ["lang", "gram", "n"])


def learn(docs: DataFrame, known: Column, documents: int = DOCUMENTS, size: int = PROFILE) -> dict[str, np.ndarray]:
    """The profile of each language, from at most ``documents`` of its documents for which ``known`` holds.

    Those with the smallest hashes of their ids are taken. Documents without an id, a language or a text teach nothing; a
    language whose documents have no letter isn't learned. ``docs`` has doc_id, text and lang. The languages' counts of
    documents, and a little more than their profiles, come to the driver.
    """
    ids = docs.filter(known & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang").distinct()
    ids = least_hashed(ids, "lang", documents)
    # At most ``documents`` ids of each language: the size is proven.
    sample = docs.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"]).select("lang", "text")
    # Dealt by n-gram, not by language: there are few languages, and one may have most documents.
    counted = sample.mapInArrow(tidied(_counted), "lang string, gram long, n long").repartition("gram").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = materialise(counted, "grams")
    found: dict[str, list[tuple[int, int]]] = {}
    for r in counted.groupBy("lang", "n").count().collect():
        found.setdefault(r.lang, []).append((r.n, r["count"]))
    least = []
    for lang, steps in found.items():
        total = 0
        for n, k in sorted(steps, reverse=True):
            total += k
            if total >= size:
                break
        least.append((lang, n))
    few = docs.sparkSession.createDataFrame(least, "lang string, least long")
    top = counted.join(F.broadcast(few), "lang").filter(F.col("n") >= F.col("least")).select("lang", "gram", "n").collect()
    out: dict[str, list] = {}
    for lang, gram, _ in sorted(top, key=lambda r: (r[0], -r[2], r[1])):
        out.setdefault(lang, []).append(gram)
    return {lang: np.array(keys[:size], np.int64) for lang, keys in out.items()}


class Guess:
    """The nearest profile of a text by the out-of-place distance, as a share of the largest possible one."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.size = size
        self.langs = sorted(profiles)
        self.sorted = [np.sort(profiles[lang]) for lang in self.langs]
        self.ranks = [np.argsort(profiles[lang], kind="stable") for lang in self.langs]

    def __call__(self, text: str | None) -> tuple[str, float]:
        keys, counts = grams(text)
        if not len(keys) or not self.langs:
            return UNKNOWN, 0.0
        own = ranked(keys, counts, self.size)
        place = np.arange(len(own))
        best, where = np.inf, 0
        for i, (known, ranks) in enumerate(zip(self.sorted, self.ranks)):
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            away = np.where(known[at] == own, np.minimum(np.abs(ranks[at] - place), self.size), self.size).sum()
            if away < best:
                best, where = away, i
        return self.langs[where], 1 - float(best) / (len(own) * self.size)


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], keep: list[str]) -> DataFrame:
    """The columns ``keep`` of each document, with ``lang_pred`` and ``score`` (1: the ranks of its whole profile agree).

    ``und`` with score 0 stands for null texts, texts without a letter, and for all texts if no language was learned;
    ties go to the first language by name. The text is read whole; no other column is an input. ``keep`` mustn't hold
    ``lang_pred`` or ``score``.
    """
    guess = Guess(profiles)
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    n = len(keep)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [guess(t) for t in batch.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*keep, "lang_pred", "score"])

    return docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)], F.col("text").alias("_text")).mapInArrow(tidied(rows), schema)
