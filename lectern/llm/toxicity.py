"""Toxicity: boosted trees over dense features of a whole text, with isotonic calibration.

The lexicon is learned from labelled documents: words and word beginnings whose presence goes with the label.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import calibrated, fit_forest, fit_isotonic
from .common import fold, least_hashed, materialise, tidied

#: Second persons of the languages at hand.
SECOND_PERSON = frozenset("you your yours yourself du dich dir dein deine ihr euch tu te toi ton ta tes vous votre tú ti tuyo vosotros usted".split())
#: Characters that stand in for letters.
LOOK_ALIKES = str.maketrans("0134578@$!|", "oieastbasil")

LETTERS = re.compile(r"[^\W\d_]+")
STAND_INS = re.compile(r"[0-9@$!|*]+")
UPPER = np.array([chr(c).isupper() for c in range(0x3000)])
FEATURES = ("hit_density", "hits", "hit_types", "near_person", "person_density", "capital_rate", "shout_rate", "punct_rate", "masked_rate", "spelled_rate", "repeat_rate", "hidden_hits", "log_words")
#: Lengths of the word beginnings that may enter the lexicon.
STEM_LENGTHS = (4, 5, 6)


def stems(words: set[str]) -> set[str]:
    """The words of four letters or more, and their beginnings of four to six letters followed by ``*``."""
    out = {w for w in words if len(w) >= 4}
    for n in STEM_LENGTHS:
        out |= {w[:n] + "*" for w in words if len(w) > n}
    return out


def _listed(word: str, lexicon: frozenset[str]) -> bool:
    return word in lexicon or any(len(word) > n and word[:n] + "*" in lexicon for n in STEM_LENGTHS)


def _masked(text: str) -> list[str]:
    """Tokens in which digits or signs stand between letters."""
    out, end = [], 0
    for m in STAND_INS.finditer(text):
        if m.start() >= end and m.start() and m.end() < len(text) and text[m.start() - 1].isalpha() and text[m.end()].isalpha():
            start, end = m.start(), m.end()
            while start and not text[start - 1].isspace():
                start -= 1
            while end < len(text) and not text[end].isspace():
                end += 1
            out.append(text[start:end])
    return out


def _spelled(words: list[str]) -> list[str]:
    """Runs of four single letters or more, put together."""
    single = np.flatnonzero(np.fromiter(map(len, words), np.int64, len(words)) == 1)
    runs = np.split(single, np.flatnonzero(np.diff(single) > 1) + 1) if len(single) else []
    return ["".join(words[i] for i in run) for run in runs if len(run) >= 4]


def features(text: str | None, lexicon: frozenset[str], heads: frozenset[str]) -> list[float]:
    """The dense features of one whole text, in the order of ``FEATURES``; zeros for null and empty.

    ``heads`` holds the first four letters of the lexicon's entries.
    """
    text = text or ""
    words = LETTERS.findall(text.lower())
    tokens = text.split()
    hits = [i for i, w in enumerate(words) if w[:4] in heads and _listed(w, lexicon)]
    persons = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    n, chars = max(1, len(words)), max(1, len(text))
    near = 0.0
    if hits and persons:
        at, to = np.array(hits), np.array([-99, *persons, 10**9])
        k = np.searchsorted(to, at)
        near = float(np.mean(np.minimum(to[k] - at, at - to[k - 1]) <= 5))
    masked, spelled = _masked(text), _spelled(words)
    hidden = [w for x in (*masked, *spelled) for w in LETTERS.findall(x.lower().translate(LOOK_ALIKES)) if w[:4] in heads and _listed(w, lexicon)]
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    capitals = int(UPPER[np.minimum(codes, len(UPPER) - 1)].sum())
    repeats = int(((codes[2:] == codes[1:-1]) & (codes[1:-1] == codes[:-2]) & (codes[2:] >= 65)).sum())
    shouts = sum(t.isupper() and len(t) > 2 for t in tokens)
    marks = sum(map(text.count, "!?*#$%&@"))
    return [
        len(hits) / n, float(len(hits)), float(len({words[i] for i in hits})), near, len(persons) / n, capitals / chars,
        shouts / n, marks / chars, len(masked) / n, len(spelled) / n, repeats / chars, float(len(hidden)), float(np.log1p(len(words))),
    ]


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[y].update(stems(set(LETTERS.findall((text or "").lower()))))
        for y in (0, 1):
            if counts[y]:
                yield pa.RecordBatch.from_arrays([pa.array(counts[y].keys(), pa.string()), pa.array([y] * len(counts[y]), pa.int32()), pa.array(counts[y].values(), pa.int64())], ["stem", "y", "n"])


def learn_lexicon(sample: DataFrame, size: int = 512, least_g: float = 25.0) -> frozenset[str]:
    """Stems with the largest likelihood ratio G2 that speak for the label 1; at most ``size`` rows reach the driver."""
    n0, n1 = (sample.agg(F.sum(1 - F.col("y")), F.sum("y")).first()) or (0, 0)
    if not n0 or not n1:
        return frozenset()
    counted = sample.select("text", "y").mapInArrow(tidied(_stem_counts), "stem string, y int, n long")
    a, b = F.col("a"), F.col("b")
    rate = (a + b) / F.lit(float(n0 + n1))
    part = lambda k, n: F.when(k > 0, k * F.log(k / (rate * n))).otherwise(0.0) + F.when(k < n, (n - k) * F.log((n - k) / ((1 - rate) * n))).otherwise(0.0)
    table = (
        counted.groupBy("stem").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"))
        .filter((a >= 3) & (a / float(n1) >= 20 * b / float(n0)))
        .withColumn("g", 2 * (part(a, float(n1)) + part(b, float(n0))))
        .filter(F.col("g") >= least_g)
        .orderBy(F.desc("g"), "stem").limit(size)
    )
    return frozenset(r.stem for r in table.select("stem").collect())


def bounded_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, modulus: int, held: int) -> DataFrame:
    """(doc_id, text, y) of at most ``bound`` labelled documents of each class outside the held-out fold.

    The documents with the smallest hashes of their ids are taken, so that the sample doesn't depend on the partitioning.
    A document whose labels contradict each other counts as 1; null labels don't count.
    """
    y = labels.filter(F.col(label).isNotNull() & (fold(modulus) != held)).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y")).filter(F.col("y").isin(0, 1))
    chosen = least_hashed(y, "y", bound)
    # At most two times the bound of pairs: the size is proven, so the texts needn't be dealt out.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = 6000, modulus: int = 5, held: int = 0) -> Callable[[list[str | None]], np.ndarray]:
    """A scorer of texts, fitted on at most ``bound`` labelled documents of each class outside the held-out fold.

    The trees learn from three quarters of the sample, the calibration from the rest. Without both classes in the
    sample, every score is the share of the one class (0.0 without labels).
    """
    # Written once: counts, stems and features read the bounded sample, not all texts again.
    sample = materialise(bounded_sample(docs, labels, label, bound, modulus, held), "labelled")
    lexicon = learn_lexicon(sample)
    heads = frozenset(s[:4] for s in lexicon)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t, lexicon, heads) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    got = sample.mapInArrow(tidied(rows), "doc_id long, y int, x array<double>").toArrow().sort_by("doc_id")
    y = got.column("y").to_numpy().astype(float)
    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return lambda texts: np.full(len(texts), share)
    x = np.array(got.column("x").to_pylist())
    rest = np.arange(len(y)) % 4 == 3
    forest = fit_forest(x[~rest], y[~rest])
    knots = fit_isotonic(forest.margin(x[rest]), y[rest]) if 0 < y[rest].sum() < rest.sum() else fit_isotonic(forest.margin(x), y)

    def score(texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return calibrated(forest.margin(np.array([features(t, lexicon, heads) for t in texts])), knots)

    return score


def score_texts(docs: DataFrame, scorer: Callable[[list[str | None]], np.ndarray], keep: list[str]) -> DataFrame:
    """The columns ``keep`` of each document, with its score.

    Empty and null texts get the score of a text without words. Repeated rows are scored alike. Columns of ``docs``
    that aren't in ``keep`` don't reach Python. ``keep`` mustn't hold a column named ``score``, which is an error.
    """
    if "score" in keep:
        raise ValueError("a column that is kept is named score")
    schema = docs.select(*keep).schema.add("score", "double")
    inner = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)], F.col("text").alias("_text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array(scorer(batch.column(len(keep)).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], score], [*keep, "score"])

    return inner.mapInArrow(tidied(rows), schema)
