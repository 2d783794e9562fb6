import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField(n, k) for n, k in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])
SYLLABLES = "ba ke li mo nu pra sto ven zi ro ta del fir".split()


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    out = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3))) + r.choice(["", "", "", ",", "."]) for _ in range(words)]
    return "".join(w + ("\n" if r.random() < 0.06 else " ") for w in out).strip()


def odd_rows() -> list[tuple]:
    """Rows with nulls, empty and blank texts, a very long text, copies, near copies and repeated ids."""
    base = [prose(i, 40 + 7 * i) for i in range(20)]
    near = base[3].split(" ")
    near[5] = "changed"
    texts = [*base, base[3], " ".join(near), base[3], "", None, "   \n\t ", "one two", "One TWO", prose(99, 60_000), base[7] + "\n" + base[8], "é 日本  x y 😀"]
    rows = [(i, t, ["en", "de", None][i % 3], f"src{i % 5}" if i % 6 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[4], (5, "another text under an id that is there", "en", "src1", 38), (None, base[2], "en", "src0", 5), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def plain(spark):
    """Documents with distinct ids and no nulls in them."""
    return spark.createDataFrame([r for i, r in enumerate(odd_rows()) if r[0] is not None and r[0] == i], DOCS)
