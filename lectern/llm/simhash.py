"""Document fingerprints: SimHash of 128 bits, and the search for all fingerprints within a Hamming radius.

The terms of a text are its shingles of five words, A-Z in lower case (a shorter text's whole sequence is its term), and
a term weighs as often as it occurs. Each term's hash votes with its weight for or against every bit. Everything is
DataFrame functions.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lower_ascii, materialise, words_of

SIZE, BITS = 5, 128
_HALF = 32
#: Both lanes of 32 bits of a counter.
_LANES = 0x100000001
#: Documents of a range, and most ranges of one cut: the table of ranges is broadcast, so its size must have a bound.
BUCKET_ROWS, MOST_BUCKETS = 64, 200_000
#: Times that ranges which hold far too many documents are cut anew, and how many documents are far too many.
CUTS, FAR = 6, 8


def term_hashes(text: Column) -> Column:
    """Array of the hashes of a text's terms, one for each occurrence; a single null for a text without words."""
    words = words_of(lower_ascii(text))

    def of(w: Column) -> Column:
        shingle = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SIZE)])
        return (
            F.when(F.size(w) == 0, F.array(F.lit(None).cast("long")))
            .when(F.size(w) < SIZE, F.array(F.xxhash64(w)))
            .otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - SIZE), shingle))
        )

    # The words are named once: a filter of an array of one keeps Spark from splitting the text for each use.
    return F.get(F.transform(F.array(words), of), 0)


def _votes() -> list[Column]:
    """Sums over the rows of a group, two counters of set bits in each, then the number of votes."""
    hashes = (F.col("_h"), F.col("_g"))
    return [F.sum(F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_LANES))).alias(f"_v{j}_{k}") for j, h in enumerate(hashes) for k in range(_HALF)] + [F.count("_h").alias("_total")]


def _bits() -> Column:
    """The fingerprint as 32 hexadecimal digits: a bit is set if more than half of the votes are for it."""
    parts = []
    for j in range(2):
        word = None
        for k in range(_HALF):
            v = F.coalesce(F.col(f"_v{j}_{k}"), F.lit(0))
            for lane, n in ((k, v.bitwiseAND(F.lit(0xFFFFFFFF))), (k + _HALF, F.shiftrightunsigned(v, _HALF))):
                bit = F.shiftleft((2 * n > F.col("_total")).cast("long"), lane)
                word = bit if word is None else word.bitwiseOR(bit)
        parts.append(F.lpad(F.lower(F.hex(word)), 16, "0"))
    return F.concat(*parts)


def _words_of_hex(fingerprint: Column) -> list[Column]:
    """The fingerprint's four parts of 32 bits."""
    return [F.conv(F.substring(fingerprint, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def distance(a: Column, b: Column) -> Column:
    out = None
    for x, y in zip(_words_of_hex(a), _words_of_hex(b)):
        d = F.bit_count(x.bitwiseXOR(y))
        out = d if out is None else out + d
    return out


def likeness(a: Column, b: Column) -> Column:
    return 1 - distance(a, b) / F.lit(float(BITS))


def _fingerprinted(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` and the fingerprint of each row's text; the keys tell the rows apart."""
    hashed = texts.select(*keys, F.explode(term_hashes(F.col(text))).alias("_h")).withColumn("_g", F.when(F.col("_h").isNotNull(), F.xxhash64("_h")))
    return hashed.groupBy(*keys).agg(*_votes()).select(*keys, _bits().alias("fingerprint"))


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fingerprint) of every distinct (id, text); null, empty and blank texts have the fingerprint of zeros."""
    rows = docs.select(F.col(id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.withColumn("_key", F.xxhash64("_text"))
    return _fingerprinted(rows.dropDuplicates(["_id", "_key"]), ["_id", "_key"], "_text").select(F.col("_id").alias(id), "fingerprint")


Cut = tuple[int, int] | DataFrame


def _ranges(ids: DataFrame) -> tuple[list[Cut], DataFrame]:
    """The cuts of the ids into ranges, and (_range, _top) of the last ranges. The first cut is the least id and a width, a
    later one a table (_key, _lo, _width) of the ranges that are cut.

    A cut makes pieces of equal width, within the bounds of what is there; a piece that still holds far more than its
    share is cut again, so that a few ids far away from all others do no harm. Only bounds and counts are ever together.
    """
    seen = ids.agg(F.count("*").alias("n"), F.min("_id").alias("lo"), F.max("_id").alias("hi")).first()
    share = max(BUCKET_ROWS, -(-seen.n // MOST_BUCKETS))
    cuts: list[Cut] = []
    placed = ids.withColumn("_range", F.lit(""))
    if seen.n > FAR * share and seen.lo < seen.hi:
        cuts.append((seen.lo, -(-(seen.hi - seen.lo + 1) // min(MOST_BUCKETS, -(-seen.n // share)))))
        placed = _cut(placed, cuts[0])
    while True:
        found = materialise(placed.groupBy("_range").agg(F.count("*").alias("n"), F.min("_id").alias("lo"), F.max("_id").alias("hi")), "ranges")
        far = found.filter((F.col("n") > FAR * share) & (F.col("lo") < F.col("hi")))
        if not cuts or len(cuts) == CUTS or far.isEmpty():
            return cuts, found.select("_range", F.col("hi").alias("_top"))
        pieces = F.least(F.ceil(F.col("n") / share), F.lit(MOST_BUCKETS)).cast("decimal(38,0)")
        width = F.expr("CAST(hi AS DECIMAL(38,0)) - CAST(lo AS DECIMAL(38,0)) + 1")
        cuts.append(materialise(far.select(F.col("_range").alias("_key"), F.col("lo").alias("_lo"), F.ceil(width / pieces).cast("decimal(38,0)").alias("_width")), "cut"))
        placed = _cut(placed, cuts[-1])


def _cut(placed: DataFrame, cut: Cut) -> DataFrame:
    """``placed`` with ``_range`` made longer by the piece's number, in the ranges that are cut."""
    if isinstance(cut, tuple):
        return placed.withColumn("_range", F.expr(f"CAST((CAST(_id AS DECIMAL(38,0)) - CAST({cut[0]} AS DECIMAL(38,0))) DIV CAST({cut[1]} AS DECIMAL(38,0)) AS STRING)"))
    # At most ``MOST_BUCKETS`` ranges hold ``FAR`` times their share, by what the share is.
    met = placed.join(F.broadcast(cut), F.col("_range") == F.col("_key"), "left")
    piece = F.expr("CAST((CAST(_id AS DECIMAL(38,0)) - CAST(_lo AS DECIMAL(38,0))) DIV _width AS STRING)")
    return met.withColumn("_range", F.when(F.col("_lo").isNull(), F.col("_range")).otherwise(F.concat_ws("/", "_range", piece))).drop("_key", "_lo", "_width")


def neighbours(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_group, _tail, _id, _text, _next): each document and the text of the one that follows it in descending id.

    The first follows the last. Rows with the same id stand in order of their texts; null ids come last, in the order of
    a hash of their texts. Ids are cut into ranges; each range also gets the document that follows its last one, with
    ``_tail`` 1, so that no window sees more than a range. Only the ranges' bounds and one row for each are ever together.
    """
    rows = docs.select(F.col(id).cast("long").alias("_own"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    # Null ids are a line of their own, below all others: each has a place on it by its text.
    lines = (rows.filter(F.col("_own").isNull()).withColumn("_id", F.xxhash64("_text")), rows.filter(F.col("_own").isNotNull()).withColumn("_id", F.col("_own")))
    parts, ranges = [], None
    for line, own in enumerate(lines):
        cuts, found = _ranges(own.select("_id"))
        placed = own.withColumn("_range", F.lit(""))
        for cut in cuts:
            placed = _cut(placed, cut)
        name = F.concat_ws(":", F.lit(str(line)), "_range")
        parts.append(placed.withColumn("_range", name))
        found = found.select(F.lit(line).alias("_line"), name.alias("_range"), "_top")
        ranges = found if ranges is None else ranges.union(found)
    every = W.partitionBy(F.lit(0)).orderBy("_line", "_top")
    first = F.first("_range").over(every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    ranges = materialise(ranges.withColumn("_above", F.coalesce(F.lead("_range").over(every), first)).drop("_line"), "ranges")
    placed = parts[0].unionByName(parts[1]).join(F.broadcast(ranges), "_range")
    at = F.array(F.struct(F.col("_range").alias("group"), F.lit(0).alias("tail")))
    both = F.concat(at, F.array(F.struct(F.col("_above").alias("group"), F.lit(1).alias("tail"))))
    copied = placed.withColumn("_at", F.explode(F.when(F.col("_id") == F.col("_top"), both).otherwise(at)))
    copied = copied.select(F.col("_at.group").alias("_group"), F.col("_at.tail").alias("_tail"), F.col("_id").alias("_order"), F.col("_own").alias("_id"), "_text")
    order = W.partitionBy("_group").orderBy("_tail", F.col("_order").desc(), "_text")
    return copied.withColumn("_place", F.row_number().over(order)).withColumn("_next", F.lead("_text").over(order)).drop("_order")


def edited_fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of whole texts and of edited ones, with their likenesses.

    The edited text has its last third (rounded down, in code points) replaced by as many first code points of the next
    document in descending id, or all it has. Null texts count as empty. Rows with the same id and text come back as
    often as they are there. An empty table gives an empty one; columns but id and text aren't read.
    """
    near = neighbours(docs, id, text)
    n = F.length("_text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), n - third), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), third))
    keys = ["_group", "_place", "_tail", "_id", "_n", "_sha"]
    shown = near.withColumn("_n", n.cast("long")).withColumn("_edited", edited).withColumn("_sha", F.sha2("_edited", 256))
    version = F.when(F.col("_tail") == 0, F.array(F.struct(F.lit(0).alias("v"), F.col("_text").alias("t")), F.struct(F.lit(1).alias("v"), F.col("_edited").alias("t")))).otherwise(F.array(F.struct(F.lit(0).alias("v"), F.col("_text").alias("t"))))
    texts = shown.select(*keys, F.explode(version).alias("_x")).select(*keys, F.col("_x.v").alias("_v"), F.col("_x.t").alias("_t"))
    found = _fingerprinted(texts, [*keys, "_v"], "_t")
    both = found.groupBy(*keys).agg(F.max(F.when(F.col("_v") == 0, F.col("fingerprint"))).alias("fingerprint"), F.max(F.when(F.col("_v") == 1, F.col("fingerprint"))).alias("edited_fingerprint"))
    after = F.lead("fingerprint").over(W.partitionBy("_group").orderBy("_place"))
    return (
        both.withColumn("_after", after).filter("_tail = 0")
        .select(F.col("_id").alias(id), F.col("_n").alias("n_chars"), F.col("_sha").alias("edited_sha256"), "fingerprint", "edited_fingerprint",
                likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("_after")).alias("near_next"))
    )


def within(found: DataFrame, radius: int, blocks: int = 0, id: str = "doc_id") -> DataFrame:
    """(fingerprint, other, distance): all pairs of different fingerprints within the Hamming radius, each once.

    A fingerprint's 32 digits are cut into ``blocks`` blocks, more than the radius (two more by default). Fingerprints
    within the radius agree in all but ``radius`` blocks, so each choice of the other blocks gives a table in which the
    two meet. Documents with equal fingerprints are one row here, found again by joining on ``fingerprint``; null
    fingerprints are left out. Many blocks make longer keys and so fewer candidates, but more tables.
    """
    blocks = blocks or radius + 2
    if not radius < blocks <= 32:
        raise ValueError("blocks must be more than the radius and at most 32")
    cut = [round(i * 32 / blocks) for i in range(blocks + 1)]
    parts = [F.substring(F.col("fingerprint"), cut[i] + 1, cut[i + 1] - cut[i]) for i in range(blocks)]
    tables = F.array(*[F.concat(F.lit(f"{k}:"), *[parts[i] for i in kept]) for k, kept in enumerate(combinations(range(blocks), blocks - radius))])
    keyed = found.filter("fingerprint is not null").select("fingerprint").distinct().select("fingerprint", F.explode(tables).alias("key"))
    meet = keyed.join(keyed.select(F.col("fingerprint").alias("other"), "key"), "key").filter("fingerprint < other")
    return meet.select("fingerprint", "other").distinct().withColumn("distance", distance(F.col("fingerprint"), F.col("other"))).filter(F.col("distance") <= radius)
