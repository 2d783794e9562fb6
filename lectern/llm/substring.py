"""Removal of repeated lines and sentences: each distinct unit stays where it occurs first.

Units are whole lines and the sentences inside them, since a passage is often pasted into the middle of a line. They are
compared by a digest of their normalised text. What is removed is reported by its offsets in the original text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices, tidied

#: Units of fewer words are never removed: short ones repeat by chance and carry no passage.
LEAST_LINE, LEAST_SENTENCE = 4, 6

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORD = re.compile("[^\x20\x09-\x0d]+")
#: White space that str.split knows and words may contain.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SENTENCE = re.compile("[^.!?]+[.!?]*|[.!?]+")


def spans(text: str | None, least_line: int = LEAST_LINE, least_sentence: int = LEAST_SENTENCE) -> Iterator[tuple[int, int, str]]:
    """(start, end, normalised text) of each unit. A line's span has its line break; the normalised text has lower-case
    A-Z and one space between words."""
    text = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")
    words_of = _WORD.findall if _OTHER_SPACE.search(text) else str.split
    start = 0
    for line in text.split("\n"):
        words = words_of(line)
        if len(words) >= least_line:
            yield start, min(start + len(line) + 1, len(text)), " ".join(words)
        if len(words) >= least_sentence:
            for m in _SENTENCE.finditer(line):
                own = words_of(m[0])
                if len(own) >= least_sentence:
                    yield start + m.start(), start + m.end(), " ".join(own)
        start += len(line) + 1


def _units(least_line: int, least_sentence: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, starts, ends, a, b = [], [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for start, end, unit in spans(text, least_line, least_sentence):
                    digest = hashlib.blake2b(unit.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    ids.append(i)
                    starts.append(start)
                    ends.append(end)
                    a.append(int.from_bytes(digest[:8], "big", signed=True))
                    b.append(int.from_bytes(digest[8:], "big", signed=True))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["id", "start", "end", "d1", "d2"])

    return rows


def repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", least_line: int = LEAST_LINE, least_sentence: int = LEAST_SENTENCE) -> DataFrame:
    """(id, removed): the spans of the units of each document that occurred before, in order of id and offset.

    The first occurrences come from a partial aggregate, and the join with them can be split, so that a unit that a
    third of all documents hold meets no single task.
    """
    texts = docs.filter(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    units = materialise(texts.mapInArrow(tidied(_units(least_line, least_sentence)), "id long, start int, end int, d1 long, d2 long"), "units")
    first = units.groupBy("d1", "d2").agg(F.min(F.struct("id", "start")).alias("first"), F.max(F.struct("id", "start")).alias("last")).filter("first <> last")
    later = units.join(first.select("d1", "d2", "first"), ["d1", "d2"]).filter((F.col("id") != F.col("first.id")) | (F.col("start") != F.col("first.start")))
    return later.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("removed"))


def cut(text: str, removed: list) -> str:
    out, at = [], 0
    for start, end in removed:
        if start > at:
            out.append(text[at:start])
        at = max(at, end)
    return "".join([*out, text[at:]])


def deduplicate(docs: DataFrame, id: str = "doc_id", text: str = "text", least_line: int = LEAST_LINE, least_sentence: int = LEAST_SENTENCE) -> DataFrame:
    """``docs`` with the text left of each document, and ``_removed``: an array of (start, end) in code points of the
    original text, in order, where spans of sentences may lie in those of lines; null if nothing was removed.

    A document without repeats keeps its text as it is, null and empty included; one whose units were all removed keeps
    what is left, maybe nothing. The smallest id keeps a unit, and within a document its first occurrence. Rows with
    the same id count as one document whose texts lie over one another: what is removed from one at some offset is
    removed from all. Rows with a null id are neither changed nor compared. Other columns pass through, whatever their
    names but for ``_removed`` and ``_id``. An empty table gives an empty one.
    """
    found = repeats(docs, id, text, least_line, least_sentence).select(F.col("id").alias("_id"), F.col("removed").alias("_removed"))
    joined = docs.join(found, F.col(id) == F.col("_id"), "left").drop("_id")
    schema = joined.schema
    at, spans_at = joined.columns.index(text), len(joined.columns) - 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            left = batch.column(at).to_pylist()
            for k, removed in enumerate(batch.column(spans_at).to_pylist()):
                if removed is not None and left[k] is not None:
                    left[k] = cut(left[k], [(r["start"], r["end"]) for r in removed])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return joined.mapInArrow(tidied(rows), schema)


_CLEAN = "trim(regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+', ' ', 'g'))"
_WORDS = "len(regexp_extract_all({0}, '[^\\x20\\x09-\\x0D]+'))"


def sql(docs: str, name: str = "deduped", least_line: int = LEAST_LINE, least_sentence: int = LEAST_SENTENCE) -> str:
    """Common table expressions, the last of them ``name`` (doc_id, text, removed_chars, spans, n_spans), of the relation ``docs``.

    Texts are cut into pieces, a piece being a sentence or a line break; a piece goes with its line or by itself.
    """
    return f"""
lines AS (
  SELECT doc_id, k, line, coalesce(sum(len(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
         k = max(k) OVER (PARTITION BY doc_id) AS is_last
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM {docs})
),
cuts AS (SELECT *, regexp_extract_all(line, '[^.!?]+[.!?]*|[.!?]+') AS bits FROM lines),
bits AS (
  SELECT doc_id, k, j, bit, start + coalesce(sum(len(bit)) OVER (PARTITION BY doc_id, k ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM (SELECT doc_id, k, start, unnest(bits) AS bit, generate_subscripts(bits, 1) AS j FROM cuts)
),
units AS (
  SELECT doc_id, start, start + len(line) + CASE WHEN is_last THEN 0 ELSE 1 END AS stop, k, 0 AS j, {_CLEAN.format("line")} AS unit FROM lines WHERE {_WORDS.format("line")} >= {least_line}
  UNION ALL
  SELECT doc_id, start, start + len(bit), k, j, {_CLEAN.format("bit")} FROM bits WHERE {_WORDS.format("bit")} >= {least_sentence}
),
firsts AS (SELECT *, first_value(struct_pack(a := doc_id, b := start)) OVER (PARTITION BY unit ORDER BY doc_id, start) AS first FROM units),
gone AS (SELECT DISTINCT doc_id, k, j, start, stop FROM firsts WHERE doc_id <> first.a OR start <> first.b),
spans AS (
  SELECT doc_id, count(*) AS n_spans, string_agg(CAST(start AS BIGINT) || '-' || CAST(stop AS BIGINT), ',' ORDER BY start, stop) AS spans
  FROM (SELECT DISTINCT doc_id, start, stop FROM gone) GROUP BY doc_id
),
pieces AS (
  SELECT doc_id, k, j, bit FROM bits UNION ALL SELECT doc_id, k, 1000000000, chr(10) FROM lines WHERE NOT is_last
),
marked AS (
  SELECT p.doc_id, p.k, p.j, p.bit, l.k IS NOT NULL OR s.k IS NOT NULL AS gone
  FROM pieces p LEFT JOIN (SELECT * FROM gone WHERE j = 0) l ON p.doc_id = l.doc_id AND p.k = l.k
       LEFT JOIN (SELECT * FROM gone WHERE j > 0) s ON p.doc_id = s.doc_id AND p.k = s.k AND p.j = s.j
),
{name} AS (
  SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(m.text, '') END AS text, coalesce(m.removed_chars, 0) AS removed_chars,
         coalesce(r.spans, '') AS spans, coalesce(r.n_spans, 0) AS n_spans
  FROM {docs} d LEFT JOIN (
    SELECT doc_id, string_agg(bit, '' ORDER BY k, j) FILTER (NOT gone) AS text, coalesce(sum(len(bit)) FILTER (gone), 0) AS removed_chars FROM marked GROUP BY doc_id
  ) m ON d.doc_id = m.doc_id LEFT JOIN spans r ON d.doc_id = r.doc_id
)"""
