"""Queries of layout, metadata, chunking and answers. The tables hold no page geometry; a frame of blocks is made from
``lineitem``, one page for each order, by the same rule in both languages."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import sentences_for_packing, token_count
from ..operators import answers as A
from ..operators import chunking as C
from ..operators import layout as Y
from ..operators import metadata as M
from ..sources.tables import stored, tasks
from .catalog import _DENSE, _FUSED, _POSTINGS, _SPARSE, ORACLES, query, read, rrf_fuse

_STOP = ", ".join(f"'{w}'" for w in A.STOPWORDS)
_FRAME = """blocks AS (
  SELECT l_orderkey % 50 AS doc_id, l_orderkey AS page, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS block_index, CAST(40 + l_partkey * 37 % 400 AS DOUBLE) AS x0, CAST((l_suppkey * 53 + l_linenumber * 97) % 830 AS DOUBLE) AS y0,
    CAST(60 + l_partkey * 37 % 400 + CAST(l_quantity AS BIGINT) * 4 AS DOUBLE) AS x1, CAST((l_suppkey * 53 + l_linenumber * 97) % 830 + 8 + l_partkey % 20 AS DOUBLE) AS y1,
    CASE l_partkey % 9 WHEN 0 THEN 'Book ' WHEN 1 THEN 'Section ' WHEN 2 THEN 'Part ' ELSE 'page ' END || l_partkey AS text, CAST(8 + l_suppkey % 8 AS DOUBLE) AS size, CAST(595 AS DOUBLE) AS width, CAST(842 AS DOUBLE) AS height FROM lineitem)"""
_COLUMNS = """gaps AS (SELECT *, (x0 + x1) / 2 - lag((x0 + x1) / 2) OVER (PARTITION BY page ORDER BY (x0 + x1) / 2, block_index) > width * CAST(0.18 AS DOUBLE) AS gap FROM {0}),
cols AS (SELECT *, sum(CAST(coalesce(gap, false) AS INTEGER)) OVER (PARTITION BY page ORDER BY (x0 + x1) / 2, block_index) AS col FROM gaps)"""


def frame(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem")
    part, supp, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    x, y = 40 + part * 37 % 400, (supp * 53 + line * 97) % 830
    name = F.when(part % 9 == 0, "Book ").when(part % 9 == 1, "Section ").when(part % 9 == 2, "Part ").otherwise("page ")
    d = lambda c: c.cast("double")
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return l.select(
        (F.col("l_orderkey") % 50).alias("doc_id"), F.col("l_orderkey").alias("page"), F.row_number().over(order).alias("block_index"), d(x).alias("x0"), d(y).alias("y0"), d(x + 20 + F.col("l_quantity").cast("long") * 4).alias("x1"), d(y + 8 + part % 20).alias("y1"),
        F.concat(name, part.cast("string")).alias("text"), d(8 + supp % 8).alias("size"), F.lit(595.0).alias("width"), F.lit(842.0).alias("height"),
    )


@query(f"WITH {_FRAME}, {_COLUMNS.format('blocks')} SELECT page, block_index, CAST(col AS BIGINT) AS \"column\" FROM cols")
def column_cluster(spark, sf_dir):
    return Y.columns(frame(spark, sf_dir)).select("page", "block_index", F.col("column").cast("long").alias("column"))


_ORDER = f"""body AS (SELECT * FROM blocks WHERE y0 > height * CAST(0.07 AS DOUBLE) AND y1 < height * CAST(0.93 AS DOUBLE)), {_COLUMNS.format('body')},
parts AS (SELECT page, block_index, 1 AS part, min(x0) OVER (PARTITION BY page, col) AS a, max(x1) OVER (PARTITION BY page, col) AS b, round_even(y0, 1) AS c, x0 AS d FROM cols
  UNION ALL SELECT page, block_index, 0, 0, 0, y0, x0 FROM blocks WHERE y0 <= height * CAST(0.07 AS DOUBLE) UNION ALL SELECT page, block_index, 2, 0, 0, y0, x0 FROM blocks WHERE y1 >= height * CAST(0.93 AS DOUBLE)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY part, a, b, c, d, block_index) - 1 AS n FROM parts)"""


@query(f"WITH {_FRAME}, {_ORDER} SELECT page, block_index, CAST(max(n) AS INTEGER) AS reading_order FROM numbered GROUP BY ALL")
def reading_order(spark, sf_dir):
    return Y.reading_order(frame(spark, sf_dir)).select("page", "block_index", "reading_order")


@query(f"""WITH {_FRAME}, body AS (SELECT * FROM blocks WHERE y1 > height * CAST(0.07 AS DOUBLE) AND y0 < height * CAST(0.93 AS DOUBLE)), {_COLUMNS.format('body')},
spans AS (SELECT page, col, min(x0) AS l, max(x1) AS r, max(x1) - min(x0) AS w FROM cols GROUP BY ALL),
main AS (SELECT page, arg_max(struct_pack(col := col, l := l, r := r, w := w), w * 1000 - col) AS m FROM spans GROUP BY page),
narrow AS (SELECT s.page, s.col FROM spans s JOIN main USING (page) WHERE m.w > 0 AND s.col <> m.col AND s.w < m.w * CAST(0.6 AS DOUBLE) AND CASE WHEN s.w > 0 THEN greatest(0, least(s.r, m.r) - greatest(s.l, m.l)) / s.w ELSE 1 END < 0.5),
margin AS (SELECT page, block_index FROM cols JOIN narrow USING (page, col)),
font AS (SELECT page, max(size) AS f FROM body GROUP BY page)
SELECT b.page, b.block_index, CASE WHEN y1 <= height * CAST(0.07 AS DOUBLE) THEN 'header' WHEN y0 >= height * CAST(0.93 AS DOUBLE) THEN 'footer' WHEN x1 - x0 < width * CAST(0.02 AS DOUBLE) OR y1 - y0 < height * CAST(0.004 AS DOUBLE) THEN 'unknown'
  WHEN m.page IS NOT NULL THEN 'margin' WHEN y0 >= height * CAST(0.72 AS DOUBLE) AND size < coalesce(f, 0) * CAST(0.85 AS DOUBLE) THEN 'footnote' ELSE 'main' END AS region
FROM blocks b LEFT JOIN margin m ON b.page = m.page AND b.block_index = m.block_index LEFT JOIN font ON b.page = font.page""")
def layout_regions(spark, sf_dir):
    return Y.regions(frame(spark, sf_dir)).select("page", "block_index", "region")


@query(f"""WITH {_FRAME}, regions AS ({ORACLES["layout_regions"]}), orders AS ({ORACLES["reading_order"]}),
main AS (SELECT b.*, o.reading_order FROM blocks b JOIN regions r USING (page, block_index) JOIN orders o USING (page, block_index) WHERE region = 'main'),
sizes AS (SELECT page, round_even(size, 1) AS font, sum(len(text)) AS n, min(block_index) AS first FROM main WHERE size > 0 GROUP BY ALL), fonts AS (SELECT page, font FROM sizes QUALIFY row_number() OVER (PARTITION BY page ORDER BY n DESC, first) = 1)
SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, reading_order) - 1 AS INTEGER) AS unit, text, CASE WHEN page % 3 > 0 THEN CAST(page % 100 AS INTEGER) END AS printed,
  CASE WHEN size >= font * CAST(1.08 AS DOUBLE) THEN CASE WHEN text LIKE 'Book%' THEN 'kitab' WHEN text LIKE 'Section%' THEN 'bab' WHEN text LIKE 'Part%' THEN 'fasl' ELSE 'topic' END END AS level FROM main LEFT JOIN fonts USING (page)""")
def chunk_units(spark, sf_dir):
    """What chunks are made of: blocks, their layout, and the printed numbers of two pages in three."""
    blocks = frame(spark, sf_dir)
    contexts = blocks.filter("page % 3 > 0").select("doc_id", "page", (F.col("page") % 100).cast("int").alias("printed")).distinct()
    return C.units_of(blocks, contexts)


@query(f"""WITH {_FRAME}, s AS (SELECT page, round_even(size, 1) AS font, sum(len(text)) AS n, min(block_index) AS first FROM blocks WHERE size > 0 GROUP BY ALL)
SELECT page, font FROM s QUALIFY row_number() OVER (PARTITION BY page ORDER BY n DESC, first) = 1""")
def dominant_font_mode(spark, sf_dir):
    return Y.dominant_font(frame(spark, sf_dir)).select("page", "font")


_HEADS = """body AS (SELECT * FROM blocks WHERE y0 > height * CAST(0.07 AS DOUBLE) AND y1 < height * CAST(0.93 AS DOUBLE)),
sizes AS (SELECT page, round_even(size, 1) AS font, sum(len(text)) AS n, min(block_index) AS first FROM body WHERE size > 0 GROUP BY ALL),
fonts AS (SELECT page, font FROM sizes QUALIFY row_number() OVER (PARTITION BY page ORDER BY n DESC, first) = 1),
heads AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page, round_even(y0, 1), x0, block_index) AS place, CASE WHEN text LIKE 'Book%' THEN 'kitab' WHEN text LIKE 'Section%' THEN 'bab' WHEN text LIKE 'Part%' THEN 'fasl' ELSE 'topic' END AS level, text AS name
  FROM body JOIN fonts USING (page) WHERE size >= font * CAST(1.08 AS DOUBLE))"""


@query(f"WITH {_FRAME}, {_HEADS} SELECT doc_id, page, CAST(place AS INTEGER) AS place, level, name FROM heads")
def heading_levels(spark, sf_dir):
    return M.headings(frame(spark, sf_dir))


@query(f"""WITH {_FRAME}, {_HEADS}, one AS (SELECT * FROM heads QUALIFY row_number() OVER (PARTITION BY doc_id, level, page ORDER BY place DESC) = 1),
ends AS (SELECT doc_id, max(page) AS last_page FROM blocks GROUP BY 1)
SELECT doc_id, level, name, page AS page_start, coalesce(lead(page) OVER (PARTITION BY doc_id, level ORDER BY page) - 1, greatest(last_page, page)) AS page_end FROM one JOIN ends USING (doc_id)""")
def structure_ranges(spark, sf_dir):
    blocks = frame(spark, sf_dir)
    return M.sections(M.headings(blocks), blocks.groupBy("doc_id").agg(F.max("page").alias("last_page")))


@query(f"""WITH {_FRAME}, {_HEADS}, own AS (SELECT doc_id, page, arg_max(name, place) FILTER (level = 'kitab') AS kitab, arg_max(name, place) FILTER (level = 'bab') AS bab, arg_max(name, place) FILTER (level = 'fasl') AS fasl FROM heads GROUP BY ALL),
p AS (SELECT DISTINCT doc_id, page FROM blocks)
SELECT doc_id, page, last_value(kitab IGNORE NULLS) OVER w AS kitab, last_value(bab IGNORE NULLS) OVER w AS bab, last_value(fasl IGNORE NULLS) OVER w AS fasl FROM p LEFT JOIN own USING (doc_id, page) WINDOW w AS (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def carry_forward_sections(spark, sf_dir):
    blocks = frame(spark, sf_dir)
    return M.active_sections(blocks.select("doc_id", "page").distinct(), M.headings(blocks))


@query(f"""WITH {_FRAME}, foot AS (SELECT page, regexp_extract(text, '[0-9]+') AS label FROM blocks WHERE y1 >= height * CAST(0.93 AS DOUBLE) QUALIFY row_number() OVER (PARTITION BY page ORDER BY round_even(y1, 1) DESC, x0 DESC, block_index DESC) = 1)
SELECT DISTINCT b.page, coalesce(label, '') AS label, CAST(label AS INTEGER) AS numeral, CASE WHEN label IS NULL THEN 'none' ELSE 'latin' END AS system, label IS NULL AS uncertain, CAST(CASE WHEN label IS NULL THEN 0.15 ELSE 0.9 END AS DOUBLE) AS confidence FROM blocks b LEFT JOIN foot USING (page)""")
def printed_page_numbers(spark, sf_dir):
    return M.page_numbers(frame(spark, sf_dir)).drop("doc_id")


@query("""WITH n AS (SELECT doc_id, source || ' vol ' || (doc_id % 7) || ' - ' || lang || '.pdf' AS filename FROM documents),
m AS (SELECT doc_id, regexp_extract(filename, '^(.+) vol ([0-9]+) - (.+)\\.pdf$', ['title', 'volume', 'author']) AS f FROM n)
SELECT doc_id, f.title, f.author, f.volume FROM m""")
def filename_fields(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    name = F.concat("source", F.lit(" vol "), (F.col("doc_id") % 7).cast("string"), F.lit(" - "), "lang", F.lit(".pdf"))
    return d.select("doc_id", M.filename_fields(name).alias("f")).select("doc_id", "f.title", "f.author", "f.volume")


def _units(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("unit", "text"))
    return lines.withColumn("level", F.when((F.col("unit") % 5 == 0) & (F.length("text") < 60), F.when(F.col("unit") % 2 == 0, "bab").otherwise("fasl"))).withColumn("page", F.floor(F.col("unit") / 4).cast("int")).withColumn("printed", F.col("page") + 1)


@query()
def sentence_pack_chunks(spark, sf_dir):
    """Chunks of the documents, whose lines are their units; short lines in every fifth place count as headings."""
    return C.chunks(_units(spark, sf_dir)).select("doc_id", "order_index", "chunk_id", "bab", "fasl", "page_start", "page_end", "token_count")


@query("""WITH RECURSIVE cut AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '[^.؟!؛]*[.؟!؛]+|[^.؟!؛]+$'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS parts FROM documents),
s AS (SELECT doc_id, i - 1 AS i, len(regexp_extract_all(t, '\\S+')) AS n FROM (SELECT doc_id, unnest(parts) AS t, generate_subscripts(parts, 1) AS i FROM cut)),
b AS (SELECT *, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY i) - n AS BIGINT) AS before FROM s),
t AS (SELECT *, least(i - 1, min(i) OVER (PARTITION BY doc_id ORDER BY before RANGE BETWEEN 48 PRECEDING AND CURRENT ROW)) AS back FROM b),
sums AS (SELECT doc_id, list(before ORDER BY i) AS ps FROM b GROUP BY 1),
fold AS (SELECT doc_id, i, i AS first, CAST(0 AS INTEGER) AS pack FROM t WHERE i = 0 UNION ALL
SELECT t.doc_id, t.i, CASE WHEN t.before + t.n - ps[f.first + 1] > 320 THEN greatest(f.first, t.back) ELSE f.first END, f.pack + CASE WHEN t.before + t.n - ps[f.first + 1] > 320 THEN 1 ELSE 0 END
FROM fold f JOIN t ON t.doc_id = f.doc_id AND t.i = f.i + 1 JOIN sums ON sums.doc_id = f.doc_id)
SELECT f.doc_id, CAST(pack AS INTEGER) AS pack, CAST(min(first) AS INTEGER) AS first, CAST(max(f.i) AS INTEGER) AS last, CAST(max(t.before + t.n) - any_value(ps[f.first + 1]) AS BIGINT) AS tokens
FROM fold f JOIN t ON t.doc_id = f.doc_id AND t.i = f.i JOIN sums ON sums.doc_id = f.doc_id GROUP BY 1, 2""")
def packed_sentences(spark, sf_dir):
    """Which sentences of every document make each pack of at most 320 tokens, with their overlap."""
    cut = read(spark, sf_dir, "documents").select("doc_id", F.transform(sentences_for_packing(F.col("text")), token_count).alias("n"))
    packs = cut.select("doc_id", "n", F.posexplode(C.packs(F.col("n"))).alias("pack", "p"))
    own = F.slice("n", F.col("p.first") + 1, F.col("p.last") - F.col("p.first") + 1)
    return packs.select("doc_id", "pack", "p.first", "p.last", F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x).alias("tokens"))


@query("""SELECT doc_id, unit, CAST(sum(begins) OVER (PARTITION BY doc_id ORDER BY unit) AS BIGINT) AS segment FROM (SELECT doc_id, unit, CASE WHEN page <> lag(page) OVER w AND NOT (NOT regexp_matches(rtrim(lag(text) OVER w), '[.؟!؛]$')) THEN 1 ELSE CAST(unit = min(unit) OVER (PARTITION BY doc_id) AS INTEGER) END AS begins
  FROM (SELECT doc_id, i - 1 AS unit, text, (i - 1) // 4 AS page FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)) WHERE trim(text) <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY unit))""")
def chunk_segments(spark, sf_dir):
    """Segments of documents without headings: cuts at clean page breaks only."""
    plain = _units(spark, sf_dir).withColumn("level", F.lit(None).cast("string")).filter("trim(text) <> ''")
    return C.segments(plain).select("doc_id", F.col("unit").cast("long").alias("unit"), F.col("segment").cast("long").alias("segment"))


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(q, 'author|written by|who wrote|authored by') THEN 'author' WHEN regexp_matches(q, 'book name|book title|called') THEN 'title' WHEN regexp_matches(q, 'publisher|published by') THEN 'publisher' WHEN regexp_matches(q, 'how many pages|number of pages') THEN 'page_count' ELSE 'explanation' END AS intent FROM (SELECT *, lower(trim(coalesce(text, ''))) AS q FROM conversations)""")
def question_intent(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", A.intent(F.col("text")).alias("intent"))


@query(f"""WITH {_POSTINGS},{_SPARSE},{_DENSE},{_FUSED},
p AS (SELECT q_id, doc_id AS chunk_id, b.text AS question, d.text FROM fused JOIN benchmark b ON q_id = b.item_id JOIN documents d USING (doc_id)),
s AS (SELECT q_id, chunk_id, list_distinct(regexp_extract_all(lower(question), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')) AS q, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS i FROM (SELECT *, list_filter(list_transform(string_split(regexp_replace(text, '([।.?؟])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' \t\n\r')), lambda x: x <> '') AS parts FROM p)),
h AS (SELECT *, len(list_filter(regexp_extract_all(lower(sentence), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda w: list_contains(q, w) AND NOT list_contains([{_STOP}], w))) AS hits FROM s)
SELECT q_id, chunk_id, sentence, CAST(hits AS INTEGER) AS hits FROM h QUALIFY row_number() OVER (PARTITION BY q_id, chunk_id ORDER BY hits DESC, i) = 1""")
def best_sentence(spark, sf_dir):
    """The pairs are the fused hits of all questions; each text that is hit is cut into sentences and words once."""
    b = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q_id"), F.col("text").alias("question"))
    hits = stored(rrf_fuse(spark, sf_dir).select("q_id", F.col("doc_id").alias("chunk_id")), "hits")
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    some = stored(d.join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi").repartition(tasks(spark)).select("chunk_id", A.told(F.col("text")).alias("told")), "told")
    return A.best_sentences(hits.join(b, "q_id").repartition(tasks(spark)).join(some, "chunk_id"))


@query("""WITH r AS (SELECT l_orderkey AS q_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rank, l_discount * 8 AS s, l_shipmode AS topic, l_linestatus = 'F' AS verified FROM (SELECT *, l_returnflag AS l_shipmode FROM lineitem)),
a AS (SELECT q_id, round_even(max(s), 4) AS score, CASE WHEN count(DISTINCT CASE WHEN rank <= 3 THEN topic END) <= 1 THEN 'consensus' ELSE 'conflict' END AS agreement, count(*) FILTER (rank <= 3 AND verified) AS verified FROM r GROUP BY 1)
SELECT *, CASE WHEN score >= CAST(0.6 AS DOUBLE) AND agreement = 'consensus' AND verified >= 2 THEN 'high' WHEN score >= CAST(0.35 AS DOUBLE) THEN 'medium' ELSE 'low' END AS level FROM a""")
def answer_confidence(spark, sf_dir):
    order = W.partitionBy("l_orderkey").orderBy(F.desc("l_discount"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    r = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q_id"), F.row_number().over(order).alias("rank"), (F.col("l_discount") * 8).alias("rerank_score"), F.col("l_returnflag").alias("topic"), F.lit("").alias("kitab"), (F.col("l_linestatus") == "F").alias("verified"))
    return A.confidence(r)


@query()
def html_sanitize(spark, sf_dir):
    """Checked against plain expectations in tests; SQL has no parser of HTML."""
    return read(spark, sf_dir, "pages").select("page_id", A.sanitise(F.col("html")).alias("html"))
