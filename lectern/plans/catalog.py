"""The queries of the engine over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as E
from ..operators import relational as R
from ..operators import vectors as V
from ..sources.tables import stored
from ..streaming import limits as L

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        name = f.__name__
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q_id"), "text")


# --- vectors and retrieval ---------------------------------------------------------------------------------------

_POSTINGS = """
d_tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\S+')) AS t FROM documents),
q_tok AS (SELECT item_id AS q_id, unnest(regexp_extract_all(lower(text), '\\S+')) AS t FROM benchmark),
d_post AS (SELECT doc_id, CAST(('0x' || substr(md5(t), 12, 5)) AS BIGINT) AS idx, count(*) AS tf FROM d_tok GROUP BY ALL),
q_post AS (SELECT q_id, CAST(('0x' || substr(md5(t), 12, 5)) AS BIGINT) AS idx, count(*) AS tf FROM q_tok GROUP BY ALL)"""
_SPARSE = """
sparse AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT q_id, doc_id, CAST(sum(d.tf * q.tf) AS DOUBLE) AS score FROM d_post d JOIN q_post q USING (idx) GROUP BY ALL) QUALIFY rank <= 40)"""
_DENSE = """
d_dense AS (SELECT doc_id, idx % 1024 AS idx, sum(tf) AS tf FROM d_post GROUP BY ALL),
q_dense AS (SELECT q_id, idx % 1024 AS idx, sum(tf) AS tf FROM q_post GROUP BY ALL),
d_norm AS (SELECT doc_id, sqrt(CAST(sum(tf * tf) AS DOUBLE)) AS n FROM d_dense GROUP BY ALL),
q_norm AS (SELECT q_id, sqrt(CAST(sum(tf * tf) AS DOUBLE)) AS n FROM q_dense GROUP BY ALL),
dots AS (SELECT q_id, doc_id, CAST(sum(d.tf * q.tf) AS DOUBLE) AS dot FROM d_dense d JOIN q_dense q USING (idx) GROUP BY ALL),
dense AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT q_id, doc_id, round(dot / (d_norm.n * q_norm.n), 9) AS score FROM dots JOIN d_norm USING (doc_id) JOIN q_norm USING (q_id)) QUALIFY rank <= 40)"""
_FUSED = """
fused AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT q_id, doc_id, round(sum(share), 9) AS score, max(dense_score) AS dense_score FROM (
    SELECT q_id, doc_id, CAST(0.5 AS DOUBLE) / (60 + rank) AS share, score AS dense_score FROM dense UNION ALL
    SELECT q_id, doc_id, CAST(0.5 AS DOUBLE) / (60 + rank), NULL FROM sparse) GROUP BY ALL) QUALIFY rank <= 40)"""
_RERANKED = """
sets AS (SELECT f.*, b.text AS q_text, d.text, d.source, list_distinct(regexp_extract_all(lower(b.text), '\\S+')) AS q, list_distinct(regexp_extract_all(lower(d.text), '\\S+')) AS t
  FROM fused f JOIN benchmark b ON f.q_id = b.item_id JOIN documents d USING (doc_id)),
reranked AS (SELECT *, round(greatest(coalesce(CAST(len(list_intersect(q, t)) AS DOUBLE) / len(list_distinct(list_concat(q, t))), 0), dense_score, 0), 9) AS rerank_score FROM sets),
once AS (SELECT *, row_number() OVER (PARTITION BY q_id, sha256(coalesce(source, '') || ':' || substr(text, 1, 200)) ORDER BY rerank_score DESC, rank, doc_id) AS n FROM reranked WHERE rerank_score >= 0.05),
placed AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY rerank_score DESC, rank, doc_id) AS place FROM once WHERE n = 1 QUALIFY place <= 8)"""


@query(f"WITH {_POSTINGS},{_SPARSE},{_DENSE},{_FUSED},{_RERANKED} SELECT q_id, CAST(place AS INTEGER) AS place, doc_id, rerank_score FROM placed")
def hybrid_search_topn(spark, sf_dir):
    return V.hybrid_search(questions(spark, sf_dir), read(spark, sf_dir, "documents"))


@query(f"WITH {_POSTINGS} SELECT doc_id, CAST(idx AS INTEGER) AS idx, tf FROM d_post")
def sparse_tf_vectors(spark, sf_dir):
    return V.postings(read(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"WITH {_POSTINGS},{_SPARSE} SELECT q_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM sparse")
def sparse_topk_dot(spark, sf_dir):
    return V.rankings(V.postings(questions(spark, sf_dir), "q_id", "text"), read(spark, sf_dir, "documents"), kinds=("sparse",))[0]


@query(f"WITH {_POSTINGS},{_DENSE} SELECT q_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM dense")
def dense_topk_hashed(spark, sf_dir):
    return V.rankings(V.postings(questions(spark, sf_dir), "q_id", "text"), read(spark, sf_dir, "documents"), kinds=("dense",))[0]


@query(f"WITH {_POSTINGS},{_SPARSE},{_DENSE},{_FUSED} SELECT q_id, doc_id, score, dense_score, CAST(rank AS INTEGER) AS rank FROM fused")
def rrf_fuse(spark, sf_dir):
    return V.search(V.postings(questions(spark, sf_dir), "q_id", "text"), read(spark, sf_dir, "documents"))


_NEAR = """SELECT q_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, vec_id) AS rank FROM (
  SELECT q.vec_id AS q_id, v.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0{0})) WHERE rank <= 10"""


def _asking(all_: DataFrame) -> DataFrame:
    """The stated queries of a search: every vector whose id is divisible by 100."""
    return all_.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q"))


@query(_NEAR.format(""))
def dense_topk_cosine(spark, sf_dir):
    all_ = read(spark, sf_dir, "embeddings")
    return V.vector_top(_asking(all_), all_.select("vec_id", F.col("embedding").alias("v")))


@query(_NEAR.format(" AND v.label = 3"))
def payload_filter_topk(spark, sf_dir):
    """The filter stands below the ranking."""
    all_ = read(spark, sf_dir, "embeddings")
    return V.vector_top(_asking(all_), R.payload_filter(all_, label=3, source=None).select("vec_id", F.col("embedding").alias("v")))


@query(f"""WITH {_POSTINGS}, hits AS (
  SELECT q_id, CAST(idx % 3 AS INTEGER) AS candidate, doc_id, CAST(sum(d.tf * q.tf) AS DOUBLE) AS score FROM d_post d JOIN q_post q USING (idx) GROUP BY ALL),
best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY q_id, doc_id ORDER BY score DESC, candidate) = 1)
SELECT q_id, candidate, doc_id, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS r FROM best) WHERE r <= 40""")
def merge_best_hit(spark, sf_dir):
    q = V.postings(questions(spark, sf_dir), "q_id", "text")
    # A document among the best by its best candidate is among the best of that candidate.
    asked = q.select(F.struct("q_id", (F.col("idx") % 3).cast("int").alias("candidate")).alias("q_id"), "idx", "tf")
    hits = V.rankings(asked, read(spark, sf_dir, "documents"), kinds=("sparse",))[0].select("q_id.*", "doc_id", "score")
    return V.merge_best(hits, "doc_id").select("q_id", "candidate", "doc_id", "score", "rank")


@query(f"""WITH {_POSTINGS},{_SPARSE},{_DENSE},{_FUSED},
s AS (SELECT q_id, doc_id, list_distinct(regexp_extract_all(lower(b.text), '\\S+')) AS q, list_distinct(regexp_extract_all(lower(d.text), '\\S+')) AS t FROM fused JOIN benchmark b ON q_id = item_id JOIN documents d USING (doc_id))
SELECT q_id, doc_id, round(CASE WHEN len(q) = 0 OR len(t) = 0 THEN 0 ELSE CAST(len(list_intersect(q, t)) AS DOUBLE) / len(list_distinct(list_concat(q, t))) END, 9) AS score FROM s""")
def jaccard_rerank(spark, sf_dir):
    """The pairs are the fused hits of all questions; each text that is hit is cut into tokens once."""
    q = questions(spark, sf_dir).select("q_id", F.array_distinct(T.tokens(F.col("text"))).alias("q"))
    hits = stored(rrf_fuse(spark, sf_dir).select("q_id", "doc_id"), "hits")
    d = read(spark, sf_dir, "documents").join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    d = stored(d.select("doc_id", F.array_distinct(T.tokens(F.col("text"))).alias("t")), "told")
    return hits.join(q, "q_id").join(d, "doc_id").select("q_id", "doc_id", F.round(V.jaccard(F.col("q"), F.col("t")), 9).alias("score"))


@query("""SELECT source, CAST(place AS INTEGER) AS place, doc_id, score FROM (SELECT source, doc_id, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS place FROM (
  SELECT source, doc_id, score, row_number() OVER (PARTITION BY source, lang, substr(text, 1, 200) ORDER BY score DESC, doc_id) AS n
  FROM (SELECT *, round(n_chars / 100000, 9) AS score FROM documents) WHERE score >= 0.005) WHERE n = 1) WHERE place <= 8""")
def evidence_floor_dedupe(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("source").alias("q_id"), "doc_id", "lang", "text", F.round(F.col("n_chars") / 100000, 9).alias("rerank_score"), F.lit(0).alias("rank"))
    out = V.compress(d, "doc_id", F.coalesce("lang", F.lit("")), floor=0.005)
    return out.select(F.col("q_id").alias("source"), "place", "doc_id", F.col("rerank_score").alias("score"))


# --- text ----------------------------------------------------------------------------------------------------------

@query("""SELECT doc_id, CASE WHEN total = 0 THEN 'other' WHEN en = greatest(en, bn, ar) THEN 'en' WHEN bn = greatest(en, bn, ar) THEN 'bn' ELSE 'ar' END AS code,
  round(CASE WHEN total = 0 THEN 0 ELSE greatest(en, bn, ar) / total END, 9) AS confidence
FROM (SELECT *, en + bn + ar AS total FROM (SELECT doc_id, len(regexp_replace(text, '[^A-Za-zÀ-ÿ]', '', 'g')) AS en, len(regexp_replace(text, '[^ঀ-৿]', '', 'g')) AS bn, len(regexp_replace(text, '[^؀-ۿݐ-ݿࢠ-ࣿ]', '', 'g')) AS ar FROM documents))""")
def language_detect(spark, sf_dir):
    out = read(spark, sf_dir, "documents").select("doc_id", T.detected_language(F.col("text")).alias("l"))
    return out.select("doc_id", "l.code", F.round("l.confidence", 9).alias("confidence"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS normalised, len(regexp_extract_all(text, '\\S+')) AS n_tokens FROM documents")
def normalize_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.one_space(F.col("text")).alias("normalised"), T.token_count(F.col("text")).cast("long").alias("n_tokens"))


_ARABIC = "إِنَّ الصَّلاةَ ٱلْأُولى مؤمنٌ هٰذا شئ قــال آمن"


@query(f"""SELECT doc_id, regexp_replace(translate(nfc_normalize(text || ' {_ARABIC}' || substr('{_ARABIC}', CAST(doc_id % 40 AS INTEGER) + 1)), 'أإآٱىةؤئ', 'اااايهءء'), '[\\x{{064B}}-\\x{{065F}}\\x{{0670}}\\x{{06D6}}-\\x{{06ED}}\\x{{0640}}]', '', 'g') AS canonical FROM documents""")
def arabic_normalize(spark, sf_dir):
    """The tables hold no Arabic, so every text gets some, begun at another place in each."""
    text = F.concat("text", F.lit(" " + _ARABIC), F.substring(F.lit(_ARABIC), (F.col("doc_id") % 40 + 1).cast("int"), F.lit(200)))
    return read(spark, sf_dir, "documents").select("doc_id", T.normalise_arabic(text).alias("canonical"))


@query("""SELECT doc_id, pos - 1 AS pos, sentence FROM (SELECT doc_id, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS pos FROM (
  SELECT doc_id, list_filter(list_transform(regexp_extract_all(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '[^.؟!؛]*[.؟!؛]+|[^.؟!؛]+$'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS parts FROM documents))""")
def sentence_split(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences_for_packing(F.col("text"))).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("long"))


@query("""SELECT doc_id, (SELECT count(*) FROM (SELECT unnest(string_split(regexp_replace(regexp_replace(text, '([।.!؟])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1))) AS s) WHERE trim(s, ' \t\n\r') <> '') AS grounding,
  (SELECT count(*) FROM (SELECT unnest(string_split(regexp_replace(text, '([।.?؟])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS s) WHERE trim(s, ' \t\n\r') <> '') AS facts FROM documents""")
def sentence_counts(spark, sf_dir):
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", F.size(T.sentences_for_grounding(t)).cast("long").alias("grounding"), F.size(T.sentences_for_facts(t)).cast("long").alias("facts"))


@query("""SELECT conv_id, turn, CASE WHEN clean = '' THEN 'empty' WHEN len(clean) > 500 THEN 'too_long'
  WHEN regexp_matches(lower(clean), 'ignore previous instructions|ignore all previous instructions|disregard your instructions|forget your instructions|pretend you are|system prompt|you are now|jailbreak|fuck|shut up|stupid|idiot|الاحمق|غبي|بلا عقل') THEN 'disallowed' ELSE 'ok' END AS verdict
FROM (SELECT *, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS clean FROM conversations)""")
def query_validate(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.query_verdict(F.col("text")).alias("verdict"))


@query("""WITH h AS (SELECT doc_id, text, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(CAST(doc_id AS VARCHAR))) AS h FROM documents)
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + CAST(('0x' || substr(h, 17, 1)) AS INTEGER) % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id,
  sha256('0:' || text) AS chunk_id FROM h""")
def point_uuid5(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.uuid5_url(F.col("doc_id").cast("string")).alias("point_id"), T.chunk_id(F.lit(0), F.col("text")).alias("chunk_id"))


@query("""SELECT doc_id, CASE WHEN len(line) <= 200 THEN line ELSE rtrim(substr(line, 1, 200)) || '…' END AS summary FROM (SELECT doc_id, trim(replace(text, chr(10), ' ')) AS line FROM documents)""")
def source_summary(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.excerpt(F.col("text")).alias("summary"))


@query("""SELECT page_id, CASE WHEN kept = '' THEN 'document' ELSE kept END AS filename FROM (SELECT page_id, substr(trim(regexp_replace(string_split(replace(url, '\\', '/'), '/')[-1], '[\\x00-\\x1f\\x7f]', '', 'g')), 1, 255) AS kept FROM pages)""")
def sanitize_filename(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.clean_filename(F.col("url")).alias("filename"))


@query("""SELECT doc_id, CAST(g AS INTEGER) AS seq, string_agg(w, ' ' ORDER BY i) AS delta FROM (SELECT doc_id, (i - 1) // 4 AS g, i, w FROM (
  SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents)) GROUP BY ALL""")
def delta_groups(spark, sf_dir):
    """Groups of four words, as an answer is streamed."""
    # The words are named once, so that each group doesn't split the text again.
    of = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / 4).cast("int")), lambda g: F.array_join(F.slice(w, g * 4 + 1, 4), " "))
    groups = F.get(F.transform(F.array(F.split("text", " ")), of), 0)
    return read(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.posexplode(groups).alias("seq", "delta"))


# --- relational ------------------------------------------------------------------------------------------------------

@query("SELECT trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_normalized_texts(spark, sf_dir):
    return R.repeated_texts(read(spark, sf_dir, "documents"), T.one_space(F.col("text")))


@query("""WITH u AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(CAST(doc_id AS VARCHAR))) AS h FROM documents),
c AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, h FROM u),
p AS (SELECT sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(CAST(doc_id * 2 AS VARCHAR))) AS h FROM labels),
f AS (SELECT h, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + CAST(('0x' || substr(h, 17, 1)) AS INTEGER) % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM p)
SELECT 'orphan' AS kind, id FROM f WHERE h NOT IN (SELECT h FROM c) UNION ALL SELECT 'unindexed', chunk_id FROM c WHERE h NOT IN (SELECT h FROM p)""")
def index_health(spark, sf_dir):
    chunks = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"))
    points = read(spark, sf_dir, "labels").select(T.uuid5_url((F.col("doc_id") * 2).cast("string")).alias("point_id"))
    return R.index_health(chunks, points)


@query("""SELECT l_suppkey AS job_id, count(*) AS pages, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS chars, CAST(sum(l_linenumber) AS BIGINT) AS blocks, CAST(sum(CAST(l_returnflag = 'N' AS INTEGER)) AS BIGINT) AS text_pages, round(coalesce(avg(l_discount), 0), 9) AS confidence FROM lineitem GROUP BY 1""")
def job_summary(spark, sf_dir):
    pages = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("job_id"), F.col("l_quantity").cast("long").alias("n_chars"), F.col("l_linenumber").alias("n_blocks"), (F.col("l_returnflag") == "N").alias("has_text"), F.col("l_discount").alias("confidence"))
    return R.job_summary(pages).withColumn("confidence", F.round("confidence", 9))


@query("SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def region_summary(spark, sf_dir):
    s, n, r = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark, sf_dir):
    return R.latest(read(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS place FROM events WHERE event_type = 'error' OR value < 5 QUALIFY place <= 5")
def last_n_errors(spark, sf_dir):
    return R.latest(read(spark, sf_dir, "events").filter("event_type = 'error' OR value < 5"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id", "place")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 100")
def pagination(spark, sf_dir):
    return R.page_of_rows(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.desc("o_orderkey")], 100, 50)


@query("SELECT r_name, n_name, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def volumes_of_book(spark, sf_dir):
    s, n, r = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r.filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name", "s_name")


@query("""SELECT l_orderkey, l_linenumber, s_suppkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey OR s_suppkey = l_partkey""")
def pages_or_join(spark, sf_dir):
    return R.either_key(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"), read(spark, sf_dir, "supplier").select("s_suppkey"), "l_suppkey", "l_partkey", "s_suppkey").select("l_orderkey", "l_linenumber", "s_suppkey")


@query("""SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAY""")
def range_containment_resolve(spark, sf_dir):
    ranges = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("start"), F.expr("o_orderdate + interval 30 days").alias("end"))
    points = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_shipdate")
    return R.containing_ranges(points, ranges, ["o_orderkey"], "l_shipdate", "start", "end").select("o_orderkey", "l_linenumber")


_EDGES = "edges AS (SELECT a.n_name AS p, b.n_name AS r, CASE WHEN a.n_nationkey % 2 = 0 THEN 'synonym' ELSE 'related' END AS relation, (a.n_nationkey * b.n_nationkey % 10) / 10 AS confidence FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey)"


def _edges(spark, sf_dir):
    a, b = (read(spark, sf_dir, "nation").select(F.col("n_name").alias(f"{x}_name"), F.col("n_nationkey").alias(f"{x}_key"), "n_regionkey") for x in "ab")
    return a.join(b, "n_regionkey").filter("a_key < b_key").select(
        F.col("a_name").alias("primary_term"), F.col("b_name").alias("related_term"), F.when(F.col("a_key") % 2 == 0, "synonym").otherwise("related").alias("relation"), (F.col("a_key") * F.col("b_key") % 10 / 10).alias("confidence")
    )


@query(f"WITH {_EDGES} SELECT p AS term, r AS neighbour, relation, confidence FROM edges UNION ALL SELECT r, p, relation, confidence FROM edges")
def term_neighbours(spark, sf_dir):
    return R.both_ways(_edges(spark, sf_dir), read(spark, sf_dir, "nation").select(F.col("n_name").alias("term")))


@query(f"""WITH {_EDGES}, fresh AS (SELECT r AS p, p AS r, relation, CAST(1 AS DOUBLE) AS confidence FROM edges WHERE confidence > 0.5 UNION ALL SELECT p, r, 'synonym', CAST(0.5 AS DOUBLE) FROM edges WHERE confidence = 0)
SELECT p AS primary_term, r AS related_term, relation, confidence FROM edges WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.p = edges.p AND f.r = edges.r) UNION ALL SELECT p, r, relation, confidence FROM fresh""")
def edge_upsert(spark, sf_dir):
    old = _edges(spark, sf_dir)
    swapped = old.filter("confidence > 0.5").select(F.col("related_term").alias("primary_term"), F.col("primary_term").alias("related_term"), "relation", F.lit(1.0).alias("confidence"))
    new = swapped.union(old.filter("confidence = 0").select("primary_term", "related_term", F.lit("synonym"), F.lit(0.5)))
    return R.upsert(old, new, ["primary_term", "related_term"])


@query("SELECT l_orderkey AS job_id, page FROM (SELECT l_orderkey, unnest(range(1, CAST(max(l_linenumber) AS BIGINT) + 3)) AS page FROM lineitem GROUP BY 1) t WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = t.l_orderkey AND l.l_linenumber = t.page)")
def resume_missing_pages(spark, sf_dir):
    pages = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").cast("long").alias("page"))
    return R.missing_pages(pages, pages.groupBy("job_id").agg((F.max("page") + 2).alias("n")))


@query("""WITH now AS (SELECT * FROM (SELECT user_id AS upload_id, event_id, CASE WHEN event_id % 2 = 0 THEN 'extraction' ELSE 'metadata' END AS kind, CASE WHEN value > 20 THEN 'completed' ELSE 'failed' END AS status, ts FROM events)
  QUALIFY row_number() OVER (PARTITION BY upload_id, kind ORDER BY ts DESC, event_id DESC) = 1)
SELECT upload_id FROM now WHERE status = 'completed' GROUP BY 1 HAVING count(*) = 2""")
def stage_eligibility(spark, sf_dir):
    jobs = read(spark, sf_dir, "events").select(F.col("user_id").alias("upload_id"), F.col("event_id").alias("id"), F.when(F.col("event_id") % 2 == 0, "extraction").otherwise("metadata").alias("kind"), F.when(F.col("value") > 20, "completed").otherwise("failed").alias("status"), F.col("ts").alias("created_at"))
    return R.eligible_for_stage(jobs, {"extraction": "completed", "metadata": "completed"})


# --- evaluation ------------------------------------------------------------------------------------------------------

@query("""WITH r AS (SELECT l_orderkey AS q_id, l_partkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank FROM lineitem),
e AS (SELECT DISTINCT l_orderkey AS q_id, l_partkey AS doc_id FROM lineitem WHERE l_returnflag = 'R'),
n AS (SELECT q_id, count(*) AS n FROM e GROUP BY 1),
h AS (SELECT q_id, min(rank) AS first, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) END) AS dcg FROM r JOIN e USING (q_id, doc_id) GROUP BY 1)
SELECT q_id, CAST(coalesce(first <= 5, false) AS DOUBLE) AS recall_5, CAST(coalesce(first <= 10, false) AS DOUBLE) AS recall_10, CAST(coalesce(first <= 20, false) AS DOUBLE) AS recall_20,
  coalesce(1 / first, 0) AS mrr, coalesce(round(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 9), 0) AS ndcg_10 FROM n LEFT JOIN h USING (q_id)""")
def recall_mrr_ndcg(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem")
    order = W.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")
    ranked = l.select(F.col("l_orderkey").alias("q_id"), F.col("l_partkey").alias("doc_id"), F.row_number().over(order).alias("rank"))
    return E.ranking_measures(ranked, l.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("q_id"), F.col("l_partkey").alias("doc_id")))


@query("""WITH m AS (SELECT count(*) FILTER (quality = 0 AND toxic = 1) AS tp, count(*) FILTER (quality <> 0 AND toxic = 1) AS fp, count(*) FILTER (quality = 0 AND toxic <> 1) AS fn, count(*) FILTER (quality <> 0 AND toxic <> 1) AS tn FROM labels),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1 END AS recall FROM m)
SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM r""")
def refusal_confusion(spark, sf_dir):
    return E.refusal_matrix(read(spark, sf_dir, "labels").select((F.col("quality") == 0).alias("expected"), (F.col("toxic") == 1).alias("given")))


@query("""WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, any_value(n) AS n, median(value) AS p50, max(value) FILTER (i = least(n - 1, CAST(floor(n * CAST(0.95 AS DOUBLE)) AS BIGINT))) AS p95 FROM s GROUP BY 1""")
def latency_percentiles(spark, sf_dir):
    return E.latency(read(spark, sf_dir, "events"), "event_type", "value")


@query("""WITH m AS (SELECT 'recall@10' AS metric, avg(quality) AS actual FROM labels UNION ALL SELECT 'mrr', avg(1 - toxic) FROM labels UNION ALL SELECT 'hallucination_rate', avg(toxic) FROM labels),
t AS (SELECT * FROM (VALUES ('recall@10', 0.8), ('mrr', 0.6), ('ndcg@10', 0.7), ('citation_accuracy', 0.9), ('groundedness', 0.8), ('hallucination_rate', 0.05), ('refusal_precision', 0.8), ('refusal_recall', 0.8)) v(metric, threshold))
SELECT metric, actual, CAST(threshold AS DOUBLE) AS threshold, actual IS NULL OR CASE WHEN metric = 'hallucination_rate' THEN actual > CAST(threshold AS DOUBLE) ELSE actual < CAST(threshold AS DOUBLE) END AS violation FROM t LEFT JOIN m USING (metric)""")
def threshold_gate(spark, sf_dir):
    one = read(spark, sf_dir, "labels").agg(F.avg("quality").alias("recall@10"), F.avg(1 - F.col("toxic")).alias("mrr"), F.avg("toxic").alias("hallucination_rate"))
    return E.gate(one.unpivot([], ["recall@10", "mrr", "hallucination_rate"], "metric", "actual"))


@query("""WITH w AS (SELECT doc_id, source, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+')) AS ws FROM documents),
p AS (SELECT a.doc_id, b.doc_id AS other, a.ws AS x, b.ws AS y FROM w a JOIN w b ON a.doc_id + 1 = b.doc_id)
SELECT doc_id, other, CASE WHEN f >= 0.5 THEN 2 WHEN f >= 0.2 THEN 1 ELSE 0 END AS grade FROM (SELECT *, CASE WHEN len(list_intersect(x, y)) = 0 THEN 0 ELSE CAST(2 * len(list_intersect(x, y)) AS DOUBLE) / (len(x) + len(y)) END AS f FROM p)""")
def lexical_judge(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    other = d.select(F.col("doc_id").alias("other"), (F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("b"))
    return d.join(other, "doc_id").select("doc_id", "other", E.lexical_grade(F.col("text"), F.col("b")).alias("grade"))


@query("""WITH s AS (SELECT conv_id, turn, unnest(list_filter(string_split(regexp_replace(regexp_replace(text, '([।.!؟])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)), lambda x: trim(x, ' \t\n\r') <> '')) AS s FROM conversations WHERE role = 'assistant'),
e AS (SELECT conv_id, list(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+'))) AS sets FROM conversations WHERE role = 'user' GROUP BY 1),
j AS (SELECT conv_id, sets IS NOT NULL AS held, len(list_filter(coalesce(sets, []), lambda x: len(list_intersect(x, list_distinct(regexp_extract_all(lower(s), '[\\p{L}\\p{M}\\p{N}_]+')))) >= 2)) > 0 AS ok FROM s LEFT JOIN e USING (conv_id))
SELECT conv_id AS a_id, count(*) AS n_sentences, count(*) FILTER (ok) / count(*) AS groundedness, CASE WHEN NOT bool_or(held) THEN 1 ELSE count(*) FILTER (NOT ok) / count(*) END AS hallucination_rate FROM j GROUP BY 1""")
def groundedness(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return E.grounding(c.filter("role = 'assistant'").select(F.col("conv_id").alias("a_id"), "text"), c.filter("role = 'user'").select(F.col("conv_id").alias("a_id"), "text")).filter("n_sentences > 0")


@query("""SELECT e.l_orderkey AS item_id, avg(CAST(EXISTS (SELECT 1 FROM lineitem a WHERE a.l_orderkey = e.l_orderkey AND a.l_linenumber <> e.l_linenumber AND a.l_returnflag = e.l_returnflag AND abs(CAST(a.l_quantity AS INTEGER) - CAST(e.l_quantity AS INTEGER)) <= 1) AS DOUBLE)) AS accuracy
FROM lineitem e WHERE e.l_linenumber = 1 GROUP BY 1""")
def citation_band_match(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), "l_linenumber", F.col("l_returnflag").alias("book"), F.lit(None).cast("string").alias("volume"), F.col("l_quantity").cast("int").alias("page"))
    return E.citation_accuracy(l.filter("l_linenumber = 1").drop("l_linenumber"), l.filter("l_linenumber <> 1").drop("l_linenumber"))


# --- limits and state ------------------------------------------------------------------------------------------------

@query("""SELECT event_id, in_window, allowed, CAST(greatest(0, 5 - in_window) AS INTEGER) AS remaining, CASE WHEN allowed THEN 0 ELSE greatest(1, CAST(floor(86400 - (epoch_us(ts) - first) / 1e6) AS INTEGER) + 1) END AS retry_after FROM (
  SELECT *, in_window <= 5 AS allowed FROM (SELECT event_id, ts, count(*) OVER w AS in_window, min(epoch_us(ts)) OVER w AS first FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)))""")
def rate_limit_sliding(spark, sf_dir):
    return L.sliding_limit(read(spark, sf_dir, "events"), "user_id", "ts", 5, 86400).select("event_id", "in_window", "allowed", "remaining", "retry_after")


@query("""SELECT event_id FROM events WHERE epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts) < 604800000000 AND event_type NOT LIKE 'p%'""")
def cache_ttl_evict(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    now = events.agg(F.max("ts")).first()[0]
    return L.evicted(L.live_entries(events, "ts", now, 604800), "event_type", "p*").select("event_id")
