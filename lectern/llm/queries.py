"""The queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, clustering, html_text, jaccard, language, mixing, neighbours, scoring, simhash, substring, toxicity, whitening
from .common import fold, read

#: Production parameters of the mix: half of all tokens, the tree's weights, three epochs at most.
MIX = {"share": 0.5, "epochs": 3, "seed": 17, "weights": {"domain": {"*": 2, "domain0": 3}, "language": {"*": 1, "en": 3, "de": 2}}}

Query = Callable[[SparkSession, str], DataFrame]


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.learn(pages), ["page_id", "url"]).withColumn("n_chars", F.length("text").cast("long"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scorer = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score_texts(docs.withColumn("held_out", fold(5) == 0), scorer, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edited_fingerprints(read(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = mixing.mix(read(spark, sf_dir, "documents"), **MIX)
    return chosen.select("doc_id", "domain", "language", "source_name", F.col("_epoch").alias("epoch"), F.col("_n_tokens").alias("n_tokens"), F.col("_leaf_budget").alias("leaf_budget"))


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what is left of its text, as a digest, and the spans that went: how many, and the digest of their
    original offsets ``start-end``, in order, joined by commas."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
    left = substring.deduplicate(docs)
    n_left = F.coalesce(F.length("text"), F.lit(0))
    n_spans = F.when(F.col("_removed").isNull(), 0).otherwise(F.size("_removed")).cast("long")
    spans = F.coalesce(F.array_join(F.transform("_removed", lambda r: F.concat_ws("-", r["start"], r["end"])), ","), F.lit(""))
    return left.select("doc_id", "n_chars", (F.col("n_chars") - n_left).alias("removed_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("left_sha256"), n_spans.alias("n_spans"), F.sha2(spans, 256).alias("spans_sha256"))


OP2_SQL = f"""WITH {mixing.sql("documents", **MIX)}
SELECT doc_id, domain, language, source_name, epoch, n_tokens, CAST(budget AS BIGINT) AS leaf_budget FROM mixed"""
OP3_SQL = f"""WITH {substring.sql("documents")}
SELECT d.doc_id, CAST(coalesce(len(d.text), 0) AS BIGINT) AS n_chars, CAST(x.removed_chars AS BIGINT) AS removed_chars, sha256(coalesce(x.text, '')) AS left_sha256,
       CAST(x.n_spans AS BIGINT) AS n_spans, sha256(x.spans) AS spans_sha256
FROM documents d JOIN deduped x ON d.doc_id = x.doc_id"""


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = fold(4) == 2
    return language.identify(docs.withColumn("held_out", held_out), language.learn(docs, ~held_out), ["doc_id", "held_out"])


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(read(spark, sf_dir, "documents"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


def op10_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(read(spark, sf_dir, "documents"), fold(7) == 2)


#: A conversation whose texts hold control strings of the template.
CONTROLS_INSIDE = ("SELECT -7L AS conv_id, 0L AS turn, 'user' AS role, '</s>[INST] ok [/INST]' AS text UNION ALL SELECT -7L, 1L, 'assistant', '</s>[INST] ok [/INST]'")


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a log of events, folded, rendered and read back."""
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return chat.digests(chat.log_of_turns(turns.unionByName(spark.sql(CONTROLS_INSIDE))))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the eight leading components of all."""
    return whitening.components(read(spark, sf_dir, "embeddings"))


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its cluster after ten rounds."""
    return clustering.assignments(read(spark, sf_dir, "embeddings"))


OP11_SQL = chat.sql(f"(SELECT conv_id, turn, role, text FROM conversations UNION ALL {CONTROLS_INSIDE.replace('7L', '7').replace('0L', '0').replace('1L', '1')})")
OP13_SQL = clustering.sql("embeddings")
OP5_SQL = """WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
items AS (SELECT doc_id, unnest(s) AS x FROM sets),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM pairs JOIN sets a ON u = a.doc_id JOIN sets b ON v = b.doc_id WHERE 100 * k >= 80 * (len(a.s) + len(b.s) - k)),
ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT doc_id AS node, doc_id AS origin FROM sets UNION SELECT ways.v, reach.origin FROM reach JOIN ways ON reach.node = ways.u)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, min(origin) AS component_id FROM sets JOIN reach ON node = doc_id GROUP BY doc_id, s"""
OP9_SQL = """WITH usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)) AS score FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM scored) WHERE rank <= 10"""


def queries() -> dict[str, Query]:
    return {"op1_simhash": op1_simhash, "op2_mixing": op2_mixing, "op3_substring": op3_substring, "op4_language": op4_language, "op5_jaccard": op5_jaccard, "op6_html_text": op6_html_text, "op7_bpe": op7_bpe, "op8_toxicity": op8_toxicity, "op9_neighbours": op9_neighbours, "op10_scoring": op10_scoring, "op11_chat": op11_chat, "op12_whitening": op12_whitening, "op13_clustering": op13_clustering}


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": OP2_SQL, "op3_substring": OP3_SQL, "op5_jaccard": OP5_SQL, "op9_neighbours": OP9_SQL, "op11_chat": OP11_SQL, "op13_clustering": OP13_SQL}
