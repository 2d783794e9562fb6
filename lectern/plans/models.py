"""Queries that ask models through ports, check what they reply, and search vectors that are laid out by nearness.

The models here are functions of their inputs, so that SQL can say what they answer.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import generation as G
from ..operators import vectors as V
from ..sources import ports as O
from ..sources import tables as S
from ..sources import vectors as C
from . import services
from .catalog import ORACLES, query, questions, read, rrf_fuse


@query(ORACLES["dense_topk_hashed"])
def dense_topk_embedded(spark, sf_dir):
    """The hashed dense search with vectors that come through the embedder's port."""
    asked, docs = S.stored(O.embedded(questions(spark, sf_dir), "q_id", "text"), "asked"), read(spark, sf_dir, "documents")
    return V.embedded_top(asked, O.vectors(docs, "doc_id", "text"), docs)


@query(ORACLES["jaccard_rerank"])
def reranked_by_port(spark, sf_dir):
    """The fused hits of all questions, scored by the reranker's port."""
    texts = read(spark, sf_dir, "documents").select("doc_id", "text")
    # The port's plan comes back to the pairs, so they are found once.
    hits = S.stored(rrf_fuse(spark, sf_dir).select("q_id", "doc_id"), "hits")
    pairs = S.stored(hits.join(questions(spark, sf_dir).withColumnRenamed("text", "query"), "q_id").join(texts, "doc_id"), "pairs")
    return O.reranked(pairs).select("q_id", "doc_id", F.round("score", 9).alias("score"))


@query(ORACLES["payload_filter_topk"])
def payload_filter_cells(spark, sf_dir):
    """The filtered search by cosine in a table of cells, of which only those are read that can hold a hit."""
    all_, path = read(spark, sf_dir, "embeddings"), S.shared_path(spark, "cells")
    C.write_cells(all_, path, "vec_id", "embedding", ["label"], cells=32)
    found, _ = C.search_cells(all_.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q")), path, 10, {"label": 3})
    return found.select("q_id", F.col("id").alias("vec_id"), "score", "rank")


# --- replies ----------------------------------------------------------------------------------------------------------

_ONE = '{"answer_language": "en", "explanation": {"html": "<p>See [EVIDENCE_1].</p>"}, "arabic_quotes": [{"text": "q", "region": "main"}], "citations": [{"chunk_id": "{c1}", "book": "made up", "page": 9}], "caveats": ["c"], "related": null}'
_TWO = "```json\n" + '{"answer_language": "en", "explanation": {"html": "<p>Both: [EVIDENCE_1]</p>"}, "citations": [{"chunk_id": "{c2}"}, {"chunk_id": "{c1}"}]}' + "\n```"
#: What a provider replies at first and when it is asked again, by kind of question; None is a call that fails.
REPLIES: dict[int, tuple[str | None, str | None]] = {
    0: (_ONE, _ONE), 1: (_TWO, _TWO), 2: ("no json", "{}["), 3: (_ONE.replace('"en"', '"bn"'), _ONE), 4: (None, _ONE),
    5: (_ONE.replace("{c1}", "{c2}x"), _ONE.replace('[{"chunk_id": "{c1}", "book": "made up", "page": 9}]', "[]")), 6: ("[]", None),
    7: (_ONE.replace('"caveats"', '"refusal": {"reason": "insufficient_evidence", "closest_evidence": ["e"]}, "caveats"'), _ONE),
}
_KIND = "q_id // 4 % 8"


def provider(rows: list[tuple]) -> list[str]:
    """Replies to (question, attempt, prompt): which chunks there are it reads from the prompt."""
    out = []
    for q_id, attempt, prompt in rows:
        ids = re.findall(r"\(chunk ([^)]*)\)\nTOPIC", prompt)
        reply = REPLIES[q_id // 4 % 8][attempt - 1]
        if reply is None:
            raise ConnectionError("the provider can't be reached")
        out.append(reply.replace("{c1}", ids[0]).replace("{c2}", ids[min(1, len(ids) - 1)]))
    return out


def _replies(spark, sf_dir):
    evidence = S.stored(services.evidence(spark, sf_dir), "evidence")
    asked = evidence.filter("evidence_sufficient")
    return evidence, O.replies(G.prompts(asked, "Q: {query} ({language})\n{evidence}"), provider)


@query(f"""{services._RANKED}, told AS (SELECT q_id, {_KIND} AS kind, q_id % 4 > 0 AS enough, arg_min(chunk_id || ':' || book_name || ':' || page, rank) AS c1, arg_min(chunk_id || ':' || book_name || ':' || page, CASE WHEN rank = 1 THEN 99 ELSE rank END) AS c2 FROM ranked GROUP BY 1),
b AS (SELECT *, CASE WHEN NOT enough THEN 'refused' WHEN kind IN (4, 6) THEN 'synthesised' WHEN kind IN (2, 5) THEN 'refused' ELSE 'assembled' END AS branch FROM told)
SELECT q_id, branch, CAST(CASE WHEN enough THEN CASE WHEN kind IN (0, 1, 4, 7) THEN 1 ELSE 2 END END AS INTEGER) AS attempt, CASE WHEN enough AND kind = 2 THEN 'not an object' WHEN enough AND kind = 5 THEN 'uncited evidence' END AS fault,
  CASE WHEN branch = 'assembled' THEN CASE WHEN kind = 1 THEN '<p>Both: [EVIDENCE_1]</p>' ELSE '<p>See [EVIDENCE_1].</p>' END END AS html, CASE WHEN branch = 'assembled' THEN CASE WHEN kind = 1 THEN c2 || ',' || c1 ELSE c1 END END AS citations,
  CASE WHEN NOT enough OR kind = 7 THEN 'insufficient_evidence' WHEN kind IN (2, 5) THEN 'generation_unavailable' END AS refusal_reason FROM b""")
def replies_checked(spark, sf_dir):
    """Answers of all four branches: refused, synthesised when the provider fails, assembled from a sound reply, refused when no reply was sound."""
    checked = G.checked_replies(*_replies(spark, sf_dir))
    answers = G.answers_with_replies(checked)
    own = F.col("branch") == "assembled"
    cited = F.array_join(F.transform("citations", lambda c: F.concat_ws(":", c["chunk_id"], c["book"], c["page"])), ",")
    out = answers.select("q_id", "branch", F.when(own, F.col("html")).alias("html"), F.when(own, cited).alias("citations"), "refusal_reason")
    return out.join(checked.select("q_id", "attempt", "fault"), "q_id")


def _said(column: str) -> str:
    """The provider's first reply in the SQL of both engines, from columns kind, c1 and c2."""
    quote = lambda s: "replace(replace('" + s.replace("'", "''").replace("\n", " ") + "', '{c1}', c1), '{c2}', c2)"
    return "CASE kind " + " ".join(f"WHEN {k} THEN {quote(first)}" for k, (first, _) in REPLIES.items() if first) + f" END AS {column}"


_SOUND = (0, 7)
_PIECE = 40


@query(f"""{services._RANKED}, told AS (SELECT q_id, {_KIND} AS kind, arg_min(chunk_id, rank) AS c1, arg_min(chunk_id, CASE WHEN rank = 1 THEN 99 ELSE rank END) AS c2 FROM ranked GROUP BY 1),
said AS (SELECT *, {_said('reply')} FROM told), cut AS (SELECT q_id, kind, reply, q_id % 3 = 2 AS broken, unnest(range(0, CAST(ceil(len(reply) / {_PIECE}) AS BIGINT) + 1)) AS i FROM said WHERE reply IS NOT NULL)
SELECT q_id, CAST(i AS INTEGER) AS seq, CASE WHEN i * {_PIECE} < len(reply) THEN 'delta' ELSE 'done' END AS event, CASE WHEN i * {_PIECE} < len(reply) THEN substr(reply, i * {_PIECE} + 1, {_PIECE}) END AS text, true AS cacheable FROM cut WHERE NOT broken AND kind IN {_SOUND}
UNION ALL SELECT q_id, CAST(0 AS INTEGER), 'error', CASE WHEN broken THEN 'broken off' WHEN kind IN (1, 2, 6) THEN 'not an object' WHEN kind = 3 THEN 'language' ELSE 'unknown citation' END, false FROM cut WHERE i = 0 AND (broken OR kind NOT IN {_SOUND})""")
def replies_held(spark, sf_dir):
    """Deltas of streamed replies, held back until a reply is whole and sound; a third of the replies break off."""
    evidence = S.stored(services.evidence(spark, sf_dir).select("q_id", "language", "chunks"), "evidence")
    ids = evidence.select("q_id", F.expr(_KIND.replace("//", "div")).alias("kind"), F.col("chunks")[0]["chunk_id"].alias("c1"), F.coalesce(F.get("chunks", 1)["chunk_id"], F.col("chunks")[0]["chunk_id"]).alias("c2"))
    said = ids.select("q_id", F.expr(_said("reply"))).filter("reply IS NOT NULL")
    n = F.ceil(F.length("reply") / _PIECE).cast("int")
    each = said.select("q_id", n.alias("n"), "reply", F.explode(F.sequence(F.lit(0), n)).alias("seq")).filter("NOT (q_id % 3 = 2 AND seq >= greatest(n - 1, 1))")
    at = F.timestamp_micros(F.lit(1704067200000000) + F.col("q_id") * 1000000 + F.col("seq") * 1000)
    kind = F.when(F.col("seq") < F.col("n"), "delta").otherwise("end")
    deltas = each.select("q_id", F.lit(1).alias("attempt"), "seq", at.alias("ts"), kind.alias("kind"), F.substring("reply", F.col("seq") * _PIECE + 1, F.lit(_PIECE)).alias("text"))
    last = spark.range(1).select(F.lit(-1).cast("long").alias("q_id"), F.lit(1).alias("attempt"), F.lit(0).alias("seq"), F.to_timestamp(F.lit("2034-01-01")).alias("ts"), F.lit("end").alias("kind"), F.lit("").alias("text"))
    folder, out, checkpoint = S.shared_path(spark, "deltas"), S.shared_path(spark, "events"), S.shared_path(spark, "checkpoint")
    for part in (deltas.filter("q_id % 2 = 0"), deltas.filter("q_id % 2 = 1"), last):
        part.write.mode("append").parquet(folder)
    stream = spark.readStream.schema(deltas.schema).parquet(folder)
    held = G.held_replies(stream, "30 seconds", "1 minute")
    G.released(held, evidence).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("q_id", "seq", "event", "text", "cacheable")


