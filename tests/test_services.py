"""Answers, expansion, indexing, jobs, extraction, runs and sinks, against literal expectations."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lectern.operators import expansion as X
from lectern.operators import extraction as P
from lectern.operators import generation as G
from lectern.operators import indexing as I
from lectern.operators import jobs as J
from lectern.operators import runs as N
from lectern.plans import services  # noqa: F401
from lectern.sources import tables as S
from lectern.streaming import limits as L

CHUNKS = "q_id int, rank int, chunk_id string, text string, book_name string, volume string, printed_page_start int, topic string, kitab string, bab string, region string, verified boolean, rerank_score double"


def chunk(q, rank, text, **more):
    own = {"book_name": "Al Hidaya", "volume": "2", "printed_page_start": 7, "topic": "t", "kitab": "k", "bab": None, "region": "main", "verified": True, "rerank_score": 0.7} | more
    return (q, rank, f"c{q}{rank}", text, *own.values())


def asked(spark, rows, chunks):
    q = spark.createDataFrame([(*r, False, True) for r in rows], "q_id int, query string, language string, translated boolean, evidence_sufficient boolean")
    return q.join(G.gathered(spark.createDataFrame(chunks, CHUNKS)), "q_id", "left").withColumn("chunks", F.coalesce("chunks", F.expr("filter(array(named_struct('rank', 0, 'chunk_id', '', 'text', '', 'book_name', '', 'volume', '', 'printed_page_start', 0, 'topic', '', 'kitab', '', 'bab', '', 'region', '', 'verified', true, 'rerank_score', 0D, 'body', '')), x -> false)")))


def test_facts_of_every_kind(spark):
    rows = [(1, "Who wrote this?", "en"), (2, "লেখক কে?", "bn"), (3, "book name", "en"), (4, "publisher of it", "en"), (5, "how many pages", "en"), (6, "Who wrote this?", "en"), (7, "What of water?", "en"), (8, "book title", "en")]
    chunks = [
        chunk(1, 1, "Topic: x\nNothing here."), chunk(1, 2, "First. The work is written by Abu Bakr, and more\nsecond line."), chunk(2, 1, "এই কিতাবটি ড. রহমান সাহেব রচিত। অন্য বাক্য।"),
        chunk(3, 1, "a", book_name="unknown"), chunk(3, 2, "b"), chunk(4, 1, "It was published by: Dar X\nelse"), chunk(5, 1, "এই বই ১২৩ পৃষ্ঠা"), chunk(6, 1, "   "), chunk(6, 2, "no name"),
        chunk(7, 1, "Of the earth. Water is water. Of fire."), chunk(7, 2, "Some water here. Other."), chunk(8, 1, "x রচিত নামের গ্রন্থ", book_name=" "),
    ]
    got = {r.q_id: r for r in G.with_facts(asked(spark, rows, chunks)).select("q_id", "fact_type", "heading", "fact.*").collect()}
    one = lambda i: (got[i].answer, got[i].quote, got[i].chunk_id, got[i].strength)
    assert one(1) == ("The author of this book is Abu Bakr, and more second line..", "The work is written by Abu Bakr, and more second line", "c12", 1.0)
    assert one(2) == ("এই কিতাবের লেখক রহমান সাহেব।", "রহমান সাহেব রচিত", "c21", 1.0)
    assert one(3) == ("The title of this book is: Al Hidaya.", None, "c32", 0.8)
    assert one(4) == ("This book is published by Dar X else.", "It was published by: Dar X else", "c41", 1.0)
    assert one(5) == ("This book has 123 pages.", None, "c51", 1.0)
    assert one(6) == ("This information was not found in the available evidence.", None, "c62", 0.4)
    assert one(7) == ("Water is water. Some water here.", "Water is water.", "c71", 0.6) and got[7].heading == "Answer"
    assert one(8) == ("The title of this book is: নামের গ্রন্থ.", None, "c81", 0.7)


def test_answers_and_refusals(spark):
    rows = [(1, "Who wrote this?", "en"), (2, "এটা কী?", "bn"), (3, "What?", "ar")]
    chunks = [chunk(1, 1, "written by Zayd"), chunk(1, 2, "x"), chunk(2, 1, "نص عربي هنا.", volume=None, kitab=""), chunk(2, 2, "b" * 400, topic=None, kitab="Kitab", verified=False, rerank_score=0.2)]
    got = {r.q_id: r for r in G.answers(asked(spark, rows, chunks)).collect()}
    a = got[1]
    assert a.html == "<p><b>Author:</b> The author of this book is Zayd.</p>\n<blockquote><p>written by Zayd</p></blockquote>\n<p>Source: <cite>Al Hidaya, vol. 2, p. 7</cite></p>"
    assert [c.chunk_id for c in a.citations] == ["c11"] and a.citations[0].page == "7" and a.citations[0].chapter == "t" and a.related == ["t"]
    assert a.confidence.level == "high" and a.confidence.score == 0.7 and a.confidence.rationale.startswith("Deterministic fact extraction matched the source. top rerank score 0.70; 1 chunk(s) considered; source agreement: consensus; verified evidence: 1/1.")
    b = got[2]
    assert [(q.text, q.translation) for q in b.quotes] == [("نص عربي هنا.", "উদ্ধৃতাংশ — Al Hidaya, পৃষ্ঠা 7")] and [c.chapter for c in b.citations] == ["t", "Kitab"]
    assert b.confidence.agreement == "conflict" and b.confidence.level == "medium" and b.refusal_reason is None
    c = got[3]
    assert c.branch == "refused" and c.refusal_reason == "insufficient_evidence" and c.closest == [] and c.html.count("<p>") == 1 and c.confidence.rationale == "No evidence retrieved for this question."
    far = G.refused(asked(spark, rows[1:2], chunks), F.lit("generation_unavailable")).first()
    assert far.closest == ["نص عربي هنا.", "b" * 300 + "…"] and far.html.endswith("<p><i>" + "b" * 300 + "…</i></p>") and far.refusal_reason == "generation_unavailable"
    states = spark.createDataFrame([(None, "r", None), (True, None, None), (True, "r", None), (True, "r", "bad")], "s boolean, r string, f string")
    assert [r.p for r in states.select(G.policy(F.col("s"), F.col("r"), F.col("f")).alias("p")).collect()] == ["refuse", "synthesise", "assemble", "give_up"]


def test_events_and_prompts(spark):
    rows = asked(spark, [(1, 'Who "wrote" this?', "en")], [chunk(1, 1, "written by Zayd ibn Ali of Kufa", book_name=None, printed_page_start=None, volume=None, topic="")])
    events = [r.event for r in G.event_stream(G.answers(rows), rows).orderBy("seq").collect()]
    assert all(e.endswith("\n\n") and e.startswith("event: ") for e in events)
    parts = [(e.split("\n")[0][7:], json.loads(e.split("\n")[1][6:])) for e in events]
    assert [k for k, _ in parts if k != "delta"] == ["meta", "citation", "confidence", "done"] and parts[0][1]["query"] == 'Who "wrote" this?'
    html = G.answers(rows).first().html
    assert "".join(d["text"] for k, d in parts if k == "delta") == html + " " and all(len(d["text"].split(" ")) <= 5 for k, d in parts if k == "delta")
    assert events[0] == 'event: meta\ndata: {"query": "Who \\"wrote\\" this?", "language": "en", "answer_language": "en", "latency_budget_ms": 3000}\n\n'
    assert parts[-1][1]["refusal"] is None and parts[-1][1]["related"] == []
    prompt = G.prompts(rows, "{query}|{language}|{evidence}|{other}").first().prompt
    assert prompt == 'Who "wrote" this?|en|[EVIDENCE_1]\nSOURCE: Unknown Book, vol ?, p. ? (chunk c11)\nTOPIC: General\nCONTENT:\nwritten by Zayd ibn Ali of Kufa\n[/EVIDENCE_1]\n\n|{other}'


def test_replies_with_fields_of_other_kinds(spark):
    good = {"answer_language": "en", "explanation": {"html": "x [EVIDENCE_1]"}, "citations": [{"chunk_id": "a", "page": 3}], "arabic_quotes": None, "refusal": None, "caveats": []}
    cases = [
        (good, None), ([1], "not an object"), ("{", "not an object"), (None, "not an object"), (good | {"answer_language": "bn"}, "language"), (good | {"explanation": "x"}, "no explanation"),
        (good | {"explanation": {"html": " "}}, "no text"), (good | {"arabic_quotes": "q"}, "quotes are no list"), (good | {"arabic_quotes": [{"text": " "}]}, "empty quote"), (good | {"arabic_quotes": ["q"]}, "empty quote"),
        (good | {"citations": {}}, "citations are no list"), (good | {"citations": ["a"]}, "no chunk id"), (good | {"citations": [{"chunk_id": 3}]}, "no chunk id"), (good | {"citations": [{"chunk_id": "z"}]}, "unknown citation"),
        (good | {"explanation": {"html": "[EVIDENCE_9]"}}, "unknown evidence"), (good | {"citations": []}, "uncited evidence"), (good | {"refusal": "no"}, "refusal is no object"), (good | {"refusal": {"reason": "x"}}, "refusal reason"),
        (good | {"refusal": {"reason": "insufficient_evidence", "closest_evidence": "x"}}, "closest evidence is no list"), (good | {"refusal": {"reason": "insufficient_evidence"}}, None), (good | {"related": {}}, "related is no list"),
    ]
    rows = [(i, None if r is None else r if isinstance(r, str) else ("```json\n" + json.dumps(r) + "\n```" if i % 2 else json.dumps(r))) for i, (r, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, reply string")
    got = {r.i: r.f for r in df.select("i", G.reply_faults(F.col("reply"), F.array(F.lit("a"), F.lit("b")), F.lit("en")).alias("f")).collect()}
    assert [got[i] for i in range(len(cases))] == [f for _, f in cases]


def test_cited_numbers_become_text(spark):
    replies = ['{"citations": [{"chunk_id": "a", "page": 3, "volume": "2"}, {"chunk_id": "b"}]}', "```json\n{}\n```", "no json"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, reply string").select("i", G.reply_citations(F.col("reply")).alias("c"))
    got = {r.i: r.c for r in df.collect()}
    assert [(c.chunk_id, c.page, c.volume) for c in got[0]] == [("a", "3", "2"), ("b", None, None)] and got[1] == [] and got[2] == []


def test_candidates(spark):
    queries = spark.createDataFrame([(1, "What of صلاة?", "الصَّلاةُ والماء طلاق"), (2, " same ", "same"), (3, "x", "ثبوت ثبوت")], "q_id int, original string, canonical string")
    edges = spark.createDataFrame(X.SEEDS, S.SCHEMAS["term_relations"])
    got = {}
    for r in X.candidates(queries, edges, most=9).orderBy("q_id", "candidate").collect():
        got.setdefault(r.q_id, []).append((r.kind, r.text))
    assert got[2] == [("original", "same")]
    assert got[3] == [("original", "x"), ("canonical", "ثبوت ثبوت"), ("synonym", "وجوب ثبوت")]
    assert got[1] == [
        ("original", "What of صلاة?"), ("canonical", "الصلاه والماء طلاق"), ("synonym", "العباده والماء طلاق"), ("synonym", "الصلاه والطهور طلاق"),
        ("kg", "الصلاه والماء عده"), ("kg", "الصلاه والماء نكاح"),
    ]
    assert X.candidates(queries, edges).groupBy("q_id").count().agg(F.max("count")).first()[0] <= X.MOST
    more = spark.createDataFrame([(2, 1, "again"), (2, 2, "same")], "q_id int, n int, text string")
    assert [r.kind for r in X.candidates(queries, edges, more).filter("q_id = 2").orderBy("candidate").collect()] == ["original", "llm"]


def test_candidates_are_dealt_out_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(S, "ROWS_EACH", 10)
    queries = spark.range(205).select(F.col("id").alias("q_id"), F.lit("ثبوت ماء").alias("original"), F.lit("ثبوت ماء").alias("canonical"))
    edges = spark.createDataFrame([("ماء", "b", "r", 0.5), ("ثبوت", "b", "r", 0.1), ("c", "ثبوت", "r", None), ("ثبوت", "a", "r", 0.1), ("ثبوت", "d", "r", 0.9)], S.SCHEMAS["term_relations"])
    out = X.candidates(queries, edges, most=9)
    assert out.rdd.getNumPartitions() == 21
    assert [r.text for r in out.filter("q_id = 7 AND kind = 'kg'").orderBy("candidate").collect()] == ["d ماء", "a ماء", "b ماء", "c ماء"] and out.count() == 205 * 7


def test_points_are_replaced_and_deleted(spark):
    points = spark.createDataFrame([("p1", "u1", "c1", True), ("p2", "u1", "c2", None), ("p3", "u2", "c3", False)], "point_id string, upload_id string, chunk_id string, verified boolean")
    new = spark.createDataFrame([("p2", "u1", "n2", True), ("p2", "u1", "n9", True), ("p4", "u1", "n4", True)], points.schema)
    ids = lambda df: sorted((r.point_id, r.chunk_id) for r in df.collect())
    assert ids(I.upserted(points, new)) == [("p1", "c1"), ("p2", "n9"), ("p3", "c3"), ("p4", "n4")]
    once = I.reindexed(points, new)
    assert ids(once) == ids(I.reindexed(once, new)) == [("p2", "n9"), ("p3", "c3"), ("p4", "n4")]
    assert ids(I.deleted(points, verified=True)) == [("p2", "c2"), ("p3", "c3")]
    with pytest.raises(ValueError):
        I.deleted(points)
    keys = spark.createDataFrame([("", "p"), (None, "p"), ("c", "p")], "a string, b string").select(I.point_key(F.col("a"), F.col("b")).alias("k")).collect()
    assert [r.k for r in keys] == ["p", "p", "c"]
    assert [(r.points, r.percent) for r in I.indexing_progress(spark.createDataFrame([("j", 250), ("k", 0)], "job_id string, n long")).collect()] == [(100, 40), (200, 80), (250, 99)]


def test_stages_begin_when_they_may(spark):
    t = dt.datetime(2024, 1, 1)
    ago = lambda d: t - dt.timedelta(days=d)
    jobs = spark.createDataFrame(
        [("a", "u1", "initial", "completed", ago(3)), ("b", "u1", "metadata", "completed", ago(2)), ("c", "u1", "chunking", "completed", ago(1)), ("d", "u2", "initial", "completed", ago(3)), ("e", "u2", "initial", "failed", ago(1)), ("f", "u3", "chunking", "queued", ago(1)), ("g", "u4", None, "completed", ago(1))],
        "id string, upload_id string, kind string, status string, created_at timestamp",
    )
    uploads = spark.createDataFrame([(f"u{i}",) for i in range(1, 6)], "id string")
    documents, chunks = spark.createDataFrame([("b",)], "job_id string"), spark.createDataFrame([("c",), ("c",)], "job_id string")
    told = lambda kind: {r.upload_id: r.refusal for r in J.refusals_to_start(uploads, jobs, documents, chunks, kind).collect()}
    assert told("chunking") == {"u1": None, "u2": "no completed extraction", "u3": "already running", "u4": "no completed extraction", "u5": "no completed extraction"}
    assert told("indexing") == {"u1": None, "u2": "no chunks", "u3": "no chunks", "u4": "no chunks", "u5": "no chunks"}
    assert told("layout")["u1"] is None and told("metadata")["u2"] == "no completed extraction"
    failures = spark.createDataFrame([("u3", "broken")], "upload_id string, message string")
    more = jobs.withColumn("error_message", F.lit(None).cast("string")).withColumn("finished_at", F.lit(None).cast("timestamp"))
    got = {r.id: (r.status, r.error_message) for r in J.siblings_failed(more, failures, F.lit(t)).collect()}
    assert got["f"] == ("failed", "broken") and got["a"] == ("completed", None)
    waits = J.retries(spark.createDataFrame([("x", i, True) for i in range(5)] + [("y", 0, False)], "job_id string, attempt int, failed boolean")).orderBy("job_id", "attempt").collect()
    assert [(r.retry, r.wait) for r in waits] == [(True, 10), (True, 20), (True, 40), (False, None), (False, None), (False, None)]


def test_refusals_are_dealt_out_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(S, "ROWS_EACH", 10)
    uploads = spark.range(205).select(F.concat(F.lit("u"), "id").alias("id"))
    kinds = F.explode(F.array(*map(F.lit, ("initial", "metadata", "chunking")))).alias("kind")
    jobs = spark.range(205).select("id", kinds).select(F.concat("kind", "id").alias("id"), F.concat(F.lit("u"), "id").alias("upload_id"), "kind", F.lit("completed").alias("status"), F.to_timestamp(F.lit("2024-01-01")).alias("created_at"))
    documents, chunks = (jobs.filter((F.col("kind") == k) & (F.substring("upload_id", 2, 9).cast("int") < n)).select(F.col("id").alias("job_id")) for k, n in (("metadata", 50), ("chunking", 60)))
    out = J.refusals(uploads, jobs, documents, chunks)
    assert out.rdd.getNumPartitions() == 62
    assert {(r.stage, r.refusal): r["count"] for r in out.groupBy("stage", "refusal").count().collect()} == {
        ("layout", None): 205, ("metadata", None): 205, ("chunking", None): 50, ("chunking", "no metadata document"): 155, ("indexing", None): 60, ("indexing", "no chunks"): 145,
    }


def test_pages_fan_out(spark):
    span = lambda t, size, font="f": {"text": t, "font": font, "size": size, "x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0, "flags": None}
    box = {"x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0}
    blocks = [
        box | {"kind": 0, "lines": [[span("a" * 10, 9.0), span("", 30.0)], [span("b" * 10, 12.0, ""), span("c", 12.0, "g")]]}, box | {"kind": 1, "lines": []}, box | {"kind": 0, "lines": [[span("", 1.0)]]}, box | {"kind": 0, "lines": None}, box | {"kind": 0, "lines": [[span("z", None)]]},
    ]
    images, drawings = [box | {"width": 0, "height": 5, "xref": 0}], [{"x0": None, "y0": None, "x1": None, "y1": None, "kind": "s", "stroke_width": None}]
    rows = [("j", 1, 595.0, 842.0, 0, blocks, images, drawings, None), ("j", 2, 595.0, 842.0, 90, blocks, images, drawings, "bad page"), ("j", 3, 1.0, 1.0, 0, None, None, None, None)]
    out = {k: v.orderBy(*v.columns[:3]).collect() for k, v in P.fanned_out(spark.createDataFrame(rows, P.PAGES)).items()}
    assert [(r.page_number, r.char_count, r.has_text, r.block_count, r.image_count, r.drawing_count, r.error_message) for r in out["pages"]] == [(1, 22, True, 2, 1, 1, None), (2, 0, False, 0, 0, 0, "bad page"), (3, 0, False, 0, 0, 0, None)]
    assert [r.confidence for r in out["pages"]] == [22 / 4000, 0.0, 0.0]
    assert [(r.block_index, r.text, r.font, r.font_size, r.span_count) for r in out["blocks"]] == [(0, "a" * 10 + "b" * 10 + "c", None, 12.0, 3), (1, "z", "f", 0.0, 1)]
    assert [(r.block_index, r.span_index, r.flags) for r in sorted(out["spans"], key=lambda r: (r.block_index, r.span_index))] == [(0, 0, 0), (0, 1, 0), (0, 2, 0), (1, 0, 0)]
    assert [(r.width, r.height, r.xref) for r in out["images"]] == [(None, 5, None)] and [(r.x0, r.kind) for r in out["drawings"]] == [(0.0, "s")]
    total = P.document_summary(P.page_rows(P.with_blocks(spark.createDataFrame(rows, P.PAGES)))).first()
    assert (total.page_count, total.total_chars, total.has_text_layer) == (3, 22, True)
    steps = P.checkpoints(spark.createDataFrame([("a", 60), ("b", 3)], "job_id string, n long"), spark.createDataFrame([("a", i) for i in range(1, 6)] + [("b", i) for i in (1, 2, 3)], "job_id string, page int"))
    assert sorted((r.job_id, r.pages, r.percent) for r in steps.collect()) == [("a", 30, 50), ("a", 55, 92), ("a", 60, 100), ("b", 3, 100)]


def test_gold_citations_are_resolved(spark):
    books = spark.createDataFrame([("b2", "The Hidaya"), ("b1", "al-HIDAYA commentary"), ("b3", "Other")], "id string, title string")
    editions, volumes = spark.createDataFrame([("e1", "b1")], "id string, book_id string"), spark.createDataFrame([("v1", "e1", 1), ("v0", "e1", 0)], "id string, edition_id string, volume_number int")
    chunks = spark.createDataFrame([("c1", "b1", "v1", 1, 5), ("c2", "b1", "v0", 6, 9), ("c3", "b3", None, None, None), ("c4", "b1", "v1", 6, 6)], "chunk_id string, book_id string, volume_id string, printed_page_start int, printed_page_end int")
    items = [("1", None, [("hidaya", "1", 4)]), ("2", None, [("hidaya", None, 6)]), ("3", "b3", [("ignored", None, None)]), ("4", None, [("hidaya", "9", None), ("nothing", None, None)]), ("5", None, [("Hidaya", "one", None)]), ("6", "gone", [("hidaya", None, None)])]
    gold = N.gold_citations(spark.createDataFrame(items, "id string, book_id string, expected_citations array<struct<book:string,volume:string,page:int>>"))
    got = sorted(map(tuple, N.resolved(gold, books, editions, volumes, chunks).collect()))
    assert got == [("1", "c1"), ("2", "c2"), ("2", "c4"), ("3", "c3"), ("5", "c2")]
    assert {r.title for r in N.missing_books(gold, books).collect()} == {"hidaya", "ignored", "nothing", "Hidaya"}
    texts = spark.createDataFrame([("<p>x</p>", "t"), ("", "t"), (None, None)], "html string, text string").select(N.answer_text(F.struct("html", "text")).alias("t")).collect()
    assert [r.t for r in texts] == ["<p>x</p>", "t", ""]


def test_runs_and_verdicts(spark):
    rows = spark.createDataFrame([("a1", "i1", "r", True, False, 10.0), ("a2", "i2", "r", False, True, 30.0), ("a3", "i3", "r", True, True, None)], "a_id string, item_id string, run_id string, expect_refusal boolean, refusal_given boolean, latency_ms double")
    retrieved = spark.createDataFrame([("a1", "c1", 1), ("a1", "c2", 2), ("a2", "c9", 1)], "a_id string, chunk_id string, rank int")
    gold = spark.createDataFrame([("i1", "c2"), ("i2", "c1")], "item_id string, chunk_id string")
    other = spark.createDataFrame([("a1", 1.0), ("a2", 0.5)], "a_id string, groundedness double")
    got = {r.metric: r.actual for r in N.run_measures(N.run_rows(rows, retrieved, gold, [other])).collect()}
    assert got["recall_5"] == pytest.approx(1 / 3) and got["mrr"] == pytest.approx(0.5 / 3) and got["groundedness"] == 0.5 and got["refusal_precision"] == 0.5 and got["refusal_recall"] == 0.5
    assert got["latency_p50"] == 20.0 and got["latency_p95"] == 30.0
    told = N.verdicts(spark.createDataFrame([("r", "mrr", 0.4), ("r", "hallucination_rate", 0.2), ("s", "mrr", 0.9), ("s", "hallucination_rate", 0.0)], "run_id string, metric string, actual double"), {"mrr": 0.5, "hallucination_rate": 0.1})
    assert {r.run_id: (r.status, r.violations) for r in told.collect()} == {"r": ("failed", ["hallucination_rate: 0.2 > ceiling 0.1", "mrr: 0.4 < floor 0.5"]), "s": ("passed", [])}


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "chunks")
    old = spark.createDataFrame([("j1", 1), ("j1", 2), ("j2", 3)], "job_id string, x int")
    S.append(old, str(tmp_path / "log"))
    S.append(old, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 6
    S.write_for_key(old, path, "job_id")
    S.write_for_key(spark.createDataFrame([("j1", 9)], old.schema), path, "job_id")
    assert sorted((r.job_id, r.x) for r in spark.read.parquet(path).collect()) == [("j1", 9), ("j2", 3)]
    S.replace_children(old, {"fields": old, "pages": old.limit(1)}, str(tmp_path / "meta"))
    assert spark.read.parquet(str(tmp_path / "meta" / "fields")).count() == 3
    left = S.cascade({"a": (old, "job_id"), "b": (old.withColumnRenamed("job_id", "id"), "id")}, old.filter("x = 3"), "job_id")
    assert {k: v.count() for k, v in left.items()} == {"a": 2, "b": 2}
    news = spark.createDataFrame([("j2", None)], old.schema)
    assert sorted((r.job_id, r.x or 0) for r in S.updated(old, news, ["job_id"], ["x"]).collect()) == [("j1", 1), ("j1", 2), ("j2", 0)]
    assert all(S.empty_table(spark, name).count() == 0 for name in ("chunks", "cache"))


def test_only_misses_are_computed(spark):
    asked_ = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2), ("c", 3)], "key string, n int")
    now = dt.datetime(2024, 1, 2)
    cache = spark.createDataFrame([("a", "A", dt.datetime(2024, 1, 3)), ("c", "C", dt.datetime(2024, 1, 1)), ("b", None, dt.datetime(2024, 1, 3))], S.SCHEMAS["cache"])
    seen = []

    def compute(misses):
        seen.extend(r.key for r in misses.collect())
        return misses.select("key", F.concat(F.lit("new"), F.col("n").cast("string")).alias("value"))

    out, new = S.got_or_set(asked_, cache, compute, F.lit(now))
    assert sorted(seen) == ["b", "c"] and sorted((r.key, r.value, r.hit) for r in out.collect()) == [("a", "A", True), ("b", "new2", False), ("b", "new2", False), ("c", "new3", False)]
    assert sorted(r.key for r in new.collect()) == ["b", "c"]


def test_quotas_begin_anew_on_first_use(spark):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, 30) + dt.timedelta(seconds=s)
    calls = [(0, 10), (59, 10), (60, 10), (100, None), (121, 10), (86399, 1), (86400, 1)]
    df = spark.createDataFrame([("p", at(s), n, i) for i, (s, n) in enumerate(calls)] + [("q", at(0), 1, 0)], "name string, ts timestamp, tokens long, i int")
    got = L.quota_states(df, "name", "ts", "tokens", "i", {"requests_per_minute": 1, "tokens_per_day": 35}).filter("name = 'p'").orderBy("i").collect()
    assert [(r.minute_requests, r.minute_tokens, r.day_requests, r.day_tokens, r.exceeded) for r in got] == [
        (1, 10, 1, 10, False), (2, 20, 2, 20, True), (1, 10, 3, 30, False), (2, 10, 4, 30, True), (1, 10, 5, 40, True), (1, 1, 6, 41, True), (1, 1, 1, 1, False),
    ]
