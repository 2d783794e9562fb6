"""Relational queries, limits, sources and the driver's contract."""

import datetime as dt

from pyspark.sql import functions as F

from lectern.functions.text import uuid5_url
from lectern.operators import relational as R
from lectern.sources import files as S
from lectern.streaming import limits as L


def test_index_health(spark):
    chunks = spark.createDataFrame([(c,) for c in ("healthy1", "unindexed1", "unindexed2", "dup1", "dup2")], "chunk_id string")
    points = chunks.filter("chunk_id = 'healthy1'").select(uuid5_url(F.col("chunk_id")).alias("point_id")).union(spark.createDataFrame([("lost",)], "point_id string"))
    got = R.index_health(chunks, points).collect()
    assert {(r.kind, r.id) for r in got} == {("orphan", "lost"), *[("unindexed", c) for c in ("dup1", "dup2", "unindexed1", "unindexed2")]}


def test_disjunctive_join_plans_without_comparing_all(spark):
    left = spark.createDataFrame([(1, 10, 11), (2, 12, None), (3, 10, 10)], "c int, a int, b int")
    right = spark.createDataFrame([(10, "x"), (11, "y"), (12, "z")], "id int, n string")
    out = R.either_key(left, right, "a", "b", "id")
    assert sorted((r.c, r.n) for r in out.collect()) == [(1, "x"), (1, "y"), (2, "z"), (3, "x")]
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_latest_upsert_and_replace(spark):
    jobs = spark.createDataFrame([("u", "e", 1, "completed", 1), ("u", "e", 2, "failed", 2), ("u", "m", 3, "completed", 1), ("v", "e", 4, "completed", 1), ("v", "m", 5, "completed", 2)], "upload_id string, kind string, id int, status string, created_at int")
    assert [r.upload_id for r in R.eligible_for_stage(jobs, {"e": "completed", "m": "completed"}).collect()] == ["v"]
    new = spark.createDataFrame([("u", "e", 9, "running", 9)], jobs.schema)
    assert {r.id for r in R.upsert(jobs, new, ["upload_id", "kind"]).collect()} == {9, 3, 4, 5}
    assert {r.id for r in R.replace_for_key(jobs, new, "upload_id", "u").collect()} == {9, 4, 5}
    assert R.payload_filter(jobs, kind="e", status=None).count() == 3 and R.payload_filter(jobs).count() == 5


def test_sliding_limit(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [("a", at(0)), ("a", at(10)), ("a", at(20)), ("a", at(60)), ("b", at(20))]
    got = L.sliding_limit(spark.createDataFrame(rows, "scope string, ts timestamp"), "scope", "ts", 2, 60).orderBy("scope", "ts").collect()
    assert [(r.in_window, r.allowed, r.retry_after, r.remaining) for r in got] == [(1, True, 0, 1), (2, True, 0, 0), (3, False, 41, 0), (3, False, 11, 0), (1, True, 0, 1)]


def test_limit_stream_agrees_with_the_table(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [("a", at(s)) for s in (0, 10, 20, 60, 61)] + [("b", at(5))]
    df = spark.createDataFrame(rows, "scope string, ts timestamp")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = L.sliding_limit_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "scope", "ts", 2, 60)
    q = stream.writeStream.format("memory").queryName("limited").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = L.sliding_limit(df, "scope", "ts", 2, 60)
    key = lambda d: sorted((r.scope, r.ts, r.in_window, r.allowed) for r in d.select("scope", "ts", "in_window", "allowed").collect())
    assert key(spark.table("limited")) == key(want)
    seen = L.first_seen_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "scope", "ts")
    q = seen.writeStream.format("memory").queryName("seen").option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.scope for r in spark.table("seen").collect()) == ["a", "b"]


def test_breaker_opens_and_recovers(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    calls = [(0, False), (1, False), (2, False), (3, True), (302, True), (303, False), (304, True), (305, True)]
    df = spark.createDataFrame([("p", at(s), ok, i) for i, (s, ok) in enumerate(calls)], "name string, ts timestamp, ok boolean, i int")
    got = L.breaker_states(df, "name", "ts", "ok", "i").orderBy("i").collect()
    assert [(r.allowed, r.state) for r in got] == [(True, "closed"), (True, "closed"), (True, "open"), (False, "open"), (False, "open"), (True, "open"), (False, "open"), (False, "open")]


def test_cache_expiry_and_patterns(spark):
    now = dt.datetime(2024, 1, 2)
    df = spark.createDataFrame([("qa:1", now), ("qa_2", now), ("emb:1", now - dt.timedelta(hours=30))], "key string, at timestamp")
    assert {r.key for r in L.live_entries(df, "at", now, 86400).collect()} == {"qa:1", "qa_2"}
    assert {r.key for r in L.evicted(df, "key", "qa:*", "chunk:*").collect()} == {"qa_2", "emb:1"}


def test_uploads(spark, tmp_path):
    files = {"a.pdf": b"%PDF-1 body %%EOF", "b.pdf": b"%PDF-1 body %%EOF", "c.pdf": b"PK", "e.pdf": b"%PDF" + b"x" * 3000}
    for name, body in files.items():
        (tmp_path / name).write_bytes(body)
    got = {r.filename: r.status for r in S.upload_files(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": "accepted", "b.pdf": "duplicate", "c.pdf": "bad_magic", "e.pdf": "no_trailer"}
    # The source passes over empty files; other sources may not.
    one = spark.createDataFrame([("d.pdf", 0, bytearray(b"")), ("f.pdf", S.MOST_BYTES + 1, bytearray(b"%PDF %%EOF"))], "path string, length long, content binary")
    assert {r.filename: r.status for r in S.uploads(one).collect()} == {"d.pdf": "empty", "f.pdf": "too_large"}


def test_gold_thresholds_and_frames(spark, tmp_path):
    (tmp_path / "gold.jsonl").write_text('# comment\n\n{"id":"1","question":{"en":"q"},"expected_citations":[{"book":"b"}]}\n{"id":"2","question":{"en":""}}\n{"id":"4","question":{"en":"q"},"category":"should_refuse"}\n{"id":"5","question":{"en":"q"}}\n{"id":"3","question":{"ar":"x"}}\n{"id":"3","question":{"ar":"y"}}\nnot json\n')
    got = sorted((r.id or "", r.fault or "") for r in S.gold_questions(spark, str(tmp_path / "gold.jsonl")).collect())
    assert got == [("", "invalid"), ("1", ""), ("2", "invalid"), ("3", "repeated"), ("3", "repeated"), ("4", "refusal not expected"), ("5", "no citations")]
    (tmp_path / "t.yaml").write_text("metrics:\n  recall@10: 0.75\n  mrr: 0.5  # floor\n")
    assert {r.metric: r.threshold for r in S.thresholds(spark, str(tmp_path / "t.yaml")).collect()} == {"recall@10": 0.75, "mrr": 0.5}
    df = spark.createDataFrame([("x", bytearray(b"ok")), ("y", bytearray(b"bad"))], "path string, content binary")

    def parse(content):
        if content == b"bad":
            raise ValueError("broken")
        yield {"page": 1, "block_index": 0, "text": "t", "x0": 1.0}

    out = {r.doc_id: (r.text, r.error) for r in S.page_frames(df, parse).collect()}
    assert out == {"x": ("t", None), "y": (None, "ValueError: broken")}

    def by_page(content):
        for n in range(1, 5):
            yield n, lambda n=n: [{"text": f"page {n}"}] if n != 2 else [][1]

    got = sorted((r.page, r.text or r.error.split(":")[0]) for r in S.page_frames(df.limit(1), by_page).collect())
    assert got == [(1, "page 1"), (2, "IndexError"), (3, "page 3"), (4, "page 4")]
    assert [r.error for r in S.page_frames(df.limit(1), by_page, most_pages=3).collect()] == ["TooManyPages: more than 3"]
    assert [list(x) for x in S.extraction_plan(5, 2)] == [[1, 2, 3], [4, 5]] and S.extraction_plan(0, 3) == []


def test_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["q_id", "place", "doc_id", "rerank_score"]
