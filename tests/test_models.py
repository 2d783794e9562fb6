"""Ports to models, replies that are checked and held back, vectors laid out by nearness."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import generation as G
from lectern.operators import vectors as V
from lectern.sources import ports as O
from lectern.sources import vectors as C

T0 = dt.datetime(2024, 1, 1)


def counting(folder, model):
    """A model that writes down what it is asked: one file for each call."""

    def ask(rows):
        import uuid

        (folder / uuid.uuid4().hex).write_text(json.dumps(rows))
        return model(rows)

    return ask


def test_each_distinct_input_is_asked_for_once_in_batches(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i % 7}" if i % 5 else None) for i in range(60)], "id int, text string").coalesce(1).withColumn("value", F.lit("clash"))
    model = counting(tmp_path, lambda rows: [f"<{t}>" for (t,) in rows])
    out, new = O.ask(rows.drop("value"), model, ["text"], O.digest("text"), "string", batch=3)
    assert {r["id"]: r["value"] for r in out.collect()} == {i: f"<t{i % 7}>" if i % 5 else "<None>" for i in range(60)}
    calls = [json.loads(p.read_text()) for p in tmp_path.iterdir()]
    assert sum(map(len, calls)) == 8 == new.count() and max(map(len, calls)) <= 3
    # What a cache holds and hasn't expired isn't asked for.
    cache = new.limit(5).withColumn("expires_at", F.lit(T0 + dt.timedelta(days=1)))
    _, missed = O.ask(rows.drop("value"), model, ["text"], O.digest("text"), "string", cache, F.lit(T0))
    _, late = O.ask(rows.drop("value"), model, ["text"], O.digest("text"), "string", cache, F.lit(T0 + dt.timedelta(days=2)))
    assert (missed.count(), late.count()) == (3, 8)
    assert O.ask(rows.drop("value").limit(0), model, ["text"], O.digest("text"), "string")[0].collect() == []


def test_failures_cost_single_inputs_only(spark):
    def judge(rows):
        if any(a == "bad" for _, a in rows):
            raise ConnectionError("no")
        return [float(len(a or "")) for _, a in rows]

    pairs = spark.createDataFrame([(1, "x", "abc"), (2, "x", "bad"), (3, "x", None), (4, "x", "abc")], "id int, expected string, answer string").coalesce(1)
    assert {r["id"]: r["grade"] for r in O.judged(pairs, judge).collect()} == {1: 3.0, 2: 0.0, 3: 0.0, 4: 3.0}
    with pytest.raises(Exception, match="answers to"):
        O.judged(pairs, lambda rows: [1.0] * (len(rows) + 1)).collect()


def test_the_default_models_say_what_the_operators_say(spark):
    texts = spark.createDataFrame([(1, "A b\tc é"), (2, "a a ß"), (3, ""), (4, None), (5, "A b\tc é")], "id int, text string")
    got = sorted(tuple(r) for r in O.embedded(texts, "id", "text").collect())
    want = V.dense_postings(V.postings(texts, "id", "text"), "id")
    assert got == sorted(tuple(r) for r in want.collect()) and got
    pairs = spark.createDataFrame([("a b", "B c"), ("", "x"), (None, "x"), ("a", "A")], "query string, text string")
    assert [r["score"] for r in O.reranked(pairs).orderBy("query", "text").collect()] == pytest.approx([0.0, 0.0, 1.0, 1 / 3])


CHUNKS = "q_id int, rank int, chunk_id string, text string, book_name string, volume string, printed_page_start int, topic string, kitab string, bab string, region string, verified boolean, rerank_score double"


@pytest.fixture(scope="module")
def evidence(spark):
    chunks = spark.createDataFrame([(q, i, f"c{i}", f"Text {i} of water.", "Book", str(i), 10 + i, "t", "", None, "main", True, 0.9 - i / 10) for q in range(9) for i in (1, 2)], CHUNKS)
    asked = spark.createDataFrame([(q, "what is water", "en", False, q != 0) for q in range(9)], "q_id int, query string, language string, translated boolean, evidence_sufficient boolean")
    return asked.join(G.gathered(chunks), "q_id").cache()


def reply(**other):
    return json.dumps({"answer_language": "en", "explanation": {"html": "<p>[EVIDENCE_1]</p>"}, "citations": [{"chunk_id": "c1", "book": "made up", "page": 3}]} | other)


def test_the_first_reply_that_is_sound_or_fails_decides(spark, evidence):
    replies = [
        (0, 1, reply()), (1, 1, reply(caveats=["x"], arabic_quotes=[{"text": "q"}])), (2, 1, "["), (2, 2, reply()), (3, 1, None), (3, 2, reply()), (4, 1, "["), (4, 2, None), (5, 1, "["), (5, 2, reply(citations=[])), (5, 3, reply()),
        (6, 1, reply(answer_language="bn")), (7, 2, "x"), (7, 1, reply(refusal={"reason": "insufficient_evidence", "closest_evidence": ["e"]})),
    ]
    checked = G.checked_replies(evidence, spark.createDataFrame(replies, "q_id int, attempt int, reply string"))
    told = {r["q_id"]: (r["branch"], r["attempt"], r["fault"]) for r in checked.collect()}
    assert told == {
        0: ("refuse", 1, None), 1: ("assemble", 1, None), 2: ("assemble", 2, None), 3: ("synthesise", 1, None), 4: ("synthesise", 2, None), 5: ("give_up", 2, "uncited evidence"), 6: ("give_up", 1, "language"),
        7: ("assemble", 1, None), 8: ("synthesise", None, None),
    }
    answers = {r["q_id"]: r for r in G.answers_with_replies(checked, F.upper).collect()}
    assert {q: a["branch"] for q, a in answers.items()} == {0: "refused", 1: "assembled", 2: "assembled", 3: "synthesised", 4: "synthesised", 5: "refused", 6: "refused", 7: "assembled", 8: "synthesised"}
    assert {q: a["refusal_reason"] for q, a in answers.items() if a["refusal_reason"]} == {0: "insufficient_evidence", 5: "generation_unavailable", 6: "generation_unavailable", 7: "insufficient_evidence"}
    one = answers[1]
    assert one["html"] == "<P>[EVIDENCE_1]</P>" and [(c["chunk_id"], c["book"], c["page"]) for c in one["citations"]] == [("c1", "Book", "11")]
    assert one["caveats"] == ["x"] and one["quotes"][0]["text"] == "q" and answers[7]["closest"] == ["e"] and one["confidence"]["score"] == 0.8


def test_deltas_are_held_until_a_reply_is_whole_and_sound(spark, evidence):
    def cut(q, text, attempt=1, whole=True):
        parts = [text[i : i + 9] for i in range(0, len(text), 9)]
        rows = [(q, attempt, i, T0 + dt.timedelta(milliseconds=i), "delta", p) for i, p in enumerate(parts)]
        return rows + [(q, attempt, len(parts), T0 + dt.timedelta(milliseconds=len(parts)), "end", None)] if whole else rows[:-1]

    good = cut(1, reply())
    deltas = spark.createDataFrame(good + good[:2] + cut(2, reply(), whole=False) + cut(3, "no") + cut(1, reply(answer_language="bn"), 2), "q_id int, attempt int, seq int, ts timestamp, kind string, text string")
    got = G.released(G.held_replies(deltas.orderBy(F.rand(3))), evidence).orderBy("q_id", "attempt", "seq").collect()
    by = {}
    for r in got:
        by.setdefault((r["q_id"], r["attempt"]), []).append((r["event"], r["text"], r["cacheable"]))
    assert "".join(t for e, t, _ in by[1, 1] if e == "delta") == reply() and by[1, 1][-1] == ("done", None, True)
    assert by[2, 1] == [("error", "broken off", False)] and by[3, 1] == [("error", "not an object", False)] and by[1, 2] == [("error", "language", False)]


VECTORS = "vec_id long, embedding array<float>, label int"


def test_cells_give_the_exact_nearest_and_skip_files(spark, tmp_path):
    rng = np.random.default_rng(5)
    middles = rng.standard_normal((12, 16)) * 3
    x = (middles[np.arange(600) % 12] + rng.standard_normal((600, 16)) * 0.2).astype(np.float32)
    x[7] = x[19]
    rows = [(i, v, i % 12 // 3) for i, v in enumerate(x.tolist())] + [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [], 1)]
    frame = spark.createDataFrame(rows, VECTORS)
    C.write_cells(frame, f"{tmp_path}/t", "vec_id", "embedding", ["label"], cells=24)
    queries = frame.filter("vec_id % 50 = 0 OR vec_id = 901").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q"))
    for where, kept in (({}, range(600)), ({"label": 2}, [i for i in range(600) if i % 12 // 3 == 2]), ({"label": 99}, [])):
        found, told = C.search_cells(queries, f"{tmp_path}/t", 5, where)
        got = {}
        for r in found.collect():
            got.setdefault(r["q_id"], []).append((r["rank"], r["id"], r["score"]))
        u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
        for q in range(0, 600, 50):
            best = sorted((-round(float(u[q] @ u[i]), 6), i) for i in kept)[:5]
            assert [(i, s) for _, i, s in sorted(got.get(q, []))] == [(i, pytest.approx(-s, abs=1.1e-6)) for s, i in best]
        assert told["cells"] <= 24 and told["meetings"] <= told["of"]
    _, told = C.search_cells(queries, f"{tmp_path}/t", 5, {"label": 2})
    assert told["ruled_out"] > 0 and told["meetings"] < told["of"] / 3
    # The hint of which files are read is kept: one question opens few cells.
    _, one = C.search_cells(queries.limit(1), f"{tmp_path}/t", 5, {})
    assert one["read"] < one["cells"] / 2


def test_tables_without_vectors(spark, tmp_path):
    none = spark.createDataFrame([(1, None, 1), (2, [0.0], 1)], VECTORS)
    C.write_cells(none, f"{tmp_path}/t", "vec_id", "embedding", ["label"])
    found, told = C.search_cells(none.select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q")), f"{tmp_path}/t")
    assert found.collect() == [] and told["cells"] == 0
    with pytest.raises(Exception, match="components"):
        C.write_cells(spark.createDataFrame([(1, [1.0], 1), (2, [1.0, 2.0], 1)], VECTORS), f"{tmp_path}/u", "vec_id", "embedding", ["label"])
