"""Chats, whitening and clustering against plain Python and numpy."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import chat, clustering, whitening

LOG = "conv_id long, seq long, message string, kind string, role string, text string"
TURNS = "conv_id long, turn long, role string, text string"
VECTORS = "vec_id long, embedding array<double>"
MARKS = ["</s>", "[INST]", "[/INST]", "[SYS]", "[ROLE]", "[/ROLE]", "<s>", "\\", "\\\\", "<", "[", "\n", "é😀", " ", "a", "", "/s>", "INST]", "<\\/s>"]


def folded(log):
    """The fold in plain Python: events of each message in order, one after another."""
    said, order = {}, {}
    key = lambda v: (v is not None, v if v is not None else 0)
    for conv, seq, message, kind, role, text in sorted(log, key=lambda r: (key(r[1]), *((r[i] is not None, r[i] or "") for i in (3, 4)), r[5] or "")):
        now = said.setdefault((conv, message), {"text": "", "role": None, "gone": False})
        order.setdefault((conv, message), seq)
        now["role"] = now["role"] if now["role"] is not None else role
        if kind in ("message", "edit", "regenerate"):
            now.update(text="" if kind == "regenerate" else text or "", gone=False)
        elif kind == "delta":
            now["text"] += text or ""
        elif kind == "delete":
            now["gone"] = True
    return sorted(((c, m, order[c, m], v["role"] or "", v["text"]) for (c, m), v in said.items() if not v["gone"]), key=repr)


def test_logs_fold_as_one_event_after_another(spark):
    r = random.Random(5)
    kinds = ["message", "delta", "delta", "delta", "edit", "regenerate", "delete", "odd", None]
    log = [(r.choice([1, 2, None]), r.choice([*range(40), None]), r.choice(["a", "b", "c", None]), r.choice(kinds), r.choice(["user", "assistant", None]), r.choice([*"xyz", "", None])) for _ in range(400)]
    log += log[:20]
    got = chat.messages(spark.createDataFrame(log, LOG).withColumn("_events", F.lit(1)).withColumn("position", F.lit(2)))
    assert sorted((tuple(x) for x in got.collect()), key=repr) == folded(log)


def test_edits_regenerations_and_deletions(spark):
    log = [
        (1, 1, "q", "message", "user", "wie"), (1, 2, "a", "message", "assistant", ""), (1, 3, "a", "delta", None, "dra"), (1, 4, "a", "regenerate", None, "ignored"), (1, 5, "a", "delta", None, "fi"),
        (1, 7, "a", "delta", None, "nal"), (1, 6, "q", "edit", None, "who"), (1, 8, "gone", "message", "user", "x"), (1, 9, "gone", "delete", None, None), (2, 1, "d", "delta", None, None),
    ]
    got = {tuple(r) for r in chat.messages(spark.createDataFrame(log, LOG)).collect()}
    assert got == {(1, "q", 1, "user", "who"), (1, "a", 2, "assistant", "final"), (2, "d", 1, "", "")}
    formatted = chat.format_chats(spark.createDataFrame(log, LOG)).filter("conv_id = 1").first()
    assert formatted["formatted"] == "[INST]who</s>[/INST]final</s>"
    assert [tuple(s) for s in formatted["loss"]] == [(20, 25, 20, 25)]


def test_rendered_texts_come_back_whatever_they_hold(spark):
    r = random.Random(9)
    turns = [(c, t, r.choice(["user", "assistant", "system", "tool", "[ROLE]", "a\n</s>", "", None]), "".join(r.choice(MARKS) for _ in range(r.randint(0, 12)))) for c in range(60) for t in range(r.randint(1, 6))]
    turns += [(7, 1, "user", "same"), (7, 1, "user", "same"), (7, 1, "assistant", None), (None, None, "user", "no id"), (None, 3, None, None), (99, 0, "assistant", "x[INST]\\" * 30_000)]
    frame = spark.createDataFrame(turns, TURNS)
    template = chat.Template()
    out = chat.format_chats(chat.log_of_turns(frame, piece=7), template).select("conv_id", "formatted", "loss", chat.read_back(F.col("formatted"), template).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("learned"))
    expected = {}
    for c, t, role, text in sorted(turns, key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        expected.setdefault(c, []).append((role or "", text or ""))
    found = {row["conv_id"]: row for row in out.collect()}
    assert found.keys() == expected.keys()
    for c, row in found.items():
        assert [tuple(t) for t in row["turns"]] == expected[c]
        assert row["learned"] == "".join(t for role, t in expected[c] if role == "assistant")
        for s in row["loss"]:
            assert row["formatted"][s["start"] : s["end"]].encode() == row["formatted"].encode()[s["byte_start"] : s["byte_end"]]
        # Control strings stand only where turns begin and end: one pair for each turn, and the pair around other names.
        others = sum(role not in template.opens for role, _ in expected[c])
        assert sum(row["formatted"].count(m) for m in template.controls()) == 2 * len(expected[c]) + others


def test_chat_digests_and_their_sql(spark):
    import duckdb

    turns = [(1, 0, "system", "s"), (1, 1, "user", "hé</s>"), (1, 2, "assistant", "a[INST]\\"), (2, 5, "tool[SYS]", None), (3, None, None, ""), (3, 0, "assistant", "😀" * 1200), (3, 0, "assistant", "b")]
    got = chat.digests(chat.log_of_turns(spark.createDataFrame(turns, TURNS).withColumn("message", F.lit("clash")).withColumn("_part", F.lit(1))))
    con = duckdb.connect()
    con.execute("CREATE TABLE t (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", turns)
    assert sorted(tuple(r) for r in got.collect()) == sorted(con.execute(chat.sql("t")).fetchall())
    assert chat.digests(chat.log_of_turns(spark.createDataFrame([], TURNS))).collect() == []
    one = got.filter("conv_id = 1").first()
    assert one["turns_sha256"] == hashlib.sha256("system\ns\nuser\nhé</s>\nassistant\na[INST]\\\n".encode()).hexdigest() and one["loss_chars"] == 8


def test_templates_whose_marks_could_be_mistaken_are_refused():
    for bad in ({"end": "x"}, {"end": "</s><"}, {"end": "a\\b"}, {"opens": {"user": "[U]", "assistant": "[U]x"}}, {"opens": {"user": "[ROLE]"}}):
        with pytest.raises(ValueError):
            chat.Template(**bad)


def test_chats_stay_in_the_engine(spark):
    plan = chat.digests(chat.log_of_turns(spark.createDataFrame([(1, 0, "user", "x")], TURNS)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def odd_vectors(n=300, width=6, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, width)) * np.arange(1, width + 1) + 50
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    nan, inf = float("nan"), float("inf")
    bad = [(900, None), (901, []), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (903, [nan] * 6), (904, [inf, 1.0, 1.0, 1.0, 1.0, 1.0]), (905, [1.0, 2.0]), (906, [1e300] * 6)]
    return rows + [(None, x[0].tolist()), (5, x[5].tolist())], bad


def test_whitening_equals_numpy(spark):
    good, bad = odd_vectors()
    frame = spark.createDataFrame([*good, *bad], VECTORS).repartition(5).withColumn("whitened", F.lit(1)).withColumn("part", F.lit("x"))
    rows = whitening.components(frame, k=4).collect()
    x = np.floor(1024 * np.array([v for _, v in good])).astype(np.int64) + 100_000
    n, mean = len(x), x.mean(axis=0)
    e, u = np.linalg.eigh((x - mean).T @ (x - mean) / n)
    e, u = e[::-1], u[:, ::-1]
    assert len(rows) == 4 * n and {r["component"] for r in rows} == {1, 2, 3, 4} and {r["n"] for r in rows} == {n}
    exact = {i: int(((n * row - x.sum(axis=0)) ** 2).sum()) for (i, _), row in zip(good, x)}
    expected = {i: (row - mean) @ u[:, :4] / np.sqrt(e[:4]) for (i, _), row in zip(good, x)}
    sign = np.sign([sum(r["whitened"] * expected[r["vec_id"]][c] for r in rows if r["component"] == c + 1) for c in range(4)])
    for r in rows:
        c = r["component"] - 1
        assert r["deviation"] == exact[r["vec_id"]]
        assert r["whitened"] == pytest.approx(sign[c] * expected[r["vec_id"]][c], abs=1e-9)
        assert r["explained"] == pytest.approx(e[c] / e.sum(), rel=1e-9) and r["identity_error"] < 1e-9


def test_whitening_of_nothing_of_equals_and_of_large_numbers(spark):
    assert whitening.components(spark.createDataFrame([], VECTORS)).collect() == []
    assert whitening.components(spark.createDataFrame([(1, None), (2, [])], VECTORS)).collect() == []
    assert whitening.components(spark.createDataFrame([(1, [2.0, 3.0]), (2, [2.0, 3.0])], VECTORS)).collect() == []
    line = whitening.components(spark.createDataFrame([(1, [0.0, 3.0]), (2, [1.0, 3.0]), (3, [1.0])], VECTORS)).collect()
    assert {(r["vec_id"], r["component"], round(abs(r["whitened"]), 9)) for r in line} == {(1, 1, 1.0), (2, 1, 1.0)}
    far = spark.createDataFrame([(1, [1e12]), (2, [-1e12]), (3, [0.0])], VECTORS)
    model = whitening.fit(far)
    exact = {r["vec_id"]: int(r["deviation"]) for r in whitening.whiten(far, model, ["vec_id"]).collect()}
    assert exact == {1: (3 * 1024 * 10**12) ** 2, 2: (3 * 1024 * 10**12) ** 2, 3: 0}
    assert all(r["deviation"] is None for r in whitening.components(far).collect() if r["vec_id"] < 3)
    with pytest.raises(ValueError):
        whitening.whiten(far.withColumn("Whitened", F.lit(1)), model, ["Whitened"])


@pytest.mark.parametrize("matrix", [np.zeros((20, 20)), np.eye(30), np.diag([5.0] + [1.0] * 40), np.diag([5.0, 4, 3] + [0.0] * 40), np.diag([3.0]), "random", "spread"])
def test_lanczos_finds_the_largest_pairs(matrix):
    if isinstance(matrix, str):
        q = np.linalg.qr(np.random.default_rng(2).standard_normal((400, 400)))[0]
        matrix = (q * (np.arange(400) ** 2 if matrix == "random" else 0.8 ** np.arange(400))) @ q.T
    asked = []
    values, vectors, passes = whitening.block_lanczos(lambda b: (asked.append(b.shape[1]), matrix @ b)[1], len(matrix), 8, block=4, most=40)
    expected = np.sort(np.linalg.eigvalsh(matrix))[::-1][: len(values)]
    top = max(expected[0], 1e-9)
    assert len(values) == min(8, len(matrix)) and passes == len(asked)
    assert np.abs(values - expected).max() <= 1e-10 * top
    assert np.linalg.norm(matrix @ vectors - vectors * values) <= 1e-8 * top
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-10


def plain_clusters(rows, k=8, rounds=10):
    x = [[int(np.floor(1024 * c)) for c in v] for _, v in rows]
    order = sorted(range(len(rows)), key=lambda i: (hashlib.sha256(f"3:{'' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest(), x[i]))
    centroids = [x[i] for i in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for v in x:
            groups.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(d) // len(groups[i]) for d in zip(*groups[i])] if i in groups else c for i, c in enumerate(centroids)]
    found = [near(v) for v in x]
    inertia = {i: sum(d for d, j in found if j == i) for i in range(k)}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for (i, _), (d, c) in zip(rows, found)), key=repr)


def test_clusters_equal_plain_rounds(spark):
    rng = np.random.default_rng(8)
    middles = rng.standard_normal((5, 64))
    # Few distinct values, copies and symmetric pairs make ties.
    x = np.concatenate([np.round((middles[rng.integers(0, 5, 200)] + rng.standard_normal((200, 64)) / 2) * 2) / 2, np.eye(64)[:20], -np.eye(64)[:20], np.zeros((5, 64))])
    good = [(i, v) for i, v in enumerate(x.tolist())] + [(3, x[9].tolist()), (3, x[3].tolist()), (None, x[1].tolist())]
    bad = [(900, None), (901, []), (902, [None] + [1.0] * 63), (903, [float("nan")] * 64), (904, [float("inf")] + [1.0] * 63), (905, [1.0] * 65), (906, [1e300] * 64)]
    frame = spark.createDataFrame([*good, *bad], VECTORS).repartition(4).withColumn("cluster", F.lit("clash")).withColumn("x", F.lit(1))
    assert sorted((tuple(r) for r in clustering.assignments(frame).collect()), key=repr) == plain_clusters(good)
    _, _, calculated = clustering.cluster(frame.select("vec_id", "embedding"), ["vec_id"])
    assert sum(calculated[1:]) < 0.7 * 8 * len(good) * (len(calculated) - 1)


def test_clusters_of_few_and_no_vectors(spark):
    few = [(i, [float(i)] * 64) for i in range(3)]
    assert sorted((tuple(r) for r in clustering.assignments(spark.createDataFrame(few, VECTORS)).collect()), key=repr) == plain_clusters(few)
    assert clustering.assignments(spark.createDataFrame([], VECTORS)).collect() == []
    assert clustering.assignments(spark.createDataFrame([(1, None), (2, [1.0])], VECTORS)).collect() == []


def test_bounds_hold_and_keep_ties():
    rng = np.random.default_rng(4)
    x = rng.integers(-3, 4, (500, 3))
    centroids = rng.integers(-3, 4, (6, 3))
    cluster, upper, lower = clustering.first_bounds(x, centroids)
    for _ in range(6):
        moved = centroids + rng.integers(-1, 2, centroids.shape)
        cluster, upper, lower, calculated = clustering.moved_bounds(x, cluster, upper, lower, moved, clustering.squares(moved, centroids))
        centroids = moved
        exact = ((x[:, None] - centroids) ** 2).sum(axis=2)
        assert (cluster == exact.argmin(axis=1)).all()
        assert (upper.astype(float) ** 2 >= exact[np.arange(500), cluster]).all() and (lower.astype(float) ** 2 <= exact).all()


def test_passed_over_lists_keep_their_places():
    column = pa.array([[1.0, 2.0], None, [3.0], [4.0, None], [5.0, 6.0]], pa.list_(pa.float32()))
    at, x = clustering.whole(column.slice(1), 2, 10)
    assert at.tolist() == [3] and x.tolist() == [[50, 60]]
