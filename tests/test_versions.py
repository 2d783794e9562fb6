"""Tables published together, increments of an index's health, retries and fallbacks from logs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lectern.functions.text import uuid5_url
from lectern.operators import indexing as I
from lectern.operators import jobs as J
from lectern.operators import relational as R
from lectern.sources import manifest as M
from lectern.streaming import health as H
from lectern.streaming import limits as L

T0 = dt.datetime(2024, 1, 1)


def frames(spark, rows, name):
    return spark.createDataFrame([(k, f"{name} {v}") for k, v in rows], "job_id long, value string")


def contents(spark, root, name, version=None):
    return sorted((r["job_id"], r["value"]) for r in M.read(spark, root, name, version).collect())


def test_a_writer_that_stops_leaves_the_version_before(spark, tmp_path):
    root = str(tmp_path)
    keys = spark.createDataFrame([(k,) for k in range(6)], "job_id long")
    both = {"parent": frames(spark, [(k, "a") for k in range(6)], "p"), "child": frames(spark, [(k, i) for k in range(4) for i in range(2)], "c")}
    M.replace(spark, root, both, keys, buckets=4)
    before = {n: contents(spark, root, n) for n in both}
    one = spark.createDataFrame([(2,), (3,)], "job_id long")
    news = {"parent": frames(spark, [(2, "b"), (3, "b")], "p"), "child": frames(spark, [(2, 9)], "c")}
    lost = M.replace(spark, root, news, one, stop_before_publishing=True)
    assert lost.number == 2 and M.current(spark, root).number == 1
    assert {n: contents(spark, root, n) for n in both} == before
    # What wasn't published is there for whoever knows of it, and both tables of a version belong together.
    assert contents(spark, root, "parent", lost) != before["parent"]
    second = M.replace(spark, root, news, one)
    assert contents(spark, root, "parent") == [(0, "p a"), (1, "p a"), (2, "p b"), (3, "p b"), (4, "p a"), (5, "p a")]
    assert contents(spark, root, "child") == [(k, f"c {i}") for k in (0, 1) for i in range(2)] + [(2, "c 9")]
    assert contents(spark, root, "child", M.Version(1, M._stored(spark, root, 1).tables)) == before["child"]
    assert second.number == 2
    third = M.replace(spark, root, {"parent": frames(spark, [], "p")}, one)
    assert [k for k, _ in contents(spark, root, "parent")] == [0, 1, 4, 5] and contents(spark, root, "child") == contents(spark, root, "child", second) and third.number == 3
    assert M.vacuum(spark, root, keep=1) >= 2 and [k for k, _ in contents(spark, root, "parent")] == [0, 1, 4, 5]
    assert M._numbers(spark, root) == [3]


def test_two_writers_and_strange_rows(spark, tmp_path):
    root, keys = str(tmp_path), spark.createDataFrame([(1,), (None,)], "job_id long")
    M.replace(spark, root, {"t": frames(spark, [(1, "a")], "t")}, keys, buckets=2)
    slow = M.replace(spark, root, {"t": frames(spark, [(1, "slow")], "t")}, keys, stop_before_publishing=True)
    M.replace(spark, root, {"t": frames(spark, [(1, "quick")], "t")}, keys)
    with pytest.raises(M.Conflict):
        M._publish(spark, root, slow)
    assert contents(spark, root, "t") == [(1, "t quick")]
    for rows in ([(2, "other key")], [(None, "no key")]):
        with pytest.raises(ValueError, match="other keys"):
            M.replace(spark, root, {"t": frames(spark, rows, "t")}, keys)
    with pytest.raises(ValueError, match="schema"):
        M.replace(spark, root, {"t": spark.createDataFrame([(1, 2)], "job_id long, value long")}, keys)
    assert M.current(spark, str(tmp_path / "none")) == M.Version(0, {})


def test_health_after_every_increment_is_that_of_the_whole(spark, tmp_path):
    r = random.Random(4)
    texts = ["same", "other", "third", None]
    uuid = {str(i): spark.range(1).select(uuid5_url(F.lit(str(i)))).first()[0] for i in range(12)}
    chunks, points = [], []
    changes, out, checkpoint = (f"{tmp_path}/{n}" for n in ("changes", "out", "checkpoint"))
    for step in range(4):
        rows = []
        for _ in range(8):
            if r.random() < 0.5:
                if chunks and r.random() < 0.3:
                    gone = chunks.pop(r.randrange(len(chunks)))
                    rows.append(("chunk", *gone, -1))
                else:
                    chunks.append((str(r.randrange(12)), r.choice(texts)))
                    rows.append(("chunk", *chunks[-1], 1))
            elif points and r.random() < 0.3:
                rows.append(("point", points.pop(r.randrange(len(points))), None, -1))
            else:
                points.append(r.choice([uuid[str(r.randrange(12))], f"stray {r.randrange(3)}"]))
                rows.append(("point", points[-1], None, 1))
        rows += [("odd", "x", None, 1), ("chunk", None, "same", 1)]
        spark.createDataFrame(rows, H.CHANGES).repartition(2).write.mode("append").parquet(changes)
        H.health_stream(spark, changes, out, checkpoint).awaitTermination()
        c = spark.createDataFrame(chunks, "chunk_id string, text string")
        p = spark.createDataFrame([(x,) for x in points], "point_id string").distinct()
        faults = R.index_health(c.select("chunk_id").distinct(), p)
        want = I.health_report(c.select("chunk_id").distinct(), p, faults, R.repeated_texts(c, F.col("text"))).first()
        got = H.report(spark, out).first()
        assert got.asDict(recursive=True) == want.asDict(recursive=True), step
    # A batch that is done again adds nothing.
    last = sorted(str(x) for x in (tmp_path / "out" / "log").iterdir())[-1].rsplit("=", 1)[1]
    again = spark.read.parquet(f"{out}/staged/{last}")
    assert again.count() > 0
    before = H.report(spark, out).first()
    H.merge(spark, spark.createDataFrame([], H.CHANGES), out, "empty")
    assert H.report(spark, out).first() == before


def test_failures_in_a_row_are_tried_again(spark):
    rows = [("j", T0 + dt.timedelta(seconds=i), failed, i) for i, failed in enumerate([True, True, False, True, True, True, True, True])] + [(None, T0, True, 50), ("k", T0, False, 51)]
    got = {r["i"]: (r["attempt"], r["retry"], r["wait"]) for r in J.retries(J.attempts(spark.createDataFrame(rows, "job string, at timestamp, failed boolean, i int"), "job", "at", "i", "failed")).collect()}
    assert got == {0: (0, True, 10), 1: (1, True, 20), 2: (0, False, None), 3: (0, True, 10), 4: (1, True, 20), 5: (2, True, 40), 6: (3, False, None), 7: (4, False, None), 50: (0, True, 10), 51: (0, False, None)}


def test_calls_go_to_the_first_provider_whose_breaker_is_closed(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    calls = [("a", at(s), False, i) for i, s in enumerate((0, 1, 2))] + [("b", at(5), True, 10)] + [("c", at(s), False, 20 + s) for s in (0, 1, 2)]
    asked = [(1, at(-5)), (2, at(1)), (3, at(2)), (4, at(302)), (5, at(303)), (6, None)]
    got = L.first_free(spark.createDataFrame(asked, "id int, ts timestamp"), "id", "ts", spark.createDataFrame(calls, "p string, ts timestamp, ok boolean, i int"), "p", "ok", "i", ["a", "c", "b"])
    assert {r["id"]: r["p"] for r in got.collect()} == {1: "a", 2: "a", 3: "b", 4: "b", 5: "a", 6: "a"}
    shut = L.first_free(spark.createDataFrame([(1, at(10))], "id int, ts timestamp"), "id", "ts", spark.createDataFrame(calls, "p string, ts timestamp, ok boolean, i int"), "p", "ok", "i", ["a", "c"])
    assert [r["p"] for r in shut.collect()] == [None]
