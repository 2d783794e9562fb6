"""Folds of events in order of time: over tables that are cut into ranges, and as state of streams that stop and go on."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import temporal as T
from lectern.streaming import limits as L
from lectern.streaming import state as S

T0 = dt.datetime(2024, 1, 1)
CALLS = "name string, ts timestamp, ok boolean, tokens long, i int"


def calls(n=500, seed=3, span=3000):
    r = random.Random(seed)
    return [(r.choice(["p", "p", "p", "q", None]), T0 + dt.timedelta(seconds=r.randint(0, span)), r.choice([True, False, None]), r.choice([1, 5, None]), i) for i in range(n)]


def played(rows, step, columns):
    out = {}
    for name in {r[0] for r in rows}:
        state = None
        for row in sorted((r for r in rows if r[0] == name), key=lambda r: (r[1], r[4])):
            state, out[row[4]] = step(state, tuple(row[i] for i in columns))
    return out


@pytest.mark.parametrize("rows", [1 << 20, 60, 9])
def test_breakers_and_quotas_are_the_same_however_time_is_cut(spark, rows):
    said = calls()
    df = spark.createDataFrame(said, CALLS).withColumn("_range", F.lit("clash"))
    utc = [(n, t.replace(tzinfo=dt.timezone.utc), ok, k, i) for n, t, ok, k, i in said]
    got = {r["i"]: (r["allowed"], r["state"]) for r in L.breaker_states(df, "name", "ts", "ok", "i", rows=rows).collect()}
    assert got == played(utc, L.breaker_step(3, 300), (1, 2)) and any(not a for a, _ in got.values())
    limits = {"requests_per_minute": 1, "tokens_per_day": 300}
    far = [(n, T0 + (t - T0) * 100, ok, k, i) for n, t, ok, k, i in said]
    got = {r["i"]: tuple(r)[2:] for r in L.quota_states(spark.createDataFrame(far, CALLS), "name", "ts", "tokens", "i", limits, rows).collect()}
    assert got == played(far, L.quota_step(limits), (1, 3))


def test_calls_without_a_time_and_no_calls(spark):
    rows = [("p", None, False, 1, i) for i in range(3)] + [("p", T0, True, 2, 3)]
    df = spark.createDataFrame(rows, CALLS)
    got = {r["i"]: (r["allowed"], r["state"]) for r in L.breaker_states(df, "name", "ts", "ok", "i").collect()}
    assert got == {0: (True, "closed"), 1: (True, "closed"), 2: (True, "open"), 3: (True, "closed")}
    quotas = {r["i"]: r["minute_requests"] for r in L.quota_states(df, "name", "ts", "tokens", "i", {}).collect()}
    assert quotas == {0: None, 1: None, 2: None, 3: 1}
    none = spark.createDataFrame([], CALLS)
    assert L.breaker_states(none, "name", "ts", "ok", "i").collect() == [] and L.quota_states(none, "name", "ts", "tokens", "i", {}).collect() == []


def test_tables_of_a_breaker_say_what_playing_does():
    r = random.Random(8)
    for _ in range(60):
        at, now = [], 1000
        for _ in range(r.randint(1, 12)):
            now += r.choice([0, 1, 3, 5])
            at.append(now * 1_000_000)
        ok = [r.random() < 0.4 for _ in at]
        closed, probes = L.breaker_table(L.np.array(at), ok, 3, 4)
        step = L.breaker_step(3, 4)
        for state in [(0, None), (1, None), (2, None), *((3, t * 1_000_000) for t in range(990, at[0] // 1_000_000 + 1))]:
            want = state
            for call in zip(at, ok):
                want, _ = step(want, call)
            assert L.breaker_after(state, closed, probes, 4) == want


def test_as_of_joins_equal_a_search(spark):
    r = random.Random(1)
    left = [(r.choice([1, 1, 1, 1, 2, None]), r.choice([r.randint(0, 500), None]), i) for i in range(300)]
    right = [(r.choice([1, 1, 1, 1, 2, None]), r.choice([r.randint(-5, 500), None]), r.choice(["a", "b", None]), i) for i in range(150)]
    frames = spark.createDataFrame(left, "k int, t long, i long").withColumn("_at", F.lit(1)).withColumn("s", F.lit("own")), spark.createDataFrame(right, "k int, t long, s string, n long")
    for rows in (1 << 20, 40):
        got = {x["i"]: (x["status"], x["n"]) for x in T.asof_join(*frames, ["k"], "t", "t", {"status": "s", "n": "n"}, rows).collect()}
        for k, t, i in left:
            found = [(at, s is not None, s or "", n) for key, at, s, n in right if None not in (k, t, key, at) and key == k and at <= t]
            best = max(found) if found else None
            assert got[i] == ((best[2] if best[1] else None, best[3]) if best else (None, None))
    empty = frames[1].limit(0)
    assert {x["status"] for x in T.asof_join(frames[0], empty, ["k"], "t", "t", {"status": "s"}).collect()} == {None}
    assert T.asof_join(frames[0].limit(0), frames[1], ["k"], "t", "t", {"status": "s"}).collect() == []


def test_running_totals_and_durations(spark):
    r = random.Random(2)
    rows = [(r.choice([1, 1, None]), r.randint(0, 90), i) for i in range(200)]
    cut = T.ranged(spark.createDataFrame(rows, "k int, t long, i long"), "t", 15)
    assert cut.select("_range").distinct().count() > 8
    got = {x["i"]: x["n"] for x in T.running_totals(cut, ["k"], ["t", "i"], {"n": F.col("t")}).collect()}
    assert got == {i: sum(u for q, u, j in rows if q == k and (u, j) <= (t, i)) for k, t, i in rows}
    times = spark.createDataFrame([(1, 5), (1, 9), (1, 9), (1, 20), (2, 3)], "job_id int, at long")
    assert sorted((x["job_id"], x["at"], x["seconds"]) for x in T.durations(times, rows=2).filter("seconds IS NOT NULL").collect()) == [(1, 5, 4e-6), (1, 9, 1.1e-5), (1, 9, 1.1e-5)]


def cache_events(n=400, seed=6):
    r = random.Random(seed)
    keys = ["qa:1", "qa:2", "qa_1", "chunk:1", "a%b", "", None]
    out = [(i, T0 + dt.timedelta(seconds=r.randint(0, 4000), microseconds=r.randint(0, 3)), r.choice(["get", "get", "set", "set", "evict", "odd", None]), r.choice(keys), r.choice(["x", "y", None])) for i in range(n)]
    return [(i, t, op, r.choice(["qa:*", "*1", "chunk:1", "a%*", "q*1", "*", None]) if op == "evict" and r.random() < 0.3 else k if op != "evict" else "none*", v) for i, t, op, k, v in out]


def answered(events, seconds):
    """A cache in plain Python."""
    held, out = {}, {}
    rank = {"evict": 0, "set": 1, "get": 2}
    for i, at, op, key, value in sorted((e for e in events if e[2] in rank), key=lambda e: (e[1], rank[e[2]], (e[4] is not None, e[4] or ""), e[0])):
        if op == "set" and key is not None:
            held[key] = (value, at + dt.timedelta(seconds=seconds))
        elif op == "evict" and key is not None:
            held = {k: v for k, v in held.items() if not S.matches(k, key)}
        elif op == "get":
            hit = key in held and at < held[key][1]
            out[i] = (key, hit, held[key][0] if hit else None)
    return out


def test_a_cache_is_replayed_from_a_table(spark):
    events = cache_events()
    want = answered(events, 600)
    got = {r["event_id"]: tuple(r)[1:] for r in S.cache_replay(spark.createDataFrame(events, S.EVENTS), 600).collect()}
    assert got == want and len({h for _, h, _ in want.values()}) == 2
    assert S.cache_replay(spark.createDataFrame([], S.EVENTS), 600).collect() == []


def in_parts(spark, rows, schema, folder, number):
    """Rows of a stream in files that arrive one after another: nearly in order, some of them late."""
    r = random.Random(4)
    placed = sorted(rows, key=lambda e: e[1] + dt.timedelta(seconds=r.randint(0, 300)))
    size = -(-len(placed) // number)
    return [placed[i : i + size] for i in range(0, len(placed), size)]


def test_a_cache_stream_with_late_rows_and_a_restart_says_the_same(spark, tmp_path):
    events = cache_events(160)
    want = answered(events, 600)
    source, out, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "checkpoint"))
    parts = in_parts(spark, events, S.EVENTS, source, 3)
    # A last event far ahead lets the watermark pass all others.
    parts[-1].append((9999, T0 + dt.timedelta(days=2), "get", "end", None))
    for part in parts:
        spark.createDataFrame(part, S.EVENTS).coalesce(1).write.mode("append").parquet(source)
        stream = S.cache_stream(spark.readStream.schema(S.EVENTS).parquet(source), 600, "10 minutes", shards=3)
        S.run_to_end(stream, out, checkpoint)
    rows = spark.read.parquet(out).collect()
    assert len(rows) == len(want) and {r["event_id"]: tuple(r)[1:] for r in rows} == want


def test_a_breaker_stream_says_what_the_table_says(spark, tmp_path):
    said = [c for c in calls(200) if c[0]]
    source, out, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "checkpoint"))
    parts = in_parts(spark, said, CALLS, source, 2)
    parts[-1].append(("p", T0 + dt.timedelta(days=2), True, 1, 9999))
    parts[-1].append(("q", T0 + dt.timedelta(days=2), True, 1, 9998))
    for part in parts:
        spark.createDataFrame(part, CALLS).coalesce(1).write.mode("append").parquet(source)
        stream = S.folded_stream(spark.readStream.schema(CALLS).parquet(source), "name", "ts", "i", ["ts", "ok"], L.breaker_step(3, 300), "allowed boolean, state string", "10 minutes")
        S.run_to_end(stream, out, checkpoint)
    want = {r["i"]: (r["allowed"], r["state"]) for r in L.breaker_states(spark.createDataFrame(said, CALLS), "name", "ts", "ok", "i").collect()}
    assert {r["i"]: (r["allowed"], r["state"]) for r in spark.read.parquet(out).collect() if r["i"] < 9000} == want


class Handle:
    """State of one key in plain Python, which counts timers."""

    def __init__(self):
        self.timers, self.registered = set(), 0

    def registerTimer(self, at):
        self.timers.add(at)
        self.registered += 1

    def deleteTimer(self, at):
        self.timers.discard(at)

    def getListState(self, name, kind):
        return Held([])

    def getValueState(self, name, kind):
        return Held(None)

    def getMapState(self, name, *kinds):
        return Held({})


class Held:
    def __init__(self, of):
        self.of = of

    def exists(self):
        return self.of not in (None, [])

    def get(self):
        return self.of

    def clear(self):
        self.of = [] if isinstance(self.of, list) else None

    def put(self, rows):
        self.of = rows

    def update(self, value):
        self.of = value

    def iterator(self):
        return iter([*self.of.items()])

    def keys(self):
        return iter([*self.of])

    def containsKey(self, key):
        return key in self.of

    def getValue(self, key):
        return self.of[key]

    def updateValue(self, key, value):
        self.of[key] = value

    def removeKey(self, key):
        del self.of[key]


def test_a_shard_of_the_cache_wakes_once_however_many_entries_it_has():
    class At:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

        getExpiryTimeInMs = getCurrentWatermarkInMs

    handle, cache = Handle(), S._Cache(600)
    cache.init(handle)
    start = T0.timestamp() * 1000
    cache.kept.of = [(i, T0 + dt.timedelta(seconds=i), "set", f"k{i}", "v", 1) for i in range(300)]
    cache.timer.of = (int(start),)
    told = [len(f) for f in cache.handleExpiredTimer((0,), At(start + 299_000), At(start))]
    assert sum(told) == 0 and len(cache.entries.of) == 300 and handle.registered == 1
    # Half of the entries end; one timer stands at the next end.
    (due,) = handle.timers
    list(cache.handleExpiredTimer((0,), At(start + 750_000), At(due)))
    assert len(cache.entries.of) == 150 and handle.registered == 2 and cache.expiry.of[0] > start + 750_000


def test_rows_that_are_due_are_merged_from_blocks_and_few_are_held_at_once(spark, monkeypatch):
    """A key's rows come in order whatever blocks they are in; only blocks that overlap are in memory, and those left keep a timer."""
    import pandas as pd

    class At:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    for name, rows in (("RUN_ROWS", 500), ("BLOCK_ROWS", 50), ("HANDED_ROWS", 60)):
        monkeypatch.setattr(S, name, rows)
    most, got = [0], []

    class Kept(S.Ordered):
        def fold(self, key, rows):
            for row in rows:
                yield row

        def _sorted(self, rows):
            most[0] = max(most[0], sum(map(len, rows)))
            return super()._sorted(rows)

        def frame(self, answers):
            got.extend(answers)
            return pd.DataFrame(answers)

    r, handle, kept = random.Random(5), Handle(), Kept("ts", ["name", "i"], "ts timestamp, name string, i long")
    kept.init(handle)
    rows = [(T0 + dt.timedelta(seconds=r.randint(0, 4000)), r.choice(["a", "b", None]), i) for i in range(6000)]
    frames = [pd.DataFrame(rows[i : i + 100], columns=["ts", "name", "i"]) for i in range(0, 6000, 100)]
    list(kept.handleInputRows((1,), iter(frames), None))
    start, order = pd.Timestamp(T0).value // 1_000_000, lambda x: (x[0], x[1] is not None, x[1] or "", x[2])
    assert handle.timers == {int(start + min((t - T0).total_seconds() for t, _, _ in rows) * 1000)} and len(kept.blocks.of) == 120
    list(kept.handleExpiredTimer((1,), At(start + 1_000_000), None))
    early = [x for x in rows if x[0] <= T0 + dt.timedelta(seconds=1000)]
    assert got == sorted(early, key=order) and len(kept.blocks.of) < 120
    list(kept.handleExpiredTimer((1,), At(start + 9_000_000), None))
    assert got == sorted(rows, key=order) and kept.blocks.of == {} and not kept.places.exists()
    # Of 6,000 rows, 12 runs overlap by a block or two each.
    assert most[0] <= 2000
