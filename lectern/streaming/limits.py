"""Sliding-window limits, expiring caches and circuit breakers, over tables and over streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.temporal import ROWS, asof_join, micros, ranged, running_totals


def sliding_limit(events: DataFrame, scope: str, ts: str, limit: int, seconds: int) -> DataFrame:
    """``events`` with ``in_window``, ``allowed``, ``remaining`` and ``retry_after``.

    An attempt counts itself and those less than the window's length before it, refused ones included. Attempts of one
    scope at one microsecond see each other.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    span = W.partitionBy(scope).orderBy("_at").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    seen = events.withColumn("_at", at).withColumn("in_window", F.count("*").over(span)).withColumn("_first", F.min("_at").over(span))
    wait = F.greatest(F.lit(1), (F.floor(seconds - (F.col("_at") - F.col("_first")) / 1e6) + 1).cast("int"))
    ok = F.col("in_window") <= limit
    return seen.withColumn("allowed", ok).withColumn("remaining", F.greatest(F.lit(0), limit - F.col("in_window")).cast("int")).withColumn("retry_after", F.when(ok, 0).otherwise(wait)).drop("_at", "_first")


def sliding_limit_stream(events: DataFrame, scope: str, ts: str, limit: int, seconds: int) -> DataFrame:
    """(scope, ts, in_window, allowed) of a stream: the same rule, with the times of each scope's window as its state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times: list[int] = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(ts)
        for t in rows[ts]:
            now = t.value // 1000
            times = [x for x in times if x > now - seconds * 1_000_000] + [now]
            yield pd.DataFrame({scope: [key[0]], ts: [t], "in_window": [len(times)], "allowed": [len(times) <= limit]})
        state.update((times,))
        state.setTimeoutDuration(2000 * seconds)

    kind = dict(events.dtypes)[scope]
    out = f"{scope} {kind}, {ts} timestamp, in_window long, allowed boolean"
    return events.select(scope, ts).groupBy(scope).applyInPandasWithState(step, out, "times array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def first_seen_stream(events: DataFrame, key: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """A stream without repeats of a key, remembered for as long as the watermark allows."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def live_entries(cache: DataFrame, written: str, now, seconds: int) -> DataFrame:
    """Cache entries that haven't expired: those written less than ``seconds`` before now."""
    return cache.filter(F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col(written).cast("timestamp")) < seconds * 1_000_000)


def evicted(cache: DataFrame, key: str, *patterns: str) -> DataFrame:
    """Entries whose keys match none of the patterns, in which ``*`` stands for anything."""
    out = cache
    for p in patterns:
        out = out.filter(~F.col(key).like(p.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")))
    return out


def folded(rows: DataFrame, key: str, order: list[str], columns: list[str], step: Callable[[Any, tuple], tuple[Any, tuple]], out: str) -> DataFrame:
    """(key, columns of ``order``, ``out``): each row's answer of a fold over its key's rows in order.

    ``step(state, values)`` takes the state, None at first, and a row's ``columns``, and gives the next state and the
    answer. Rows come sorted in batches, so that a key of any length needs the memory of one batch and one state.
    """
    kept = rows.select(key, *order, *[c for c in columns if c not in order])
    names = kept.columns
    own, told = names.index(key), [names.index(c) for c in order]
    given = [names.index(c) for c in columns]
    answer = StructType.fromDDL(out)
    schema = StructType([*[kept.schema[c] for c in (key, *order)], *answer])
    kinds = [to_arrow_type(f.dataType) for f in answer]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, begun = None, None, False
        for batch in batches:
            got: list[tuple] = []
            for k, *values in zip(batch.column(own).to_pylist(), *(batch.column(i).to_pylist() for i in given)):
                if not begun or k != now:
                    now, state, begun = k, None, True
                state, one = step(state, tuple(values))
                got.append(one)
            found = [pa.array(x, t) for x, t in zip(zip(*got) if got else [()] * len(kinds), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(own), *(batch.column(i) for i in told), *found], schema.names)

    return kept.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows that are sorted by their first columns, one table for each value of those."""
    now, held = None, []
    for batch in batches:
        told = list(zip(*(c.to_pylist() for c in batch.columns[:keys])))
        cuts = [0, *(i for i in range(1, len(told)) if told[i] != told[i - 1]), len(told)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                if held and told[a] != now:
                    yield now, pa.Table.from_batches(held)
                    held = []
                now = told[a]
                held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


#: Calls without a time come before all others.
_BEFORE_ALL = -(1 << 62)
_STATE = "struct<failures:int,opened:bigint>"


def breaker_step(threshold: int, recovery: int) -> Callable[[Any, tuple], tuple[Any, tuple]]:
    """One call of a breaker, (microseconds or time, success): the next state (failures, when it opened) and (allowed, state)."""

    def step(state, values):
        failures, opened = state or (0, None)
        at, good = values
        at = at if at is None or isinstance(at, int) else int(at.timestamp() * 1_000_000 + 0.5) if not hasattr(at, "value") else at.value // 1000
        at = _BEFORE_ALL if at is None else at
        if opened is not None and at - opened <= recovery * 1_000_000:
            return (failures, opened), (False, "open")
        if good:
            return (0, None), (True, "closed")
        failures = min(failures + 1, threshold)
        opened = at if opened is not None or failures >= threshold else None
        return (failures, opened), (True, "closed" if opened is None else "open")

    return step


def breaker_table(at: np.ndarray, ok: list, threshold: int, recovery: int) -> tuple[list, list]:
    """What calls in order make of every state that a breaker may come to them in.

    The first list has the state after them for a closed breaker with 0, 1, ... failures. The second has (time, state): a breaker that opened at t0 lets the
    first of these calls through whose time is more than the recovery after t0, and is in that state in the end; if there is none, it
    stays as it is. Only calls that can be the first are listed, and runs with one state as their last call. Found from the last call to the first.
    """
    wait, n = recovery * 1_000_000, len(at)
    after = np.searchsorted(at, at + wait, side="right")
    closed = [(f, None) for f in range(threshold)]
    probed: list = [None] * n
    for i in range(n - 1, -1, -1):
        opened = probed[after[i]] if after[i] < n else (threshold, int(at[i]))
        if ok[i]:
            probed[i] = closed[0]
            closed = [closed[0]] * threshold
        else:
            probed[i] = opened
            closed = [*closed[1:], opened]
    most = min(n, int(np.searchsorted(at, at[0] + wait, side="right")) + 1) if n else 0
    probes = [(int(at[i]), probed[i]) for i in range(most) if i + 1 == most or probed[i] != probed[i + 1]]
    return closed, probes


def breaker_after(state: tuple, closed: list, probes: list, recovery: int) -> tuple:
    """The state after the calls that a table stands for."""
    failures, opened = state
    if opened is None:
        return tuple(closed[failures])
    return next((tuple(s) for at, s in probes if at > opened + recovery * 1_000_000), (failures, opened))


def breaker_states(calls: DataFrame, name: str, ts: str, ok: str, order: str, threshold: int = 3, recovery: int = 300, rows: int = ROWS) -> DataFrame:
    """(name, order, allowed, state, at): a circuit breaker's answer to each call, and its state after it.

    It opens after ``threshold`` failures in a row. Once more than ``recovery`` seconds have gone by, one call is let through: its
    success closes the breaker, its failure opens it again. Calls that aren't let through change nothing. A null success is a failure, a null time
    before all others; calls at one time go by ``order``.

    Time is cut into ranges. Each range says for every state what state it leaves; these tables, a few rows for each name and range, are put
    together along time; then each range is played through from the state it is entered in. A name with all calls takes as many tasks as there are ranges.
    ``at`` is the time of the call in microseconds.
    """
    kept = calls.select(F.struct(name).alias("_key"), micros(calls, ts).alias("_at"), F.coalesce(F.col(ok), F.lit(False)).alias("_ok"), F.col(order).alias("_order"))
    cut = ranged(kept, "_at", rows).withColumn("_at", F.coalesce("_at", F.lit(_BEFORE_ALL))).select("_range", F.to_json("_key").alias("_name"), "_at", "_order", "_ok", "_key")
    dealt = cut.repartition("_name", "_range").sortWithinPartitions("_name", "_range", "_at", "_order")
    empty = "closed array<" + _STATE + ">, probes array<struct<at:bigint,after:" + _STATE + ">>"
    of_tables, of_states = (to_arrow_schema(StructType.fromDDL(d)) for d in (f"_name string, _range int, {empty}", "_name string, _range int, failures int, opened bigint"))

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, part), run in _runs(batches, 2):
            closed, probes = breaker_table(run.column(2).to_numpy(), run.column(3).to_pylist(), threshold, recovery)
            state = lambda s: {"failures": s[0], "opened": s[1]}
            told = {"_name": key, "_range": part, "closed": [state(s) for s in closed], "probes": [{"at": at, "after": state(s)} for at, s in probes]}
            yield pa.RecordBatch.from_pylist([told], of_tables)

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, (0, None)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["_name"] != now:
                    now, state = row["_name"], (0, None)
                out.append({"_name": now, "_range": row["_range"], "failures": state[0], "opened": state[1]})
                pair = lambda s: (s["failures"], s["opened"])
                state = breaker_after(state, [pair(s) for s in row["closed"]], [(p["at"], pair(p["after"])) for p in row["probes"]], recovery)
            yield pa.RecordBatch.from_pylist(out, of_states)

    found = dealt.select("_name", "_range", "_at", "_ok").mapInArrow(tables, f"_name string, _range int, {empty}")
    states = found.repartition("_name").sortWithinPartitions("_name", "_range").mapInArrow(entered, "_name string, _range int, failures int, opened bigint")
    ready = dealt.join(states, ["_name", "_range"]).sortWithinPartitions("_name", "_range", "_at", "_order")
    step = breaker_step(threshold, recovery)
    schema = StructType([kept.schema["_key"], kept.schema["_order"], *StructType.fromDDL("allowed boolean, state string, at bigint")])

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            allowed, told = [], []
            for name, part, at, good, failures, opened in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if (name, part) != now:
                    now, state = (name, part), (failures, opened)
                state, (yes, word) = step(state, (at, good))
                allowed.append(yes)
                told.append(word)
            yield pa.RecordBatch.from_arrays([batch.column(6), batch.column(7), pa.array(allowed, pa.bool_()), pa.array(told, pa.string()), batch.column(2)], schema.names)

    out = ready.select("_name", "_range", "_at", "_ok", "failures", "opened", "_key", "_order").mapInArrow(answers, schema)
    return out.select(F.col(f"_key.{name}").alias(name), F.col("_order").alias(order), "allowed", "state", "at")


def first_free(asked: DataFrame, id: str, ts: str, calls: DataFrame, name: str, ok: str, order: str, chain: list[str], threshold: int = 3, recovery: int = 300) -> DataFrame:
    """(id, name) of every row asked: the first of a chain of names whose breaker lets a call through at that time; null if none does.

    Breakers are played from ``calls`` (``name``, ``ts``, ``ok``, ``order``). A call at the very time counts; a name without calls is free.
    """
    # Calls that weren't let through change nothing, so that an open breaker opened at the last one that was.
    turns = breaker_states(calls, name, ts, ok, order, threshold, recovery).filter("allowed").select(F.col(name).alias("_name"), F.col("at").alias("_turn"), F.col(order).alias("_order"), "state")
    each = asked.select(F.col(id).alias("_id"), micros(asked, ts).alias("_asked"), F.posexplode(F.array(*map(F.lit, chain))).alias("_place", "_name"))
    known = asof_join(each, turns, ["_name"], "_asked", "_turn", {"_order": "_order", "_state": "state", "_since": "_turn"})
    free = F.coalesce(F.col("_state") != "open", F.lit(True)) | (F.col("_asked") - F.col("_since") > recovery * 1_000_000)
    return known.groupBy("_id").agg(F.min_by("_name", F.when(free, F.col("_place"))).alias(name)).withColumnRenamed("_id", id)


QUOTAS = "minute_requests long, minute_tokens long, day_requests long, day_tokens long, exceeded boolean"
_LIMITS = ("requests_per_minute", "tokens_per_minute", "requests_per_day", "tokens_per_day")
_MINUTE, _DAY = 60_000_000, 86_400_000_000


def quota_step(limits: dict[str, int]) -> Callable[[Any, tuple], tuple[Any, tuple]]:
    """One call of a quota, (time, tokens): the next state and (counts of the minute and of the day, whether a limit is exceeded)."""

    def step(state, values):
        at, n = values
        minute_at, day_at, counts = state or (at, at, (0, 0, 0, 0))
        if (at - day_at).total_seconds() >= 86400:
            minute_at, day_at, counts = at, at, (0, 0, 0, 0)
        elif (at - minute_at).total_seconds() >= 60:
            minute_at, counts = at, (0, 0, *counts[2:])
        counts = tuple(c + x for c, x in zip(counts, (1, n or 0) * 2))
        return (minute_at, day_at, counts), (*counts, any(limits.get(k) and c > limits[k] for k, c in zip(_LIMITS, counts)))

    return step


def _window_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, when a minute or a day began, when its day began) of sorted (name, time): one step for each window, not for each row."""
    now, minute, day = None, 0, 0
    for batch in batches:
        out: list[tuple] = []
        names, times = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            at = times[a:b]
            if names[a] != now:
                now, minute, day = names[a], int(at[0]), int(at[0])
                out.append((now, minute, day))
            while (i := int(np.searchsorted(at, min(minute + _MINUTE, day + _DAY)))) < len(at):
                minute = int(at[i])
                day = minute if minute >= day + _DAY else day
                out.append((now, minute, day))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ((), (), ()), (pa.string(), pa.int64(), pa.int64()))], ["_name", "_minute", "_day"])


def quota_states(calls: DataFrame, name: str, ts: str, tokens: str, order: str, limits: dict[str, int], rows: int = ROWS) -> DataFrame:
    """(name, order, minute_requests, minute_tokens, day_requests, day_tokens, exceeded) after each call.

    Counts of a minute and of a day begin anew with the first call at or after their deadline, which is a minute or a day
    after they last began, not with the clock; the end of a day begins a minute, too. ``limits`` may have
    requests_per_minute, tokens_per_minute, requests_per_day and tokens_per_day; a limit of 0 is none. Null tokens are none; calls without a time count
    nothing and get nulls; calls at one time go by ``order``.

    When windows begin can only be told from one to the next: that pass reads names and times, in order, and takes one step for each window. Calls find
    their window by an as-of join and are counted by running totals, both of which split a name with all calls by time.
    """
    timed = calls.select(F.to_json(F.struct(name)).alias("_name"), F.col(name).alias("_key"), micros(calls, ts).alias("_at"), F.coalesce(F.col(tokens), F.lit(0)).cast("long").alias("_tokens"), F.col(order).alias("_order"))
    known = timed.filter("_at IS NOT NULL").select("_name", "_at")
    starts = known.repartition("_name").sortWithinPartitions("_name", "_at").mapInArrow(_window_starts, "_name string, _minute long, _day long")
    placed = ranged(asof_join(timed, starts, ["_name"], "_at", "_minute", {"_minute": "_minute", "_day": "_day"}, rows), "_at", rows)
    one = F.when(F.col("_at").isNotNull(), 1).cast("long")
    counted = running_totals(placed, ["_name", "_day", "_minute"], ["_at", "_order"], {"minute_requests": one, "minute_tokens": F.col("_tokens") * one})
    counted = running_totals(counted, ["_name", "_day"], ["_at", "_order"], {"day_requests": one, "day_tokens": F.col("_tokens") * one})
    columns = [c.split()[0] for c in QUOTAS.split(", ")][:4]
    over = F.lit(False)
    for limit, column in zip(_LIMITS, columns):
        if limits.get(limit):
            over = over | (F.col(column) > limits[limit])
    known_at = F.col("_at").isNotNull()
    return counted.select(F.col("_key").alias(name), F.col("_order").alias(order), *[F.when(known_at, F.col(c)).alias(c) for c in columns], F.when(known_at, over).alias("exceeded"))
