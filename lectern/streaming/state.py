"""Caches, breakers and quotas as state of streams that are folded in order of event time.

Events are kept until the watermark has gone past them and are then folded in order, so that what a stream says doesn't depend on the order in
which events came, or in which batches: it says what the fold of the whole table says. Events that are later than the watermark
allows are left out by Spark. Folds start again from their checkpoint.
"""

from __future__ import annotations

import functools
import pickle
import re
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import StructType

from ..operators.temporal import asof_join, micros

#: What is done first of what happens at one time.
RANKS = {"evict": 0, "set": 1, "get": 2}
EVENTS = "event_id long, ts timestamp, op string, key string, value string"
ANSWERS = "event_id long, key string, hit boolean, value string"


#: Rows that are sorted at once, rows of a block of state, and rows that are handed on at once.
RUN_ROWS, BLOCK_ROWS, HANDED_ROWS = 100_000, 4_096, 10_000


def _said(column: pa.Array) -> list:
    """Values of a column; times as pandas has them, which know no local zone."""
    if not pa.types.is_timestamp(column.type):
        return column.to_pylist()
    return [None if v is pd.NaT else v for v in column.to_pandas().tolist()]


class Ordered(StatefulProcessor):
    """Keeps rows until the watermark is past them and hands them on in order; subclasses fold them.

    Rows are kept in blocks, each an entry of state of its own: what comes is sorted in runs of bounded size, and a run is cut into blocks.
    Rows that are due are merged from blocks that overlap in time, which alone are in memory, and a block is taken out once it is read.
    A timer stands at the earliest row that is kept. Kept columns come after ``skip`` others.
    """

    skip = 0

    def __init__(self, ts: str, order: list[str], columns: str):
        self.ts, self.order, self.columns = ts, order, columns
        # Workers have no session to parse columns with.
        self.kind = StructType.fromDDL(columns)
        self.names = self.kind.names
        self.of_timer, self.of_state, self.of_block = StructType.fromDDL("at long"), StructType.fromDDL("value binary"), StructType.fromDDL("number long")

    def init(self, handle) -> None:
        self.handle = handle
        # Times are without a zone, as they come.
        self.arrow = pa.schema([pa.field(f.name, pa.timestamp("us") if pa.types.is_timestamp(f.type) else f.type) for f in to_arrow_schema(self.kind)])
        self.kept = handle.getListState("kept", self.kind)
        self.blocks = handle.getMapState("blocks", self.of_block, self.of_state)
        self.places = handle.getValueState("places", self.of_state)
        self.timer = handle.getValueState("timer", self.of_timer)
        self.begin(handle)

    def begin(self, handle) -> None:
        """Makes the states of a subclass."""

    def fold(self, key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        """Answers to rows that come in order."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, size, first = [], 0, None
        for part in rows:
            # By place, since names that begin with an underscore don't reach this function.
            new = part.iloc[:, self.skip : self.skip + len(self.names)].set_axis(self.names, axis=1)
            held.append(pa.Table.from_pandas(new, self.arrow, preserve_index=False))
            size += len(new)
            if size >= RUN_ROWS:
                first, held, size = min(self._store(held), first or 1 << 62), [], 0
        if size:
            first = min(self._store(held), first or 1 << 62)
        if first is not None:
            self._wake(first // 1000)
        yield pd.DataFrame()

    def _wake(self, at: int) -> None:
        now = self.timer.get()[0] if self.timer.exists() else None
        if now is None or at < now:
            if now is not None:
                self.handle.deleteTimer(now)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def _where(self) -> list[tuple[int, int]]:
        """(earliest time, number) of the blocks that are kept."""
        return pickle.loads(self.places.get()[0]) if self.places.exists() else []

    def _times(self, rows: pa.Table) -> np.ndarray:
        return rows.column(self.ts).cast(pa.int64()).to_numpy()

    def _sorted(self, rows: list[pa.Table]) -> pa.Table:
        table = pa.concat_tables(rows)
        return table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in (self.ts, *self.order)], null_placement="at_start")).combine_chunks()

    def _store(self, rows: list[pa.Table]) -> int:
        """Writes rows as blocks; their earliest time."""
        table, where = self._sorted(rows), self._where()
        number = max((n for _, n in where), default=-1) + 1
        times = self._times(table)
        for at in range(0, len(table), BLOCK_ROWS):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, self.arrow, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table.slice(at, BLOCK_ROWS))
            self.blocks.updateValue((number,), (sink.getvalue().to_pybytes(),))
            where.append((int(times[at]), number))
            number += 1
        self.places.update((pickle.dumps(where),))
        return int(times[0])

    def _due(self, watermark: int) -> Iterator[tuple]:
        """Rows up to the watermark in order, taken out of state. Spark lets through what is later than the watermark's millisecond."""
        end = (watermark + 1) * 1000
        where = sorted(self._where())
        due, left = [w for w in where if w[0] < end], [w for w in where if w[0] >= end]
        held, size, most = [], 0, HANDED_ROWS
        for i, (_, number) in enumerate(due):
            held.append(pa.ipc.open_stream(bytes(self.blocks.getValue((number,))[0])).read_all())
            self.blocks.removeKey((number,))
            size += len(held[-1])
            if size >= most or i + 1 == len(due):
                # What is earlier than the blocks to come is in order now.
                table = self._sorted(held)
                cut = int(np.searchsorted(self._times(table), due[i + 1][0] if i + 1 < len(due) else end))
                for batch in table.slice(0, cut).to_batches(max_chunksize=HANDED_ROWS):
                    yield from zip(*map(_said, batch.columns))
                held, size = [table.slice(cut)], len(table) - cut
                most = max(HANDED_ROWS, 2 * size)
        self.places.update((pickle.dumps(left),))
        if size:
            self._store(held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        if self.kept.exists():
            # State of before there were blocks.
            self._store([pa.Table.from_pylist([dict(zip(self.names, r)) for r in self.kept.get()], self.arrow)])
            self.kept.clear()
        self.timer.clear()
        told: list[tuple] = []
        for answer in self.fold(key, self._due(watermark)):
            told.append(answer)
            if len(told) == HANDED_ROWS:
                yield self.frame(told)
                told = []
        if where := self._where():
            self._wake(min(where)[0] // 1000)
        else:
            self.places.clear()
        yield self.frame(told)

    def frame(self, answers: list[tuple]) -> pd.DataFrame:
        raise NotImplementedError

    def close(self) -> None:
        pass


class _Steps(Ordered):
    """A fold by a step function, with its state pickled as one value."""

    skip = 1

    def __init__(self, ts: str, order: list[str], columns: str, given: list[str], step: Callable[[Any, tuple], tuple[Any, tuple]], told: list[str]):
        super().__init__(ts, order, columns)
        self.given, self.step, self.told = given, step, told

    def begin(self, handle) -> None:
        self.state = handle.getValueState("state", self.of_state)

    def fold(self, key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        at, order = [self.names.index(c) for c in self.given], self.names.index(self.order[0])
        now = pickle.loads(self.state.get()[0]) if self.state.exists() else None
        for row in rows:
            now, answer = self.step(now, tuple(row[i] for i in at))
            yield (key[0], row[order], *answer)
        self.state.update((pickle.dumps(now),))

    def frame(self, answers: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(answers, columns=self.told) if answers else pd.DataFrame()


def folded_stream(events: DataFrame, key: str, ts: str, order: str, columns: list[str], step: Callable[[Any, tuple], tuple[Any, tuple]], out: str, delay: str) -> DataFrame:
    """(key, order, ``out``) of a stream: the answers of ``limits.folded`` with the same step, once events are older than ``delay``."""
    names = list(dict.fromkeys([ts, order, *columns]))
    kept = StructType([events.schema[n] for n in names])
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.fields)
    told = StructType([events.schema[key], events.schema[order], *StructType.fromDDL(out).fields])
    processor = _Steps(ts, [order], ddl, columns, step, told.names)
    rows = events.select(key, *names).withWatermark(ts, delay)
    return rows.groupBy(key).transformWithStateInPandas(processor, told, "Append", "EventTime")


class _Cache(Ordered):
    """Entries of a shard of keys. All rows that are due are folded over entries that are read once, and what changed is written back.

    An entry is taken out when the watermark passes the time at which it expires. One timer stands at the earliest such time, so that a
    shard wakes once for each batch, however many entries it has.
    """

    def __init__(self, seconds: int):
        super().__init__("ts", ["_rank", "value", "event_id"], EVENTS + ", _rank int")
        self.seconds, self.told = seconds, StructType.fromDDL(ANSWERS).names
        self.kinds = [StructType.fromDDL(d) for d in ("key string", "value string, expires timestamp")]

    def begin(self, handle) -> None:
        self.entries = handle.getMapState("entries", *self.kinds)
        self.expiry = handle.getValueState("expiry", self.of_timer)

    def fold(self, key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        held = {k[0]: (v[0], v[1], -1) for k, v in self.entries.iterator()}
        before = set(held)
        # The place of the last eviction by each pattern, in order of places: an entry meets only those that came after it was set.
        evicted: dict[str, int] = {}

        def live(name: str) -> tuple | None:
            entry = held.get(name)
            if entry is not None:
                for pattern, place in reversed(evicted.items()):
                    if place < entry[2]:
                        break
                    if matches(name, pattern):
                        return held.pop(name) and None
            return entry

        for place, (event, at, op, name, value, _) in enumerate(rows):
            if op == "set" and name is not None:
                held[name] = (value, at + pd.Timedelta(seconds=self.seconds), place)
            elif op == "evict" and name is not None:
                evicted.pop(name, None)
                evicted[name] = place
            elif op == "get":
                entry = live(name) if name is not None else None
                hit = entry is not None and pd.Timestamp(at) < pd.Timestamp(entry[1])
                yield event, name, hit, entry[0] if hit else None
        for name in list(held):
            live(name)
        for name in before - held.keys():
            self.entries.removeKey((name,))
        for name, entry in held.items():
            if entry[2] >= 0:
                self.entries.updateValue((name,), entry[:2])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        # Rows that are due come before what expires at the same timer: a row may ask for an entry that is about to go.
        folded = self.timer.exists() and self.timer.get()[0] <= watermark
        if folded:
            yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)
        due = self.expiry.get()[0] if self.expiry.exists() else None
        if folded or (due is not None and due <= watermark):
            self._swept(watermark, due)
        yield pd.DataFrame()

    def _swept(self, watermark: int, due: int | None) -> None:
        """Takes out entries that no row to come can hit, and moves the timer to the earliest expiry of the others."""
        ends = [(int(v[1].timestamp() * 1000) + 1, k[0]) for k, v in self.entries.iterator()]
        for end, name in ends:
            if end <= watermark:
                self.entries.removeKey((name,))
        first = min((end for end, _ in ends if end > watermark), default=None)
        if first != due:
            if due is not None and due > watermark:
                self.handle.deleteTimer(due)
            if first is None:
                self.expiry.clear()
            else:
                self.handle.registerTimer(first)
                self.expiry.update((first,))

    def frame(self, answers: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(answers, columns=self.told) if answers else pd.DataFrame()


def matches(key: str, pattern: str) -> bool:
    """Whether a key matches a pattern in which ``*`` stands for anything and nothing else has a meaning."""
    return _like(pattern).fullmatch(key) is not None


@functools.lru_cache(10_000)
def _like(pattern: str) -> re.Pattern:
    return re.compile(".*".join(map(re.escape, pattern.split("*"))), re.S)


def cache_stream(events: DataFrame, seconds: int, delay: str = "1 hour", shards: int = 64) -> DataFrame:
    """(event_id, key, hit, value) of every ``get`` of a stream of events (event_id, ts, op, key, value): what a cache would answer.

    ``set`` writes an entry that expires ``seconds`` later; ``evict`` takes out all entries whose keys match a pattern. At one time evictions come
    before sets and those before gets; of several sets the largest value stays. Keys are dealt to shards, each of which gets all evictions.
    """
    own = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")
    to = F.when(F.col("op") == "evict", F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(F.array(own))
    rank = F.lit(None).cast("int")
    for op, place in RANKS.items():
        rank = F.when(F.col("op") == op, place).otherwise(rank)
    rows = events.filter(F.col("op").isin(*RANKS)).select(*StructType.fromDDL(EVENTS).names, rank.alias("_rank"), F.explode(to).alias("_shard"))
    return rows.withWatermark("ts", delay).groupBy("_shard").transformWithStateInPandas(_Cache(seconds), ANSWERS, "Append", "EventTime")


def cache_replay(events: DataFrame, seconds: int) -> DataFrame:
    """The same answers from a table of events: the last set of the key, unless it expired or a later eviction matches.

    Which patterns match which keys is found by the part of a pattern before its first ``*``: keys and patterns meet where they begin alike. Lengths of such
    parts, which are as few as patterns are short, come to the driver. Keys that are null are never hit.
    """
    at = micros(events, "ts")
    rows = events.withColumn("_at", at)
    gets = rows.filter("op = 'get'").select("event_id", "key", "_at")
    sets = rows.filter("op = 'set' AND key IS NOT NULL").select("key", F.col("_at").alias("_set_at"), "value")
    found = asof_join(gets, sets, ["key"], "_at", "_set_at", {"_set_at": "_set_at", "_value": "value"})
    live = found.filter(F.col("_at") < F.col("_set_at") + seconds * 1_000_000)
    evictions = rows.filter("op = 'evict' AND key IS NOT NULL").select(F.col("key").alias("pattern"), F.col("_at").alias("_evicted_at"))
    begins = evictions.select("pattern", F.substring_index("pattern", "*", 1).alias("_begin")).distinct()
    lengths = [r[0] for r in begins.select(F.length("_begin")).distinct().collect()]
    keys = live.select("key").distinct().withColumn("_length", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>"))).withColumn("_begin", F.left("key", F.col("_length")))
    like = F.replace(F.replace(F.replace(F.replace("pattern", F.lit("\\"), F.lit("\\\\")), F.lit("%"), F.lit("\\%")), F.lit("_"), F.lit("\\_")), F.lit("*"), F.lit("%"))
    hit_by = keys.join(begins, "_begin").filter(F.col("_length") == F.length("_begin")).filter(F.call_function("like", F.col("key"), like)).select("key", "pattern")
    asked = live.select("event_id", "key", "_at").join(hit_by, "key")
    evicted = asof_join(asked, evictions, ["pattern"], "_at", "_evicted_at", {"_evicted_at": "_evicted_at"}).groupBy("event_id").agg(F.max("_evicted_at").alias("_evicted_at"))
    kept = live.join(evicted, "event_id", "left").filter("_evicted_at IS NULL OR _evicted_at < _set_at")
    hits = kept.select("event_id", F.lit(True).alias("hit"), F.col("_value").alias("value"))
    return gets.select("event_id", "key").join(hits, "event_id", "left").select("event_id", "key", F.coalesce("hit", F.lit(False)).alias("hit"), "value")


#: State of these streams needs a store that can hold lists, maps and timers.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_to_end(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Plays all that a stream has into Parquet files, going on from the checkpoint if it is there."""
    spark = stream.sparkSession
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(STORE[0], before) if before else spark.conf.unset(STORE[0])
