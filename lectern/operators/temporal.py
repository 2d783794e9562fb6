"""Joins and running totals along time that split a hot key.

Time is cut into ranges of about equally many rows. What a range can say by itself is worked out range by range; what it needs to know
of earlier ones is one row for each key and range, carried on by a window over those few rows. So a key that has
all rows is worked on by as many tasks as there are ranges.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a range, and into how many bins of equal length time is cut to count them.
ROWS, BINS = 1 << 20, 4096


def micros(df: DataFrame, at: str) -> Column:
    """A time as whole microseconds; whole numbers are themselves."""
    return F.col(f"`{at}`") if dict(df.dtypes)[at] in ("bigint", "int") else F.unix_micros(F.col(f"`{at}`").cast("timestamp"))


def ranged(df: DataFrame, at: str, rows: int = ROWS) -> DataFrame:
    """``df`` with ``_range``: the number of the range that the long ``at`` is in, in order of ``at``; nulls are in the first.

    Rows are counted in bins of equal length; neighbouring bins make a range. Rows of one bin stay together.
    """
    seen = df.agg(F.min(at).alias("low"), F.max(at).alias("high"), F.count(at).alias("n")).first()
    if seen["n"] <= rows:
        return df.withColumn("_range", F.lit(0))
    width = (seen["high"] - seen["low"]) // BINS + 1
    of_bins = df.withColumn("_bin", ((F.col(at) - seen["low"]) / F.lit(width)).cast("long"))
    # Divisions of longs as doubles may be off by a bin, but alike for equal times and never out of order.
    counts, ranges, held, now = of_bins.filter("_bin IS NOT NULL").groupBy("_bin").count().orderBy("_bin").collect(), [], 0, 0
    for b in counts:
        if held and held + b["count"] > rows:
            now, held = now + 1, 0
        ranges.append((b["_bin"], now))
        held += b["count"]
    # At most as many rows as there are bins.
    known = df.sparkSession.createDataFrame(ranges, "_bin long, _range int")
    return of_bins.join(F.broadcast(known), "_bin", "left").withColumn("_range", F.coalesce("_range", F.lit(0))).drop("_bin")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, columns: dict[str, str], rows: int = ROWS) -> DataFrame:
    """``left`` with columns of the last row of ``right`` that has equal keys and isn't later: new names by those of ``right``.

    Of rows of ``right`` at one time the one with the largest values counts, in the order in which ``columns`` names them. Null keys and
    times match nothing. Every row of ``left`` comes out once; both may hold columns of any other name.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    key = [F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)]
    value = F.struct(*[F.col(f"`{c}`").alias(new) for new, c in columns.items()])
    own = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    sides = left.select(*key, micros(left, left_at).alias("_at"), F.lit(1).alias("_side"), own.alias("_left"))
    others = right.select(*key, micros(right, right_at).alias("_at"), F.lit(0).alias("_side"), value.alias("_value"))
    both = sides.unionByName(others.filter(" AND ".join(f"{n} IS NOT NULL" for n in [*names, "_at"])), allowMissingColumns=True)
    cut = ranged(both, "_at", rows)
    here = W.partitionBy(*names, "_range").orderBy("_at", "_side", "_value").rowsBetween(W.unboundedPreceding, 0)
    told = F.last(F.when(F.col("_side") == 0, F.struct("_value")), ignorenulls=True)
    within = cut.withColumn("_found", told.over(here))
    latest = F.max(F.when(F.col("_side") == 0, F.struct("_at", "_value")))
    before = W.partitionBy(*names).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    carried = cut.groupBy(*names, "_range").agg(latest.alias("_last")).withColumn("_before", F.last("_last", ignorenulls=True).over(before))
    known = carried.filter("_before IS NOT NULL").select(*names, "_range", F.struct("_before._value").alias("_before"))
    # Both sides are dealt out by keys and range, as the window's rows are already.
    joined = within.join(known, [*names, "_range"], "left").filter("_side = 1")
    found = F.when(F.col("_at").isNotNull(), F.coalesce("_found", "_before"))
    out = joined.select("_left", found.alias("_found"))
    return out.select("_left.*", *[F.col(f"_found._value.{c}").alias(c) for c in columns])


def running_totals(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], range_: str = "_range") -> DataFrame:
    """``df`` with running sums of its rows in the order of ``order`` within ``keys``, each row's own included.

    ``range_`` names a column that never falls along that order, as ``ranged`` makes it. Equal rows in ``order`` go in any order.
    """
    part = W.partitionBy(*keys, range_)
    here = part.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    named = df.withColumns({f"_own_{n}": c for n, c in sums.items()})
    within = named.withColumns({n: F.sum(f"_own_{n}").over(here) for n in sums})
    totals = named.groupBy(*keys, range_).agg(*[F.sum(f"_own_{n}").alias(f"_own_{n}") for n in sums])
    before = W.partitionBy(*keys).orderBy(range_).rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(*keys, range_, *[F.sum(f"_own_{n}").over(before).alias(f"_before_{n}") for n in sums])
    # Null keys meet, too.
    named_keys = [(k, f"_carried{i}") for i, k in enumerate([*keys, range_])]
    carried = carried.withColumnsRenamed(dict(named_keys))
    meet = functools.reduce(lambda a, b: a & b, [within[k].eqNullSafe(carried[c]) for k, c in named_keys])
    joined = within.join(carried, meet, "left").drop(*[c for _, c in named_keys])
    added = joined.withColumns({n: F.coalesce(n, F.lit(0)) + F.coalesce(f"_before_{n}", F.lit(0)) for n in sums})
    return added.drop(*[f"_own_{n}" for n in sums], *[f"_before_{n}" for n in sums])


def status_as_of(transitions: DataFrame, asked: DataFrame, job: str = "job_id", at: str = "at") -> DataFrame:
    """``asked`` (job, time) with the job's ``status`` and ``progress_percent`` then; null before its first transition."""
    return asof_join(asked, transitions, [job], at, at, {"status": "status", "progress_percent": "progress_percent"})


def durations(transitions: DataFrame, job: str = "job_id", at: str = "at", rows: int = ROWS) -> DataFrame:
    """``transitions`` with ``seconds``: how long the status lasted until the job's next transition; null for its last one.

    The next one is found as the last before, along time that runs backwards, so that a job with all transitions splits, too.
    """
    turned = transitions.withColumn("_back", -micros(transitions, at))
    later = turned.select(F.col(job), (F.col("_back") + 1).alias("_after"), F.col("_back").alias("_next"))
    found = asof_join(turned, later, [job], "_back", "_after", {"_next": "_next"}, rows)
    return found.withColumn("seconds", (F.col("_back") - F.col("_next")) / 1e6).drop("_back", "_next")

