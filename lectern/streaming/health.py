"""The health of an index kept up to date by increments, each of which costs what it changes and a look at what was there.

A batch adds up its changes by key, finds what those keys had before in the narrow log of earlier batches, and appends by how much every
count changed. Counts of all batches add up to those of the whole, in whatever order changes come.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.text import uuid5_url
from ..sources.tables import exists

#: Changes as they come: chunks (with their normalised text) and points, added (1) or taken away (-1).
CHANGES = "kind string, id string, text string, n long"
LOG = "space string, key string, chunks long, points long, label string"
KINDS = ("chunk", "point", "orphan", "unindexed", "duplicate")


def keyed(changes: DataFrame) -> DataFrame:
    """(space, key, chunks, points, label): a chunk counts for its point's id and, if it has one, for the digest of its text."""
    n = F.col("n")
    of_id = F.struct(F.lit("id").alias("space"), uuid5_url(F.col("id")).alias("key"), n.alias("chunks"), F.lit(0).cast("long").alias("points"), F.col("id").alias("label"))
    of_text = F.struct(F.lit("text").alias("space"), F.sha2(F.col("text"), 256).alias("key"), n.alias("chunks"), F.lit(0).cast("long").alias("points"), F.col("text").alias("label"))
    of_point = F.struct(F.lit("id").alias("space"), F.col("id").alias("key"), F.lit(0).cast("long").alias("chunks"), n.alias("points"), F.lit(None).cast("string").alias("label"))
    parts = F.when(F.col("kind") == "point", F.array(of_point)).when(F.col("text").isNull(), F.array(of_id)).otherwise(F.array(of_id, of_text))
    return changes.filter("id IS NOT NULL AND kind IN ('chunk', 'point')").select(F.explode(parts).alias("c")).select("c.*")


def counted(chunks: Column, points: Column) -> dict[str, Column]:
    """What a key counts for each of ``KINDS``; texts are repeated as often as they are there."""
    is_id = F.col("space") == "id"
    one = lambda c: F.when(c, 1).otherwise(0).cast("long")
    return {
        "chunk": one(is_id & (chunks > 0)), "point": one(is_id & (points > 0)), "orphan": one(is_id & (points > 0) & (chunks <= 0)),
        "unindexed": one(is_id & (chunks > 0) & (points <= 0)), "duplicate": F.when(~is_id & (chunks > 1), chunks).otherwise(0).cast("long"),
    }


def merge(spark: SparkSession, changes: DataFrame, out: str, part: str) -> None:
    """Adds changes to the log of ``out`` and appends what they change as ``part``; doing it again under the same name changes nothing."""
    delta = keyed(changes).groupBy("space", "key").agg(F.sum("chunks").alias("chunks"), F.sum("points").alias("points"), F.max("label").alias("label"))
    delta.write.mode("overwrite").parquet(f"{out}/staged/{part}")
    delta = spark.read.parquet(f"{out}/staged/{part}")
    told = delta.select("space", "key", F.col("chunks").alias("d_chunks"), F.col("points").alias("d_points"), "label")
    if exists(spark, f"{out}/log"):
        # Keys of the batch meet the log; Spark broadcasts them where they are few.
        earlier = spark.read.schema(LOG + ", batch string").parquet(f"{out}/log").filter(F.col("batch") != part)
        before = earlier.join(told.select("space", "key"), ["space", "key"], "left_semi").groupBy("space", "key").agg(F.sum("chunks").alias("chunks"), F.sum("points").alias("points"), F.max("label").alias("known"))
        told = told.join(before, ["space", "key"], "left")
    else:
        told = told.withColumns({"chunks": F.lit(None).cast("long"), "points": F.lit(None).cast("long"), "known": F.lit(None).cast("string")})
    old = {c: F.coalesce(c, F.lit(0)) for c in ("chunks", "points")}
    was, now = counted(old["chunks"], old["points"]), counted(old["chunks"] + F.col("d_chunks"), old["points"] + F.col("d_points"))
    changed = F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), (now[k] - was[k]).alias("n")) for k in KINDS]), lambda c: c["n"] != 0)
    each = told.select("key", "label", "known", F.explode(changed).alias("c")).select(F.col("c.kind").alias("kind"), F.when(F.col("c.kind") == "orphan", F.col("key")).otherwise(F.coalesce("label", "known")).alias("label"), "key", F.col("c.n").alias("n"))
    # Single faults are kept with their names, what is sound only as counts.
    sums = each.groupBy("kind").agg(F.sum("n").alias("n"))
    each.filter("kind IN ('orphan', 'unindexed', 'duplicate')").write.mode("overwrite").parquet(f"{out}/faults/batch={part}")
    sums.write.mode("overwrite").parquet(f"{out}/totals/batch={part}")
    # Chunks go by their names in the log, texts only by their digests.
    delta.withColumn("label", F.when(F.col("space") == "id", F.col("label"))).select("space", "key", "chunks", "points", "label").write.mode("overwrite").parquet(f"{out}/log/batch={part}")


def health_stream(spark: SparkSession, changes: str, out: str, checkpoint: str, run: str = "run", files_a_batch: int = 1) -> StreamingQuery:
    """Starts an increment: all files of changes that are new since the last one, some at a time."""
    source = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files_a_batch).parquet(changes)
    return source.writeStream.foreachBatch(lambda batch, n: merge(batch.sparkSession, batch, out, f"{run}-{n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def faults(spark: SparkSession, out: str) -> DataFrame:
    """(kind, id, n) of all orphans, chunks without a point and repeated texts."""
    rows = spark.read.parquet(f"{out}/faults").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.max("label").alias("id"))
    return rows.filter("n > 0").select("kind", "id", "n")


def report(spark: SparkSession, out: str, most: int = 100) -> DataFrame:
    """One row as ``indexing.health_report`` has it, from the counts and single faults that increments left."""
    totals = spark.read.parquet(f"{out}/totals").groupBy().pivot("kind", ["chunk", "point"]).sum("n")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    found = totals.select(zero("point").alias("point_count"), zero("chunk").alias("chunk_count"))
    rows = faults(spark, out)
    for kind, name in (("orphan", "orphan_points"), ("unindexed", "never_indexed"), ("duplicate", "duplicates")):
        of_kind = rows.filter(F.col("kind") == kind)
        value = F.struct(F.col("id").alias("text"), "n") if kind == "duplicate" else F.col("id")
        few = of_kind.orderBy("id").limit(most).agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("k"), value.alias("v")))).alias("s"))
        # Each side is one row.
        found = found.crossJoin(of_kind.agg(F.count("*").alias(f"{name}_count"))).crossJoin(few.select(F.transform("s", lambda x: x["v"]).alias(name)))
    return found
