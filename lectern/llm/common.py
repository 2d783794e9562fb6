"""Helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space that separates words: the space and the controls from tab to carriage return.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(modulus: int, key: str = "doc_id") -> Column:
    """crc32 of the key's decimal text, modulo ``modulus``; -1 for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus, F.lit(-1))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def trimmed(text: Column) -> Column:
    """Text without white space at its ends; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")


def words_of(text: Column) -> Column:
    """Array of the words of a text, empty for null, empty or blank texts."""
    clean = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, f"{SPACE_CLASS}+"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one in ``spark.checkpoint.dir``. Only a local session may go without it and gets a temporary one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        found = _local_folder()
    return found.rstrip("/")


@functools.cache
def _local_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="lectern-")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from Parquet in the shared folder: later plans start there, and so do retries."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lectern-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(written: DataFrame) -> None:
    """Deletes a table that ``materialise`` wrote and that nothing reads any more."""
    spark = written.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in written.inputFiles()}:
        if "/lectern-" in path:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that have ended, which it does once the driver has collected their plans.

    A driver with much memory and little to do collects seldom, and the files of all steps would lie on the disks until the end.
    """
    gc.collect()
    spark._jvm.System.gc()


def input_bytes(df: DataFrame) -> int:
    """Spark's own estimate of the size of ``df``, by which numbers of buckets grow."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def least_hashed(rows: DataFrame, group: str, bound: int, key: str = "doc_id") -> DataFrame:
    """Of each group the ``bound`` rows with the smallest hashes of their key, ties by the key, and all of a smaller group.

    ``rows`` has no null group, and each key once in a group. Counts of the groups give a threshold that leaves little
    more than the bound, so that no window sees a whole group; the groups' counts come to the driver. In one case of
    billions the threshold leaves a few rows less.
    """
    # An odd hash, so that the rows aren't those that another hash of the key picks.
    value = F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(7)), 1)
    share = lambda n: min(1.0, (bound + 8 * bound**0.5 + 32) / n)
    limits = [(r[0], min(2**63 - 1, int(share(r[1]) * 2**63))) for r in rows.groupBy(group).count().collect()]
    few = rows.sparkSession.createDataFrame(limits, rows.select(group).schema.add("_most", "long"))
    order = Window.partitionBy(group).orderBy("_hash", key)
    left = rows.join(F.broadcast(few), group).withColumn("_hash", value).filter(F.col("_hash") <= F.col("_most"))
    return left.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= bound).select(*rows.columns)


def packed(rows: np.ndarray) -> pa.Array:
    """Rows of numbers as binary values, which pass between Spark and Python, and into files, at the cost of their bytes."""
    n, width = rows.shape
    data = np.ascontiguousarray(rows)
    offsets = np.arange(n + 1, dtype=np.int32) * (width * data.itemsize)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def unpacked(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """The rows of numbers that ``packed`` made; none of them null."""
    if not len(column):
        return np.zeros((0, width), kind)
    _, offsets, data = column.cast(pa.binary()).buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind).reshape(len(column), width)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what a Python worker makes of one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def give_back() -> None:
    """Memory that is free in this process goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidied(rows):
    """The same function of batches, which gives memory back to the system once a partition is done.

    Python workers live on for later tasks; what their allocators keep would count against the executor's memory.
    """
    @functools.wraps(rows)
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows(batches)
        give_back()

    return out


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
