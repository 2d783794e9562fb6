"""Tables that change together: new versions are written beside the old ones and published by one rename.

A manifest names the folder of every bucket of every table. A writer writes the buckets it changes to new folders, then a
manifest under the next number; until then, and for good if it stops before, readers see the version before. Rename has to be atomic and to
refuse names that are there, as in HDFS; two writers that begin at one version can't both publish the next.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .tables import deleted, exists

#: Buckets of the keys of a new table: a manifest has so many folders for it at most, and a replaced key writes its bucket again.
BUCKETS = 256


class Conflict(RuntimeError):
    """Another writer published the version that this one was about to."""


@dataclass(frozen=True)
class Version:
    """A number and, for each table, its schema as JSON, its number of buckets and the folder of each."""

    number: int
    tables: dict[str, dict]


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm.org.apache.hadoop.fs
    where = jvm.Path(path)
    return jvm, where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, root: str) -> list[int]:
    if not exists(spark, f"{root}/_versions"):
        return []
    _, where, files = _files(spark, f"{root}/_versions")
    names = [s.getPath().getName() for s in files.listStatus(where)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))


def _stored(spark: SparkSession, root: str, number: int) -> Version:
    # One line of text, read by the store's own reader.
    text = spark.read.option("wholetext", "true").text(f"{root}/_versions/{number:012d}.json").first()[0]
    return Version(number, json.loads(text))


def current(spark: SparkSession, root: str) -> Version:
    """The last version that was published; version 0 has no tables."""
    numbers = _numbers(spark, root)
    return _stored(spark, root, numbers[-1]) if numbers else Version(0, {})


def _publish(spark: SparkSession, root: str, version: Version) -> None:
    jvm, target, files = _files(spark, f"{root}/_versions/{version.number:012d}.json")
    draft = jvm.Path(f"{root}/_versions/.{uuid.uuid4().hex}")
    out = files.create(draft)
    out.write(json.dumps(version.tables).encode())
    out.close()
    try:
        jvm.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, target, spark._jvm.java.lang.reflect.Array.newInstance(jvm.Options.Rename._java_lang_class, 0))
    except Exception as e:
        files.delete(draft, False)
        if files.exists(target):
            raise Conflict(f"version {version.number} is there") from e
        raise


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def replace(spark: SparkSession, root: str, tables: dict[str, DataFrame], keys: DataFrame, key: str = "job_id", buckets: int = BUCKETS, stop_before_publishing: bool = False) -> Version:
    """Publishes a version in which all rows of ``keys`` are those of ``tables``, in every one of these tables; rows of other keys stay, and so do other tables.

    A key without rows in a table has none there afterwards. Rows whose key isn't among the keys, or is null, are an error. Only buckets
    of these keys are read and written again. Schemas of a table must stay the same.
    """
    before = current(spark, root)
    wanted = keys.select(F.col(key).alias("_key")).filter("_key IS NOT NULL").distinct()
    after = {name: dict(told) for name, told in before.tables.items()}
    for name, rows in tables.items():
        old = before.tables.get(name, {"schema": rows.schema.json(), "count": buckets, "buckets": {}})
        if StructType.fromJson(json.loads(old["schema"])).simpleString() != rows.schema.simpleString():
            raise ValueError(f"{name} has another schema")
        strange = rows.join(wanted, F.col(key) == F.col("_key"), "left_anti")
        if not strange.isEmpty():
            raise ValueError(f"{name} has rows of other keys")
        # As many numbers as there are buckets at most.
        touched = sorted(r[0] for r in wanted.select(_bucket("_key", old["count"])).distinct().collect())
        paths = [old["buckets"][str(b)] for b in touched if str(b) in old["buckets"]]
        kept = spark.read.schema(rows.schema).parquet(*paths).join(wanted, F.col(key) == F.col("_key"), "left_anti") if paths else None
        new = rows if kept is None else kept.unionByName(rows)
        folder = f"{root}/{name}/{uuid.uuid4().hex}"
        # Few files for each bucket, but more for a large one: Spark splits what a key has too much of.
        new.withColumn("_bucket", _bucket(key, old["count"])).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(folder)
        present = {r[0] for r in spark.read.schema("_bucket int").parquet(folder).select("_bucket").distinct().collect()} if exists(spark, f"{folder}/_SUCCESS") and touched else set()
        kept_buckets = {b: p for b, p in old["buckets"].items() if int(b) not in touched} | {str(b): f"{folder}/_bucket={b}" for b in sorted(present)}
        after[name] = {"schema": rows.schema.json(), "count": old["count"], "buckets": kept_buckets}
    version = Version(before.number + 1, after)
    if not stop_before_publishing:
        _publish(spark, root, version)
    return version


def read(spark: SparkSession, root: str, name: str, version: Version | None = None) -> DataFrame:
    """A table as of a version, the current one if none is told. All tables that are read by one version belong together."""
    told = (version or current(spark, root)).tables[name]
    schema = StructType.fromJson(json.loads(told["schema"]))
    paths = list(told["buckets"].values())
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Deletes what only versions before the last ``keep`` name, and those; and folders that no version names, which may be of a writer
    at work: none must be. How many folders went."""
    numbers = _numbers(spark, root)
    versions = [_stored(spark, root, n) for n in numbers[-keep:]]
    used = {p.rsplit("/", 1)[0] for v in versions for t in v.tables.values() for p in t["buckets"].values()}
    gone = 0
    for name in {n for v in versions for n in v.tables}:
        _, where, files = _files(spark, f"{root}/{name}")
        for status in files.listStatus(where) if files.exists(where) else []:
            path = status.getPath()
            if not any(u.endswith(f"/{name}/{path.getName()}") for u in used):
                files.delete(path, True)
                gone += 1
    for number in numbers[:-keep]:
        deleted(spark, f"{root}/_versions/{number:012d}.json")
    return gone
