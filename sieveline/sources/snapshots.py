"""Tables of published snapshots: a writer fills a new folder and publishes it as the next version, or nothing.

A version is one small pointer file, table/versions/0000000001, which names the folder and states its rows and a digest of
them. It is created only if it isn't there (compare and set): of two writers that start from one version, one publishes
and the other is refused. Readers take the folder of a version once, so they keep their snapshot while others publish.
The file system must create a file only once; HDFS and local ones do, an object store needs conditional writes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import files, present_shards


class Conflict(RuntimeError):
    """Another writer has published since."""


def _pointer(table: str, version: int) -> str:
    return f"{table}/versions/{version:010d}"


def latest(spark: SparkSession, table: str) -> int:
    """The number of the last version, 0 where nothing is published."""
    return max((int(p.rsplit("/", 1)[-1]) for p, _ in files(spark, f"{table}/versions/[0-9]*")), default=0)


def entry(spark: SparkSession, table: str, version: int) -> dict:
    """What a version states: folder, rows, digest."""
    return json.loads(spark.read.text(_pointer(table, version), wholetext=True).first().value)


def _create_once(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        out = system.create(where, False)
    except Exception as e:
        if "FileAlreadyExists" in str(e) or "already exists" in str(e):
            raise Conflict(path) from None
        raise
    out.write(bytearray(text.encode()))
    out.close()


def contents(df: DataFrame) -> tuple[int, int]:
    """(rows, digest): a sum over hashes of rows, the same in any order."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(20,0)")
    r = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(h), F.lit(0)).cast("decimal(38,0)").alias("d")).first()
    return r.n, int(r.d)


def publish(df: DataFrame, table: str, expected: int, rows: int | None = None) -> int:
    """Write df as version expected + 1 and return that number. Raises Conflict where another version is the last one,
    before or after writing, and ValueError where the folder, read again, doesn't hold so many rows; nothing is published
    then."""
    spark = df.sparkSession
    if latest(spark, table) != expected:
        raise Conflict(f"{table}: version {expected} isn't the last one")
    folder = f"{table}/data-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    n, digest = contents(spark.read.schema(df.schema).parquet(folder))
    if rows is not None and n != rows:
        raise ValueError(f"{table}: {n} rows instead of {rows}")
    text = json.dumps({"folder": folder, "rows": n, "digest": str(digest), "schema": df.schema.json()})
    _create_once(spark, _pointer(table, expected + 1), text)
    return expected + 1


def read(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """A version of the table, the last one unless another is named: versions that follow don't change what it reads."""
    version = latest(spark, table) if version is None else version
    if not version:
        raise FileNotFoundError(f"{table}: nothing is published")
    said = entry(spark, table, version)
    return spark.read.schema(T.StructType.fromJson(json.loads(said["schema"]))).parquet(said["folder"])


def publish_slices(spark: SparkSession, folder: str, names: Sequence[str], schema: T.StructType, table: str, expected: int, rows: int | None = None) -> tuple[int | None, list[str]]:
    """(version, warnings): rows of all slices (JSON lines) as the next version. A missing slice, or another number of
    rows than stated, publishes nothing: version is None, and the version before stays in force."""
    _, lacking = present_shards(spark, folder, names)
    if lacking:
        return None, [f"missing {n}" for n in lacking]
    df = spark.read.schema(schema).option("mode", "FAILFAST").json([f"{folder}/{n}" for n in names])
    try:
        return publish(df, table, expected, rows), []
    except ValueError as e:
        return None, [str(e).split(": ", 1)[1]]
