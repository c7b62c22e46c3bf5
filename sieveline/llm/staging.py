"""Shared-folder tables, session settings and shipping of worker code."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import sys
import tempfile
import types
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules["sieveline.llm"])

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of an Arrow batch in staged steps: batches of long texts must fit beside a worker's arrays.
ARROW_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where it is unset (tests on one machine)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="sieveline-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/sieveline-{uuid.uuid4().hex}/{label}"


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """Set a session setting for the block only; settings that this Spark lacks are skipped."""
    try:
        before = spark.conf.get(key, None)
        spark.conf.set(key, value)
    except Exception:  # noqa: BLE001  an unknown or static setting changes nothing
        yield
        return
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage in a way that survives lost executors.

    The shuffle files of the write go as soon as it ends, so that steps in sequence don't add up on disk.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    with setting(spark, CLEANUP, "true"), setting(spark, *ARROW_ROWS):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more: what was made of it is written."""
    jvm, jsc = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc
    path = jvm.org.apache.hadoop.fs.Path(df._staged_path.rsplit("/", 1)[0])
    path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def process_cache() -> dict:
    """One dictionary for each Python process, whichever way this code was shipped to it."""
    return sys.modules.setdefault("_sieveline_process_cache", types.ModuleType("_sieveline_process_cache")).__dict__


def packed(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, and all columns as one struct _row: other names can't clash with those an operator adds."""
    return df.select(*names, F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("_row.*")
