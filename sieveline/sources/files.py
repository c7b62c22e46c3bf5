"""Readers and writers of record files: JSON lines, JSON documents, CSV, text and YAML-like tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILE, BAD = "_file", "_bad_line"
_OWN: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for files that one run makes: in the folder named by spark.checkpoint.dir, which all machines share;
    a temporary one, removed at the end of the process, only where it is unset and all is on one machine. What is in a
    shared folder may be deleted once the run's results are written."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="sieveline-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        root = f"file://{_OWN[0]}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to a new scratch folder and read again: later passes read it instead of making it again, and a lost
    executor costs no lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def column(df: DataFrame, name: str = "instruction") -> DataFrame:
    """One column only; the scan reads no other."""
    return df.select(name)


def read_strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines where a bad line is an error when it is read. Blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_tolerant(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_checked(spark: SparkSession, path: str, schema: T.StructType, validator: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, bad): bad holds file, line number (from 1, blank lines counted) and text of lines that aren't JSON of the
    schema. Lines of a split are numbered by their ids there, after the counts of the file's splits before it; only
    counts of splits are joined."""
    m = F.col("_metadata")
    lines = spark.read.text(path).select("value", m["file_path"].alias(FILE), m["file_block_start"].alias("_block"), F.monotonically_increasing_id().alias("_id"))
    full = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    parsed = lines.where(F.trim("value") != "").withColumn("_row", F.from_json("value", full, {"columnNameOfCorruptRecord": BAD, "mode": "PERMISSIVE"}))
    rows = parsed.where(F.col(f"_row.{BAD}").isNull()).select("_row.*").drop(BAD)
    blocks = lines.groupBy(FILE, "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(FILE).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    bad = parsed.where(F.col(f"_row.{BAD}").isNotNull()).join(blocks, [FILE, "_block"])
    bad = bad.select(F.col(FILE).alias("file"), (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line"), F.col("value").alias("text"))
    return (validator(rows) if validator else rows), bad


def read_shards(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "shard_*.jsonl") -> DataFrame:
    """All shard files, with their path as order and shard key."""
    rows = spark.read.schema(schema).json(f"{folder}/{pattern}")
    return rows.withColumn(FILE, F.col("_metadata.file_path"))


def write_shards(df: DataFrame, key: str, folder: str) -> None:
    """JSON lines in one folder for each value of key (shard=value; null and empty have one too), in one pass; key stays
    a column."""
    df.withColumn("shard", F.col(key)).write.mode("overwrite").partitionBy("shard").json(folder)


def shard_of(file: Column) -> Column:
    """The value of key that write_shards gave a file its folder for."""
    value = F.url_decode(F.regexp_extract(F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B"))), r"/shard=([^/]*)/", 1))
    return F.nullif(value, F.lit("__HIVE_DEFAULT_PARTITION__"))


def files(spark: SparkSession, pattern: str) -> list[tuple[str, int]]:
    """(path, modification time) of files that match, from the file system's listing."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted((f.getPath().toString(), f.getModificationTime()) for f in (found or []))


def exists(spark: SparkSession, path: str) -> bool:
    return bool(files(spark, path))


def latest_by_name(spark: SparkSession, pattern: str) -> str | None:
    return max((p for p, _ in files(spark, pattern)), default=None)


def latest_by_time(spark: SparkSession, pattern: str) -> str | None:
    return max(((t, p) for p, t in files(spark, pattern)), default=(0, None))[1]


def require_shards(spark: SparkSession, folder: str, names: Sequence[str]) -> None:
    """All or nothing: raises with the names of missing shards."""
    there = {p.rsplit("/", 1)[-1] for p, _ in files(spark, f"{folder}/*")}
    lacking = [n for n in names if n not in there]
    if lacking:
        raise FileNotFoundError(f"{folder}: missing {', '.join(lacking)}")


def present_shards(spark: SparkSession, folder: str, names: Sequence[str]) -> tuple[list[str], list[str]]:
    """(there, missing)."""
    there = {p.rsplit("/", 1)[-1] for p, _ in files(spark, f"{folder}/*")}
    return [n for n in names if n in there], [n for n in names if n not in there]


def load_or_create(spark: SparkSession, path: str, schema: T.StructType, create: Callable[[], DataFrame], size: int, order: str, train: DataFrame | None = None, key: str = "instruction") -> DataFrame:
    """The first size rows of a stored table, which is made first if it isn't there. With train, a stored table must
    share no normalised key with it: raises ValueError if it does."""
    if not exists(spark, path):
        write_jsonl(create(), path)
    stored = spark.read.schema(schema).json(path)
    if train is not None:
        from ..operators.leakage import check_no_overlap

        check_no_overlap(stored, train, key)
    return stored.orderBy(order).limit(size)


def merge_slices(spark: SparkSession, folder: str, names: Sequence[str], schema: T.StructType, target: str, expected: int | None = None) -> tuple[bool, list[str]]:
    """(done, warnings): rows of all slices in one table. Nothing is written if a slice is missing; another number of
    rows than expected is a warning."""
    _, lacking = present_shards(spark, folder, names)
    if lacking:
        return False, [f"missing {n}" for n in lacking]
    write_jsonl(spark.read.schema(schema).option("mode", "FAILFAST").json([f"{folder}/{n}" for n in names]), target)
    n = spark.read.text(target).count()
    return True, [] if expected in (None, n) else [f"{n} rows instead of {expected}"]


def missing_files(spark: SparkSession, folder: str, required: Sequence[str] = ("adapter_config.json", "adapter_model.safetensors")) -> list[str]:
    """Which of the files that a checkpoint needs a folder lacks; all of them if it isn't there."""
    return present_shards(spark, folder, required)[1]


def require_files(spark: SparkSession, folder: str, required: Sequence[str] = ("adapter_config.json", "adapter_model.safetensors")) -> None:
    lacking = missing_files(spark, folder, required)
    if lacking:
        raise FileNotFoundError(f"{folder}: missing {', '.join(lacking)}")


def distinct_instructions(df: DataFrame, column: str = "instruction") -> DataFrame:
    from ..functions.text import norm_key

    return df.select(norm_key(F.col(column)).alias("key")).distinct()


# Principles where no configuration is stored.
DEFAULT_PRINCIPLES = (
    ("follow_instruction", "Follow the instruction exactly as given", None),
    ("be_accurate", "Provide accurate and factual information", None),
    ("be_complete", "Fully address what was requested", None),
    ("be_concise", "Be concise and avoid unnecessary elaboration", None),
)


def yaml_entries(text: str, name: str) -> list[dict[str, str]]:
    """The list of flat mappings under a top-level key of a YAML document; values are strings, with or without quotes."""
    entries: list[dict[str, str]] = []
    inside = False
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if not line[0].isspace() and not line.startswith("-"):
            inside = line.split(":", 1)[0].strip() == name
            continue
        m = re.match(r"\s*(- +)?([\w-]+):\s*(.*?)\s*$", line)
        if inside and m:
            if m[1]:
                entries.append({})
            value = m[3]
            if value[:1] in ("'", '"'):
                mark = value[0]
                value = value[1 : value.rindex(mark)]
                value = value.replace("''", "'") if mark == "'" else value.replace('\\"', '"').replace("\\\\", "\\")
            else:
                value = re.sub(r"\s+#.*$", "", value)
            if entries:
                entries[-1][m[2]] = value
    return entries


def read_principles(spark: SparkSession, path: str, name: str = "principles") -> list[tuple[str, str, str | None]]:
    """(id, text, category) of a YAML configuration, in its order; the default ones where there is none. Configurations
    are small: they are read on the driver."""
    if not exists(spark, path):
        return list(DEFAULT_PRINCIPLES)
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    return [(e["id"], e["text"], e.get("category")) for e in yaml_entries(text, name)]


def principles(spark: SparkSession, rows: Sequence[tuple[str, str, str | None]], first: int = 4) -> DataFrame:
    """(ord, id, text, category): the first principles of a configuration, in its order."""
    data = [(i, *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "ord int, id string, text string, category string").orderBy("ord").limit(first)


def write_jsonl(df: DataFrame, path: str, files: int | None = None, ascii_only: bool = False) -> None:
    """JSON lines; files: how many, for small artifacts. ascii_only: other characters as \\u escapes."""
    out = df if files is None else df.coalesce(files)
    if ascii_only:
        line = F.to_json(F.struct("*"))
        chars = F.transform(F.split(line, ""), lambda c: F.when(F.ascii(c) < 128, c).when(F.ascii(c) < 65536, F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(F.ascii(c).cast("long")), 4, "0")))).otherwise(_surrogates(c)))
        out.select(F.array_join(chars, "").alias("value")).write.mode("overwrite").text(path)
    else:
        out.write.mode("overwrite").json(path)


def _surrogates(c):
    point = F.ascii(c).cast("long") - 65536
    unit = lambda x: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(x), 4, "0")))
    return F.concat(unit(F.lit(0xD800) + F.shiftright(point, 10)), unit(F.lit(0xDC00) + point % 1024))


def lines_in_order(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """(value, file, block, line) of files, and the columns that order them: by the file's name, the split within it and
    the line within that. Lines end at line feeds alone; a carriage return stays."""
    m = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(list(paths))
    return lines.select("value", m["file_path"].alias(FILE), m["file_block_start"].alias("_block"), F.monotonically_increasing_id().alias("_line")), [FILE, "_block", "_line"]


def concat_lines(spark: SparkSession, paths: Sequence[str], target: str) -> None:
    """Lines of files as they are, not parsed, in the order of the files' names: the parts of target, by name, hold them
    in that order. Ranges of the order are written side by side."""
    lines, order = lines_in_order(spark, paths)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = lines.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows.select("value").write.mode("overwrite").option("lineSep", "\n").text(target)


def concat_present(spark: SparkSession, paths: Sequence[str], target: str) -> list[str]:
    """concat_lines of the paths that are there; returns those that aren't."""
    there = [p for p in paths if exists(spark, p)]
    concat_lines(spark, there, target)
    return [p for p in paths if p not in there]


def write_csv(df: DataFrame, path: str, decimals: int = 3) -> None:
    """CSV with a header; doubles with fixed decimals."""
    cols = [F.format_string(f"%.{decimals}f", f.name).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields]
    df.select(*cols).write.mode("overwrite").option("header", "true").csv(path)


def write_document(df: DataFrame, path: str) -> None:
    """A one-row summary as one JSON document."""
    df.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A report as a text file."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def rewrite_with_backup(spark: SparkSession, path: str, backup: str, schema: T.StructType, change: Callable[[DataFrame], DataFrame], target: str) -> DataFrame:
    """Copy the lines of path to backup as they are, then write the changed rows to target (never over the input)."""
    if target in (path, backup):
        raise ValueError("the target must be another path than the input and the backup")
    concat_lines(spark, [path], backup)
    write_jsonl(change(spark.read.schema(schema).json(path)), target)
    return spark.read.schema(schema).json(target)
