"""Provenance: git and environment facts, run manifests, and stamps on records."""

from __future__ import annotations

import platform
import subprocess
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MANIFEST_ENTRY


def git_info(folder: str = ".") -> dict[str, str | bool]:
    """Commit, branch and whether there are changes; unknown where git can't tell."""

    def ask(*args: str) -> str | None:
        try:
            done = subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, timeout=10)
        except (OSError, subprocess.TimeoutExpired):
            return None
        return done.stdout.strip() if done.returncode == 0 else None

    status = ask("status", "--porcelain")
    return {"commit": ask("rev-parse", "HEAD") or "unknown", "branch": ask("rev-parse", "--abbrev-ref", "HEAD") or "unknown", "dirty": bool(status)}


def environment_info(spark: SparkSession) -> dict[str, str]:
    return {"python": platform.python_version(), "platform": platform.platform(), "spark": spark.version, "master": spark.sparkContext.master, "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions")}


def merged(*maps: Column) -> Column:
    """Maps in one; later keys win."""
    keys = F.array_distinct(F.flatten(F.array(*[F.map_keys(m) for m in maps])))

    def last(k: Column) -> Column:
        return F.coalesce(*[F.try_element_at(m, k) for m in reversed(maps)])

    return F.map_from_arrays(keys, F.transform(keys, last))


def stamped(df: DataFrame, operations: Sequence[str], timestamp: str) -> DataFrame:
    """df with repaired, repair_timestamp and repair_operations set in its metadata struct."""
    m = F.coalesce(F.col("metadata"), F.from_json(F.lit("{}"), df.schema["metadata"].dataType))
    for name, value in (("repaired", F.lit(True)), ("repair_timestamp", F.lit(timestamp)), ("repair_operations", F.array(*[F.lit(o) for o in operations]))):
        m = m.withField(name, value)
    return df.withColumn("metadata", m)


def record(spark: SparkSession, manifest: str, session: str, path: str, kind: str, timestamp: str, success: bool = True, error: str | None = None, parameters: dict[str, str] | None = None) -> None:
    """Append an artifact to a manifest table."""
    git = git_info()
    row = (session, path, kind, timestamp, success, error, str(git["commit"]), str(git["branch"]), bool(git["dirty"]), parameters or {})
    spark.createDataFrame([row], MANIFEST_ENTRY).write.mode("append").parquet(manifest)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST_ENTRY).parquet(path)


def session_summary(entries: DataFrame) -> DataFrame:
    """(session, n, n_failed, last) of a manifest table."""
    return entries.groupBy("session").agg(F.count("*").alias("n"), F.count_if(~F.col("success")).alias("n_failed"), F.max("timestamp").alias("last"))


def passed_gate(entries: DataFrame, kind: str = "qc_summary") -> DataFrame:
    """Entries that let later stages run; raises if there are none."""
    good = entries.where((F.col("type") == kind) & F.col("success") & (F.try_element_at("parameters", F.lit("thresholds_passed")) == "true"))
    if good.isEmpty():
        raise ValueError(f"no {kind} passed its thresholds")
    return good


# What a loader must have recorded of itself.
LOADER_FIELDS = ("loader_version", "quantization", "template_disabled", "sentinel_tests_passed", "add_special_tokens")


def missing(info: dict, keys: Sequence[str] = LOADER_FIELDS) -> list[str]:
    """Which of the fields a record lacks."""
    return [k for k in keys if info.get(k) is None]


def loader_record(model: str, sentinels: Sequence[dict], load_in_4bit: bool = False, load_in_8bit: bool = False, dtype: str = "bfloat16", device_map: str = "auto") -> dict:
    """What a model loader records of itself: version, quantisation, and how its probes came out."""
    return {
        "loader_version": git_info()["commit"],
        "model_name": model,
        "quantization": "4bit-nf4" if load_in_4bit else "8bit" if load_in_8bit else "none",
        "torch_dtype": dtype,
        "template_disabled": True,
        "add_special_tokens": False,
        "sentinel_tests_passed": all(s["passed"] for s in sentinels),
        "sentinel_results": list(sentinels),
        "device_map": device_map,
    }


def artifact_record(kind: str, script: str, model: str, loader: dict, timestamp: str, parameters: dict | None = None, more: dict | None = None) -> dict:
    """What is recorded of an artifact: git facts, then those of the loader, then parameters and more; later keys win."""
    out = {"artifact_type": kind, "script_name": script, "timestamp": timestamp, "model_name": model, **git_info(), **loader}
    return out | ({"generation_params": parameters} if parameters else {}) | (more or {})


def required(info: dict, *keys: str) -> dict:
    lacking = missing(info, keys)
    if lacking:
        raise ValueError(f"provenance lacks {', '.join(lacking)}")
    return info


def qc_record(summary: DataFrame, timestamp: str) -> DataFrame:
    """A summary (one row) as a JSON document with time and commit."""
    git = git_info()
    return summary.select(F.to_json(F.struct(F.lit(timestamp).alias("timestamp"), F.struct(*[F.lit(v).alias(k) for k, v in git.items()]).alias("git"), F.struct("*").alias("qc"))).alias("document"))


def qc_document(gated: DataFrame, thresholds: dict, timestamp: str, margins: Column | None = None) -> DataFrame:
    """A gated summary (of qc.gate) as JSON documents in sections: counts, acceptance, token statistics, margins,
    thresholds, verdict and reasons, with time and commit."""
    git = F.struct(*[F.lit(v).alias(k) for k, v in git_info().items()])
    counts = F.struct(*[F.col(c) for c in gated.columns if c == "total" or (c.startswith("n_") and "judged" not in c and "good" not in c)])
    acceptance = F.struct(*[F.col(c) for c in gated.columns if "acceptance" in c or "judged" in c or "good" in c])
    tokens = F.struct(*[F.col(c) for c in gated.columns if c.endswith("_tokens")])
    sections = {"timestamp": F.lit(timestamp), "git": git, "counts": counts, "acceptance": acceptance, "token_stats": tokens, "margins": margins if margins is not None else F.lit(None).cast("struct<mean:double>"), "thresholds": F.struct(*[F.lit(v).alias(k) for k, v in thresholds.items()]), "thresholds_passed": F.col("passed"), "failed_reasons": F.col("failed_reasons")}
    rest = [c for c in gated.columns if not (c == "total" or c.startswith("n_") or c.endswith(("_tokens", "_rate", "_acceptance")) or c in ("passed", "failed_reasons"))]
    return gated.select(*rest, F.to_json(F.struct(*[c.alias(k) for k, c in sections.items()])).alias("document"))


def run_steps(steps: Sequence[tuple[str, str, callable]], exists, force: Sequence[str] = ()) -> list[tuple[str, str]]:
    """Steps (name, artifact, function) in order; those whose artifact exists are skipped unless forced. Stops at the
    first failure. Returns (name, done, skipped or the error)."""
    log = []
    for name, artifact, function in steps:
        if name not in force and exists(artifact):
            log.append((name, "skipped"))
            continue
        try:
            function()
        except Exception as e:  # noqa: BLE001  the log is the result
            log.append((name, f"failed: {e}"))
            break
        log.append((name, "done"))
    return log
