"""Capability cubes, matrices and readiness gates over scored responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scorers import SIX

PRIMARY = {"pure_completion": "completion", "pure_instruction": "instruction", "question_answer": "answer"}


def fan_out_runs(tests: DataFrame, models: DataFrame, temperatures: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Every test for every model at every temperature: the plan of runs, as large as its product by definition."""
    temps = F.explode(F.array(*[F.lit(t) for t in temperatures])).alias("temperature")
    return tests.crossJoin(F.broadcast(models)).select("*", temps)


def long_scores(scored: DataFrame, scores: str = "scores") -> DataFrame:
    """One row for each dimension."""
    keep = [c for c in scored.columns if c != scores]
    rows = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(f"{scores}.{d}").cast("double").alias("score")) for d in SIX])
    return scored.select(*keep, F.inline(rows))


def cube(scored: DataFrame, scores: str = "scores") -> DataFrame:
    """(model, temperature, category, dimension, mean, std, n): for each category, and over all (category null). Sample
    deviation, 0 for one row. One aggregation over wide rows: dimensions unfold after it."""
    parts = [f(F.col(f"{scores}.{d}")).alias(f"{d}_{k}") for d in SIX for k, f in (("mean", F.avg), ("std", F.stddev_samp))]
    wide = scored.groupingSets([["model", "temperature", "category"], ["model", "temperature"]], "model", "temperature", "category").agg(F.count("*").alias("n"), *parts)
    rows = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(f"{d}_mean").alias("mean"), F.coalesce(f"{d}_std", F.lit(0.0)).alias("std")) for d in SIX])
    return wide.select("model", "temperature", "category", "n", F.inline(rows))


def _mean(scores: str, names: tuple[str, ...]) -> Column:
    total = F.lit(0.0)
    for n in names:
        total = total + F.col(f"{scores}.{n}")
    return total / len(names)


def matrix(scored: DataFrame, scores: str = "scores") -> DataFrame:
    """(model, temperature, category, primary_score, overall_score, n): the category's own dimension, or the mean of
    three, and the mean of all six."""
    chain = None
    for category, dimension in PRIMARY.items():
        chain = F.when(F.col("category") == category, F.col(f"{scores}.{dimension}")) if chain is None else chain.when(F.col("category") == category, F.col(f"{scores}.{dimension}"))
    primary = chain.otherwise(_mean(scores, ("completion", "instruction", "answer")))
    return scored.groupBy("model", "temperature", "category").agg(F.avg(primary).alias("primary_score"), F.avg(_mean(scores, SIX)).alias("overall_score"), F.count("*").alias("n"))


def stage_gate(m: DataFrame, base: str = "base", temperature: float = 0.5) -> DataFrame:
    """Readiness of each model but the base, from a matrix, at one temperature: scores, criteria, ready, and advice."""
    at = lambda c, v: F.max(F.when(F.col("category") == c, F.col(v)))
    per_model = m.where(F.col("temperature") == temperature).groupBy("model").agg(at("pure_instruction", "primary_score").alias("instruction"), at("question_answer", "primary_score").alias("answer"), at("pure_completion", "primary_score").alias("completion"), F.avg("overall_score").alias("overall"))
    reference = per_model.where(F.col("model") == base).select(F.col("instruction").alias("_base"))
    out = per_model.where(F.col("model") != base).crossJoin(F.broadcast(reference)).withColumn("improvement", F.col("instruction") - F.col("_base")).drop("_base")
    out = out.withColumn("instruction_ok", F.col("instruction") >= 0.7).withColumn("improvement_ok", F.col("improvement") >= 0.4).withColumn("overall_ok", F.col("overall") >= 0.6)
    out = out.withColumn("ready", F.coalesce(F.col("instruction_ok") & F.col("improvement_ok") & F.col("overall_ok"), F.lit(False)))
    return out.withColumn("advice", advice(F.col("instruction"), F.col("answer"), F.col("completion")))


def advice(instruction: Column, answer: Column, completion: Column) -> Column:
    found = F.array_compact(F.array(F.when(instruction < 0.7, "train on more diverse commands"), F.when(answer < 0.6, "add question and answer pairs"), F.when(completion < 0.8, "preserve completion ability")))
    return F.when(F.size(found) == 0, F.array(F.lit("ready for the next stage"))).otherwise(found)


FOUR = ("instruction_following", "coherence", "relevance", "quality")


def scoreboard(scored: DataFrame, most: int = 360, scores: str = "scores") -> DataFrame:
    """(model, category, dimension, points, pct): totals for each model, by category, and by dimension, of 0..2 scores."""
    wide = scored.groupingSets([["model"], ["model", "category"]], "model", "category").agg(*[F.sum(f"{scores}.{d}").alias(d) for d in FOUR], F.grouping("category").alias("_all"))
    total = F.array(F.struct(F.lit(None).cast("string").alias("dimension"), sum([F.col(d) for d in FOUR], F.lit(0)).alias("points")))
    parts = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("points")) for d in FOUR])
    rows = F.when(F.col("_all") == 1, F.concat(total, parts)).otherwise(total)
    out = wide.select("model", "category", F.explode(rows).alias("r")).select("model", "category", "r.dimension", F.col("r.points").cast("long").alias("points"))
    return out.withColumn("pct", F.col("points") / most * 100)


CRITICAL = ("explicit_instructions", "prerequisite_for_stage2")


def readiness(points: DataFrame) -> DataFrame:
    """(category, score, passed, overall_score, ready) from rows (category, score, max_score): 70 % for each category,
    which is critical for two of them, and 60 % for the plain mean of categories."""
    per = points.groupBy("category").agg((F.sum("score") / F.sum("max_score")).alias("score"))
    per = per.withColumn("passed", F.col("score") >= 0.7)
    whole = per.agg(F.avg("score").alias("overall_score"), F.bool_and(F.col("passed") | ~F.col("category").isin(*CRITICAL)).alias("_critical"))
    return per.crossJoin(F.broadcast(whole)).withColumn("ready", F.col("_critical") & (F.col("overall_score") >= 0.6)).drop("_critical")
