"""Quality-control summaries and threshold gates with reasons."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import rate
from ..functions.text import END, HASHES, RUNAWAY_BASE, RUNAWAY_CHAT, TOKEN_PROXIES, is_runaway, is_truncated, leaks_delimiter, strip
from ..sources.files import kept
from .quantiles import exact_quantiles


@dataclass(frozen=True)
class Rules:
    """What a quality gate counts and where it draws lines. strict: a rate equal to its bound still passes."""

    runaway_patterns: tuple[str, ...]
    delimiter: str
    proxy: str
    token_limit: int | None
    strict: bool
    checks: tuple[str, ...]
    runaway_max: float = 0.05
    token_limit_max: float = 0.10
    median_max: float = 40
    acceptance_min: float = 0.5


RULES = {
    "pilot": Rules(RUNAWAY_BASE, HASHES, "chars", 95, False, ("runaway", "token_limit", "delimiter", "truncation", "median", "acceptance")),
    "repair": Rules(RUNAWAY_BASE + RUNAWAY_CHAT, HASHES, "chars", 90, True, ("runaway", "token_limit", "delimiter", "median", "acceptance")),
    "scale": Rules(RUNAWAY_BASE, END, "words", None, False, ("runaway", "delimiter", "median")),
}


def qc_columns(response: Column, rules: Rules) -> dict[str, Column]:
    tokens = TOKEN_PROXIES[rules.proxy](response)
    return {
        "tokens": tokens,
        "runaway": is_runaway(response, rules.runaway_patterns),
        "delimiter": leaks_delimiter(response, rules.delimiter),
        "at_limit": tokens >= rules.token_limit if rules.token_limit is not None else F.lit(False),
        "truncated": F.endswith(strip(response), F.lit(":")),
    }


def with_quantiles(summary: DataFrame, rows: DataFrame, value: Column, probabilities: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """summary, one row for each group of by, with quantiles: an array, null where a group has no values."""
    found = exact_quantiles(rows, value, probabilities, by)
    found = found.withColumnsRenamed({c: f"_q{i}" for i, c in enumerate(by)})
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_q{i}"))
    return summary.join(found, same, "left").drop(*[f"_q{i}" for i in range(len(by))])


def qc_summary(df: DataFrame, response: str, variant: str = "repair", by: Sequence[str] = (), instruction_good: Column | None = None, pair_good: Column | None = None) -> DataFrame:
    """Counts, token statistics and rates, for each group of by. Statistics of nothing are 0. Texts are read once: their
    figures are written as a narrow table, from which counts and exact quantiles are taken.

    instruction_good and pair_good: critic verdicts, where there are any (null counts as missing).
    """
    rules = RULES[variant]
    rows = df.select(*by, *[c.alias(n) for n, c in qc_columns(F.col(response), rules).items()], *[(g if g is not None else F.lit(None).cast("boolean")).alias(n) for n, g in (("instruction_good", instruction_good), ("pair_good", pair_good))])
    rows = kept(rows, "qc")
    out = rows.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if("runaway").alias("n_runaway"),
        F.count_if("delimiter").alias("n_delimiter"),
        F.count_if("at_limit").alias("n_token_limit"),
        F.count_if("truncated").alias("n_truncated"),
        F.count_if("instruction_good").alias("n_instructions_good"),
        F.count("instruction_good").alias("n_instructions_judged"),
        F.count_if("pair_good").alias("n_pairs_good"),
        F.count("pair_good").alias("n_pairs_judged"),
        F.avg("tokens").alias("_mean"),
        F.min("tokens").alias("_min"),
        F.max("tokens").alias("_max"),
    )
    out = with_quantiles(out, rows, F.col("tokens"), (0.5, 0.95), by)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = out.select(
        *by,
        "total",
        *[c for c in out.columns if c.startswith("n_")],
        zero(F.try_element_at("quantiles", F.lit(1))).alias("median_tokens"),
        zero(F.try_element_at("quantiles", F.lit(2))).alias("p95_tokens"),
        zero(F.col("_mean")).alias("mean_tokens"),
        F.coalesce("_min", F.lit(0)).cast("long").alias("min_tokens"),
        F.coalesce("_max", F.lit(0)).cast("long").alias("max_tokens"),
    )
    rates = {"runaway_rate": "n_runaway", "delimiter_rate": "n_delimiter", "token_limit_rate": "n_token_limit", "truncation_rate": "n_truncated"}
    for name, count in rates.items():
        out = out.withColumn(name, rate(F.col(count), F.col("total")))
    out = out.withColumn("instruction_acceptance", F.try_divide(F.col("n_instructions_good").cast("double"), F.col("n_instructions_judged")))
    return out.withColumn("pair_acceptance", F.try_divide(F.col("n_pairs_good").cast("double"), F.col("n_pairs_judged")))


def gate(summary: DataFrame, variant: str = "repair") -> DataFrame:
    """summary with failed_reasons and passed. Acceptance is judged only where critics judged rows."""
    rules = RULES[variant]
    over = (lambda c, bound: F.col(c) > bound) if rules.strict else (lambda c, bound: F.col(c) >= bound)
    tests = {
        "runaway": [(over("runaway_rate", rules.runaway_max), "runaway_rate")],
        "token_limit": [(over("token_limit_rate", rules.token_limit_max), "token_limit_rate")],
        "delimiter": [(F.col("n_delimiter") > 0, "delimiter_leakage")],
        "truncation": [(F.col("n_truncated") > 0, "truncation")],
        "median": [(over("median_tokens", rules.median_max), "median_tokens")],
        "acceptance": [(F.col(f"{k}_acceptance") < rules.acceptance_min, f"{k}_acceptance") for k in ("instruction", "pair")],
    }
    flags = [F.when(bad, F.lit(name)) for check in rules.checks for bad, name in tests[check]]
    return summary.withColumn("failed_reasons", F.array_compact(F.array(*flags))).withColumn("passed", F.size("failed_reasons") == 0)


def truncated_shards(df: DataFrame, response: str, shard: str, most: float = 0.02) -> DataFrame:
    """(shard, n, truncation_rate) of shards to make again."""
    hit = F.avg(is_truncated(F.col(response)).cast("double"))
    return df.groupBy(shard).agg(F.count("*").alias("n"), hit.alias("truncation_rate")).where(F.col("truncation_rate") > most)


def acceptance(verdicts: DataFrame, kind: str, verdict: str, exclusive: bool = False) -> DataFrame:
    """(kind, good, bad, low_confidence): low confidence overlaps the others unless exclusive (D-20)."""
    v = F.col(verdict)
    good, sure = v["is_good"], v["confident"]
    if exclusive:
        parts = {"good": good & sure, "low_confidence": good & ~sure, "bad": ~good}
    else:
        parts = {"good": good, "low_confidence": ~sure, "bad": ~good}
    return verdicts.groupBy(kind).agg(*[F.count_if(c).alias(n) for n, c in parts.items()])


def margin_stats(verdicts: DataFrame, kind: str, margin: Column) -> DataFrame:
    """(kind, n, mean, p25, median, p75) of critic margins."""
    rows = verdicts.select(kind, margin.cast("double").alias("m"))
    out = with_quantiles(rows.groupBy(kind).agg(F.count("m").alias("n"), F.avg("m").alias("mean")), rows, F.col("m"), (0.25, 0.5, 0.75), [kind])
    return out.select(kind, "n", "mean", *[F.try_element_at("quantiles", F.lit(i + 1)).alias(x) for i, x in enumerate(("p25", "median", "p75"))])


def margin_histogram(verdicts: DataFrame, margin: Column, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): bin 0 is below low, bins + 1 at high or above."""
    return verdicts.groupBy(F.width_bucket(margin, F.lit(low), F.lit(high), F.lit(bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def sample_qc(df: DataFrame, cleaned: Column) -> DataFrame:
    """Percentages of cleaning outcomes (of text.layered_cleanup) and the verdict on a sample."""
    c = kept(df.select(cleaned.alias("c")).select(*[F.col(f"c.{f}") for f in ("delimiter_found", "heuristic_cutoff", "hit_token_limit", "forbidden_markers")], (F.length("c.text") / 4).alias("tokens")), "sample")
    pct = lambda f: 100 * rate(F.count_if(F.col(f)), F.count("*"))
    out = c.agg(F.count("*").alias("n"), pct("delimiter_found").alias("delimiter_pct"), pct("heuristic_cutoff").alias("cutoff_pct"), pct("hit_token_limit").alias("limit_pct"), F.count_if("forbidden_markers").alias("n_forbidden"))
    out = with_quantiles(out, c, F.col("tokens"), (0.5,))
    out = out.withColumn("median_tokens", F.coalesce(F.try_element_at("quantiles", F.lit(1)), F.lit(0.0))).drop("quantiles")
    return out.withColumn("passed", (F.col("delimiter_pct") >= 80) & (F.col("limit_pct") < 10) & (F.col("median_tokens") < 40) & (F.col("n_forbidden") == 0))


def shard_counts(df: DataFrame, shard: str) -> DataFrame:
    """Rows of each shard, and of all (shard null)."""
    return df.rollup(shard).agg(F.count("*").alias("n"))


def placeholder_share(df: DataFrame, response: str, order: str, rows: int = 20) -> DataFrame:
    """(n, n_placeholder, warn) over the first rows: the check is on a head by design."""
    from ..functions.text import is_placeholder

    head = df.orderBy(order).limit(rows)
    return head.agg(F.count("*").alias("n"), F.count_if(is_placeholder(F.col(response))).alias("n_placeholder")).withColumn("warn", F.col("n_placeholder") > 0.5 * F.col("n"))
