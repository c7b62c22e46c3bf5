"""Success rates, comparisons of two systems, and paired analysis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import benjamini_hochberg, cohens_h, mcnemar, rate, wilson

GATE_P = 0.01


def type_rates(df: DataFrame, kind: str, success: str = "success") -> DataFrame:
    """(kind, total, n_success, rate) for each kind, and over all (kind null)."""
    out = df.rollup(kind).agg(F.count("*").alias("total"), F.count_if(success).alias("n_success"))
    return out.withColumn("rate", rate(F.col("n_success"), F.col("total")))


def failure_reasons(df: DataFrame, by: Sequence[str], success: str = "success", reason: str = "reason") -> DataFrame:
    return df.where(~F.col(success)).groupBy(*by, reason).agg(F.count("*").alias("n"))


def compare(results: DataFrame, kind: str, base: str = "base", other: str = "sft") -> DataFrame:
    """Long results (model, kind, success) side by side for each kind and over all (null): rates with 0 for a side that
    lacks the kind, improvement, relative improvement (infinite over 0), failures eliminated."""
    sides = []
    for name, model in (("base", base), ("other", other)):
        r = type_rates(results.where(F.col("model") == model), kind)
        sides.append(r.select(F.col(kind).alias("kind"), F.col("total").alias(f"{name}_total"), F.col("n_success").alias(f"{name}_success"), F.col("rate").alias(f"{name}_rate")))
    a, b = sides
    joined = a.withColumnRenamed("kind", "_k").join(b, F.col("_k").eqNullSafe(F.col("kind")), "full").withColumn("kind", F.coalesce("kind", "_k")).drop("_k")
    joined = joined.fillna(0, [c for c in joined.columns if c != "kind"])
    gain = F.col("other_rate") - F.col("base_rate")
    return joined.withColumn("improvement", gain).withColumn("relative_improvement", F.coalesce(F.try_divide(gain, F.col("base_rate")), F.lit(float("inf")))).withColumn("failures_eliminated", (F.col("base_total") - F.col("base_success")) - (F.col("other_total") - F.col("other_success")))


def against_baseline(rates: DataFrame, baseline: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """rates (type, rate) beside baseline (category, rate) by a mapping of types; unmatched ones are left out."""
    names = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    r = rates.select("type", F.col("rate"), F.try_element_at(names, F.col("type")).alias("category"))
    return r.join(baseline.select("category", F.col("rate").alias("baseline_rate")), "category").withColumn("improvement", F.col("rate") - F.col("baseline_rate"))


def condition_contrasts(results: DataFrame) -> DataFrame:
    """Results (model base|trained, prompt raw|few_shot, success) as one row of four rates and four differences."""
    cell = lambda m, p: F.avg(F.when((F.col("model") == m) & (F.col("prompt") == p), F.col("success").cast("double")))
    out = results.agg(*[cell(m, p).alias(f"{m}_{p}") for m in ("base", "trained") for p in ("raw", "few_shot")])
    gaps = {"training_raw": ("trained_raw", "base_raw"), "training_few_shot": ("trained_few_shot", "base_few_shot"), "prompting_base": ("base_few_shot", "base_raw"), "prompting_trained": ("trained_few_shot", "trained_raw")}
    return out.select("*", *[(F.col(a) - F.col(b)).alias(n) for n, (a, b) in gaps.items()])


def stage_summary(rows: DataFrame, kind: str, error: str, order: str, k: int = 3) -> DataFrame:
    """(kind, n, n_ok, samples): rows of a stage and those without an error, with the first k of these by order."""
    ok = F.col(error).isNull()
    counts = rows.groupBy(kind).agg(F.count("*").alias("n"), F.count_if(ok).alias("n_ok"))
    from .ranking import first_of_each

    samples = first_of_each(rows.where(ok), [kind], [order], k).groupBy(kind).agg(F.array_sort(F.collect_list(order)).alias("samples"))
    return counts.join(samples, kind, "left")


def previews(df: DataFrame, kind: str, order: str, k: int = 3) -> DataFrame:
    """The first k successes and failures of each kind."""
    from .ranking import first_of_each

    return first_of_each(df, [kind, "success"], [order], k)


def paired_counts(pairs: DataFrame, a: str, b: str, kind: str | None = None) -> DataFrame:
    """Counts of paired 0/1 outcomes over all rows (scope overall) and, in the same pass, for each kind."""
    one, two = F.col(a) == 1, F.col(b) == 1
    counts = [F.count("*").alias("n"), F.count_if(one).alias("n_a"), F.count_if(two).alias("n_b"), F.count_if(~one & two).alias("n01"), F.count_if(one & ~two).alias("n10")]
    if kind is None:
        return pairs.agg(*counts).select(F.lit("overall").alias("scope"), F.lit(None).cast("string").alias("type"), "*")
    out = pairs.rollup(kind).agg(F.grouping(kind).alias("_all"), *counts)
    return out.select(F.when(F.col("_all") == 1, "overall").otherwise("type").alias("scope"), F.col(kind).alias("type"), *[c for c in out.columns if c not in ("_all", kind)])


def with_statistics(counts: DataFrame, confidence: float = 0.95, method: str = "auto") -> DataFrame:
    ci = lambda c: wilson(F.col(c), F.col("n"), confidence)
    out = counts.withColumn("a_rate", rate(F.col("n_a"), F.col("n"))).withColumn("b_rate", rate(F.col("n_b"), F.col("n"))).withColumn("_a", ci("n_a")).withColumn("_b", ci("n_b")).withColumn("_m", mcnemar(F.col("n01"), F.col("n10"), method))
    out = out.withColumn("lift", F.col("b_rate") - F.col("a_rate")).withColumn("cohens_h", cohens_h(F.col("b_rate"), F.col("a_rate")))
    out = out.withColumn("abs_h", F.abs("cohens_h"))
    return out.select("*", F.col("_a.lower").alias("a_low"), F.col("_a.upper").alias("a_high"), F.col("_b.lower").alias("b_low"), F.col("_b.upper").alias("b_high"), F.col("_m.statistic").alias("statistic"), F.col("_m.p").alias("p"), F.col("_m.method").alias("method")).drop("_a", "_b", "_m")


def paired_analysis(pairs: DataFrame, a: str, b: str, kind: str, fdr: float = 0.10, confidence: float = 0.95, method: str = "auto", least: int = 10) -> DataFrame:
    """Overall and by-type rows of a paired comparison, with Benjamini-Hochberg over the types.

    Types of fewer than least rows are left out, and all of them if there is one type only.
    """
    rows = with_statistics(paired_counts(pairs, a, b, kind), confidence, method)
    overall = rows.where("scope = 'overall'")
    types = rows.where((F.col("scope") == "type") & (F.col("n") >= least))
    types = types.withColumn("_types", F.count("*").over(Window.partitionBy())).where("_types > 1").drop("_types")
    adjusted = benjamini_hochberg(types, "p", fdr, "type")
    return adjusted.unionByName(overall, allowMissingColumns=True)


def correction_summary(analysis: DataFrame, fdr: float = 0.10) -> DataFrame:
    """(fdr, n_tests, n_significant_raw, n_significant_adjusted) of a paired analysis."""
    return analysis.where("scope = 'type'").agg(F.lit(fdr).alias("fdr"), F.count("*").alias("n_tests"), F.count_if(F.col("p") < 0.05).alias("n_significant_raw"), F.count_if("significant").alias("n_significant_adjusted"))


def gate_decision(analysis: DataFrame, p: float = GATE_P) -> DataFrame:
    """PASS or FAIL of the overall row."""
    return analysis.where("scope = 'overall'").select("n", "n01", "n10", "p", F.when(F.col("p") < p, "PASS").otherwise("FAIL").alias("decision"))


def success_gate(results: DataFrame, least: float = 0.95, success: str = "success") -> DataFrame:
    return results.agg(F.count("*").alias("n"), F.avg(F.col(success).cast("double")).alias("rate")).withColumn("passed", F.coalesce(F.col("rate") >= least, F.lit(False)))


def lift_by_cells(pairs: DataFrame, a: str, b: str, samples: int = 10_000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """(lift, low, high): the interval of bootstrap.bootstrap_lift for outcomes of 0 and 1, from counts of the cells -1,
    0 and 1 of b - a: each resample draws its two counts as binomials. The work doesn't grow with the rows."""
    d = F.col(b).cast("int") - F.col(a).cast("int")
    counts = pairs.agg(F.count("*").alias("n"), F.count_if(d == 1).alias("up"), F.count_if(d == -1).alias("down"))

    def draw(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                rng = np.random.default_rng([seed, int(r.id)])
                n = int(r.n)
                up, down, _ = rng.multinomial(n, [r.up / n, r.down / n, max(0.0, 1 - (r.up + r.down) / n)]) if n else (0, 0, 0)
                out.append((up - down) / n if n else 0.0)
            yield pd.DataFrame({"lift": out})

    resamples = pairs.sparkSession.range(samples).crossJoin(F.broadcast(counts)).mapInPandas(draw, "lift double")
    tail = (1 - confidence) / 2
    ends = resamples.agg(F.percentile("lift", F.array(F.lit(tail), F.lit(1 - tail))).alias("p"))
    lift = counts.select(F.coalesce(F.try_divide((F.col("up") - F.col("down")).cast("double"), F.col("n")), F.lit(0.0)).alias("lift"))
    return lift.crossJoin(ends).select("lift", F.col("p")[0].alias("low"), F.col("p")[1].alias("high"))


def condition_gate(rates: DataFrame, bounds: dict[str, tuple[float, float]], base: str, other: str, least_h: float = 0.5) -> DataFrame:
    """rates (condition, n, n_success) judged as a whole: each within its bounds, intervals of base and other apart,
    and the effect large enough. One row."""
    r = rates.withColumn("rate", rate(F.col("n_success"), F.col("n"))).withColumn("ci", wilson(F.col("n_success"), F.col("n")))
    within = F.lit(True)
    for name, (low, high) in bounds.items():
        within = within & F.when(F.col("condition") == name, F.col("rate").between(low, high)).otherwise(True)
    at = lambda name, c: F.max(F.when(F.col("condition") == name, c))
    out = r.agg(F.bool_and(within).alias("within_bounds"), (at(other, F.col("ci.lower")) > at(base, F.col("ci.upper"))).alias("intervals_apart"), cohens_h(at(other, F.col("rate")), at(base, F.col("rate"))).alias("h"))
    return out.withColumn("passed", F.col("within_bounds") & F.col("intervals_apart") & (F.abs("h") >= least_h))


def abort_reasons(rates: DataFrame, rules: Sequence[tuple[str, str, float, str]]) -> DataFrame:
    """(aborted, reasons): one row on rates (condition, n, n_success). Each rule (condition, 'at_least' or 'below', bound,
    reason) ends the run where the condition's rate is there; a condition without rows ends nothing."""
    r = rates.withColumn("_rate", F.try_divide(F.col("n_success").cast("double"), F.col("n")))
    at = lambda name: F.max(F.when(F.col("condition") == name, F.col("_rate")))
    flags = [F.when(at(name) >= bound if way == "at_least" else at(name) < bound, F.lit(reason)) for name, way, bound, reason in rules]
    out = r.agg(F.array_compact(F.array(*flags)).alias("reasons"))
    return out.select((F.size("reasons") > 0).alias("aborted"), "reasons")


# When an evaluation of conversations is given up.
ABORT_RULES = (
    ("base_formatted", "at_least", 0.60, "conversation isn't hard enough"),
    ("alt_base", "at_least", 0.60, "all base models can converse"),
    ("instruct", "below", 0.80, "too hard even for the instruct model"),
)


def report(analysis: DataFrame) -> str:
    """A text report of a paired analysis: a few rows, brought to the driver."""
    lines = []
    for r in sorted(analysis.collect(), key=lambda r: (r.scope != "overall", r.type or "")):
        name = "overall" if r.scope == "overall" else r.type
        lines.append(f"{name}: n={r.n}, {r.a_rate:.1%} [{r.a_low:.1%}, {r.a_high:.1%}] -> {r.b_rate:.1%} [{r.b_low:.1%}, {r.b_high:.1%}], lift {r.lift:+.1%}, n01={r.n01}, n10={r.n10}, p={r.p:.3g} ({r.method}), h={r.cohens_h:+.2f}" + (", significant" if r.significant else ""))
    return "\n".join(lines)
