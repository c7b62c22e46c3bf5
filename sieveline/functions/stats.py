"""Statistics of proportions and paired outcomes as column expressions."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXACT_BELOW = 25


def z_value(confidence: float) -> float:
    return NormalDist().inv_cdf((1 + confidence) / 2)


def rate(part: Column, whole: Column) -> Column:
    """part / whole, 0 where there is nothing."""
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def wilson(successes: Column, n: Column, confidence: float = 0.95, variant: str = "standard") -> Column:
    """struct(lower, upper): the Wilson interval, (0, 0) without trials. variant 'wide' has the margin of an earlier
    formula, with its square root over a wider term (D-01)."""
    z = z_value(confidence)
    p, k = F.try_divide(successes.cast("double"), n), n.cast("double")
    center = (p + z * z / (2 * k)) / (1 + z * z / k)
    spread = F.sqrt(p * (1 - p) / k + z * z / (4 * k * k))
    margin = z * spread * (1 / (1 + z * z / k) if variant == "standard" else F.sqrt(1 / (1 + z * z / k)))
    low, high = F.greatest(F.lit(0.0), center - margin), F.least(F.lit(1.0), center + margin)
    some = F.when(n > 0, F.struct(low.alias("lower"), high.alias("upper")))
    return F.coalesce(some, F.struct(F.lit(0.0).alias("lower"), F.lit(0.0).alias("upper")))


def erfc(z: Column) -> Column:
    """The complementary error function for z >= 0: a series where it is large, a continued fraction in the tail."""
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(120)),
        F.struct(z.alias("term"), z.alias("sum")),
        lambda acc, n: F.struct((acc["term"] * 2 * z * z / (2 * n + 1)).alias("term"), (acc["sum"] + acc["term"] * 2 * z * z / (2 * n + 1)).alias("sum")),
        lambda acc: acc["sum"],
    )
    body = 1 - 2 / math.sqrt(math.pi) * F.exp(-z * z) * series
    fraction = F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), z, lambda acc, n: z + (n / 2) / acc)
    tail = F.exp(-z * z) / math.sqrt(math.pi) / fraction
    return F.when(z < 2.5, body).otherwise(tail)


def chi2_p(chi2: Column) -> Column:
    """Upper tail of chi-squared with one degree of freedom."""
    return erfc(F.sqrt(chi2 / 2))


def binomial_p(n01: Column, n10: Column) -> Column:
    """Two-sided exact p of a fair split, at most 1."""
    n, k = (n01 + n10).cast("int"), F.least(n01, n10).cast("int")
    start = F.struct(F.pow(F.lit(0.5), n).alias("term"), F.pow(F.lit(0.5), n).alias("sum"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] * (n - i + 1) / i
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    tail = F.when(k > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), start, add, lambda acc: acc["sum"])).otherwise(F.pow(F.lit(0.5), n))
    return F.least(F.lit(1.0), 2 * tail)


def mcnemar(n01: Column, n10: Column, method: str = "auto") -> Column:
    """struct(statistic, p, method). auto: exact below 25 discordant pairs, else chi-squared with continuity correction
    (D-03). Without discordant pairs: 0 and 1."""
    n, gap = (n01 + n10).cast("double"), F.abs(n01 - n10).cast("double")
    exact = F.struct(F.least(n01, n10).cast("double").alias("statistic"), binomial_p(n01, n10).alias("p"), F.lit("exact").alias("method"))

    def chi2(correction: int, name: str) -> Column:
        x = F.try_divide(F.pow(gap - correction, F.lit(2)), n)
        return F.struct(x.alias("statistic"), chi2_p(x).alias("p"), F.lit(name).alias("method"))

    ways = {"exact": exact, "chi2": chi2(1, "chi2"), "chi2_no_continuity": chi2(0, "chi2_no_continuity")}
    test = F.when(n < EXACT_BELOW, exact).otherwise(ways["chi2"]) if method == "auto" else ways[method]
    none = F.struct(F.lit(0.0).alias("statistic"), F.lit(1.0).alias("p"), F.lit("none").alias("method"))
    return F.when(n == 0, none).otherwise(test)


def cohens_h(p1: Column, p2: Column) -> Column:
    """Signed effect size between two proportions, clipped to 0..1."""
    arc = lambda p: 2 * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))))
    return arc(p1) - arc(p2)


def cohens_kappa(both: Column, first: Column, second: Column, neither: Column) -> Column:
    """Agreement of two raters beyond chance, from the four counts; null where chance alone agrees fully."""
    n = (both + first + second + neither).cast("double")
    seen = (both + neither) / n
    chance = ((both + first) * (both + second) + (second + neither) * (first + neither)) / (n * n)
    return F.try_divide(seen - chance, 1 - chance)


def benjamini_hochberg(tests: DataFrame, p: str = "p", fdr: float = 0.10, key: str = "type") -> DataFrame:
    """tests with rank, threshold, p_adjusted, significant (step-up) and significant_per_rank (each p against its own
    threshold only, D-02). One row for each test: few enough for one window."""
    every = Window.partitionBy()
    order = Window.orderBy(F.col(p), key)
    t = tests.withColumn("rank", F.row_number().over(order)).withColumn("m", F.count("*").over(every))
    t = t.withColumn("threshold", F.col("rank") / F.col("m") * fdr)
    down = Window.orderBy(F.col("rank").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("p_adjusted", F.least(F.lit(1.0), F.min(F.col(p) * F.col("m") / F.col("rank")).over(down)))
    last = F.max(F.when(F.col(p) <= F.col("threshold"), F.col("rank"))).over(every)
    t = t.withColumn("significant", F.coalesce(F.col("rank") <= last, F.lit(False)))
    return t.withColumn("significant_per_rank", F.col(p) <= F.col("threshold")).drop("m")
