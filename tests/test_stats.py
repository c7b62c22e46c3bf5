"""Statistics against known values."""

import math
import random

import pytest
from pyspark.sql import functions as F
from sieveline.functions import stats
from sieveline.operators import evaluate


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(
    "n01,n10,method,statistic,p",
    [(10, 2, "chi2", 49 / 12, math.erfc(math.sqrt(49 / 24))), (0, 0, "auto", 0, 1), (100, 0, "chi2", 98.01, math.erfc(math.sqrt(98.01 / 2))), (8, 2, "exact", 2, 0.109375), (10, 2, "auto", 2, 2 * 79 / 4096), (57, 2, "auto", 54**2 / 59, math.erfc(math.sqrt(54**2 / 118))), (12, 12, "auto", 12, 1), (12, 13, "auto", 0, 1), (10, 2, "chi2_no_continuity", 64 / 12, math.erfc(math.sqrt(64 / 24))), (5, 0, "exact", 0, 0.0625)],
)
def test_mcnemar(spark, n01, n10, method, statistic, p):
    r = one(spark, stats.mcnemar(F.lit(n01), F.lit(n10), method).alias("m")).m
    assert r.statistic == pytest.approx(statistic, abs=1e-9) and r.p == pytest.approx(p, rel=1e-9, abs=1e-25)


def test_erfc_over_its_range(spark):
    rows = spark.createDataFrame([(x / 20,) for x in range(0, 200)], "z double").select("z", stats.erfc(F.col("z")).alias("e")).collect()
    assert all(r.e == pytest.approx(math.erfc(r.z), rel=1e-9) for r in rows)


@pytest.mark.parametrize("k,n,low,high", [(243, 300, 0.76180, 0.85037), (298, 300, 0.97602, 0.99817), (0, 0, 0, 0), (3, 10, 0.108, 0.603)])
def test_wilson(spark, k, n, low, high):
    r = one(spark, stats.wilson(F.lit(k), F.lit(n)).alias("w")).w
    assert (r.lower, r.upper) == pytest.approx((low, high), abs=6e-4 if n == 10 else 1e-5)


def test_wide_wilson(spark):
    r = one(spark, stats.wilson(F.lit(243), F.lit(300), variant="wide").alias("w")).w
    assert (r.lower, r.upper) == pytest.approx((0.76151, 0.85065), abs=1e-5)


def test_interval_shrinks_with_n(spark):
    rows = spark.createDataFrame([(n,) for n in (10, 100, 1000)], "n int").select(stats.wilson(F.col("n") / 2, F.col("n")).alias("w")).collect()
    widths = [r.w.upper - r.w.lower for r in rows]
    assert widths == sorted(widths, reverse=True)


def test_cohens_h(spark):
    r = one(spark, stats.cohens_h(F.lit(298 / 300), F.lit(243 / 300)).alias("h"), stats.cohens_h(F.lit(0.0), F.lit(1.0)).alias("m"), stats.cohens_h(F.lit(1.5), F.lit(1.0)).alias("c"))
    assert r.h == pytest.approx(0.73857, abs=1e-5) and r.m == pytest.approx(-math.pi) and r.c == 0


def step_up(p, fdr):
    order = sorted(range(len(p)), key=lambda i: p[i])
    last = max((k for k, i in enumerate(order, 1) if p[i] <= k / len(p) * fdr), default=0)
    adjusted, low = [0.0] * len(p), 1.0
    for k in range(len(p), 0, -1):
        low = min(low, p[order[k - 1]] * len(p) / k)
        adjusted[order[k - 1]] = low
    return adjusted, [order.index(i) < last for i in range(len(p))]


@pytest.mark.parametrize("seed", range(4))
def test_benjamini_hochberg(spark, seed):
    rng = random.Random(seed)
    p = [round(rng.random() ** 3, 6) for _ in range(12)]
    df = spark.createDataFrame(list(enumerate(p)), "type int, p double")
    got = {r.type: (r.p_adjusted, r.significant) for r in stats.benjamini_hochberg(df).collect()}
    adjusted, rejected = step_up(p, 0.10)
    assert all(got[i][0] == pytest.approx(adjusted[i]) and got[i][1] == rejected[i] for i in range(12))


def test_step_up_rejects_more_than_each_rank(spark):
    df = spark.createDataFrame([("a", 0.04), ("b", 0.06), ("c", 0.07)], "type string, p double")
    got = {r.type: (r.significant, r.significant_per_rank) for r in stats.benjamini_hochberg(df).collect()}
    assert got == {"a": (True, False), "b": (True, True), "c": (True, True)}
    assert stats.benjamini_hochberg(df.limit(0)).collect() == []


def outcomes(spark, cells):
    rows, i = [], 0
    for kind, counts in cells.items():
        for (a, b), n in counts.items():
            for _ in range(n):
                rows.append((i, kind, a, b))
                i += 1
    return spark.createDataFrame(rows, "id int, type string, a int, b int")


def test_published_comparison(spark):
    df = outcomes(spark, {"x": {(0, 1): 57, (1, 0): 2, (1, 1): 241, (0, 0): 0}})
    r = evaluate.with_statistics(evaluate.paired_counts(df, "a", "b")).first()
    assert (r.n, r.n01, r.n10) == (300, 57, 2) and r.statistic == pytest.approx(49.4237, abs=1e-4) and r.p == pytest.approx(2.06236e-12, rel=1e-4) and r.abs_h == pytest.approx(0.73857, abs=1e-5)


def test_small_types_and_single_types_are_left_out(spark):
    big, small = {(0, 1): 6, (1, 1): 6}, {(0, 1): 9}
    two = evaluate.paired_analysis(outcomes(spark, {"x": big, "y": big, "z": small}), "a", "b", "type")
    assert sorted(r.type for r in two.where("scope = 'type'").collect()) == ["x", "y"]
    one_type = evaluate.paired_analysis(outcomes(spark, {"x": big, "z": small}), "a", "b", "type")
    assert [r.scope for r in one_type.collect()] == ["overall"]
    assert "overall: n=33" in evaluate.report(two)
    assert evaluate.gate_decision(two).first().decision == "PASS"
    assert evaluate.correction_summary(two).first().n_tests == 2


def test_lift_by_cells(spark):
    df = outcomes(spark, {"x": {(0, 1): 30, (1, 0): 5, (1, 1): 50, (0, 0): 15}})
    a, b = (evaluate.lift_by_cells(df, "a", "b", samples=2000).first() for _ in range(2))
    assert a == b and a.lift == pytest.approx(0.25) and 0.12 < a.low < a.lift < a.high < 0.38
    assert evaluate.lift_by_cells(df.limit(0), "a", "b", samples=10).first().lift == 0


def test_kappa(spark):
    from sieveline.operators import conversation

    df = outcomes(spark, {"x": {(1, 1): 20, (1, 0): 5, (0, 1): 10, (0, 0): 15}})
    assert conversation.kappa(df, "a", "b").first().kappa == pytest.approx(0.4)


def test_condition_gate(spark):
    df = spark.createDataFrame([("base", 100, 20), ("sft", 100, 90)], "condition string, n int, n_success int")
    assert evaluate.condition_gate(df, {"base": (0.1, 0.5), "sft": (0.8, 1.0)}, "base", "sft").first().passed
    assert not evaluate.condition_gate(df, {"base": (0.3, 0.5)}, "base", "sft").first().passed
