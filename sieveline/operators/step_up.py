"""Step-up correction (Benjamini-Hochberg) of very many tests.

Tests are dealt to ranges of p and sorted there. A rank is the place in the range and the sizes of the ranges before; an
adjusted p is the least p * m / rank from the test on, so the least of those behind it in its range and of the ranges'
minima after it; the last test that passes its threshold is one aggregate. Only a row for each range meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import PART, PLACE, in_ranges


def step_up(tests: DataFrame, p: str = "p", key: str = "type", fdr: float = 0.10) -> DataFrame:
    """tests with rank, threshold, p_adjusted, significant (step-up) and significant_per_rank (each p against its own
    threshold), as stats.benjamini_hochberg gives them. Ties in p are ranked by key. Null p come last and pass nothing."""
    rows = in_ranges(tests, [F.col(p).asc_nulls_last(), F.col(key)])
    sizes = rows.groupBy(PART).agg(F.count("*").alias("_n"))
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(PART, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_m"))
    rows = rows.join(F.broadcast(sizes), PART).withColumn("rank", F.col("_before") + F.col(PLACE) + 1)
    rows = rows.withColumn("threshold", F.col("rank") / F.col("_m") * fdr).withColumn("_raw", F.col(p) * F.col("_m") / F.col("rank"))
    parts = rows.groupBy(PART).agg(F.min("_raw").alias("_least"), F.max(F.when(F.col(p) <= F.col("threshold"), F.col("rank"))).alias("_last"))
    after = Window.orderBy(F.col(PART).desc()).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(PART, F.min("_least").over(after).alias("_later"), F.max("_last").over(Window.partitionBy()).alias("_last"))
    behind = Window.partitionBy(PART).orderBy(F.col(PLACE).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(F.broadcast(parts), PART).withColumn("p_adjusted", F.least(F.lit(1.0), F.min("_raw").over(behind), F.col("_later")))
    rows = rows.withColumn("significant", F.coalesce(F.col("rank") <= F.col("_last"), F.lit(False)))
    rows = rows.withColumn("significant_per_rank", F.col(p) <= F.col("threshold"))
    return rows.drop(PART, PLACE, "_before", "_m", "_raw", "_later", "_last")
