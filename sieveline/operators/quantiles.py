"""Exact quantiles of groups by selection, without a task that holds a group's distinct values.

Values are written once, as a narrow table. The first pass counts buckets of a logarithmic scale, which any range of
doubles fills with 2 * 137,000 at most, and finds the buckets in which the wanted ranks lie. A bucket of one value is
done; each further pass splits those that are left, and no others, into FINE equal stretches between their least and
their largest value, until each wanted rank has one value. Most data need one to three passes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import kept

COARSE, FINE = 64, 1 << 16
#: Above all logarithmic buckets of finite numbers: infinity, and NaN as the largest value.
_SHIFT, _INFINITE, _NAN = 70_000, 1 << 19, 1 << 20


def _coarse(v: Column) -> Column:
    """A bucket number that never falls as v rises."""
    size = F.floor(F.log2(F.abs(v)) * COARSE).cast("int") + _SHIFT
    infinite = F.abs(v) == F.lit(float("inf"))
    return F.when(F.isnan(v), _NAN).when(v == 0, 0).when(infinite, F.signum(v).cast("int") * _INFINITE).otherwise(F.signum(v).cast("int") * size)


def exact_quantiles(df: DataFrame, value: Column, probabilities: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., quantiles): for each group that has values, the array of its quantiles, interpolated between the two
    neighbours of a place as percentile() does. Nulls don't count; NaN counts as the largest value; null keys of by are
    a group."""
    group = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("_all"))
    values = kept(df.select(group.alias("_g"), (value.cast("double") + F.lit(0.0)).alias("_v")).where("_v IS NOT NULL"), "values")
    place = F.transform(F.array(*[F.lit(float(p)) for p in probabilities]), lambda p: p * (F.col("_total") - 1))
    ranks = F.array_distinct(F.flatten(F.transform(place, lambda x: F.array(F.floor(x), F.ceil(x)))))
    counts = [F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")]
    cells = values.groupBy("_g", _coarse(F.col("_v")).alias("_cell")).agg(*counts)
    # windows over counted cells: their number is bounded for each group
    order = Window.partitionBy("_g").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0))).withColumn("_total", F.sum("_n").over(Window.partitionBy("_g")))
    inside = F.filter(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n")))
    found = kept(cells.select("_g", "_total", "_low", "_high", "_before", F.explode(inside).alias("_rank")), "ranks")
    done = found.where("_low <=> _high")
    left = found.where("NOT _low <=> _high")
    while not left.isEmpty():
        stretch = left.select("_g", F.col("_low").alias("_a"), F.col("_high").alias("_b")).distinct()
        some = values.join(stretch, "_g").where(F.col("_v").between(F.col("_a"), F.col("_b")))
        at = F.floor((F.col("_v") - F.col("_a")) / (F.col("_b") - F.col("_a")) * FINE)
        cells = some.groupBy("_g", "_a", "_b", at.alias("_cell")).agg(*counts)
        order = Window.partitionBy("_g", "_a", "_b").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.withColumn("_more", F.coalesce(F.sum("_n").over(order), F.lit(0)))
        wanted = left.select("_g", F.col("_low").alias("_a"), F.col("_high").alias("_b"), "_total", F.col("_before").alias("_base"), "_rank")
        begin = F.col("_base") + F.col("_more")
        hit = cells.join(wanted, ["_g", "_a", "_b"]).where((F.col("_rank") >= begin) & (F.col("_rank") < begin + F.col("_n")))
        found = kept(hit.select("_g", "_total", "_low", "_high", begin.alias("_before"), "_rank"), "ranks")
        done = done.unionByName(found.where("_low <=> _high"))
        left = found.where("NOT _low <=> _high")
    each = done.groupBy("_g", "_total").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_low"))).alias("_at"))

    def between(x: Column) -> Column:
        low, high = F.element_at("_at", F.floor(x)), F.element_at("_at", F.ceil(x))
        return F.when(low == high, low).otherwise(low * (F.ceil(x) - x) + high * (x - F.floor(x)))

    return each.select(*([F.col(f"_g.{c}") for c in by]), F.transform(place, between).alias("quantiles"))
