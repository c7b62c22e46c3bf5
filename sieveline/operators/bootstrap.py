"""Bootstrap intervals with counter-based draws, in columns.

Instead of drawing rows, each row gets, in each replicate, a weight that is Poisson(1): how often a large sample with
replacement takes it. The weight comes from the row's key, the replicate's number and a seed alone, by the inverse of the
distribution, so a replicate is the same however rows are dealt, on a rerun, and in any engine. A replicate is then a few
weighted sums, added up within tasks before anything is shuffled: a task sends a row for each replicate and group, not
for each row. Any statistic of sums of columns can be resampled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MASK = (1 << 32) - 1
#: An odd constant of a mixing step of 32 bits, below 2**31 so that products stay within 64 bits.
_MIX = 0x45D9F3B


def poisson_limits() -> list[int]:
    """Weight k is drawn by numbers of 32 bits below the k-th limit and not below the one before."""
    out, term, total = [], math.exp(-1), 0.0
    while True:
        total += term
        limit = math.floor(total * (1 << 32))
        if out and limit <= out[-1]:
            return out
        out.append(limit)
        term /= len(out)


def _mixed(x: Column) -> Column:
    for _ in range(2):
        x = (F.shiftright(x, 16).bitwiseXOR(x) * F.lit(_MIX)).bitwiseAND(F.lit(_MASK))
    return F.shiftright(x, 16).bitwiseXOR(x)


def _half(digest: Column, at: int) -> Column:
    return F.conv(F.substring(digest, at, 8), 16, 10).cast("long")


def replicates(df: DataFrame, key: Column, sums: dict[str, Column], samples: int, seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """(by..., replicate, n, sums...): the weighted number of rows and weighted sums of each replicate; replicate -1 is
    the rows as they are. Null values add nothing."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
    rows = df.select(*by, *[v.cast("double").alias(n) for n, v in sums.items()], digest.alias("_d"))
    rows = rows.select(*by, *sums, _half(F.col("_d"), 1).alias("_h"), _half(F.col("_d"), 9).bitwiseOR(F.lit(1).cast("long")).alias("_step"))
    rows = rows.withColumn("replicate", F.explode(F.sequence(F.lit(-1), F.lit(samples - 1))))
    counter = (F.col("_h") + F.col("replicate") * F.col("_step")).bitwiseAND(F.lit(_MASK))
    rows = rows.withColumn("_u", _mixed(counter))
    weight = F.when(F.col("replicate") < 0, 1)
    for k, limit in enumerate(poisson_limits()):
        weight = weight.when(F.col("_u") < limit, k)
    rows = rows.withColumn("_w", weight.otherwise(len(poisson_limits())))
    return rows.groupBy(*by, "replicate").agg(F.sum("_w").alias("n"), *[F.sum(F.col("_w") * F.col(n)).alias(n) for n in sums])


def bootstrap(df: DataFrame, key: Column, sums: dict[str, Column], statistic: Column, samples: int = 1000, confidence: float = 0.95, seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """(by..., estimate, mean, low, high): a statistic of n and the named sums, of the rows and over replicates, with its
    percentile interval. Replicates in which it is null count for nothing. No rows give one row of nulls, or none by
    groups. key tells rows apart; rows with one key get the same weights."""
    each = replicates(df, key, sums, samples, seed, by).withColumn("_s", statistic.cast("double"))
    tail = (1 - confidence) / 2
    drawn = F.when(F.col("replicate") >= 0, F.col("_s"))
    # as many values for a group as there are replicates
    ends = F.percentile(drawn, F.array(F.lit(tail), F.lit(1 - tail)))
    out = each.groupBy(*by).agg(F.max(F.when(F.col("replicate") < 0, F.col("_s"))).alias("estimate"), F.avg(drawn).alias("mean"), ends.alias("_p"))
    return out.select(*by, "estimate", "mean", F.try_element_at("_p", F.lit(1)).alias("low"), F.try_element_at("_p", F.lit(2)).alias("high"))


def ratio(a: str, b: str) -> Column:
    return F.try_divide(F.col(a), F.col(b))


def bootstrap_lift(pairs: DataFrame, key: str, a: str, b: str, samples: int = 10_000, confidence: float = 0.95, seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """The mean of b - a, with its interval."""
    lift = F.col(b).cast("double") - F.col(a).cast("double")
    return bootstrap(pairs, F.col(key), {"lift": lift}, ratio("lift", "n"), samples, confidence, seed, by)
