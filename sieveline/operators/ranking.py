"""Global ranks without one task that sees all rows, and what follows from them.

Ranks and running totals over one order are a scan of several levels: rows are dealt to ranges of the order and sorted
there, and written with their range and place; totals of ranges are added up over the ranges, of which there are as many
as partitions of a shuffle; a row's value is its own within the range and what the ranges before add up to. Ranges are
cut by the rows themselves, so it makes no difference how ids are spread.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import kept

PART, PLACE = "_part", "_place"
# Primes; the first that doesn't divide a number steps through all places below it.
STEPS = (999_999_937, 999_999_929, 999_999_893)


def in_ranges(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """df in sorted ranges of the order, written, with the number of the range and the place in it (both from 0). Rows
    that are equal in the order can be split over ranges."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = df.withColumn("_tie", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(parts, *keys, F.col("_tie")).sortWithinPartitions(*keys, F.col("_tie")).drop("_tie")
    # an id's upper part is the number of the partition, the lower one the place there
    rows = kept(rows.withColumn("_at", F.monotonically_increasing_id()), "ranges")
    return rows.withColumn(PART, F.shiftright("_at", 33)).withColumn(PLACE, F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at")


def scanned(df: DataFrame, order: Sequence[Column | str], sums: dict[str, Column] | None = None, name: str = "rank") -> DataFrame:
    """df with its place (from 1) in the order and, for each of sums, the total of its values up to and with the row."""
    sums = sums or {}
    rows = in_ranges(df.withColumns(sums), order)
    totals = rows.groupBy(PART).agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_t{i}") for i, c in enumerate(sums)])
    # one row for each range
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(PART, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in totals.columns[1:]])
    so_far = Window.partitionBy(PART).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(F.broadcast(totals), PART).withColumn(name, F.col("_n_before") + F.col(PLACE) + 1)
    rows = rows.withColumns({c: F.col(f"_t{i}_before") + F.coalesce(F.sum(c).over(so_far), F.lit(0)) for i, c in enumerate(sums)})
    return rows.drop(PART, PLACE, "_n_before", *[f"_t{i}_before" for i in range(len(sums))])


def ranked(df: DataFrame, bucket: Column, order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """df with its place (from 1) in the order (bucket, order). Buckets are ranked alone and shifted by the counts of
    those before, so only bucket counts meet in one task."""
    df = df.withColumn("_bucket", bucket)
    counts = df.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    return df.withColumn("_within", within).join(counts, "_bucket").withColumn(name, F.col("_before") + F.col("_within")).drop("_bucket", "_before", "_within")


def by_id(df: DataFrame, key: str, name: str = "rank", width: int | None = None) -> DataFrame:
    """Ranked by an id of any kind, however its values are spread. width isn't used: ranges are cut by the rows."""
    return scanned(df, [key], name=name)


def draw_key(key: Column, seed: int) -> Column:
    """A fixed random order of keys: the same for the same seed, in any engine that has md5."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def shuffled(df: DataFrame, key: str, seed: int = 42, name: str = "rank") -> DataFrame:
    """Ranked in the random order of draw_key, in 4096 buckets by the first digits of the hash."""
    df = df.withColumn("_draw", draw_key(F.col(key), seed))
    return ranked(df, F.substring("_draw", 1, 3), ["_draw", key], name).drop("_draw")


def train_test_split(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """df with split: the first floor(n * share) rows in random order are test. Sizes are exact."""
    n = df.agg(F.count("*").alias("_n"))
    out = shuffled(df, key, seed, "_rank").crossJoin(F.broadcast(n))
    return out.withColumn("split", F.when(F.col("_rank") <= F.floor(F.col("_n") * test_share), "test").otherwise("train")).drop("_rank", "_n")


def sample(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """k rows drawn without replacement: the top k of the random order."""
    return df.orderBy(draw_key(F.col(key), seed), key).limit(k)


def round_robin(df: DataFrame, key: str, kinds: Sequence[str]) -> DataFrame:
    """df with kind: kinds in turn over the rows by key."""
    return by_id(df, key, "_rank").withColumn("kind", F.element_at(F.array(*[F.lit(k) for k in kinds]), ((F.col("_rank") - 1) % len(kinds) + 1).cast("int"))).drop("_rank")


def balanced_slices(df: DataFrame, key: str, slices: int) -> DataFrame:
    """df with slice (from 0): contiguous by key, the first n mod slices of them one row longer."""
    n = df.agg(F.count("*").alias("_n"))
    out = by_id(df, key, "_rank").crossJoin(F.broadcast(n))
    size, more, at = F.floor(F.col("_n") / slices), F.col("_n") % slices, F.col("_rank") - 1
    long = more * (size + 1)
    place = F.when(at < long, F.floor(at / (size + 1))).otherwise(more + F.floor((at - long) / F.greatest(size, F.lit(1))))
    return out.withColumn("slice", place.cast("int")).drop("_rank", "_n")


def first_of_each(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """The first k rows of each group: Spark keeps k rows of a group in each task before it shuffles them."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")


def stratified_sample(df: DataFrame, group: str, key: str, k: int, seed: int = 42) -> DataFrame:
    return first_of_each(df.withColumn("_draw", draw_key(F.col(key), seed)), [group], ["_draw", key], k).drop("_draw")


def quotas(total: int, kinds: Sequence[str]) -> dict[str, int]:
    """Equal shares of total; the first kinds get the remainder."""
    size, more = divmod(total, len(kinds))
    return {k: size + (i < more) for i, k in enumerate(kinds)}


def weighted_quotas(total: int, weights: dict[str, float]) -> dict[str, int]:
    """Shares by weight, rounded down; the largest remainders get the rest."""
    whole = sum(weights.values())
    exact = {k: total * w / whole for k, w in weights.items()}
    out = {k: int(x) for k, x in exact.items()}
    for k in sorted(exact, key=lambda k: (out[k] - exact[k], k))[: total - sum(out.values())]:
        out[k] += 1
    return out


def take_quotas(df: DataFrame, group: str, order: Sequence[Column | str], shares: dict[str, int]) -> DataFrame:
    """Of each group its quota of first rows; groups without one are left out."""
    quota = F.create_map(*[x for k, n in shares.items() for x in (F.lit(k), F.lit(n))])
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.where(F.col(group).isin(*shares)).withColumn("_rank", rank).where(F.col("_rank") <= F.try_element_at(quota, F.col(group))).drop("_rank")


def unit_draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the hash of a key."""
    return F.conv(F.substring(draw_key(key, seed), 1, 8), 16, 10).cast("double") / float(1 << 32)


def weighted_draw(key: Column, shares: dict[str, float], seed: int = 42) -> Column:
    """One of the names, by cumulative share."""
    u, at, chain = unit_draw(key, seed), 0.0, None
    names = list(shares)
    for name in names[:-1]:
        at += shares[name]
        chain = F.when(u < at, name) if chain is None else chain.when(u < at, name)
    return F.lit(names[-1]) if chain is None else chain.otherwise(names[-1])


def distinct_draws(key: Column, names: Sequence[str], k: Column | int, seed: int = 42) -> Column:
    """k different names in random order (all of them if k is larger): sorted by the hash of key and name."""
    drawn = F.array(*[F.struct(draw_key(F.concat_ws("|", key.cast("string"), F.lit(n)), seed).alias("h"), F.lit(n).alias("n")) for n in names])
    return F.slice(F.transform(F.array_sort(drawn), lambda s: s["n"]), 1, k)


def progress(df: DataFrame, key: str, value: Column, every: int = 50) -> DataFrame:
    """(rank, rate): the mean of value over the rows so far, at each every-th row."""
    rows = scanned(df.select(key, value.cast("double").alias("_v")), [key], {"_sum": F.col("_v"), "_count": F.col("_v").isNotNull().cast("long")})
    return rows.where(F.col("rank") % every == 0).select("rank", F.try_divide(F.col("_sum"), F.col("_count")).alias("rate"))


def sorted_output(df: DataFrame, *keys: str) -> DataFrame:
    """df in order of keys, nulls last: a range-partitioned sort, each partition before the next."""
    return df.orderBy(*[F.col(k).asc_nulls_last() for k in keys])
