"""Exact deduplication with a defined survivor, and reports on duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import digest, norm_key, preview
from ..sources.files import kept


def _key(df: DataFrame, key: Column) -> Column:
    return digest(key) if isinstance(df.select(key).schema[0].dataType, T.StringType) else key


def keep_first(df: DataFrame, key: Column, order: Sequence[str]) -> DataFrame:
    """The first row, by order, of each key. Rows are reduced to one for each key and task before the shuffle: min_by
    over the order is a partial aggregate, unlike a window, so a hot key doesn't gather in one task. Keys of text are
    grouped by their digests: a text travels in its row alone."""
    row, at = F.struct(*[F.col(c) for c in df.columns]), F.struct(*[F.col(c) for c in order])
    return df.groupBy(_key(df, key).alias("_key")).agg(F.min_by(row, at).alias("_row")).select("_row.*")


def normalized_union(existing: DataFrame, new: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Rows of both with distinct normalised keys; existing rows come first. Adds source_rank (0: existing)."""
    both = existing.withColumn("source_rank", F.lit(0)).unionByName(new.withColumn("source_rank", F.lit(1)))
    return keep_first(both, norm_key(F.col(key)), ["source_rank", *order])


def new_unique(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(n_new_unique): distinct normalised keys of new that existing lacks."""
    keys = lambda df: df.select(digest(norm_key(F.col(key))).alias("k")).distinct()
    return keys(new).join(keys(existing), "k", "left_anti").agg(F.count("*").alias("n_new_unique"))


def duplication_report(df: DataFrame, key: str) -> DataFrame:
    """(total, n_unique, duplication_rate); the rate is null for no rows. Counted from one row for each distinct key."""
    per_key = df.groupBy(_key(df, F.col(key)).alias("_key")).agg(F.count("*").alias("n"))
    out = per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("n_unique"))
    return out.withColumn("duplication_rate", 1 - F.try_divide(F.col("n_unique").cast("double"), F.col("total")))


def top_duplicates(df: DataFrame, key: str, order: str, k: int = 5, chars: int = 60) -> DataFrame:
    """The k most frequent keys that occur more than once: (preview, n). Ties: the earlier first occurrence."""
    rows = df.select(_key(df, F.col(key)).alias("_key"), preview(F.col(key), chars).alias("preview"), F.col(order).alias("_at"))
    counts = rows.groupBy("_key").agg(F.count("*").alias("n"), F.min("_at").alias("first"), F.first("preview").alias("preview")).where("n > 1")
    return counts.orderBy(F.col("n").desc(), "first").limit(k).select("preview", "n", "first")


def cap_repeats(df: DataFrame, key: str, order: Sequence[str], cap: int) -> DataFrame:
    """At most cap rows of each key, the first by order."""
    rows = df.withColumn("_key", _key(df, F.col(key)))
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_key").orderBy(*order))).where(F.col("_rank") <= cap).drop("_rank", "_key")


def merge_analysis(existing: DataFrame, new: DataFrame, key: str, target: int) -> DataFrame:
    """One row on a merge: counts, duplication of the new rows, and whether the target is met. Texts are read once, for
    digests of the key and of its normal form; the rest is counted from these."""
    k = F.col(key)
    sides = [df.select(digest(norm_key(k)).alias("norm"), _key(df, k).alias("exact"), F.lit(n).alias("new")) for df, n in ((existing, 0), (new, 1))]
    rows = kept(sides[0].unionByName(sides[1]), "digests")
    out = rows.agg(F.count_if(F.col("new") == 0).alias("n_existing"), F.count_if(F.col("new") == 1).alias("n_new"))
    distinct = rows.where("new = 1").groupBy("exact").agg(F.lit(1).alias("one")).agg(F.count("*").alias("n_new_distinct"))
    keys = rows.groupBy("norm").agg(F.min("new").alias("least"))
    # nulls are no key: they add nothing to the distinct ones of the merge, and count as new
    keys = keys.agg(F.count_if(F.col("least") == 1).alias("n_new_unique"), F.count("norm").alias("n_merged_unique"))
    out = out.crossJoin(distinct).crossJoin(keys).withColumn("new_duplication_rate", 1 - F.try_divide(F.col("n_new_distinct").cast("double"), F.col("n_new")))
    out = out.select("n_existing", "n_new", "n_new_distinct", "new_duplication_rate", "n_new_unique", "n_merged_unique")
    return out.withColumn("target_met", F.col("n_merged_unique") >= target).withColumn("n_missing", F.greatest(F.lit(0), F.lit(target) - F.col("n_merged_unique")))


def pool_split(df: DataFrame, key: str, train_share: float = 0.8, seed: int = 42) -> DataFrame:
    """df with pool (train or eval) by the hash of the normalised key: equal keys share a pool, so pools are disjoint."""
    from .ranking import unit_draw

    return df.withColumn("pool", F.when(unit_draw(norm_key(F.col(key)), seed) < train_share, "train").otherwise("eval"))


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of ids that occur again."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def content_fingerprint(df: DataFrame, key: str) -> DataFrame:
    """(fingerprint, n): a digest of the set of keys, whatever their order: the hash of the sorted hashes of 256 parts,
    each the hash of its sorted keys' hashes, so no task holds them all."""
    hashed = df.select(F.md5(F.col(key)).alias("h")).distinct()
    parts = hashed.groupBy(F.substring("h", 1, 4).alias("p")).agg(F.md5(F.concat_ws("", F.sort_array(F.collect_list("h")))).alias("d"), F.count("*").alias("n"))
    parts = parts.groupBy(F.substring("p", 1, 2).alias("p")).agg(F.md5(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("p", "d"))), lambda s: s["d"]))).alias("d"), F.sum("n").alias("n"))
    return parts.agg(F.md5(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("p", "d"))), lambda s: s["d"]))).alias("fingerprint"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
