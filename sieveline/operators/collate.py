"""Assembly of training batches: labels that ignore the prompt, and batches by a budget of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import loss_mask, padded
from .ranking import scanned

IGNORE = -100


def marker_labels(ids: Column, marker: tuple[int, int], prompt: Column) -> Column:
    """Labels of a row: all up to and with the first marker pair are ignored; without one, as many as the prompt has."""
    pairs = F.zip_with(ids, F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0))), lambda a, b: (a == marker[0]) & (b == marker[1]))
    at = F.array_position(F.transform(pairs, lambda x: F.coalesce(x, F.lit(False))), F.lit(True))
    return loss_mask(ids, F.when(at > 0, at.cast("int") + 1).otherwise(prompt), IGNORE)


def size_class(length: Column) -> Column:
    """The upper end of a length's class: lengths of one class differ by less than an eighth."""
    width = F.pow(F.lit(2), F.greatest(F.length(F.bin(length)) - 4, F.lit(0))).cast("int")
    return (F.ceil(length / width) * width).cast("int")


def token_batches(df: DataFrame, length: str, key: str, budget: int) -> DataFrame:
    """df with batch_class, batch (from 0 within the class) and longest, so that the longest row of a batch times its
    rows is within the budget; a longer row is a batch of its own.

    Rows are ranked by length class and key over ranges of that order; the classes' own totals give each its first rank,
    and a class is dealt to batches of as many rows as its upper end allows. No task sees a class. Rows of null or no
    length belong to no batch and are left out.
    """
    rows = df.where(F.col(length) > 0).withColumn("batch_class", size_class(F.col(length)))
    ranked = scanned(rows, ["batch_class", key], name="_rank")
    # one row for each class, eight to a doubling
    first = ranked.groupBy("batch_class").agg(F.min("_rank").alias("_first"))
    most = F.greatest(F.floor(F.lit(budget) / F.col("batch_class")), F.lit(1))
    rows = ranked.join(F.broadcast(first), "batch_class").withColumn("batch", F.floor((F.col("_rank") - F.col("_first")) / most).cast("long"))
    longest = F.max(length).over(Window.partitionBy("batch_class", "batch"))
    return rows.withColumn("longest", longest).drop("_rank", "_first")


def collated(batches: DataFrame, ids: str, labels: str, pad: int = 0) -> DataFrame:
    """batches with ids and labels filled up to the longest row of the batch: with pad, and with ignored labels."""
    return batches.withColumn(ids, padded(F.col(ids), F.col("longest"), pad)).withColumn(labels, padded(F.col(labels), F.col("longest"), IGNORE))
