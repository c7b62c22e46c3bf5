"""Structured Streaming form of the growing-pool deduplication, and of running success rates.

Two forms: unseen() is the engine's own deduplication, which starts from nothing; unseen_in_pool() holds a state for each
key that starts from an existing pool and takes the first arrival within a batch by a stated order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.text import norm_key


def read_shards(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int | None = 16) -> DataFrame:
    """files_per_trigger None: all files that are there are one batch."""
    reader = spark.readStream.schema(schema)
    return (reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)).json(folder)


def unseen(stream: DataFrame, key: str, event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Rows whose normalised key hasn't come before. With an event time, keys are kept for the delay only, so the state
    is bounded; without one it grows with the number of keys, as the pool does by definition."""
    rows = stream.withColumn("_key", norm_key(F.col(key)))
    if event_time:
        return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["_key"]).drop("_key")
    return rows.dropDuplicates(["_key"]).drop("_key")


class _Pool(StatefulProcessor):
    """Per key: whether it is in the pool. A key's first row goes out."""

    def __init__(self, order: str):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.there = handle.getValueState("there", T.StructType([T.StructField("there", T.BooleanType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known, first = self.there.exists(), None
        for pdf in rows:  # a batch's rows of a key come in pieces; one row of them is kept
            if not known and len(pdf):
                best = pdf if len(pdf) == 1 else pdf.sort_values(self.order, kind="stable").iloc[:1]
                if first is None or best[self.order].iloc[0] < first[self.order].iloc[0]:
                    first = best
        if first is not None:
            self.there.update((True,))
            yield first

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        self.there.update((True,))

    def close(self) -> None:
        pass


def unseen_in_pool(stream: DataFrame, key: str, order: str, pool: DataFrame) -> DataFrame:
    """Rows of stream whose normalised key is neither in pool (a batch table with the column key) nor came before: of a
    batch the first by order, as dedup.normalized_union takes it. The pool is loaded into the state with the first batch;
    a restart from the checkpoint finds it there. Null keys are one key. Keys stay: the state grows with the pool.

    States are keyed by a digest, so texts travel in their rows alone. Sets the state store of the session to the one
    that keeps states on disk.
    """
    from ..functions.text import digest

    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own = F.coalesce(F.hex(digest(norm_key(F.col(key)))), F.lit(""))
    rows = stream.withColumn("_key", own)
    start = pool.select(own.alias("_key")).distinct().groupBy("_key")
    return rows.groupBy("_key").transformWithStateInPandas(_Pool(order), stream.schema, "Append", "None", start)


def running_rates(stream: DataFrame, by: str, success: str = "success") -> DataFrame:
    return stream.groupBy(by).agg(F.count("*").alias("n"), F.avg(F.col(success).cast("double")).alias("rate"))


def append_to(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Process what is there now, append it to a table of Parquet files, and stop."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
