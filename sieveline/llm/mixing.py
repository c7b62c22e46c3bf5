"""Mixing sources to target weights with a low-discrepancy schedule, in DataFrame functions only.

1. Sources get targets: shares of all words by weight, none above twice the source's size (the excess is shared again).
2. The documents of a source, in hashed order, are one stream of words, cut into blocks of equal length. A document's
   place is a distributed running total: totals of small chunks first, then places within each chunk. Equal rows are
   counted first and stand as one.
3. Targets are laid end to end in units of blocks, and the line is filled up to a power of two. Slot i goes where the
   van der Corput point of i falls on it, and to the source that lies there; points beyond the targets are idle. So
   many points visit each place once: a source has the slots of its share, in any stretch about as many as that.
   Slots are ranked within each source (again by chunks), and slot r of a source takes block r modulo the number of its
   blocks. The last slot of a source stops at its target, to the word.
4. Slots join blocks, and a document's taken words are summed, with the first and last slot that takes some.

No step gathers a source: running totals work on chunks of at most a few thousand rows, also for a source that holds a
third of all rows. Only tables of totals are sorted as a whole: one row for each source, and of a source one for each
CHUNK documents or slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import packed, shuffle_partitions, staged, unpacked

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2
BLOCK_WORDS = 256
CHUNK = 4096
CELLS = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def running_totals(df: DataFrame, key: str, chunk: Column, order: list, value: Column, name: str) -> DataFrame:
    """df with the sum of value over the rows of key that come before, by (chunk, order). Rows of a chunk should be few."""
    df = df.withColumn("_chunk", chunk)
    sums = df.groupBy(key, "_chunk").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(key, "_chunk", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(key, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return df.join(sums, [key, "_chunk"]).withColumn(name, F.col("_before") + F.col("_within")).drop("_chunk", "_before", "_within")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes (source, source_size, ...) with ord (place by code point, null last), weight and target.

    target = min(most * size, level * weight) with the level at which targets add up to share of all sizes: where
    sharing the excess again by weight ends.
    """
    all_sources = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("ord", F.row_number().over(all_sources))
    w = F.array(*[F.lit(float(x)) for x in weights])
    s = s.withColumn("weight", F.element_at(w, ((F.col("ord") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("_cap", most * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("_cap") / F.col("weight"), "ord")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = share * F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = F.try_divide(left, F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    s = s.withColumn("_level", level)
    # sources in order of cap / weight: the first whose cap is above the level, and all after it, share by weight
    first = F.min(F.when(F.col("_cap") >= F.col("_level") * F.col("weight"), F.struct(F.col("_cap") / F.col("weight"), "ord", "_level"))).over(Window.partitionBy())
    s = s.withColumn("_level", first["_level"])
    return s.withColumn("target", F.least("_cap", F.coalesce(F.col("_level") * F.col("weight"), F.col("_cap")))).drop("_cap", "_level")


def van_der_corput(i: Column, bits: int) -> Column:
    """The radical inverse of i in base 2, times 2**bits: the lowest bits of i in reverse order. 1 <= bits <= 63."""
    x = i.cast("long")
    for n, ones in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        mask = F.lit(ones)
        x = F.shiftleft(x.bitwiseAND(mask), n).bitwiseOR(F.shiftrightunsigned(x, n).bitwiseAND(mask))
    x = F.shiftleft(x, 32).bitwiseOR(F.shiftrightunsigned(x, 32))
    return F.shiftrightunsigned(x, 64 - bits)


def mix_plan(rows: DataFrame, block_words: int = BLOCK_WORDS, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, places, mix) for rows (id columns, source, size, copies, hash), which should be cheap to read again and
    differ in their id columns or hash.

    hash: hexadecimal digits. sources: source, ord, weight, source_size, target. places: rows with ord and begin, the
    place in the source's stream. mix: ord, slot (place in the schedule), rank, block, start, stop (words of the stream
    that the slot takes).
    """
    spark = rows.sparkSession
    words = F.col("size") * F.col("copies")
    sizes = rows.groupBy("source").agg(F.sum(words).alias("source_size"), F.count("*").alias("n_rows"))
    s = targets(sizes, weights, share, most)
    goal = F.round("target").cast("long")
    s = s.withColumn("n_blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
    passes = F.coalesce(F.floor(F.try_divide(goal, F.col("source_size"))).cast("long"), F.lit(0))
    s = s.withColumn("goal", goal).withColumn("passes", passes)
    rest = F.ceil((F.col("goal") - F.col("passes") * F.col("source_size")) / block_words).cast("long")
    s = s.withColumn("n_slots", F.col("passes") * F.col("n_blocks") + rest)
    upto = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = staged(s.withColumn("high", F.sum("n_slots").over(upto)), "sources")
    total, n_sources = s.agg(F.coalesce(F.sum("n_slots"), F.lit(0)), F.count("*")).first()

    # where documents lie in their source's stream; chunks follow the order of the hash
    placed = rows.join(s.select(F.col("source").alias("_source"), "ord", "n_rows"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    chunks = F.ceil(F.col("n_rows") / CHUNK).cast("long")
    chunk = F.shiftright(F.conv(F.substring("hash", 1, 8), 16, 10).cast("long") * chunks, 32)
    order = ["hash", *[c for c in rows.columns if c not in ("hash", "source")]]
    places = running_totals(placed, "ord", chunk, order, words, "begin").drop("n_rows")

    # the schedule
    bits = max(1, (total - 1).bit_length()) if total else 0
    slots = spark.range(1 << bits if total else 0).withColumnRenamed("id", "slot").withColumn("at", van_der_corput(F.col("slot"), bits or 1))
    width = max(1, total // max(CELLS, 4 * n_sources))
    low = F.col("high") - F.col("n_slots")
    cells = s.where("n_slots > 0").select("ord", low.alias("low"), "high", F.explode(F.sequence(F.floor(low / width), F.floor((F.col("high") - 1) / width))).alias("cell"))
    slots = slots.where(F.col("at") < total).withColumn("cell", F.floor(F.col("at") / width)).join(cells, "cell").where("at >= low AND at < high").select("slot", "ord")
    slots = running_totals(slots, "ord", F.floor(F.col("slot") / CHUNK), ["slot"], F.lit(1), "rank")
    slots = slots.join(s.select("ord", "n_blocks", "source_size", "goal"), "ord")
    block = F.col("rank") % F.col("n_blocks")
    begin = F.floor(F.col("rank") / F.col("n_blocks")) * F.col("source_size") + block * block_words
    start = block * block_words
    stop = F.least(start + block_words, F.col("source_size"), start + F.col("goal") - begin)
    mix = slots.select("ord", "slot", "rank", block.alias("block"), start.alias("start"), stop.alias("stop")).where("stop > start")
    return s.select("source", "ord", "weight", "source_size", "target"), places, mix


def taken_words(rows: DataFrame, block_words: int = BLOCK_WORDS, **shares) -> DataFrame:
    """rows with source_size, target, taken (how many of the words of all its copies the mix takes, repeats counted),
    first_slot and last_slot (of those that take some; null if none does)."""
    sources, places, mix = mix_plan(rows, block_words, **shares)
    places = staged(places, "places")
    ids = places.columns
    end = F.col("begin") + F.col("size") * F.col("copies")
    blocks = places.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / block_words), F.floor((end - 1) / block_words))))
    # a block that no slot takes has no stop; least() would skip that null
    both = F.coalesce(F.when(F.col("stop").isNotNull(), F.greatest(F.least("stop", end) - F.greatest("start", "begin"), F.lit(0))), F.lit(0))
    used = F.when(both > 0, F.col("slot"))
    taken = blocks.join(mix, ["ord", "block"], "left").groupBy(*ids).agg(F.sum(both).cast("long").alias("taken"), F.min(used).alias("first_slot"), F.max(used).alias("last_slot"))
    none = F.lit(None).cast("long")
    taken = taken.unionByName(places.where("size = 0").withColumns({"taken": F.lit(0).cast("long"), "first_slot": none, "last_slot": none}))
    return taken.join(sources.select("ord", "source_size", "target"), "ord").drop("ord", "begin")


def _hash(text: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, hash, copies, part): one row for each CHUNK equal rows, numbered by part."""
    one = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _hash(F.col("text"), F.col("doc_id")).alias("hash"))
    equal = one.groupBy("doc_id", "source", "size", "hash").agg(F.count("*").alias("n"))
    parts = equal.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))))
    return staged(parts.withColumn("copies", F.least(F.lit(CHUNK), F.col("n") - F.col("part") * CHUNK).cast("long")).drop("n"), "sizes")


def source_mix(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """For each row: doc_id, size, source_size, target, taken (words), first_slot, last_slot (of the schedule; null
    where nothing is taken).

    Sources by code point, null last, weigh WEIGHTS in turn. Null and empty texts have size 0 and take nothing. A source
    without words has target 0. Null doc_ids are rows like others; rows equal in doc_id, source and text share their
    taken words evenly (the first ones take a word more where that leaves a rest) and their slots. Other columns are
    ignored. Taken words of a source add up to its target, rounded; no row exceeds MOST times its size. Reruns agree.
    """
    taken = taken_words(_rows(docs), block_words)
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    share = F.floor(F.col("taken") / F.col("copies")) + (F.col("_copy") <= F.col("taken") % F.col("copies")).cast("long")
    return taken.withColumn("_copy", each).withColumn("taken", share).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "last_slot")


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs as the mix uses them, in order of the schedule: each row as often as its taken words hold it, to the nearest
    whole number (0 to 2), the first time where its first slot stands and the second where its last one does.

    All columns stay. Rows without words go. Rows equal in doc_id, source and text share their taken words. Partitions
    hold consecutive stretches of the schedule, in order, so written files are in order of their names.
    """
    taken = taken_words(_rows(docs), block_words).where("size > 0")
    counts = taken.groupBy("doc_id", "source", "hash").agg(F.sum("taken").alias("taken"), F.sum(F.col("size") * F.col("copies")).alias("size"), F.min("first_slot").alias("first"), F.max("last_slot").alias("last"))
    times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    counts = staged(counts.select(F.col("hash").alias("_hash"), F.col("source").alias("_source"), F.col("doc_id").alias("_id"), times.alias("_times"), "first", "last").where("_times > 0"), "counts")
    span = (counts.agg(F.max("last")).first()[0] or 0) + 1
    # hashed first: a join on the expression would shuffle the text beside the row that holds it
    rows = packed(docs, "doc_id", "text", "source").select(_hash(F.col("text"), F.col("doc_id")).alias("_own"), "doc_id", "source", "_row")
    on = (F.col("_own") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source"))
    rows = rows.join(counts, on)
    slots = F.when(F.col("_times") == 1, F.array("first")).otherwise(F.array("first", "last"))
    rows = rows.select("_row", "_hash", F.explode(slots).alias("_slot"))
    # slots are spread evenly, so equal stretches of the schedule are even partitions: no sample of the texts is needed
    parts = shuffle_partitions(docs.sparkSession)
    rows = rows.repartitionById(parts, F.floor(F.col("_slot") * parts / span).cast("int")).sortWithinPartitions("_slot", "_hash")
    return unpacked(rows)
