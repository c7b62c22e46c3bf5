"""Importance resampling of documents towards a target, from hashed features in CSR blocks.

The document-by-bucket count matrix is written once, as rows of CSR blocks (row pointers, bucket indexes, counts) of
bounded size. Its column sums, and those of the target's matrix, give the two distributions; what a bucket gains is a
vector of as many numbers as there are buckets. A sparse matrix-vector product of each block with it gives the weights.

Documents are drawn without replacement by their weight and a Gumbel number from a digest of the id. Ranks come from a
range partition: sorted parts are written with each row's place, and parts are counted, so no task sees all rows.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import shuffle_partitions, staged
from .words import Words, slices

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
PART_BYTES = 3 << 20
#: Spans of more bytes go to zlib one by one; shorter ones are taken together, byte by byte.
SHORT = 32
#: A-Z in lower case; every other byte that is no part of a word becomes a space.
_KEPT = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BLOCK = "ids array<long>, words binary, pointers binary, buckets binary, counts binary"


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, np.uint32(0xEDB88320) ^ (t >> np.uint32(1)), t >> np.uint32(1))
    return t


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """zlib.crc32 of each span of data."""
    table, out, size = _crc_table(), np.empty(len(starts), np.uint32), ends - starts
    order = np.argsort(-size, kind="stable")
    first = int(np.searchsorted(-size[order], -SHORT))
    for i in order[:first].tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes())
    order = order[first:]
    at, size, c = starts[order], size[order], np.full(len(order), 0xFFFFFFFF, np.uint32)
    for k in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -k))  # the spans that are longer than k
        c[:n] = table[(c[:n] ^ data[at[:n] + k]) & np.uint32(255)] ^ (c[:n] >> np.uint32(8))
    out[order] = c ^ np.uint32(0xFFFFFFFF)
    return out


def _csr(texts: list[bytes], buckets: int, longest: int) -> tuple[np.ndarray, ...]:
    """(words, pointers, bucket indexes, counts) of some texts."""
    words = Words([t.translate(_KEPT) for t in texts])
    n_words = np.diff(words.first)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), n_words)
    cells = []
    for n in range(1, min(longest, len(words)) + 1):
        i = np.arange(len(words) - n + 1)
        i = i[owner[i] == owner[i + n - 1]]
        bucket = crc32(words.norm, words.starts[i], words.ends[i + n - 1]) % np.uint32(buckets)
        cells.append(owner[i] * buckets + bucket)
    cell, count = np.unique(np.concatenate(cells) if cells else np.zeros(0, np.int64), return_counts=True)
    pointers = np.searchsorted(cell, np.arange(len(texts) + 1, dtype=np.int64) * buckets)
    return n_words, pointers, cell % buckets, count


def _blocks(buckets: int, longest: int):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            for i, j in slices([len(t or b"") for t in texts], PART_BYTES):
                words, pointers, index, count = _csr([t or b"" for t in texts[i:j]], buckets, longest)
                arrays = (words.astype("<u4"), pointers.astype("<u4"), index.astype("<u4"), count.astype("<u4"))
                ids = pa.array([batch.column("id").slice(i, j - i).to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array([a.tobytes()], pa.binary()) for a in arrays]], ["ids", "words", "pointers", "buckets", "counts"])

    return run


def count_matrix(docs: DataFrame, id_column: str = "doc_id", buckets: int = BUCKETS, longest: int = LONGEST, label: str = "matrix") -> DataFrame:
    """The written CSR blocks of docs: ids of the rows, and as packed 32-bit integers each row's number of words, the row
    pointers, the bucket indexes and the counts. Features are all runs of 1 to longest words. Null texts have none."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), "text")
    return staged(rows.mapInArrow(_blocks(buckets, longest), _BLOCK), label)


def _arrays(batch: pa.RecordBatch, *names: str):
    for row in zip(*[batch.column(c) for c in names]):
        yield [np.frombuffer(x.as_py(), "<u4") for x in row]


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket: a vector of fixed size, added up within tasks first."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for index, count in _arrays(batch, "buckets", "counts"):
                total += np.bincount(index, count, minlength=buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    rows = matrix.select("buckets", "counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of the smoothed shares) for each bucket."""
    s_all, t_all, n = float(source.sum()), float(target.sum()), float(len(source))
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weights(matrix: DataFrame, gain: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight) for each row of the matrix: its product with the vector of gains."""

    def run(batches):
        for batch in batches:
            for ids, (words, pointers, index, count) in zip(batch.column("ids"), _arrays(batch, "words", "pointers", "buckets", "counts")):
                count = count.astype(np.int64)
                whole = [np.concatenate(([0], np.cumsum(x)))[pointers] for x in (count, count * gain[index])]
                columns = [pa.array(words.astype(np.int64)), *[pa.array(np.diff(x)) for x in whole]]
                yield pa.RecordBatch.from_arrays([ids.values, *columns], ["id", "n_words", "n_features", "weight"])

    return matrix.mapInArrow(run, "id long, n_words long, n_features long, weight long")


def scored(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """rows (id, weight, ...) with score: weight plus a Gumbel number in thousandths, from a digest of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return rows.withColumn("score", F.col("weight") + gumbel)


def drawn(rows: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """rows (id, n_words, n_features, weight, score) with rank: the places of the highest scores among documents of
    enough words, as many as percent of these, rounded down; null for the others. Ties go to smaller ids, null last."""
    enough = F.col("n_words") >= least_words
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    # numbered, so that rows that are the same in all columns can be split
    some, order = rows.where(enough).withColumn("_tie", F.monotonically_increasing_id()), [*order, F.col("_tie")]
    sorted_parts = some.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order).drop("_tie")
    # the number's upper part is the partition, the lower one the place there; written, so that both are settled
    placed = staged(sorted_parts.withColumn("_at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_at", 33)
    counts = sorted(placed.groupBy(part.alias("part")).count().collect())
    total = sum(n for _, n in counts)
    before, offsets = 0, []
    for p, n in counts:
        offsets.append((p, before))
        before += n
    offsets = rows.sparkSession.createDataFrame(offsets, "_part long, _before long")
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    # one row for each partition of the shuffle
    ranked = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn("rank", F.when(rank <= total * percent // 100, rank))
    rest = rows.where(~enough).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*rest.columns).union(rest)


def resampled(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank for each document, drawn towards the texts of target (column text).

    Null and empty texts have no features and weight 0. A null doc_id is hashed as an empty one and comes last in ties;
    each row counts, also repeated ones. An empty target leaves its smoothed shares equal. Other columns are ignored.
    """
    matrix = count_matrix(docs, "doc_id", buckets, longest)
    aim = count_matrix(target.select(F.lit(None).cast("long").alias("id"), "text"), "id", buckets, longest, "target")
    gain = gains(column_sums(matrix, buckets), column_sums(aim, buckets))
    rows = staged(scored(weights(matrix, gain), seed), "scores")
    return drawn(rows, least_words, percent).select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def sample(docs: DataFrame, target: DataFrame, **parameters) -> DataFrame:
    """The rows of docs that are drawn, with all their columns and their rank as _drawn; of rows that share a doc_id all
    come back, with the best rank, where one of them is drawn."""
    ranks = resampled(docs, target, **parameters).where("rank IS NOT NULL").groupBy("doc_id").agg(F.min("rank").alias("_rank")).select(F.col("doc_id").alias("_id"), "_rank")
    rows = docs.select("doc_id", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return rows.join(ranks, F.col("doc_id").eqNullSafe(F.col("_id"))).select("_row.*", F.col("_rank").alias("_drawn"))
