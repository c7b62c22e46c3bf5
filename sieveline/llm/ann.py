"""Nearest neighbours by cosine with randomly rotated one-bit codes.

Each unit vector o is padded with zeros to CODE_BITS dimensions where it has fewer, rotated by a fixed random orthogonal
matrix and kept as the signs of its coordinates: packed bits, the code c, a unit vector of D entries +-1/sqrt(D), and the
correction <o, c>. For a query q, <c, q> / <o, c> estimates <o, q>; the error is sqrt((1 - <o, c>^2) / <o, c>^2) *
sqrt(1 - <c, q>^2) times a coordinate of a random unit vector in D - 1 dimensions, so below EPSILON / sqrt(D - 1) of that
with high probability (RaBitQ, Gao and Long, 2024).

Codes are built once. Only codes, corrections and queries travel: codes are dealt to blocks of bounded size and queries
to parts of bounded size; each part meets each block (the stated query set against all rows). In a first pass such a
pair yields the best few estimates, whose exact cosines give each query a floor, its k-th best so far. In a second pass
it yields every vector whose upper bound reaches the floor. The vectors of these pairs, and no others, are fetched by a
join and reranked by exact cosine.

Equal vectors are one code with the smallest of their ids, as many as a result can hold, so a vector that very many rows
share costs no more than any other. All rows are indexed; the rotation is not fitted to data. Estimates of a block are
one product of matrices of signs: with numpy that takes less time than counting bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import process_cache, shuffle_partitions, staged

K, EVERY = 5, 50
EPSILON = 3.0
CODE_BITS = 512
BLOCK_ROWS, PART_ROWS, STEP_ROWS = 1 << 16, 1 << 14, 1 << 7
FIRST = 4
SEED = 20

_CODES = "rid long, dim int, only long, code binary, correction double"


def rotation(d: int, bits: int | None = None, seed: int = SEED) -> np.ndarray:
    """The first d rows of a random orthogonal matrix of as many dimensions as codes have bits, the same everywhere."""
    bits = max(CODE_BITS, -(-d // 8) * 8) if bits is None else bits
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r)))[:d]


def _turn(d: int) -> np.ndarray:
    cache = process_cache()
    if ("turn", d, CODE_BITS) not in cache:
        cache["turn", d, CODE_BITS] = rotation(d)
    return cache["turn", d, CODE_BITS]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def codes(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits of the rotated rows of x (unit vectors), and the inner product of each with its code."""
    y = x @ turn
    return np.packbits(y >= 0, axis=1), np.abs(y).sum(axis=1) / np.sqrt(turn.shape[1])


def signs_of(packed: np.ndarray, d: int) -> np.ndarray:
    """Codes as rows of 1 and -1."""
    return np.unpackbits(packed, axis=1, count=d).astype(np.float32) * 2 - 1


def bounds(packed: np.ndarray, correction: np.ndarray, q: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of inner products with the rotated unit queries q (rows), and their error bounds: queries x vectors."""
    return _bounds(signs_of(packed, q.shape[1]), correction, q, epsilon)


def _bounds(signs: np.ndarray, correction: np.ndarray, q: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    d = q.shape[1]
    near = (q.astype(np.float32) @ signs.T) / np.float32(np.sqrt(d))
    spread = np.sqrt(np.maximum(1 - correction**2, 0)) / correction / np.sqrt(max(d - 1, 1))
    # at most 1 for any vector: a bound that always holds, whatever the rotation
    error = np.minimum(epsilon, np.sqrt(max(d - 1, 1))) * spread.astype(np.float32) * np.sqrt(np.maximum(1 - near * near, 0))
    return near / correction.astype(np.float32), error + np.float32(1e-5)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; the same for the same two rows wherever they stand."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _encode(batches):
    """Codes of (rid, dim, only, v); rows arrive sorted by dim."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]
        for a, b in zip(cuts, cuts[1:]):
            part = batch.slice(a, b - a)
            if part.num_rows:
                packed, correction = codes(_unit(_matrix(part.column("v"), b - a)), _turn(int(dims[a])))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("rid", "dim", "only")), pa.array([p.tobytes() for p in packed], pa.binary()), pa.array(correction)], ["rid", "dim", "only", "code", "correction"])


def _scan(left: pa.Table, right: pa.Table, epsilon: float):
    """(query ids, rids, estimates, errors, table of the queries) for some queries at a time against a block of codes;
    estimates of vectors that only the query itself has are -inf."""
    rid = left.column("rid").to_numpy()
    only = left.column("only").fill_null(-1).to_numpy()
    known = left.column("only").is_valid().to_numpy()
    packed = np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint8).reshape(len(rid), -1)
    correction, signs = left.column("correction").to_numpy(), signs_of(packed, packed.shape[1] * 8)
    for at in range(0, right.num_rows, STEP_ROWS):
        part = right.slice(at, STEP_ROWS)
        ids, q = part.column("query_id").to_numpy(), _matrix(part.column("q"), part.num_rows)
        estimate, error = _bounds(signs, correction, _unit(q) @ _turn(q.shape[1]), epsilon)
        estimate[(ids[:, None] == only[None, :]) & known[None, :]] = -np.inf
        yield ids, rid, estimate, error, part


def _pairs(found: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.Table:
    kinds = [np.int64, np.int64, np.float64]
    return pa.table({n: pa.array(np.concatenate([f[k] for f in found]).astype(kind) if found else np.zeros(0, kind)) for k, (n, kind) in enumerate(zip(names, kinds))})


def _first(k: int, epsilon: float):
    """The best few estimates of a block for each query."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            for ids, rid, estimate, _, _ in _scan(left, right, epsilon):
                n = min(FIRST * k, len(rid))
                best = np.argpartition(-estimate, n - 1, axis=1)[:, :n]
                values = np.take_along_axis(estimate, best, axis=1).ravel()
                there = values > -np.inf
                found.append((np.repeat(ids, n)[there], rid[best.ravel()][there], values[there]))
        return _pairs(found, ["query_id", "rid", "estimate"])

    return run


def _reaching(epsilon: float):
    """The vectors of a block whose upper bound reaches the floor of a query."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            for ids, rid, estimate, error, part in _scan(left, right, epsilon):
                floor = part.column("floor").to_numpy()[:, None]
                i, j = np.nonzero((estimate + error >= floor - 1e-9) & (estimate > -np.inf))
                found.append((ids[i], rid[j]))
        return _pairs(found, ["query_id", "rid"])

    return run


def _exact(batches):
    for batch in batches:
        if batch.num_rows:
            score = np.empty(batch.num_rows)
            # vectors of a pair are equally long; lengths may differ from pair to pair
            sizes = np.diff(batch.column("v").offsets.to_numpy())
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                some = batch.take(pa.array(at)) if len(at) < len(sizes) else batch
                score[at] = _cosines(_matrix(some.column("q"), len(at)), _matrix(some.column("v"), len(at)))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("ids"), pa.array(score)], ["query_id", "ids", "score"])


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, v): vectors that are not null, zero or holding null or non-finite components; ids not null."""
    big = float("inf")
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dim"), v.alias("v"))


def _distinct(rows: DataFrame, k: int) -> DataFrame:
    """(rid, dim, v, ids, only): each vector once with its k + 1 smallest ids and how often each occurs (k at most is
    of use); only: the id, where there is but one."""
    counted = rows.groupBy("v", "vec_id").agg(F.count("*").alias("n"), F.first("dim").alias("dim"))
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = counted.withColumn("_place", place).where(F.col("_place") <= k + 1)
    one = few.groupBy("v").agg(F.first("dim").alias("dim"), F.sort_array(F.collect_list(F.struct("vec_id", F.least("n", F.lit(k)).alias("n")))).alias("ids"))
    only = F.when(F.size("ids") == 1, F.col("ids")[0]["vec_id"])
    return staged(one.select(F.monotonically_increasing_id().alias("rid"), "dim", "v", "ids", only.alias("only")), "vectors")


def _reranked(pairs: DataFrame, base: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank): the k best of the pairs (query_id, rid) by exact cosine."""
    both = pairs.select("query_id", "rid").join(base.select("rid", "v", "ids"), "rid").join(queries.select("query_id", "q"), "query_id").select("query_id", "q", "v", "ids")
    scored = both.mapInArrow(_exact, "query_id long, ids array<struct<vec_id:long,n:long>>, score double")
    each = scored.select("query_id", "score", F.explode("ids").alias("i")).where(F.col("i.vec_id") != F.col("query_id"))
    each = each.select("query_id", "score", F.col("i.vec_id").alias("vec_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("i.n"))).alias("_copy"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return each.select("query_id", "vec_id", "score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, epsilon: float = EPSILON, block_rows: int = BLOCK_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose id is divisible by every, its k nearest by cosine.

    Nearest first, ties to the smaller id; all candidates where there are fewer. Rows with the query's own id are not
    candidates. Null ids, and vectors that are null, zero or hold null or non-finite components, take no part; vectors
    of another length are no candidates. Of repeated rows (the same id), each is a candidate; as queries they are one,
    the first by components. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    base = _distinct(rows, k)
    index = staged(base.select("rid", "dim", "only", "v").sortWithinPartitions("dim").mapInArrow(_encode, _CODES), "codes")
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("q"))
    queries = staged(queries.select(F.col("vec_id").alias("query_id"), "q.dim", F.col("q.v").alias("q")), "queries")
    n, n_queries = index.count(), queries.count()
    blocks = max(1, -(-n // block_rows), min(shuffle_partitions(spark), 2 * spark.sparkContext.defaultParallelism))
    parts = max(1, -(-n_queries // part_rows))
    dealt = index.withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def asked(q: DataFrame) -> DataFrame:
        return q.withColumn("part", F.pmod(F.xxhash64("query_id", F.lit(5)), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def scanned(q: DataFrame, f, layout: str) -> DataFrame:
        return dealt.groupBy("dim", "block", "part").cogroup(asked(q).groupBy("dim", "block", "part")).applyInArrow(f, layout)

    first = scanned(queries, _first(k, epsilon), "query_id long, rid long, estimate double")
    leading = Window.partitionBy("query_id").orderBy(F.col("estimate").desc(), "rid")
    first = first.withColumn("_place", F.row_number().over(leading)).where(F.col("_place") <= FIRST * k)
    floors = _reranked(first, base, queries, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    floors = staged(queries.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))), "floors")
    pairs = staged(scanned(floors, _reaching(epsilon), "query_id long, rid long"), "pairs")
    return _reranked(pairs, base, queries, k).select("query_id", "rank", "vec_id", "score")


def exact_nearest(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """The same by brute force, to measure recall on small tables."""
    return nearest(vectors, k, every, epsilon=float("inf"))


def recall(vectors: DataFrame, k: int = K, every: int = EVERY, epsilon: float = EPSILON) -> float:
    """The share of exact neighbours that nearest() finds."""
    exact = staged(exact_nearest(vectors, k, every), "exact")
    found = nearest(vectors, k, every, epsilon).select("query_id", "vec_id")
    n = exact.count()
    return exact.join(found, ["query_id", "vec_id"], "left_semi").count() / n if n else 1.0
