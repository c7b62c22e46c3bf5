"""Vector codes of one byte a part, with codebooks from weighted Lloyd rounds over distinct integer parts.

Components become integers, vectors are cut into equal parts, and each part position has its own codebook. Equal parts of
a position are one row with a weight, so a part that very many vectors share costs one distance, and its weight stands
for them in the sums. A round assigns the distinct parts in tasks; each task adds up what falls to an entry before
anything is shuffled, so the driver sees the sums of PARTS * ENTRIES entries and nothing else. After the last round the
distinct parts get their codes and errors, which are joined back to the vectors.

Parts travel as packed integers of the least of two, four or eight bytes that holds all of a part, so that equal parts
are equal bytes. Sums and distances are exact: products of matrices in doubles while all values stay below 2**53, and
Python's integers beyond.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
STEP_ROWS = 1 << 12
EXACT = 1 << 53
MOST = (1 << 63) - 1
_ROW = "rid long, vec_id long, label int, dim int, parts array<binary>"


@dataclass(frozen=True)
class Codebooks:
    """For each length of vectors, integers [part, entry, component]."""

    books: dict[int, np.ndarray]

    def digest(self, dim: int) -> str:
        """SHA-256 of all components of a length's codebooks, by part, entry and place, with commas between."""
        return hashlib.sha256(",".join(map(str, self.books[dim].ravel().tolist())).encode()).hexdigest()


def _pack(x: np.ndarray) -> bytes:
    least, most = (int(x.min()), int(x.max())) if x.size else (0, 0)
    return x.astype(next((k for k in ("<i2", "<i4") if np.iinfo(k).min <= least and most <= np.iinfo(k).max), "<i8")).tobytes()


def _unpack(values: list[bytes], d: int) -> np.ndarray:
    """The integers of packed parts of d components, one row each."""
    out = np.empty((len(values), d), np.int64)
    if d:
        width = np.array([len(v) // d for v in values])
        for w in np.unique(width).tolist():
            at = np.flatnonzero(width == w)
            out[at] = np.frombuffer(b"".join(values[i] for i in at), f"<i{w}").reshape(-1, d)
    return out


def _part_size(dim: int, parts: int) -> int:
    return -(-dim // parts)


def _split(parts: int):
    def run(batches):
        for batch in batches:
            out = []
            for v in batch.column("v"):
                x = np.array(v.as_py(), np.int64)
                d = _part_size(len(x), parts)
                padded = np.zeros(d * parts, np.int64)
                padded[: len(x)] = x
                out.append([_pack(padded[k * d : k * d + d]) for k in range(parts)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rid", "vec_id", "label", "dim")), pa.array(out, pa.list_(pa.binary()))], ["rid", "vec_id", "label", "dim", "parts"])

    return run


def integer_parts(vectors: DataFrame, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """(rid, vec_id, label, dim, parts): the usable vectors, as packed integers floor(scale * x) cut into equal parts.

    Vectors that are null or hold null or non-finite components are dropped. Integers beyond 64 bits become the nearest
    bound. A length that parts doesn't divide is filled up with zeros. Other columns of vectors are ignored."""
    big = float("inf")
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big))
    rows = vectors.where(F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)))
    ints = F.transform(v, lambda x: F.floor(x * scale))
    rows = rows.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.size("embedding").alias("dim"), ints.alias("v"))
    return staged(rows.mapInArrow(_split(parts), _ROW), "vectors")


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entry of book nearest to each row of x (the lowest of equals), and the squared distances, as integers."""
    codes, errors = np.empty(len(x), np.int64), np.empty(len(x), object)
    most = max((int(np.abs(a.astype(float)).max()) for a in (x, book) if a.size), default=0)
    exact = x.shape[1] * (2 * most) ** 2 < EXACT
    step = STEP_ROWS if exact else max(1, (1 << 16) // max(book.size, 1))
    if exact:
        turned = book.T.astype(float)
        length = (turned * turned).sum(axis=0)
    for i in range(0, len(x), step):
        some = x[i : i + step]
        if exact:
            some = some.astype(float)
            far = length[None, :] - 2 * (some @ turned) + (some * some).sum(axis=1)[:, None]
        else:
            far = ((some[:, None, :].astype(object) - book[None, :, :].astype(object)) ** 2).sum(axis=2)
        best = np.array([row.index(min(row)) for row in far.tolist()]) if far.dtype == object else far.argmin(axis=1)
        codes[i : i + step] = best
        errors[i : i + step] = [int(e) for e in far[np.arange(len(some)), best].tolist()]
    return codes, errors


def _groups(batch: pa.RecordBatch):
    """(dim, position, indexes) of the rows of a batch."""
    dims, positions = batch.column("dim").to_numpy(), batch.column("position").to_numpy()
    for dim, position in sorted(set(zip(dims.tolist(), positions.tolist()))):
        yield dim, position, np.flatnonzero((dims == dim) & (positions == position))


def _sums(books: dict[int, np.ndarray]):
    """What falls to each entry within a task: the sum of its parts, by component, in two halves that add up apart."""
    low = (1 << 32) - 1

    def run(batches):
        total: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for dim, position, at in _groups(batch):
                book = books[dim][position]
                x = _unpack(batch.column("part").take(pa.array(at)).to_pylist(), book.shape[1])
                weight = batch.column("weight").to_numpy()[at]
                codes, _ = nearest(x, book)
                size, counts = total.setdefault((dim, position), (np.zeros(book.shape, object), np.zeros(len(book), np.int64)))
                np.add.at(counts, codes, weight)
                most = int(np.abs(x.astype(float)).max()) if x.size else 0
                if most * int(weight.sum()) < EXACT:
                    part = np.stack([np.bincount(codes, x[:, j] * weight, minlength=len(book)) for j in range(x.shape[1])], axis=1) if x.shape[1] else np.zeros(book.shape)
                    size += part.astype(np.int64).astype(object)
                else:
                    np.add.at(size, codes, x.astype(object) * weight.astype(object)[:, None])
        rows = [(d, p, e, j, int(n[e]), int(s[e, j]) >> 32, int(s[e, j]) & low) for (d, p), (s, n) in total.items() for e in np.flatnonzero(n).tolist() for j in range(s.shape[1])]
        names = ["dim", "position", "entry", "place", "n", "high", "low"]
        kinds = [pa.int32()] * 4 + [pa.int64()] * 3
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def _assigned(books: dict[int, np.ndarray]):
    def run(batches):
        for batch in batches:
            codes, errors = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, object)
            for dim, position, at in _groups(batch):
                book = books[dim][position]
                codes[at], errors[at] = nearest(_unpack(batch.column("part").take(pa.array(at)).to_pylist(), book.shape[1]), book)
            columns = [*(batch.column(c) for c in ("dim", "position", "part")), pa.array(codes.astype(np.int32)), pa.array([min(e, MOST) for e in errors.tolist()], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["dim", "position", "part", "code", "error"])

    return run


def _first_books(rows: DataFrame, parts: int, entries: int) -> dict[int, np.ndarray]:
    """Of each length, the parts of the vectors with the least ids (null last; of equal ids, by their bytes)."""
    order = Window.partitionBy("dim").orderBy(F.col("vec_id").asc_nulls_last(), "parts")
    first = rows.select("dim", "vec_id", "parts").withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= entries)
    books: dict[int, list] = {}
    for r in first.orderBy("dim", "_place").collect():
        books.setdefault(r.dim, []).append([bytes(p) for p in r.parts])
    return {dim: np.stack([_unpack([v[k] for v in some], _part_size(dim, parts)) for k in range(parts)]) for dim, some in books.items()}


def distinct_parts(rows: DataFrame) -> DataFrame:
    """(dim, position, part, weight) of integer_parts rows."""
    each = rows.select("dim", F.posexplode("parts").alias("position", "part"))
    return staged(each.groupBy("dim", "position", "part").agg(F.count("*").alias("weight")), "distinct")


def train(rows: DataFrame, distinct: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of each length of vectors after so many rounds of weighted Lloyd; unused entries stay as they are."""
    books = _first_books(rows, parts, entries)
    for _ in range(rounds):
        sums = distinct.mapInArrow(_sums(books), "dim int, position int, entry int, place int, n long, high long, low long")
        sums = sums.groupBy("dim", "position", "entry", "place").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")])
        books = {dim: b.copy() for dim, b in books.items()}
        for r in sums.collect():
            books[r.dim][r.position, r.entry, r.place] = ((r.high << 32) + r.low) // r.n
    return Codebooks(books)


def encode(rows: DataFrame, distinct: DataFrame, codebooks: Codebooks) -> DataFrame:
    """(rid, vec_id, label, dim, codes, error) of integer_parts rows: codes in the order of the parts."""
    # both sides are plain shuffles of written tables: a part that very many vectors share can be split
    found = staged(distinct.select("dim", "position", "part").mapInArrow(_assigned(codebooks.books), "dim int, position int, part binary, code int, error long"), "assigned")
    each = rows.select("rid", "dim", F.posexplode("parts").alias("position", "part"))
    each = each.join(found, ["dim", "position", "part"]).select("rid", "position", "code", F.col("error").cast("decimal(20,0)").alias("error"))
    whole = each.groupBy("rid").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "code"))), lambda x: x["code"]).alias("codes"), F.sum("error").alias("error"))
    error = F.least(F.col("error"), F.lit(MOST).cast("decimal(20,0)")).cast("long")
    return rows.select("rid", "vec_id", "label", "dim").join(whole.select("rid", "codes", error.alias("error")), "rid")


def decode(coded: DataFrame, codebooks: Codebooks, scale: int = SCALE) -> DataFrame:
    """coded with a column vector: the entries that its codes name, divided by scale."""
    books, kind = codebooks.books, pa.list_(pa.float64())

    def run(batches):
        for batch in batches:
            out = []
            for dim, codes in zip(batch.column("dim").to_pylist(), batch.column("codes").to_pylist()):
                out.append((np.concatenate([books[dim][k][c] for k, c in enumerate(codes)])[:dim] / scale).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], [*batch.schema.names, "vector"])

    layout = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema.fields)
    return coded.mapInArrow(run, f"{layout}, vector array<double>")


def with_label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error: errors summed over rows of equal labels, null ones together."""
    total = F.sum(F.col("error").cast("decimal(20,0)"))
    sums = coded.groupBy("label").agg(total.alias("_total")).select(F.col("label").alias("_label"), F.least(F.col("_total"), F.lit(MOST).cast("decimal(30,0)")).cast("long").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """The coded vectors (rid, vec_id, label, dim, codes, error) and their codebooks.

    Vectors that are null or hold null or non-finite components are dropped; of none, nothing is left. Each row counts,
    also repeated ones and those with a null id. Codebooks start from the least ids (null last, equal ids by content)
    and have fewer entries where there are fewer vectors. Vectors of different lengths have codebooks of their own.
    Distances of 2**63 and more are given as 2**63 - 1. entries is 256 at most: codes are bytes.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte")
    rows = integer_parts(vectors, parts, scale)
    distinct = distinct_parts(rows)
    books = train(rows, distinct, parts, entries, rounds)
    return encode(rows, distinct, books), books


def code_report(vectors: DataFrame) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error, codebooks_sha256 for each usable vector; see compressed."""
    coded, books = compressed(vectors)
    coded = with_label_errors(staged(coded, "coded"))
    digest = F.lit(None).cast("string")
    for dim in books.books:
        digest = F.when(F.col("dim") == dim, F.lit(books.digest(dim))).otherwise(digest)
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return coded.select("vec_id", code.alias("code"), "error", "label_error", digest.alias("codebooks_sha256"))
