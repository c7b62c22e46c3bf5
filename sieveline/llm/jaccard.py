"""Similarity join of texts by the Jaccard coefficient of their shingle sets: a size-aware join, light and heavy.

All shingles stand in one order, frequent ones last: by a table of counts in LEVEL_BITS buckets over all texts, then by
hash. Any order gives the same links; this one keeps lists short. Two sets of m and n shingles that are similar enough
share k of the first m - ceil(0.8 m) + k of the one and of the first n - ceil(0.8 n) + k of the other, for each k up to
their overlap. A text's head is that for k = 2, which holds the one for k = 1.

* Light sets, up to a boundary in size, enumerate the subsets of two shingles of their heads. Two light sets that are
  similar enough have such a subset in common (but for sets so small that they may share one shingle only: these scan).
* Heavy sets scan the inverted lists of the shingles of their heads (k = 1), light sets of nearly their size included.

The boundary is chosen by cost: for each class of sizes the subsets that its sets would write are counted, and the pairs
that scanning would compare, and the cheapest boundary is taken. Candidates pass size and position filters and parity
sketches, which reject no link, and are compared at last by their whole sets. What this can't find is no link, by 64-bit
hashes of shingles and of texts.

Only connectivity is wanted. Copies are one text before anything else. Then groups are contracted, so that a large group
of near copies costs its rows, not its pairs: of each text's first lists, a few pivots that most texts of the list are near
to are its stars, and each text is compared with the nearest star; then texts of smaller groups are compared with the
nearest text of another group in their lists, as long as that joins any. What is contracted is compared whole, too, so no
group is too large. The boundary and the join look at the lists in which several groups are left, and find all other links.
Lists of more than LIST_ROWS rows are dealt to blocks of about as many rows; rows of the list's largest group stay in their
block, and the others visit each block in parts of as many rows: no task holds a whole list.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .simhash import _LOWER
from .staging import drop_staged, staged
from .words import U64, Words, mixed, slices, tuple_hashes

SHINGLE, SIMILARITY = 5, 0.8
PART_BYTES = 3 << 20
LEVEL_BITS = 18
#: Rows of a list that meet in one task.
LIST_ROWS = 1 << 12
#: Lists of a text in which it looks for a star, rows of a list that may be stars, stars of a list, and a list's size up to
#: which each row meets the next one instead.
FIRST_LISTS, PIVOTS, STARS, FEW = 2, 16, 4, 4
#: Rounds of looking for the nearest text of another group, at most: what they leave, the join finds.
ROUNDS = 3
#: A subset that is written costs as much as so many pairs that are compared in a scan.
SUBSET_COST = 40
#: 256 parity bits that travel with a shingle, so that most pairs that can't link are never formed.
BITS = [f"s{k}" for k in range(4)]
MARKS = "size int, head array<long>, sketch binary, " + ", ".join(f"{b} long" for b in BITS)
_LIST = ("gram", "low", "high")
_ROW = (*_LIST, "mine", "above", "key", "root", "size", "at", *BITS)


def grams_of(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of all texts, with their texts; of all words where a text has fewer."""
    counts = np.diff(words.first)
    texts = np.repeat(np.arange(len(counts)), counts)
    h = words.hashes()
    g = tuple_hashes(h, n)
    inside = texts[: len(g)] == texts[n - 1 :] if len(g) else np.zeros(0, bool)
    short = np.flatnonzero((counts > 0) & (counts < n))
    few = [mixed(np.bitwise_xor.reduce(h[words.first[t] : words.first[t + 1]] * (np.arange(counts[t], dtype=U64) + U64(3)), keepdims=True))[0] for t in short]
    owner = np.concatenate((texts[: len(g)][inside], short))
    order = np.argsort(owner, kind="stable")
    return np.concatenate((g[inside], np.array(few, U64)))[order], owner[order]


def sets_of(words: Words, n: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    g, owner = grams_of(words, n)
    ends = np.searchsorted(owner, np.arange(len(words.first)))
    ordered = [np.sort(g[a:b]) for a, b in zip(ends[:-1], ends[1:])]
    return [s[np.append(True, s[1:] != s[:-1])] if len(s) else s for s in ordered]


def texts_of(batch: pa.RecordBatch):
    """(first row, end, words in lower case) for stretches of a batch of bounded size."""
    texts = batch.column("text").cast(pa.large_binary()).to_pylist()
    for i, j in slices([len(t or b"") for t in texts], PART_BYTES):
        yield i, j, Words([(t or b"").translate(_LOWER) for t in texts[i:j]])


def levels(docs: DataFrame, n: int = SHINGLE) -> np.ndarray:
    """How frequent the shingles of each bucket of hashes are, in sixteenths of a doubling: one byte a bucket. Counts are
    over all rows of docs, added up within tasks first."""
    size = 1 << LEVEL_BITS

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for _, _, words in texts_of(batch):
                total += np.bincount((grams_of(words, n)[0] >> U64(64 - LEVEL_BITS)).astype(np.int64), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size)
    counts[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return np.minimum(16 * np.log2(1 + counts / max(counts.mean(), 1e-9)), 255).astype(np.uint8)


def _least_shared(size: int, least: float) -> int:
    return math.ceil(least * size - 1e-6)


def head_of(grams: np.ndarray, least: float, level: np.ndarray) -> np.ndarray:
    """Of the sorted distinct shingles of a text the first ones in the order of all shingles, as many as two of those that
    it shares with a text that is similar enough need."""
    order = np.argsort(level[(grams >> U64(64 - LEVEL_BITS)).astype(np.int64)], kind="stable")
    return grams[order[: len(grams) - _least_shared(len(grams), least) + 2]]


def _sketch(grams: np.ndarray, size: int) -> np.ndarray:
    """2**size bits, packed: each shingle flips one. Sketches of two texts, folded to the same length, differ in no more
    bits than the texts do in shingles."""
    return np.packbits(np.bincount((grams >> U64(64 - size)).astype(np.int64), minlength=1 << size) & 1)


def marks(words: Words, n: int, least: float, level: np.ndarray) -> list[pa.Array]:
    """The columns MARKS of some texts; long sketches have two to four bits for each shingle, 256 at least."""
    sets = sets_of(words, n)
    heads = pa.array([head_of(s, least, level).view(np.int64) for s in sets], pa.list_(pa.int64()))
    sketches = pa.array([_sketch(s, max(8, len(s).bit_length() + 1)).tobytes() for s in sets], pa.binary())
    small = np.stack([_sketch(s, 8) for s in sets]).view(np.int64) if sets else np.zeros((0, len(BITS)), np.int64)
    return [pa.array([len(s) for s in sets], pa.int32()), heads, sketches, *[pa.array(small[:, k].copy()) for k in range(len(BITS))]]


def _marked(n: int, least: float, level: np.ndarray):
    names = ["doc_id", "key", "size", "head", "sketch", *BITS]

    def run(batches):
        for batch in batches:
            for i, j, words in texts_of(batch):
                rest = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([rest.column("doc_id"), rest.column("key"), *marks(words, n, least, level)], names)

    return run


def _sets(n: int):
    def run(batches):
        for batch in batches:
            for i, j, words in texts_of(batch):
                sets = sets_of(words, n)
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(i, j - i), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "grams"])

    return run


def _most_apart(least: float, sizes):
    """The most shingles in which two sets that are similar enough differ, by the sum of their sizes."""
    return (1 - least) / (1 + least) * sizes + 1e-6


def _similar(least: float):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                a, b = np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64)
                shared = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(shared >= least * (len(a) + len(b) - shared) - 1e-9)
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], ["a", "b"])

    return run


def sets_for(keys: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """(key, grams): the written sets of the texts whose hash is among keys."""
    # of each task's copies one text goes on, before anything is joined
    some = docs.select(F.xxhash64("text").alias("key"), "text").groupBy("key").agg(F.first("text").alias("text")).join(keys, "key", "left_semi")
    return staged(some.mapInArrow(_sets(n), "key long, grams binary"), "sets")


def compared(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs (a, b) whose sets are similar enough. Each side's sets are fetched for its pairs alone."""
    x = pairs.join(sets.select(F.col("key").alias("a"), F.col("grams").alias("x")), "a").select("a", "b", "x")
    y = pairs.join(sets.select(F.col("key").alias("b"), F.col("grams").alias("y")), "b").select("a", "b", "y")
    both = x.join(y, ["a", "b"]).select("a", "b", "x", "y")
    return staged(both.mapInArrow(_similar(similarity), "a long, b long"), "links")


def verified(pairs: DataFrame, docs: DataFrame, n: int, similarity: float) -> DataFrame:
    """Those of pairs (a, b) of hashes of texts whose texts are similar enough."""
    ends = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    sets = sets_for(staged(ends, "ends"), docs, n)
    out = compared(pairs, sets, similarity)
    drop_staged(sets)
    return out


def _near(least: float):
    """Pairs whose long sketches allow a link."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            i = np.arange(len(x))
            apart = _Sketches(x + y).differ(i, i + len(x))
            sizes = batch.column("m").to_numpy() + batch.column("n").to_numpy()
            kept = batch.filter(pa.array(apart <= _most_apart(least, sizes)))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], ["a", "b"])

    return run


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (key, root) after more links."""
    if links.isEmpty():
        return roots
    edges = roots.select(F.col("key").alias("a"), F.col("root").alias("b")).union(links)
    return staged(components(edges).withColumnRenamed("node", "key"), "roots")


#: For each byte the four bits that its neighbouring bits make when one flips the other.
_FOLDED = np.packbits(np.bitwise_xor.reduce(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).reshape(256, 4, 2), axis=2), axis=1)[:, 0] >> 4


class _Sketches:
    """Long sketches of some rows, by length, and folded to half of it."""

    def __init__(self, sketches: list[bytes]):
        self.length = np.array([len(x) for x in sketches])
        self.place = np.zeros(len(sketches), np.int64)
        self.whole: dict[int, np.ndarray] = {}
        self.half: dict[int, np.ndarray] = {}
        for n in np.unique(self.length).tolist():
            at = np.flatnonzero(self.length == n)
            self.place[at] = np.arange(len(at))
            self.whole[n] = np.frombuffer(b"".join(sketches[i] for i in at), np.uint8).reshape(len(at), n)

    def _folded(self, n: int) -> np.ndarray:
        if n not in self.half:
            fours = _FOLDED[self.whole[n]]
            self.half[n] = fours[:, ::2] << 4 | fours[:, 1::2]
        return self.half[n]

    def differ(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """In how many bits the sketches of pairs differ; 0 where their lengths differ by more than half."""
        out = np.zeros(len(i), np.int64)
        m, n = self.length[i], self.length[j]
        for x, y in set(zip(m.tolist(), n.tolist())):
            if not x <= 2 * y <= 4 * x:
                continue
            at = np.flatnonzero((m == x) & (n == y))
            a = self.whole[x] if x <= y else self._folded(x)
            b = self.whole[y] if y <= x else self._folded(y)
            for k in np.array_split(at, len(at) * min(x, y) // (1 << 24) + 1):
                out[k] = np.bitwise_count(a[self.place[i[k]]] ^ b[self.place[j[k]]]).sum(axis=1, dtype=np.int64)
        return out


def _pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])


def _may_be_similar(least: float, size: np.ndarray, small: np.ndarray, i, j) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of rows: whether their sizes and parity bits allow a link, and in how many bits they differ."""
    apart = np.bitwise_count(small[i] ^ small[j]).sum(axis=-1, dtype=np.int64)
    both = size[i] + size[j]
    return (np.minimum(size[i], size[j]) >= least * np.maximum(size[i], size[j]) - 1e-6) & (apart <= _most_apart(least, both)), apart


def _smaller_groups(cuts: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Whether a row isn't of the largest root of its list."""
    group = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    order = np.lexsort((root, group))
    starts = np.flatnonzero(np.append(True, (np.diff(group[order]) != 0) | (np.diff(root[order]) != 0)))
    run = np.repeat(np.diff(np.append(starts, len(root))), np.diff(np.append(starts, len(root))))
    size, first = np.empty(len(root), np.int64), np.empty(len(root), np.int64)
    size[order], first[order] = run, np.repeat(starts, np.diff(np.append(starts, len(root))))
    # of runs of one size the last
    most = np.maximum.reduceat(size * len(root) + first, cuts[:-1]) if len(root) else size
    return size * len(root) + first != np.repeat(most, np.diff(cuts))


def _meetings(least: float):
    """Pairs of rows of a list that have different roots and may be similar; lists come in the order of sizes."""

    def run(rows: np.ndarray, sketches: list[bytes]):
        low, _, mine, above, key, root, size, at, small = *rows[:, 1:9].T, rows[:, 9:].copy().view(U64)
        cuts = np.append(np.flatnonzero(np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1))), len(rows))
        group = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        left, long = size - at, None

        def fitting(i: np.ndarray, j: np.ndarray):
            nonlocal long
            # one of them at least is at home in this block
            fits = (root[i] != root[j]) & ((mine[i] == low[i]) | (mine[j] == low[j]))
            # sets that may share one shingle only have no subset of two in common
            fits &= (np.maximum(size[i], size[j]) > above[i]) | (np.minimum(size[i], size[j]) * least <= 1)
            # the first shingle that two sets share leaves enough behind it in both
            fits &= np.minimum(left[i], left[j]) >= least / (1 + least) * (size[i] + size[j]) - 1e-6
            i, j = i[fits], j[fits]
            near, _ = _may_be_similar(least, size, small, i, j)
            i, j = i[near], j[near]
            if len(i):
                long = long or _Sketches(sketches)
                near = long.differ(i, j) <= _most_apart(least, size[i] + size[j])
                if near.any():
                    yield _pair_batch(key[i[near]], key[j[near]])

        small_groups = _smaller_groups(cuts, root)
        few = np.add.reduceat(small_groups.astype(np.int64), cuts[:-1])
        # in a list of one large group, only rows of the others look for partners
        sided = (np.diff(cuts) > 64) & (few * 4 < np.diff(cuts))
        for g in np.flatnonzero(sided & (few > 0)).tolist():
            here = np.arange(cuts[g], cuts[g + 1])
            others = here[small_groups[here]]
            for some in np.array_split(others, len(others) * len(here) // (1 << 18) + 1):
                i, j = np.repeat(some, len(here)), np.tile(here, len(some))
                once = ~small_groups[j] | (i < j)
                yield from fitting(i[once], j[once])
        first, step = np.flatnonzero(~sided[group]), 0
        while True:
            step += 1
            first = first[first + step < len(rows)]
            first = first[group[first] == group[first + step]]
            first = first[size[first] >= least * size[first + step] - 1e-6]
            if not len(first):
                return
            for i in np.array_split(first, len(first) // (1 << 18) + 1):
                yield from fitting(i, i + step)

    return run


def _nearest_rows(least: float, key, root, size, small, some: np.ndarray, of: np.ndarray):
    """(a, b, apart): for each of some rows the row of the same list and another root that is nearest by parity bits."""
    for part in np.array_split(some, len(some) * len(of) // (1 << 20) + 1):
        if not len(part):
            continue
        near, apart = _may_be_similar(least, size, small, part[:, None], of[None, :])
        near &= root[part][:, None] != root[of][None, :]
        apart = np.where(near, apart, 1 << 30)
        best = apart.argmin(axis=1)
        found = apart[np.arange(len(part)), best] < 1 << 30
        yield key[part[found]], key[of[best[found]]], apart[np.arange(len(part)), best][found]


def _proposals(least: float, stars: bool):
    """(a, b, apart): texts to compare. With stars, each row with the nearest of the list's stars (in lists of few rows
    with the next row); without, each row that looks here (above is set) and isn't of the list's largest root with the
    nearest one of another root."""

    def run(rows: np.ndarray, _: list[bytes]):
        looks, key, root, size, small = rows[:, 4], rows[:, 5], rows[:, 6], rows[:, 7], rows[:, 9:].copy().view(U64)
        cuts = np.append(np.flatnonzero(np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1))), len(rows))
        a, b, c = [], [], []
        if stars:
            group = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
            short = np.diff(cuts)[group] <= FEW
            i = np.flatnonzero(short[:-1] & (group[1:] == group[:-1]) & (root[1:] != root[:-1]))
            near, apart = _may_be_similar(least, size, small, i, i + 1)
            a, b, c = [key[i[near]]], [key[i[near] + 1]], [apart[near]]
        searching = None if stars else _smaller_groups(cuts, root) & (looks > 0)
        lists = np.diff(cuts) > FEW if stars else np.add.reduceat(searching.astype(np.int64), cuts[:-1]) > 0
        for g in np.flatnonzero(lists).tolist():
            here = np.arange(cuts[g], cuts[g + 1])
            if stars:
                pivots = here[:PIVOTS]
                near, apart = _may_be_similar(least, size, small, here[:, None], pivots[None, :])
                near &= root[here][:, None] != root[pivots][None, :]
                chosen, open_ = [], np.ones(len(here), bool)
                while len(chosen) < STARS:
                    reach = near[open_].sum(axis=0)
                    best = int(reach.argmax()) if len(reach) else 0
                    if not len(reach) or not reach[best]:
                        break
                    chosen.append(best)
                    open_ &= ~near[:, best]
                if chosen:
                    apart = np.where(near[:, chosen], apart[:, chosen], 1 << 30)
                    best = apart.argmin(axis=1)
                    found = apart[np.arange(len(here)), best] < 1 << 30
                    a.append(key[here[found]])
                    b.append(key[pivots[np.array(chosen)[best[found]]]])
                    c.append(apart[np.arange(len(here)), best][found])
            else:
                for x, y, z in _nearest_rows(least, key, root, size, small, here[searching[here]], here):
                    a.append(x), b.append(y), c.append(z)
        if a and sum(map(len, a)):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b)), pa.array(np.concatenate(c).astype(np.int32))], ["a", "b", "apart"])

    return run


def _by_list(f, long: bool):
    """f over whole lists, with their long sketches where they come along; rows arrive sorted by list."""

    def run(batches):
        held: list[np.ndarray] = []
        sketches: list[bytes] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in _ROW], axis=1)
            more = batch.column("sketch").to_pylist() if long else []
            last = (rows[:, :3] == rows[-1, :3]).all(axis=1)
            begin = 0 if last.all() else int(np.flatnonzero(~last)[-1]) + 1
            if held and (begin or (held[0][0, :3] != rows[-1, :3]).any()):
                yield from f(np.concatenate([*held, rows[:begin]]), sketches + more[:begin])
                held, sketches = [], []
            elif begin:
                yield from f(rows[:begin], more[:begin])
            held.append(rows[begin:])
            sketches += more[begin:]
        if held:
            yield from f(np.concatenate(held), sketches)

    return run


def _dealt(rows: DataFrame, turn: int) -> tuple[DataFrame, Column]:
    """rows with mine, the block of a long list that a row is dealt to, and the number of blocks."""
    blocks = F.ceil(F.col("n") / LIST_ROWS).cast("int")
    return rows.withColumn("mine", F.when(F.col("n") > LIST_ROWS, F.pmod(F.xxhash64("key", "gram", F.lit(turn)), blocks).cast("int")).otherwise(0)), blocks


def _proposed(rows: DataFrame, similarity: float, stars: bool, turn: int) -> DataFrame:
    """(a, b): for each text the nearest of those that its lists propose; without stars it looks in some FIRST_LISTS of
    them, others in each turn. Long lists look within their blocks."""
    rows, _ = _dealt(rows.withColumn("above", (F.pmod(F.xxhash64("key", "gram", F.lit(turn)), F.col("lists")) < FIRST_LISTS).cast("int")), turn)
    # the same order in all lists: texts that share many shingles have the same stars in each
    rows = rows.withColumn("low", F.col("mine")).withColumn("high", F.col("mine")).withColumn("turn", F.xxhash64("key", F.lit(turn)))
    rows = rows.repartition(*_LIST).sortWithinPartitions(*_LIST, "turn").select(*_ROW)
    found = rows.mapInArrow(_by_list(_proposals(similarity, stars), False), "a long, b long, apart int")
    return found.groupBy("a").agg(F.min_by("b", F.struct("apart", "b")).alias("b")).select("a", "b")


def _pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """All candidates (a, b) among rows (gram, n, above, key, root, size, at, BITS, sketch); n is the number of rows of
    the list. Rows of a long list's largest group stay in their block; the others, in parts of LIST_ROWS rows, visit
    every block: a task has the rows of one block and one part of the visitors."""
    rows, blocks = _dealt(rows, 0)
    long = F.col("n") > LIST_ROWS
    sizes = rows.where(long).groupBy("gram", "root").count().groupBy("gram")
    sizes = sizes.agg(F.max_by("root", F.struct("count", "root")).alias("_most"), (F.sum("count") - F.max("count")).alias("_others"))
    rows = rows.join(staged(sizes, "largest"), "gram", "left")
    parts = F.greatest(F.ceil(F.col("_others") / LIST_ROWS), F.lit(1)).cast("int")
    part = F.pmod(F.xxhash64("key", F.lit(1)), parts).cast("int")
    spot = lambda block, visitors: F.struct(block.alias("low"), visitors.alias("high"))
    home = F.transform(F.sequence(F.lit(0), parts - 1), lambda v: spot(F.col("mine"), v))
    visits = F.transform(F.sequence(F.lit(0), blocks - 1), lambda y: spot(y, part))
    spots = F.when(long & (F.col("root") != F.col("_most")), F.array_distinct(F.concat(home, visits))).when(long, home).otherwise(F.array(spot(F.lit(0), F.lit(0))))
    rows = rows.withColumn("_spot", F.explode(spots)).withColumn("low", F.col("_spot.low")).withColumn("high", F.col("_spot.high"))
    rows = rows.repartition(*_LIST).sortWithinPartitions(*_LIST, "size").select(*_ROW, "sketch")
    return rows.mapInArrow(_by_list(_meetings(similarity), True), "a long, b long").distinct()


def _in_lists(rows: DataFrame) -> DataFrame:
    """rows whose gram others have too, with n, the number of rows that have it."""
    # written: a join of two plain shuffles can split a gram that very many rows share
    counts = staged(rows.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "lists")
    return rows.join(counts, "gram")


def _subsets(rows: DataFrame) -> DataFrame:
    """A row for each subset of two shingles of a light set's rows, its hash in the place of the gram."""
    names = ["key", "root", "size", *BITS, "sketch"]
    sets = rows.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("at", "gram"))).alias("g"))
    firsts = sets.select(*names, "g", F.posexplode("g").alias("i", "x")).where(F.col("i") + 1 < F.size("g"))
    both = firsts.select(*names, "x", F.explode(F.slice("g", F.col("i") + 2, F.size("g"))).alias("y"))
    return both.select(F.xxhash64("x.gram", "y.gram").alias("gram"), *names, F.col("x.at").alias("at"))


def _size_class() -> Column:
    return F.floor(F.log2("size") * 4).cast("int")


def cheapest_boundary(subsets: dict[int, int], scanned: dict[int, int], cost: float) -> int:
    """The class of sizes up to which sets are light, -1 where none is: the least sum of the cost of the subsets of light
    classes and of the pairs that the other classes scan."""
    classes = sorted(set(subsets) | set(scanned))
    best, boundary, total = sum(scanned.values()), -1, sum(scanned.values())
    for c in classes:
        total += cost * subsets.get(c, 0) - scanned.get(c, 0)
        if total < best:
            best, boundary = total, c
    return boundary


def _boundary(rows: DataFrame) -> int:
    """The largest size of light sets, from the costs of each class of sizes."""
    sets = rows.groupBy("key").agg(F.first("size").alias("size"), F.count("*").alias("m"))
    subsets = sets.groupBy(_size_class().alias("c")).agg(F.sum(F.expr("m * (m - 1) / 2")).alias("n"))
    cells = rows.where("core").groupBy("gram", _size_class().alias("c")).agg(F.count("*").alias("m"))
    # a row for each class of sizes in a list, so a window holds some hundred rows at most
    before = F.sum("m").over(Window.partitionBy("gram").orderBy("c"))
    scanned = cells.select("c", (F.col("m") * before).alias("p")).groupBy("c").agg(F.sum("p").alias("n"))
    costs = [{r.c: float(r.n) for r in x.collect()} for x in (subsets, scanned)]
    boundary = cheapest_boundary(*costs, SUBSET_COST)
    return 0 if boundary < 0 else math.ceil(2 ** ((boundary + 1) / 4)) - 1


def light_heavy_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """Candidates among rows (gram, n, core, key, root, size, at, BITS) of open lists: by subsets where both sets are
    light, by scanning lists where one is heavy."""
    most = _boundary(rows)
    scan = rows.where(F.col("core") & ((F.col("size") >= similarity * most - 1e-6) | (F.col("size") <= similarity**-2 + 1e-6))).withColumn("above", F.lit(most))
    pairs = _pairs(scan, similarity)
    if most:
        light = staged(_subsets(rows.where(F.col("size") <= most)), "subsets")
        pairs = pairs.union(_pairs(_in_lists(light).withColumn("above", F.lit(0)), similarity)).distinct()
    return pairs


def all_links(texts: DataFrame, docs: DataFrame, roots: DataFrame, n: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """roots (key, root) after all links between texts of different roots; texts that have none stand alone.

    texts: key and MARKS, one row for each; docs: text, whose xxhash64 is the key."""
    spread = texts.select("key", "size", F.posexplode("head").alias("at", "gram"))
    shared = _in_lists(spread).join(texts.select("key", *BITS), "key")
    core = F.col("at") < F.col("size") - F.ceil(F.col("size") * similarity - F.lit(1e-6)) + 1
    # windows over the head of one text
    own = Window.partitionBy("key")
    shared = shared.withColumn("core", core).withColumn("nth", F.row_number().over(own.orderBy("at"))).withColumn("lists", F.count("*").over(own))
    shared = staged(shared, "shared")

    x = texts.select(F.col("key").alias("a"), F.col("size").alias("m"), F.col("sketch").alias("x"))
    y = texts.select(F.col("key").alias("b"), F.col("size").alias("n"), F.col("sketch").alias("y"))

    def rooted(rows: DataFrame) -> DataFrame:
        return rows.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))

    def still_open(rows: DataFrame) -> DataFrame:
        """Rows of lists that several groups have. What lies within one group now stays there."""
        now = staged(rooted(rows), "rooted")
        several = now.groupBy("gram").agg(F.min("root").alias("_least"), F.max("root").alias("_most")).where("_least < _most").select("gram")
        out = staged(now.join(staged(several, "several"), "gram", "left_semi").drop("root"), "open")
        drop_staged(now)
        return out

    def proposed(rows: DataFrame, stars: bool, turn: int) -> DataFrame:
        some = staged(_proposed(rows, similarity, stars, turn), "proposed")
        near = some.join(x, "a").join(y, "b").select("a", "b", "x", "y", "m", "n").mapInArrow(_near(similarity), "a long, b long")
        # each pair once, whichever of the two proposed it
        return staged(near.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "near")

    pairs = proposed(rooted(shared).where(F.col("core") & (F.col("nth") <= FIRST_LISTS)), True, 0)
    tested, roots = pairs, joined(roots, verified(pairs, docs, n, similarity))
    rows = still_open(shared)
    drop_staged(shared)
    for turn in range(1, ROUNDS + 1):
        if rows.isEmpty():
            return roots
        pairs = staged(proposed(rooted(rows).where("core"), False, turn).join(tested, ["a", "b"], "left_anti"), "untested")
        found = verified(pairs, docs, n, similarity)
        if found.isEmpty():
            break
        tested, roots, before = tested.union(pairs), joined(roots, found), rows
        rows = still_open(before)
        drop_staged(before)
    if rows.isEmpty():
        return roots
    pairs = staged(light_heavy_pairs(rooted(rows).join(texts.select("key", "sketch"), "key"), similarity), "meetings")
    return joined(roots, verified(pairs.join(tested, ["a", "b"], "left_anti"), docs, n, similarity))


def no_roots(texts: DataFrame) -> DataFrame:
    return texts.select("key", F.col("key").alias("root")).limit(0)


def jaccard_groups(docs: DataFrame, n: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, key, size, root) for each row: key is the text's hash, size its number of distinct shingles, root the
    least key of those linked.

    A-Z are lower-cased; texts of fewer words than a shingle have one, of all their words. Null and empty texts have none.
    Repeated rows and null doc_ids stay. Other columns are ignored.
    """
    clean = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    some = clean.select("doc_id", F.xxhash64("text").alias("key"), "text")
    marked = staged(some.mapInArrow(_marked(n, similarity, levels(clean, n)), f"doc_id long, key long, {MARKS}"), "marks")
    rows = staged(marked.select("doc_id", "key", "size"), "rows")
    texts = staged(marked.groupBy("key").agg(*[F.first(c).alias(c) for c in ("size", "head", "sketch", *BITS)]), "texts")
    drop_staged(marked)
    roots = all_links(texts, clean, staged(no_roots(texts), "roots"), n, similarity)
    return rows.select("doc_id", "key", "size").join(roots, "key", "left").select("doc_id", "key", "size", F.coalesce("root", "key").alias("root"))


def jaccard_components(docs: DataFrame, n: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included) for each row.

    Texts without words (null, empty) are linked with nothing: component_id is their own doc_id. Null doc_ids take part;
    component_id is null where all of a group are. Repeated rows stay, and have one component.
    """
    rows = staged(jaccard_groups(docs, n, similarity), "groups")
    # written first: a join of two plain shuffles can split a root that very many rows share
    ids = staged(rows.where("size > 0").groupBy("root").agg(F.min("doc_id").alias("component_id")), "ids")
    found = rows.join(ids, "root", "left")
    return found.select("doc_id", F.col("size").cast("long").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
