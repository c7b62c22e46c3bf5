"""SimHash fingerprints and groups of near copies, with BK-trees.

A BK-tree holds fingerprints; a child hangs under its parent at their integer Hamming distance, so a search within
radius r of a query at distance d from a node follows only the edges d - r .. d + r.

The trees are sharded by the pigeonhole rule: of b blocks of the 64 bits, two fingerprints with at most r differing
bits agree in b - r of them or more, so for each choice of b - r blocks, those that agree there share a shard, and
each link is found in one shard at least. b grows with the number of distinct fingerprints, so that shards stay small;
each b is exact. Shards are counted, and what lies in one of more than SHARD_ROWS fingerprints is sharded again with more
blocks: the bits of common text are far from even. A shard's tree is built in the task that gets the shard: broadcasting
all of them would gather the fingerprints of all documents on the driver.

Only connectivity is wanted: a shard's groups are explored from the tree, what is reached leaves the tree, and a
search skips the subtrees that hold nothing more. A group of n yields n - 1 edges, never all its pairs. Exact copies
are one fingerprint before anything else.
"""

from __future__ import annotations

from functools import partial, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .staging import staged
from .words import U64, Words, slices

SHINGLE, RADIUS, SEED = 4, 4, 42
PART_BYTES = 3 << 20
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: (most distinct fingerprints, number of blocks): b blocks, of which b - radius are fixed.
BLOCKS = ((1 << 21, 1), (1 << 27, 2), (1 << 32, 3))
#: Shards of more rows are sharded again, with up to so many blocks that must agree.
SHARD_ROWS, MOST_BLOCKS = 1 << 16, 8


def _fingerprints(words: Words, n: int, seed: int) -> np.ndarray:
    """The fingerprint of each text of words: bit set where over half of its shingles' hashes have it set."""
    counts = np.diff(words.first)
    texts = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(texts[: len(words) - n + 1] == texts[n - 1 :]) if len(words) >= n else np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < n))
    s = np.concatenate((at, words.first[:-1][short]))
    e = np.concatenate((at + n, words.first[1:][short])) - 1
    owner = texts[s]
    order = np.argsort(owner, kind="stable")
    s, e, owner = s[order], e[order], owner[order]
    buf, get = words.norm.tobytes(), partial(xxhash.xxh64_intdigest, seed=seed)
    spans = zip(words.starts[s].tolist(), words.ends[e].tolist())
    h = np.fromiter((get(buf[a:b]) for a, b in spans), U64, len(s))
    ones = np.zeros((len(counts), 64), np.int64)
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
    for t, u in slices(np.bincount(owner, minlength=len(counts)).tolist(), 1 << 18):
        i, j = np.searchsorted(owner, (t, u))
        part = h[i:j].byteswap().view(np.uint8).reshape(-1, 8)
        for k in range(8):
            table = np.bincount((owner[i:j] - t) * 256 + part[:, k], minlength=(u - t) * 256).reshape(u - t, 256)
            ones[t:u, 8 * k : 8 * k + 8] = table @ bits
    total = np.bincount(owner, minlength=len(counts))
    return np.packbits(2 * ones > total[:, None], axis=1).view(">u8").astype(U64).ravel()


def _fingerprint_batches(n: int, seed: int):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            for i, j in slices([len(t or b"") for t in texts], PART_BYTES):
                fp = _fingerprints(Words([(t or b"").translate(_LOWER) for t in texts[i:j]]), n, seed)
                rest = batch.slice(i, j - i).drop_columns("text")
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(fp.view(np.int64))], [*rest.schema.names, "fp"])

    return run


def fingerprints(docs: DataFrame, n: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, key, fp): fp is the signed 64-bit form; key tells rows with one doc_id apart."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    return rows.mapInArrow(_fingerprint_batches(n, seed), "doc_id long, key long, fp long")


class BKTree:
    """Distinct fingerprints under a root; search(q) takes out of the tree, and returns, those within the radius."""

    def __init__(self, values: list[int], radius: int):
        self.values, self.radius = values, radius
        self.children: list[dict[int, int]] = [{} for _ in values]
        self.parent = [-1] * len(values)
        self.alive = [0] * len(values)
        self.out = [False] * len(values)
        for i in range(1, len(values)):
            at, v = 0, values[i]
            while True:
                d = (values[at] ^ v).bit_count()
                down = self.children[at].setdefault(d, i)
                if down == i:
                    self.parent[i] = at
                    break
                at = down
        for i in range(len(values) - 1, -1, -1):
            self.alive[i] += 1
            if i:
                self.alive[self.parent[i]] += self.alive[i]

    def remove(self, i: int) -> None:
        self.out[i] = True
        while i >= 0:
            self.alive[i] -= 1
            i = self.parent[i]

    def search(self, q: int) -> list[int]:
        found, stack, r = [], [0], self.radius
        values, children, alive, out = self.values, self.children, self.alive, self.out
        while stack:
            i = stack.pop()
            if not alive[i]:
                continue
            d = (values[i] ^ q).bit_count()
            if d <= r and not out[i]:
                found.append(i)
            kids = children[i]
            if len(kids) <= 2 * r + 1:
                stack += [k for e, k in kids.items() if d - r <= e <= d + r]
            else:
                stack += [kids[e] for e in range(d - r, d + r + 1) if e in kids]
        for i in found:
            self.remove(i)
        return found


def shard_links(values: list[int], radius: int, stars: bool = True) -> list[tuple[int, int]]:
    """Links (a, b) that connect the groups within values as all links within the radius do. Each group is a star, or
    (not stars) made of links that are within the radius themselves."""
    if len(values) == 2:
        return [(values[0], values[1])] if (values[0] ^ values[1]).bit_count() <= radius else []
    tree, links = BKTree(values, radius), []
    for i, v in enumerate(values):
        if tree.out[i]:
            continue
        tree.remove(i)
        queue = [i]
        while queue and tree.alive[0]:
            at = queue.pop()
            for k in tree.search(values[at]):
                links.append((values[k], v if stars else values[at]))
                queue.append(k)
    return links


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _link_shards(radius: int):
    """Rows arrive sorted by shard; a shard may span batches."""

    def emit(fps: np.ndarray) -> list[tuple[int, int]]:
        return [(_signed(a), _signed(b)) for a, b in shard_links(np.unique(fps.view(U64)).tolist(), radius)]

    def table(links: list[tuple[int, int]]) -> pa.RecordBatch:
        cols = np.array(links, np.int64).reshape(-1, 2)
        return pa.record_batch({"a": pa.array(cols[:, 0].copy()), "b": pa.array(cols[:, 1].copy())})

    def run(batches):
        held: list[np.ndarray] = []
        shard = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column("choice").to_numpy(), batch.column("bits").to_numpy()])
            fps, links = batch.column("fp").to_numpy(), []
            cuts = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(fps)]):
                here = (int(keys[0, a]), int(keys[1, a]))
                if held and here != shard:
                    if len(held) > 1 or len(held[0]) > 1:
                        links += emit(np.concatenate(held))
                    held = []
                shard = here
                held.append(fps[a:b])
            if links:
                yield table(links)
        if held:
            yield table(emit(np.concatenate(held)))

    return run


def block_masks(blocks: int, chosen: int) -> list[int]:
    """A mask for each choice of so many of the blocks of 64 bits."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    return [sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in some) for some in combinations(range(blocks), chosen)]


def _sharded(fps: DataFrame, radius: int, blocks: int) -> DataFrame:
    """Each fingerprint once for each choice of blocks - radius of the blocks, with the bits that it has there."""
    masks = block_masks(blocks, blocks - radius)
    shards = F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for i, m in enumerate(masks)]))
    return fps.select("fp", shards.alias("s")).select("fp", "s.choice", "s.bits")


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links that connect distinct fingerprints fps (column fp) as all links within the radius do."""
    n = fps.count()
    fixed = next((b for most, b in BLOCKS if n <= most), MOST_BLOCKS)
    found = []
    while True:
        shards, key = _sharded(fps, radius, radius + fixed), ["choice", "bits"]
        large = shards.groupBy(*key).count().where(F.col("count") > SHARD_ROWS).select(*key)
        more = fixed < MOST_BLOCKS and not (large := staged(large, "large")).isEmpty()
        own = shards.join(large, key, "left_anti") if more else shards
        found.append(own.repartition(*key).sortWithinPartitions(*key).mapInArrow(_link_shards(radius), "a long, b long"))
        if not more:
            return reduce(DataFrame.union, found)
        # links within large shards: both ends are among these rows
        fps = staged(shards.join(large, key, "left_semi").select("fp").distinct(), "crowded")
        fixed += 1


def grouped(docs: DataFrame, n: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """(doc_id, key, fp, root, component_id) for each row; component_id is the smallest doc_id reachable, root the
    least fingerprint."""
    rows = staged(fingerprints(docs, n, seed), "fingerprints")
    owners = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    owners = staged(owners, "owners")
    roots = components(links(owners.select("fp"), radius))
    roots = staged(owners.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    # written first: joins of two plain shuffles can split a root or fingerprint that very many rows share
    ids = staged(roots.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    ids = staged(roots.join(ids, "root").select("fp", "root", "component_id"), "members")
    return rows.join(ids, "fp").select("doc_id", "key", "fp", "root", "component_id")


def near_duplicate_groups(docs: DataFrame, n: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """For each row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of those linked, itself included).

    A-Z are lower-cased. Texts of fewer words than a shingle have one shingle, of all their words; those without words
    (null, empty) have fingerprint zero and are linked like others. Null doc_ids take part; component_id is null where
    all of a group are. Repeated rows stay. Other columns of docs are ignored.
    """
    out = grouped(docs, n, radius, seed)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

