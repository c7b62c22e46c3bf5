"""Groups of similar documents: links by wide SimHash and sharded BK-trees first, then an exact search for the rest.

First links. Each text has WIDTH independent 64-bit fingerprints over its two-word shingles, and meets, in a BK-tree for
each choice of blocks, the texts that agree in these blocks. Of the links within RADIUS of all WIDTH * 64 bits each text
keeps the nearest, and those whose five-word shingles are similar enough join groups. Links are missed.

The rest is the join of jaccard.py, which finds all links between the groups. What it can't find is no link, so the groups
are those of all pairs (by 64-bit hashes of shingles and texts), whatever the first links are: RADIUS and BLOCKS change
the cost only.

As in simhash, exact copies are one text before anything else. The driver sees counts and a table of fixed size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .jaccard import BITS, MARKS, SHINGLE, SIMILARITY, all_links, grams_of, levels, marks, texts_of, verified
from .simhash import _signed, block_masks, shard_links
from .staging import drop_staged, packed, staged, unpacked
from .words import U64, Words, mixed, slices

PAIR = 2
WIDTH, RADIUS = 4, 36
#: (most distinct texts, blocks of a fingerprint, blocks that must agree)
BLOCKS = ((1 << 19, 5, 1), (1 << 27, 6, 2), (1 << 62, 7, 3))
_WORDS = [f"w{k}" for k in range(WIDTH)]


def _wide(words: Words) -> np.ndarray:
    """WIDTH fingerprints of each text of words, over its two-word shingles."""
    n = len(words.first) - 1
    g, owner = grams_of(words, PAIR)
    total = np.bincount(owner, minlength=n)
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
    out = np.zeros((n, WIDTH), U64)
    for t, u in slices(total.tolist(), 1 << 18):
        i, j = np.searchsorted(owner, (t, u))
        at = (owner[i:j] - t) * 256
        for w in range(WIDTH):
            part = mixed(g[i:j] ^ mixed(np.array([w + 1], U64))).byteswap().view(np.uint8).reshape(-1, 8)
            ones = np.concatenate([np.bincount(at + part[:, k], minlength=(u - t) * 256).reshape(u - t, 256) @ bits for k in range(8)], axis=1)
            out[t:u, w] = np.packbits(2 * ones > total[t:u, None], axis=1).view(">u8").astype(U64).ravel()
    return out


def _candidates(batches):
    """Links between keys of texts in a shard, with the bits in which they differ; rows arrive sorted by shard, which may
    span batches."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("apart", pa.int32())])

    def links(rows: list[np.ndarray]) -> list[tuple[int, int, int]]:
        r = np.concatenate(rows)
        if len(r) < 2:
            return []
        keys: dict[int, list[int]] = {}
        for row in r.tolist():
            value = 0
            for w in row[1:]:
                value = value << 64 | w & (1 << 64) - 1
            keys.setdefault(value, []).append(row[0])
        out = [(k, same[0], 0) for same in keys.values() for k in same[1:]]
        if len(keys) > 1:
            out += [(keys[a][0], keys[b][0], (a ^ b).bit_count()) for a, b in shard_links(sorted(keys), RADIUS, stars=False)]
        return out

    def table(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"a": max(x[:2]), "b": min(x[:2]), "apart": x[2]} for x in found], schema=schema)

    held, shard = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = np.stack([batch.column("choice").to_numpy(), batch.column("bits").to_numpy()])
        rows = np.stack([batch.column(c).to_numpy() for c in ("key", *_WORDS)], axis=1)
        cuts = np.flatnonzero(np.append(True, (names[:, 1:] != names[:, :-1]).any(axis=0)))
        found: list[tuple[int, int, int]] = []
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(rows)]):
            here = (int(names[0, a]), int(names[1, a]))
            if held and here != shard:
                found += links(held)
                held = []
            shard = here
            held.append(rows[a:b])
        if found:
            yield table(found)
    if held:
        yield table(links(held))


def _fingerprints(n: int, least: float, level: np.ndarray):
    names = ["doc_id", "key", *_WORDS, "size", "head", "sketch", *BITS]

    def run(batches):
        for batch in batches:
            for i, j, words in texts_of(batch):
                fp, rest = _wide(words).view(np.int64), batch.slice(i, j - i)
                columns = [rest.column("doc_id"), rest.column("key"), *[pa.array(fp[:, w].copy()) for w in range(WIDTH)], *marks(words, n, least, level)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _links(texts: DataFrame, docs: DataFrame, n: int, similarity: float) -> DataFrame:
    count = texts.count()
    blocks, agree = next((b, k) for most, b, k in BLOCKS if count <= most)
    masks = block_masks(blocks, agree)
    choices = F.array(*[F.struct(F.lit(w * len(masks) + i).alias("choice"), F.col(_WORDS[w]).bitwiseAND(F.lit(_signed(m))).alias("bits")) for w in range(WIDTH) for i, m in enumerate(masks)])
    shards = texts.select("key", *_WORDS, F.explode(choices).alias("s")).select("key", *_WORDS, "s.choice", "s.bits")
    shards = shards.repartition("choice", "bits").sortWithinPartitions("choice", "bits")
    found = shards.mapInArrow(_candidates, "a long, b long, apart int").groupBy("a").agg(F.min_by("b", F.struct("apart", "b")).alias("b"))
    return verified(staged(found.select("a", "b"), "candidates"), docs, n, similarity)


def similar_groups(docs: DataFrame, n: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, key, root) for each row: key is the text's hash, root the least key of its group.

    Texts are compared by their sets of n-word shingles, A-Z in lower case; texts of fewer words have one shingle. Null
    and empty texts are equal. Repeated rows and null doc_ids stay. Other columns are ignored. An empty table has no rows.
    """
    clean = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    columns = "doc_id long, key long, " + ", ".join(f"{w} long" for w in _WORDS) + f", {MARKS}"
    marked = clean.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(_fingerprints(n, similarity, levels(clean, n)), columns)
    marked = staged(marked, "fingerprints")
    rows = staged(marked.select("doc_id", "key"), "rows")
    texts = staged(marked.groupBy("key").agg(*[F.min(w).alias(w) for w in _WORDS], *[F.first(c).alias(c) for c in ("size", "head", "sketch", *BITS)]), "texts")
    drop_staged(marked)
    roots = staged(components(_links(texts, clean, n, similarity)).withColumnRenamed("node", "key"), "roots")
    roots = all_links(texts, clean, roots, n, similarity)
    return rows.join(roots, "key", "left").select("doc_id", "key", F.coalesce("root", "key").alias("root"))


def one_of_each_group(docs: DataFrame, n: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each group the one with the smallest doc_id (null last);
    of rows that share it, the one with the least hash of the text; of rows the same in both, one. Null and empty texts
    are one group. An empty table stays empty."""
    ids = staged(similar_groups(docs, n, similarity), "groups")
    firsts = ids.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("f"))
    firsts = staged(firsts.select(F.col("f.doc_id").alias("_id"), F.col("f.key").alias("_key")), "firsts")
    again = ids.groupBy("doc_id", "key").count().where("count > 1").join(firsts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left_semi")
    # hashed first: a join on the expression would shuffle the text beside the row that holds it
    rows = packed(docs, "doc_id", "text").select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"), "_row")
    rows = rows.join(firsts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_key")), "left_semi")
    return unpacked(rows if again.isEmpty() else rows.dropDuplicates(["doc_id", "_hash"]))
