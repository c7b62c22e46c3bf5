"""Removal of word windows that occur earlier in the corpus.

Method: super-k-mer partitioning. Each window of 20 words has a minimiser, the smallest hash of its 3-word runs;
consecutive windows of one document that share a minimiser travel as one packed string to the bucket of that
minimiser. Equal windows have equal minimisers, so each bucket finds its repeats alone: it sorts the windows by hash
and compares the words of those with equal hashes, so the result is exact.

Scale and skew
* Runs that are so frequent that their bucket would stand out (copies, boilerplate lines, common phrases) are counted
  over all texts first and rank last as minimisers. A window that only touches a common passage goes where its own
  words send it. Their number is bounded by 18 times the number of shuffle partitions, whatever the input.
* What is packed the same twice in one batch travels once. Strings all of whose runs are frequent are held back and
  combined over all batches of a task (a bounded memory, HELD_BYTES): a passage that stands everywhere reaches its bucket
  once for each task, however many texts the task has.
* The texts are shuffled once more, to meet the removed ranges, after the files of the first shuffle are gone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import shuffle_partitions, staged
from .words import U64, Words, mixed, slices, sliding_min, tuple_hashes

WINDOW, RUN = 20, 3
BATCH_BYTES, BUCKET_BYTES = 6 << 20, 12 << 20
HELD_BYTES = 16 << 20
NO_ID = (1 << 63) - 1
_HOT = U64(1 << 63)

_PACKED = "bucket int, ranges boolean, n int, heads binary, words binary"
_RANGES = "doc_id long, tag int, start int, stop int"


def _row_key() -> tuple[Column, Column]:
    """What tells rows apart: the id (null: the largest long), and 32 bits of the text, for ids that occur again."""
    return F.coalesce(F.col("doc_id"), F.lit(NO_ID)), F.shiftright(F.xxhash64("text"), 32).cast("int")


def _batches(batch: pa.RecordBatch, most: int = BATCH_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes | None]]]:
    """Ids, tags and texts in order of id, in parts of bounded size."""
    texts = batch.column("text").cast(pa.large_binary()).to_pylist()
    ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
    tags = batch.column("tag").to_numpy(zero_copy_only=False).astype(np.int32)
    order = np.lexsort((tags, ids))
    for i, j in slices([len(texts[k] or b"") for k in order], most):
        part = order[i:j]
        yield ids[part], tags[part], [texts[k] for k in part]


def _windows(words: Words, window: int) -> np.ndarray:
    """Which runs of window words lie in one text."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, bool)
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    return text[:n] == text[window - 1 :]


def _frequent(window: int, run: int, share: float):
    """Runs that may hold share of all runs, with their counts: those with half of it in a batch. What has share of
    all has half of it, or more, in batches that report it."""

    def count(batches):
        for batch in batches:
            for _, _, texts in _batches(batch):
                words = Words(texts)
                g = tuple_hashes(words.hashes(), run)
                g = g[_windows(words, run)] & ~_HOT
                keys, n = np.unique(g, return_counts=True)
                often = n >= share / 2 * len(g)
                keys, n = np.append(keys[often], 0), np.append(n[often], len(g))
                size = np.zeros(len(keys), np.int64)
                size[-1] = len(words.norm)
                yield pa.record_batch({"run": pa.array(keys.astype(np.int64)), "total": pa.array(np.arange(len(keys)) == len(keys) - 1), "n": pa.array(n.astype(np.int64)), "size": pa.array(size)})

    return count


def _packer(window: int, run: int, hot: list[int], buckets: int):
    """Super-k-mers of each batch, one row for each bucket; and the ranges whose words occur earlier in the task."""

    def pack(batches):
        held_back: dict[bytes, tuple[int, int, int, int]] = {}  # string: bucket, id, tag, start
        held_bytes = 0
        rare = np.zeros(1 << 16, bool)
        heavy = np.sort(np.array(hot, U64))
        rare[(heavy & U64(0xFFFF)).astype(np.int64)] = True
        packer = zstandard.ZstdCompressor(level=1)

        def rows(bucket: int, ranges: bool, heads: np.ndarray, text: bytes) -> dict:
            return {"bucket": bucket, "ranges": ranges, "n": heads.shape[1], "heads": packer.compress(heads.tobytes()), "words": packer.compress(text)}

        def released():
            """The held strings, each with the place that counts as the first so far."""
            by_bucket: dict[int, list[bytes]] = {}
            for text, at in held_back.items():
                by_bucket.setdefault(at[0], []).append(text)
            for bucket, some in by_bucket.items():
                places = np.array([held_back[text][1:] for text in some], np.int64).T
                yield pa.RecordBatch.from_pylist([rows(bucket, False, np.stack([np.diff(places[0], prepend=0), places[1], places[2]]), b"\n".join(some))], schema=_PACKED_ARROW)

        for batch in batches:
            for ids, tags, texts in _batches(batch):
                words = Words(texts)
                ok = _windows(words, window)
                if not ok.any():
                    continue
                h = words.hashes()
                g = tuple_hashes(h, run) & ~_HOT
                if len(heavy):
                    maybe = np.flatnonzero(rare[(g & U64(0xFFFF)).astype(np.int64)])
                    found = np.searchsorted(heavy, g[maybe])
                    found[found == len(heavy)] = 0
                    g[maybe[heavy[found] == g[maybe]]] |= _HOT
                least = sliding_min(g, window - run + 1)
                at = np.flatnonzero(ok)
                new = np.ones(len(at), bool)
                new[1:] = (np.diff(at) != 1) | (least[at[1:]] != least[at[:-1]])
                lead = np.flatnonzero(new)
                s, last = at[lead], at[np.append(lead[1:], len(at)) - 1]
                e = last + window
                text = np.searchsorted(words.first, s, side="right") - 1
                a, b = words.starts[s], words.ends[e - 1]
                doc, tag, start = ids[text], tags[text], (s - words.first[text]).astype(np.int64)
                buf = words.norm.tobytes()
                # what is the same as earlier in this batch: few are candidates, and their bytes decide
                key = mixed(least[s] + U64(3) * h[s] + U64(5) * h[e - 1] + U64(7) * (b - a).astype(U64))
                _, back, n = np.unique(key, return_inverse=True, return_counts=True)
                local, seen = np.zeros(len(s), bool), {}
                for i in np.flatnonzero(n[back] > 1):
                    i = int(i)
                    j = seen.setdefault(buf[a[i] : b[i]], i)
                    local[i] = (doc[i], start[i]) > (doc[j], start[j])
                if local.any():
                    i = np.flatnonzero(local)
                    stop = start[i] + (e - s)[i]
                    fresh = np.ones(len(i), bool)
                    fresh[1:] = (text[i][1:] != text[i][:-1]) | (start[i][1:] > stop[:-1])
                    k = np.flatnonzero(fresh)
                    heads = np.stack([doc[i[k]], tag[i[k]].astype(np.int64), start[i[k]], stop[np.append(k[1:], len(i)) - 1]])
                    yield pa.RecordBatch.from_pylist([rows(int(doc[i[0]] % buckets), True, heads, b"")], schema=_PACKED_ARROW)
                into = ((least[s] >> U64(20)) % U64(buckets)).astype(np.int64)
                # only frequent runs: the first place so far stays here, later ones are ranges
                kept, gone = np.zeros(len(s), bool), []
                for i in np.flatnonzero(~local & (least[s] >= _HOT)).tolist():
                    string, here = buf[a[i] : b[i]], (int(doc[i]), int(tag[i]), int(start[i]))
                    before = held_back.get(string)
                    if before is None:
                        held_bytes += len(string)
                    elif (before[1], before[3]) == (here[0], here[2]):
                        continue  # rows that share an id tie
                    else:
                        late = before[1:] if (here[0], here[2]) < (before[1], before[3]) else here
                        gone.append((*late, late[2] + int(e[i] - s[i])))
                        if late is here:
                            kept[i] = True
                            continue
                    kept[i] = True
                    held_back[string] = (int(into[i]), *here)
                if gone:
                    yield pa.RecordBatch.from_pylist([rows(gone[0][0] % buckets, True, np.array(gone, np.int64).T.copy(), b"")], schema=_PACKED_ARROW)
                if held_bytes > HELD_BYTES:
                    yield from released()
                    held_back, held_bytes = {}, 0
                i = np.flatnonzero(~local & ~kept)
                bucket = into[i]
                order = np.argsort(bucket, kind="stable")
                i, bucket = i[order], bucket[order]
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                out, held = [], 0
                for c, d in zip(cuts, np.append(cuts[1:], len(i))):
                    k = i[c:d]
                    packed = b"\n".join([buf[x:y] for x, y in zip(a[k].tolist(), b[k].tolist())])
                    heads = np.stack([np.diff(doc[k], prepend=0), tag[k].astype(np.int64), start[k]])
                    out.append(rows(int(bucket[c]), False, heads, packed))
                    held += len(out[-1]["heads"]) + len(out[-1]["words"])
                    if held > (4 << 20) or d == len(i):
                        yield pa.RecordBatch.from_pylist(out, schema=_PACKED_ARROW)
                        out, held = [], 0
        yield from released()

    return pack


_PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("ranges", pa.bool_()), ("n", pa.int32()), ("heads", pa.binary()), ("words", pa.binary())])


def _repeats(words: Words, doc: np.ndarray, start: np.ndarray, window: int, again: bool) -> np.ndarray:
    """Windows (index of their first word) whose words start earlier too. The texts of words are in order of
    (doc, start), so windows are in order of what counts as earlier, unless ids occur again with other texts."""
    at = np.flatnonzero(_windows(words, window))
    if not len(at):
        return at
    hashes = tuple_hashes(words.hashes(), window)[at]
    if again:
        text = np.searchsorted(words.first, at, side="right") - 1
        order = np.lexsort((start[text] + at - words.first[text], doc[text], hashes))
    else:
        order = np.argsort(hashes, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = hashes[order[1:]] != hashes[order[:-1]]
    lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    later, first = order[~new], lead[~new]
    if not len(later):
        return later
    back = np.argsort(later)
    later, first = at[later[back]], at[first[back]]
    # neighbours that match neighbours are compared as one string
    buf = words.norm.tobytes()
    cut = np.ones(len(later), bool)
    cut[1:] = (np.diff(later) != 1) | (np.diff(first) != 1)
    k = np.flatnonzero(cut)
    to = np.append(k[1:], len(later)) - 1
    a, b = words.starts[later[k]], words.ends[later[to] + window - 1]
    c, d = words.starts[first[k]], words.ends[first[to] + window - 1]
    same = [buf[w:x] == buf[y:z] for w, x, y, z in zip(a.tolist(), b.tolist(), c.tolist(), d.tolist())]
    text = np.searchsorted(words.first, later, side="right") - 1
    text0 = np.searchsorted(words.first, first, side="right") - 1
    when, when0 = start[text] + later - words.first[text], start[text0] + first - words.first[text0]
    earlier = (doc[text0] < doc[text]) | ((doc[text0] == doc[text]) & (when0 < when))
    if all(same):
        return later[earlier]
    # equal hashes of different words: those are told apart by their bytes
    bad = np.repeat(~np.array(same), np.diff(np.append(k, len(later))))
    odd = np.unique(first[bad])
    out = set(later[earlier & ~np.isin(first, odd)].tolist())
    for f in odd:
        seen: dict[bytes, tuple] = {}
        for i in [int(f), *later[first == f].tolist()]:
            t = int(np.searchsorted(words.first, i, side="right") - 1)
            here = (doc[t], start[t] + i - words.first[t])
            if seen.setdefault(buf[words.starts[i] : words.ends[i + window - 1]], here) < here:
                out.add(i)
    return np.array(sorted(out), np.int64)


def _bucket_finder(window: int):
    """The ranges of repeated words, for one bucket."""

    def find(table: pa.Table) -> pa.Table:
        un = zstandard.ZstdDecompressor()
        docs, tags, starts, texts, done = [], [], [], [], []
        for r in table.to_pylist():
            heads = np.frombuffer(un.decompress(r["heads"]), np.int64).reshape(-1, r["n"])
            if r["ranges"]:
                done.append(heads)
                continue
            docs.append(np.cumsum(heads[0]))
            tags.append(heads[1])
            starts.append(heads[2])
            texts += un.decompress(r["words"]).split(b"\n")
        if texts:
            doc, tag, start = np.concatenate(docs), np.concatenate(tags), np.concatenate(starts)
            order = np.lexsort((start, doc))
            doc, tag, start = doc[order], tag[order], start[order]
            words = Words([texts[i] for i in order])
            del texts
            again = bool(((doc[1:] == doc[:-1]) & (tag[1:] != tag[:-1])).any())
            later = _repeats(words, doc, start, window, again)
            if len(later):
                text = np.searchsorted(words.first, later, side="right") - 1
                cut = np.ones(len(later), bool)
                cut[1:] = (np.diff(text) != 0) | (np.diff(later) > window)
                k = np.flatnonzero(cut)
                t, to = text[k], later[np.append(k[1:], len(later)) - 1]
                done.append(np.stack([doc[t], tag[t], start[t] + later[k] - words.first[t], start[t] + to + window - words.first[t]]))
        cols = np.concatenate(done, axis=1) if done else np.zeros((4, 0), np.int64)
        return pa.table({"doc_id": pa.array(cols[0]), "tag": pa.array(cols[1].astype(np.int32)), "start": pa.array(cols[2].astype(np.int32)), "stop": pa.array(cols[3].astype(np.int32))})

    return find


def _keyed(docs: DataFrame) -> DataFrame:
    doc_id, tag = _row_key()
    return docs.select(doc_id.alias("doc_id"), tag.alias("tag"), "text")


def repeated_ranges(docs: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """Word ranges [start, stop) to remove, by doc_id (null: the largest long) and tag (32 bits of the text's hash);
    ranges of a document may overlap. Written to the shared folder."""
    spark, rows = docs.sparkSession, _keyed(docs)
    parts = shuffle_partitions(spark)
    share = 1 / (18 * parts)
    runs = rows.mapInArrow(_frequent(window, run, share), "run long, total boolean, n long, size long")
    runs = staged(runs.groupBy("run", "total").agg(F.sum("n").alias("n"), F.sum("size").alias("size")), "runs")
    total = runs.where("total").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    hot = [r.run for r in runs.where(~F.col("total") & (F.col("n") >= share * total[0]) & (F.col("n") >= 100)).select("run").collect()]
    buckets = max(16 * parts, 3 * total[1] // BUCKET_BYTES)
    packed = rows.mapInArrow(_packer(window, run, hot, buckets), _PACKED)
    return staged(packed.groupBy("bucket").applyInArrow(_bucket_finder(window), _RANGES), "ranges")


_CUT = ("_n_words", "_n_removed", "_kept")


def _cutter(batches, out_text: bool):
    for batch in batches:
        names = [n for n in batch.schema.names if n not in ("text", "_ranges")]
        texts = batch.column("text").cast(pa.large_binary()).to_pylist()
        ranges = batch.column("_ranges").to_pylist()
        n_words, n_removed, kept_texts = [], [], []
        for text, gone in zip(texts, ranges):
            words = (text or b"").split()
            n = len(words)
            if gone:
                kept, at = [], 0
                for r in sorted((r["start"], r["stop"]) for r in gone):
                    if r[0] > at:
                        kept += words[at : r[0]]
                    at = max(at, r[1])
                words = kept + words[at:]
            n_words.append(n)
            n_removed.append(n - len(words))
            joined = b" ".join(words)
            if out_text:
                kept_texts.append(text.decode() if text is not None and len(words) == n else joined.decode() if text is not None else None)
            else:
                kept_texts.append(hashlib.sha256(joined).hexdigest())
        arrays = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept_texts, pa.string())]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *arrays], [*names, *_CUT])


def _with_ranges(docs: DataFrame, window: int) -> DataFrame:
    ranges = repeated_ranges(docs, window).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "stop")).alias("_ranges"))
    ranges = ranges.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), "_ranges")
    doc_id, tag = _row_key()
    return docs.join(ranges, (doc_id == F.col("_id")) & (tag == F.col("_tag")), "left").drop("_id", "_tag")


def removal_digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """For each row: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space).

    A word goes if a window over it starts earlier too: at a smaller doc_id, or earlier in the same document. Null
    doc_ids come after all others. Null or empty texts have no words. Of rows with one doc_id, windows at the same
    start tie and stay. Texts with fewer words than the window stay. Other columns of docs are ignored.
    """
    rows = _with_ranges(docs.select("doc_id", "text"), window)
    out = rows.mapInArrow(lambda b: _cutter(b, False), "doc_id long, _n_words long, _n_removed long, _kept string")
    return out.toDF("doc_id", "n_words", "n_removed", "kept_sha256")


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the repeated words cut from text (then words are joined by one space; other texts stay as they are).

    All columns stay, n_chars (where there is one) is the new length. Documents of which nothing is left stay with an
    empty text. Null texts stay null.
    """
    # the text stands apart from the other columns, so that it is shuffled once
    others = [c for c in docs.columns if c != "text"]
    rows = _with_ranges(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row")), window)
    kinds = f"doc_id long, _row {docs.select(F.struct(*[F.col(f'`{c}`') for c in others]).alias('r')).schema['r'].dataType.simpleString()}"
    out = rows.select("doc_id", "_row", "text", "_ranges").mapInArrow(lambda b: _cutter(b, True), f"{kinds}, _n_words long, _n_removed long, _kept string")
    values = {c: F.col("_kept") if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns}
    if "n_chars" in values:
        values["n_chars"] = F.length("_kept").cast(docs.schema["n_chars"].dataType)
    return out.select(*[v.alias(c) for c, v in values.items()])
