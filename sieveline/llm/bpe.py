"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut at safe boundaries first: before white space that follows something else. Each match of the pattern
is white space, or something else after at most one space, and nothing in it looks back, so no match spans such a
boundary and the matches on either side stay the same. Where a part has no such boundary for long (one unbroken run),
it is cut into the pattern's matches, each encoded separately, which is what the library does with it.
Decoding works on raw bytes; ids of part of a character are fine.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from .staging import process_cache

RANKS = "byte_bpe_multi_50k.tiktoken"
PART_CHARS = 1 << 18
_BOUNDARY = regex.compile(r"\S(?=\s)")


def encoding(path: str) -> tiktoken.Encoding:
    """The encoding of a rank file, once for each process."""
    cache = process_cache()
    if ("bpe", path) not in cache:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        cache["bpe", path] = tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return cache["bpe", path]


def safe_parts(text: str, most: int = PART_CHARS) -> Iterator[str]:
    """The text in parts of about most characters, cut at safe boundaries only; a part without any is longer."""
    at = 0
    while len(text) - at > most:
        cut = _BOUNDARY.search(text, at + most - 1)
        if cut is None:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]


def encode_parts(enc: tiktoken.Encoding, text: str, most: int = PART_CHARS) -> Iterator[list[int]]:
    """The ids of a whole text, part by part."""
    for part in safe_parts(text, most):
        if len(part) <= 2 * most:
            yield enc.encode_ordinary(part)
        else:
            for match in regex.finditer(public_tokenizers.PATTERN, part):
                yield enc.encode_ordinary(match.group())


def encode(enc: tiktoken.Encoding, text: str) -> list[int]:
    return [i for ids in encode_parts(enc, text) for i in ids]


def _digests(path: str, most: int):
    def run(batches):
        enc = encoding(path)
        for batch in batches:
            counts, ids_sha, out_sha = [], [], []
            for text in batch.column("text"):
                n, ids_hash, out_hash = 0, hashlib.sha256(), hashlib.sha256()
                for ids in encode_parts(enc, text.as_py() or "", most):
                    if ids:
                        ids_hash.update((b"," if n else b"") + str(ids)[1:-1].replace(" ", "").encode())
                        out_hash.update(enc.decode_bytes(ids))
                        n += len(ids)
                counts.append(n)
                ids_sha.append(ids_hash.hexdigest())
                out_sha.append(out_hash.hexdigest())
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": ids_sha, "decoded_sha256": out_sha})

    return run


def round_trip_digests(docs: DataFrame, path: str | None = None, part_chars: int = PART_CHARS) -> DataFrame:
    """For each row: doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (decoded bytes).

    Null texts count as empty: no tokens, and the digests of nothing. Repeated rows and null doc_ids stay as they are;
    other columns are ignored. path: a tiktoken rank file that every executor can open.
    """
    run = _digests(path or public_tokenizers.path(RANKS), part_chars)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _encoder(path: str, most: int):
    def run(batches):
        enc = encoding(path)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                text = row.column("text")[0].as_py()
                ids = None if text is None else [i for part in encode_parts(enc, text, most) for i in part]
                yield pa.RecordBatch.from_arrays([row.column("doc_id"), pa.array([ids], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def encoded(docs: DataFrame, path: str | None = None, part_chars: int = PART_CHARS) -> DataFrame:
    """(doc_id, ids): the ids of each whole text; null for null, none for empty. Repeated rows and null doc_ids stay."""
    return docs.select("doc_id", "text").mapInArrow(_encoder(path or public_tokenizers.path(RANKS), part_chars), "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, bytes): the raw bytes of ids (doc_id, ids); null for null, empty for none. They need not be valid UTF-8.
    Repeated rows and null doc_ids stay. An unknown id is an error."""
    path = path or public_tokenizers.path(RANKS)

    def run(batches):
        enc = encoding(path)
        for batch in batches:
            out = [None if x is None else enc.decode_bytes(x) for x in batch.column("ids").to_pylist()]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "bytes": pa.array(out, pa.binary())})

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")
