"""Token counts with a digest cache.

A text's key is the digest of its normalised content with the digest of the tokenizer's file. Keys are joined to the
stored counts; only distinct misses are encoded, and their counts are appended to the cache.

The file says how far content can be normalised. Where its pre-tokenizer drops white space, its normaliser changes
characters one by one or within words, and its special strings hold no white space, the library counts each piece between
ASCII white space separately: runs of white space are one space in the digest, and a text's count is the sum over its
pieces. Pieces seen before come from a bounded memory of each process, and the rest go to the library in one batch. With
any other file (tokens may span white space) the text as it is has the digest, and is encoded whole; files named .model
are read by sentencepiece.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter

import public_tokenizers
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import ARROW_ROWS, CLEANUP, new_path, process_cache, setting, staged

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
MEMORY = 200_000
CACHE = "digest binary, tokenizer string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _steps(part: dict | None, inner: str) -> list[dict]:
    return [] if part is None else part[inner] if part["type"] == "Sequence" else [part]


def counts_by_piece(path: str) -> bool:
    """Whether a tokenizer's file makes it count the pieces between ASCII white space separately."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    first = (_steps(spec.get("pre_tokenizer"), "pretokenizers") or [{"type": None}])[0]
    # a split that keeps only matches of a pattern which no white space matches, or one of those that drop white space
    pattern = first.get("pattern", {}).get("Regex", "") if first["type"] == "Split" and first.get("behavior") == "Removed" and first.get("invert") else ""
    drops = first["type"] in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer") or (pattern != "" and _without_white_space(pattern))
    own = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents"}
    blanks = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
    tame = all(n["type"] in own or n == blanks for n in _steps(spec.get("normalizer"), "normalizers"))
    plain = all(not re.search(r"\s", t["content"]) and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in spec.get("added_tokens", []))
    return drops and tame and plain and spec.get("post_processor") is None


def _without_white_space(pattern: str) -> bool:
    """Whether each branch of a pattern is letters, or classes that name no white space or exclude it."""
    branch = r"(?:'[a-z]+|\[(?:\\p\{[A-Z]\w*\})+\]\+?|\[\^\\s(?:\\p\{[A-Z]\w*\})*\]\+?)"
    return re.fullmatch(rf"{branch}(?:\|{branch})*", pattern) is not None and r"\p{Z" not in pattern and r"\p{C" not in pattern


def content_digest(text: Column, by_piece: bool = True) -> Column:
    """The digest of a text's normalised content; null counts as empty."""
    clean = F.coalesce(text, F.lit(""))
    if by_piece:
        clean = F.btrim(F.regexp_replace(clean, r"[\x20\x09-\x0D]+", " "), F.lit(" "))
    return F.unhex(F.sha2(clean, 256))


class WholeCounter:
    """Counts of whole texts by the library that reads the file."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.count = lambda text: len(pieces.encode(text))
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.count = lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


class PieceCounter:
    """Counts of whole texts by the tokenizers library, by way of the pieces between white space."""

    def __init__(self, path: str, memory: int = MEMORY):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.seen: dict[bytes, int] = {}
        self.memory = memory

    def count(self, text: str) -> int:
        pieces = Counter(text.encode().split())
        new = [p for p in pieces if p not in self.seen]
        if len(self.seen) + len(new) > self.memory:
            self.seen = {}
            new = list(pieces)
        for i in range(0, len(new), 10_000):
            part = new[i : i + 10_000]
            found = self.tokenizer.encode_batch_fast([p.decode() for p in part], add_special_tokens=False)
            self.seen.update(zip(part, (len(e.ids) for e in found)))
        seen = self.seen
        return sum(n * seen[p] for p, n in pieces.items())


def _counter(path: str, by_piece: bool) -> PieceCounter | WholeCounter:
    cache = process_cache()
    if ("counter", path, by_piece) not in cache:
        cache["counter", path, by_piece] = PieceCounter(path) if by_piece else WholeCounter(path)
    return cache["counter", path, by_piece]


def _count_misses(path: str, tokenizer: str, by_piece: bool):
    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = _counter(path, by_piece)
        for batch in batches:
            counts = [counter.count(t.as_py() or "") for t in batch.column("text")]
            yield pa.record_batch({"digest": batch.column("digest"), "tokenizer": pa.array([tokenizer] * len(counts)), "n_tokens": pa.array(counts, pa.int64())})

    return run


def _stored(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame | None:
    """(digest, n_tokens) of this tokenizer; None where there is no cache yet."""
    try:
        stored = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return stored.where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, cache: str | None = None, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """For each row: doc_id, n_bytes (UTF-8), n_tokens, over_limit.

    cache: folder of stored counts, created where it is missing (None: a new one in the shared folder). Null texts
    count as empty. Special strings inside texts count as the library's default has them. Repeated rows and null
    doc_ids stay; other columns are ignored. Texts are encoded whole.
    """
    path = path or public_tokenizers.path(TOKENIZER)
    cache = cache or new_path(docs.sparkSession, "token-cache")
    tokenizer, by_piece = tokenizer_digest(path), counts_by_piece(path)
    rows = docs.select("doc_id", "text", content_digest(F.col("text"), by_piece).alias("digest"))
    keys = staged(rows.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "digest"), "keys")
    stored = _stored(docs.sparkSession, cache, tokenizer)
    if stored is not None:
        new = staged(keys.select("digest").distinct().join(stored, "digest", "left_anti"), "misses")
        rows = rows.join(new, "digest", "left_semi")
    # one text of each digest, and of each task's copies one before the shuffle
    misses = rows.groupBy("digest").agg(F.first("text").alias("text"))
    with setting(docs.sparkSession, CLEANUP, "true"), setting(docs.sparkSession, *ARROW_ROWS):
        misses.mapInArrow(_count_misses(path, tokenizer, by_piece), CACHE).write.mode("append").parquet(cache)
    # written first: a join of two plain shuffles can split a digest that very many rows share
    stored = staged(_stored(docs.sparkSession, cache, tokenizer), "counts")
    out = keys.join(stored, "digest")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
