"""Train and test overlap: anti joins, overlap checks, n-gram and containment leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import digest, norm_key, words


def without_leaks(test: DataFrame, train: DataFrame, key: str, exact: bool = False) -> DataFrame:
    """Rows of test whose key isn't in train, by normalised key (exact: as it is). Duplicates within test stay. Keys are
    compared by their digests, so texts travel once, in their rows."""
    k = (lambda c: digest(F.col(c))) if exact else (lambda c: digest(norm_key(F.col(c))))
    seen = train.select(k(key).alias("_seen")).distinct()
    own = test.select("*", k(key).alias("_own"))
    return own.join(seen, F.col("_own") == F.col("_seen"), "left_anti").drop("_own")


def clean_test_set(test: DataFrame, train: DataFrame, key: str, order: str) -> DataFrame:
    """Deduplicated first, then without what train holds (D-17)."""
    from .dedup import keep_first

    return without_leaks(keep_first(test, norm_key(F.col(key)), [order]), train, key)


def overlap(test: DataFrame, train: DataFrame, key: str) -> DataFrame:
    """(key): distinct normalised keys of both."""
    k = norm_key(F.col(key))
    theirs = train.select(digest(k).alias("_digest")).distinct()
    ours = test.select(digest(k).alias("_digest"), k.alias("key")).join(theirs, "_digest", "left_semi")
    return ours.groupBy("_digest").agg(F.first("key").alias("key")).select("key")


def check_no_overlap(test: DataFrame, train: DataFrame, key: str) -> None:
    if not overlap(test, train, key).isEmpty():
        raise ValueError(f"{key}: test and train overlap")


#: Bits of the filter of known hashes: so many for each, a power of two, and MOST_BITS at most (2 MB).
BITS_EACH, MOST_BITS, PROBES = 12, 1 << 24, 3


def _with_runs(df: DataFrame, hashes: str, n: int, name: str) -> DataFrame:
    """df with hashes of the runs of n neighbours of an array of word hashes. A run's hash is made of the hashes of two
    shorter runs that cover it, so words are hashed once and each step doubles the length."""
    size, df = 1, df.withColumn(name, F.col(hashes))
    while size < n:
        step = min(size, n - size)
        left = F.greatest(F.size(name) - step, F.lit(0))
        # a projection for each step: the array before is used twice
        df = df.withColumn(name, F.zip_with(F.slice(name, 1, left), F.slice(name, step + 1, left), lambda a, b: F.xxhash64(a, b)))
        size += step
    return df


def _bit(h: Column, probe: int, bits: int) -> Column:
    low, high = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)
    return (low + high * probe).bitwiseAND(F.lit(bits - 1))


def known_filter(known: DataFrame, gram: str = "gram") -> tuple[bytes, int]:
    """A Bloom filter of the hashes in known, as bytes of bounded size, and its number of bits."""
    distinct = known.select(gram).distinct()
    bits = 1 << 10
    n = distinct.count()
    while bits < BITS_EACH * n and bits < MOST_BITS:
        bits *= 2
    at = distinct.select(F.explode(F.array(*[_bit(F.col(gram), k, bits) for k in range(PROBES)])).alias("at"))
    cells = at.groupBy(F.shiftright("at", 3).cast("int").alias("cell")).agg(F.bit_or(F.expr("shiftleft(1, CAST(at & 7 AS INT))")).alias("byte")).toArrow()
    out = bytearray(bits // 8)
    for cell, byte in zip(cells.column("cell").to_pylist(), cells.column("byte").to_pylist()):
        out[cell] = byte
    return bytes(out), bits


def _may_be_known(h: Column, known: tuple[bytes, int]) -> Column:
    table, bits = F.lit(bytearray(known[0])), known[1]

    def there(probe: int) -> Column:
        at = _bit(h, probe, bits)
        byte = F.ascii(F.decode(F.substring(table, (F.shiftright(at, 3) + 1).cast("int"), F.lit(1)), "ISO-8859-1"))
        return F.bit_get(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1

    hit = there(0)
    for probe in range(1, PROBES):
        hit = hit & there(probe)
    return hit


def _found(hashed: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """(key, gram): the distinct hashes of each row (an array, grams) that known (gram) has. What passes the filter of
    known hashes becomes rows, and a join decides."""
    table = known_filter(known)
    some = F.array_distinct(F.filter("grams", lambda h: _may_be_known(h, table)))
    return hashed.select(key, F.explode(some).alias("gram")).join(known.select("gram").distinct(), "gram", "left_semi")


def _hashed(df: DataFrame, text: Column, *more: str) -> DataFrame:
    """more, and the hashes of the words of a text as _h."""
    return df.select(*more, F.transform(words(text), lambda x: F.xxhash64(x)).alias("_h"))


def _grams(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(key, grams): hashes of the n-word runs of each row; shorter texts have one run of all their words."""
    w = _with_runs(_hashed(df, F.lower(F.col(text)), key).where(F.size("_h") > 0), "_h", n, "grams")
    return w.select(key, F.when(F.size("_h") >= n, F.col("grams")).otherwise(F.array(F.xxhash64("_h"))).alias("grams"))


def ngram_leakage(docs: DataFrame, benchmark: DataFrame, n: int = 8, key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """(doc_id, item_id, n_shared, share): items that share n-word runs with a document; share is of the item's runs."""
    theirs = _grams(benchmark, item, "text", n).select(item, F.explode(F.array_distinct("grams")).alias("gram"))
    sizes = theirs.groupBy(item).agg(F.count("*").alias("_size"))
    found = _found(_grams(docs, key, "text", n), key, theirs)
    shared = found.join(theirs, "gram").groupBy(key, item).agg(F.count("*").alias("n_shared"))
    return shared.join(sizes, item).select(key, item, "n_shared", (F.col("n_shared") / F.col("_size")).alias("share"))


def leak_spans(docs: DataFrame, benchmark: DataFrame, n: int = 8, key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """(doc_id, item_id, doc_begin, item_begin, n_words): every maximal run of n or more words, in lower case, that a
    document and an item share; places are counted in words from 0.

    Runs of n words that both have lie on diagonals (place in the document minus place in the item); neighbours on one
    diagonal are one span (gaps and islands), and its words are compared at last. Documents' runs pass a filter of the
    items' runs before they become rows. Null and shorter texts have no spans; rows that share an id are one text each.
    """
    def placed(df: DataFrame, name: str, place: str) -> DataFrame:
        runs = _with_runs(_hashed(df, F.lower(F.col("text")), name), "_h", n, "grams")
        return runs.select(name, F.transform("grams", lambda g, i: F.struct(g.alias("gram"), i.alias(place))).alias("_runs"))

    theirs = placed(benchmark, item, "item_at").select(item, F.inline("_runs"))
    known = known_filter(theirs)
    ours = placed(docs, key, "doc_at").select(key, F.inline(F.filter("_runs", lambda r: _may_be_known(r["gram"], known))))
    hits = ours.join(theirs, "gram").select(key, item, "doc_at", "item_at").distinct()
    diagonal = [key, item, "_diagonal"]
    hits = hits.withColumn("_diagonal", F.col("doc_at") - F.col("item_at"))
    # a diagonal has no more places than the shorter text has words
    island = F.col("doc_at") - F.row_number().over(Window.partitionBy(*diagonal).orderBy("doc_at"))
    spans = hits.withColumn("_island", island).groupBy(*diagonal, "_island").agg(F.min("doc_at").alias("doc_begin"), F.min("item_at").alias("item_begin"), (F.count("*") + n - 1).cast("int").alias("n_words"))
    spans = spans.select(key, item, "doc_begin", "item_begin", "n_words")
    said = lambda df, name, w: df.select(name, words(F.lower(F.col("text"))).alias(w))
    both = spans.join(said(docs, key, "_d"), key).join(said(benchmark, item, "_i"), item)
    same = F.slice("_d", F.col("doc_begin") + 1, F.col("n_words")) == F.slice("_i", F.col("item_begin") + 1, F.col("n_words"))
    return both.where(same).select(*spans.columns).distinct()


def containment(docs: DataFrame, benchmark: DataFrame, prefix: int = 5, key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """(doc_id, item_id): items whose text stands in a document as it is, null and empty ones left out.

    An item's inner words (all but the first and the last, which may be parts of longer words of the document) stand in
    the document as whole words. Candidates share the item's first inner words by hash, up to prefix of them, and the
    texts decide; no pair is compared without that. Items without inner words, of one or two words or none, are looked
    for by their pieces: the first piece ends a word, or lies within a word or a stretch of white space.
    """
    items = _hashed(benchmark.where("text <> ''"), F.col("text"), item, F.col("text").alias("_item")).withColumn("_n", F.least(F.size("_h") - 2, F.lit(prefix)))
    inner = items.where("_n > 0").withColumn("_h", F.slice("_h", F.lit(2), F.col("_n")))
    sizes = sorted(r[0] for r in inner.select("_n").distinct().collect())  # prefix of them at most
    found = docs.select(key).limit(0).crossJoin(items.select(item).limit(0))
    hashed, known = _hashed(docs, F.col("text"), key), None
    for n in sizes:
        hashed = _with_runs(hashed, "_h", n, f"_g{n}")
        one = _with_runs(inner.where(F.col("_n") == n), "_h", n, "_g").select(item, "_item", F.element_at("_g", 1).alias("gram"))
        known = one if known is None else known.unionByName(one)
    if sizes:
        grams = hashed.select(key, F.concat(*[F.col(f"_g{n}") for n in sizes]).alias("grams"))
        pairs = _found(grams, key, known).join(known, "gram").select(key, item, "_item").distinct()
        found = pairs.join(docs.select(key, "text"), key).where(F.contains("text", F.col("_item"))).select(key, item)
    short = items.where("_n <= 0").select(item, "_item")
    if not short.isEmpty():
        found = found.unionByName(_short_items(docs, short, key, item))
    return found.distinct()


def _short_items(docs: DataFrame, short: DataFrame, key: str, item: str) -> DataFrame:
    """Items of one or two words, or of white space alone. Its first piece, a word or all of the white space, lies within
    a word, or a stretch of white space, of a document that holds it. Distinct pieces of all documents are cut into
    every substring of the lengths 1, 2, 4, ... that items' pieces begin with, and joined to these; then documents that
    hold such a piece are compared as they are."""
    some = short.withColumn("_piece", F.coalesce(F.try_element_at(words(F.col("_item")), F.lit(1)), F.col("_item")))
    some = some.withColumn("_size", F.pow(F.lit(2), F.length(F.bin(F.length("_piece"))) - 1).cast("int"))
    some = some.withColumn("_begin", F.substring("_piece", F.lit(1), F.col("_size")))
    lengths = sorted(r[0] for r in some.select("_size").distinct().collect())  # powers of two up to the longest piece
    inside = F.concat(words(F.col("text")), F.filter(F.split("text", r"(?U)\S+"), lambda x: x != ""))
    split = docs.select(key, F.explode(F.array_distinct(inside)).alias("word"))
    cut = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length("word") - k + 1, F.lit(1))), lambda i: F.substring("word", i, F.lit(k)))
    pieces = F.array_distinct(F.flatten(F.array(*[cut(k) for k in lengths])))
    vocabulary = split.select("word").distinct().select("word", F.explode(pieces).alias("_begin"))
    hit = vocabulary.join(some, "_begin").where(F.contains("word", F.col("_piece"))).select("word", item, "_item")
    pairs = split.join(hit, "word").select(key, item, "_item").distinct()
    return pairs.join(docs.select(key, "text"), key).where(F.contains("text", F.col("_item"))).select(key, item)
