"""Operators on documents against brute force, on rows with nulls, ties, repeats and clashing columns."""

import hashlib
import re
from collections import Counter

import public_tokenizers
import pytest
import xxhash
from cases import documents, empty, same
from sieveline.llm import bpe, licenses, mixing, quality, similar, simhash, substring_dedup, token_counts

LAST = (1 << 63) - 1


def removal(rows, window):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - window + 1):
            run, at = tuple(w[k : k + window]), (LAST if i is None else i, k)
            first[run] = min(first.get(run, at), at)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (LAST if i is None else i, k):
                gone.update(range(k, k + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


@pytest.mark.parametrize("window,run", [(20, 3), (4, 2), (3, 3)])
def test_substring_dedup(spark, window, run, monkeypatch):
    df, rows = documents(spark)
    monkeypatch.setattr(substring_dedup, "RUN", run)
    same(substring_dedup.removal_digests(df.repartition(5), window).collect(), removal(rows, window))


def test_substring_dedup_with_frequent_runs(spark, monkeypatch):
    """Copies and a common passage: their runs rank last, and nothing changes."""
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(i, f"a{i} b{i} {passage} c{i} d{i}" if i % 2 else passage) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    same(substring_dedup.removal_digests(df).collect(), removal(rows, 20))


def test_a_passage_in_every_text_travels_once_for_each_task():
    """However many batches a task has, what its buckets get of a common passage stays the same."""
    import numpy as np
    import pyarrow as pa

    passage = [f"p{i}" for i in range(60)]
    words = substring_dedup.Words([" ".join(passage).encode()])
    hot = [int(x) for x in substring_dedup.tuple_hashes(words.hashes(), 3) & ~substring_dedup._HOT]

    def batch(k):
        texts = [" ".join([f"a{k}x{i}", *passage, f"b{k}x{i}"]) for i in range(50)]
        return pa.record_batch({"doc_id": pa.array(np.arange(50) + 50 * k), "tag": pa.array(np.zeros(50, np.int32)), "text": pa.array(texts)})

    def sent(n, order=1):
        rows = [r for out in substring_dedup._packer(20, 3, hot, 8)(iter([batch(k) for k in range(n)][::order])) for r in out.to_pylist()]
        return sum(r["n"] for r in rows if not r["ranges"]), sum(r["n"] for r in rows if r["ranges"])

    own = sent(1)[0] - 50 * 2
    assert [sent(n)[0] - n * 50 * 2 for n in (1, 4, 16)] == [own] * 3 and sent(4, -1) == sent(4)


def test_held_strings_are_released_in_time(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(45))
    rows = [(i, f"a{i} b{i} {passage} c{i}") for i in range(300, 0, -1)] + [(7, f"x {passage}"), (7, f"x {passage} y"), (None, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for size in (1 << 24, 100):
        monkeypatch.setattr(substring_dedup, "HELD_BYTES", size)
        same(substring_dedup.removal_digests(df).collect(), removal(rows, 20))


def test_equal_hashes_of_different_words_are_told_apart(monkeypatch):
    words = substring_dedup.Words([b"a b c d", b"x y z w", b"a b c d", b"x y z w"])
    import numpy as np

    monkeypatch.setattr(substring_dedup, "tuple_hashes", lambda h, n: np.zeros(len(h) - n + 1, np.uint64))
    doc, start = np.arange(4), np.zeros(4, np.int64)
    later = substring_dedup._repeats(words, doc, start, 3, False)
    assert sorted(later.tolist()) == [8, 9, 12, 13]


def test_without_repeats_keeps_columns(spark):
    df, rows = documents(spark)
    out = substring_dedup.without_repeats(df)
    assert out.columns == df.columns and out.count() == len(rows)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())


def test_empty_tables(spark):
    df = empty(spark)
    for f in (
        substring_dedup.removal_digests,
        substring_dedup.without_repeats,
        simhash.near_duplicate_groups,
        similar.similar_groups,
        similar.one_of_each_group,
        mixing.source_mix,
        mixing.mixed_documents,
        quality.quality_report,
        quality.accepted,
        bpe.round_trip_digests,
        token_counts.token_counts,
        licenses.license_matches,
    ):
        assert f(df).collect() == [], f


def fingerprint(text, n=4):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = low.split()
    shingles = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [b" ".join(w)] * bool(w)
    bits = Counter()
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, seed=42)
        bits.update(k for k in range(64) if h >> k & 1)
    return sum(1 << k for k in range(64) if 2 * bits[k] > len(shingles))


def groups(values, radius):
    at = list(range(len(values)))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= radius:
                at[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


def test_simhash(spark):
    df, rows = documents(spark)
    fps = [fingerprint(t) for _, t in rows]
    root = groups(fps, 4)
    least = {}
    for r, (i, _) in zip(root, rows):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    expected = [(i, f"{f:016x}", least.get(r)) for (i, _), f, r in zip(rows, fps, root)]
    same(simhash.near_duplicate_groups(df).collect(), expected)


def shingles(text, n=5):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or frozenset([tuple(w)] * bool(w))


def alike(a, b, least=0.8):
    union = len(a | b)
    return union == 0 or len(a & b) >= least * union


def test_similar_groups(spark):
    """Near copies at and around the threshold, against all pairs."""
    import random

    rng = random.Random(6)
    df, rows = documents(spark, n=30)
    more = []
    for i in range(12):
        base = [f"v{rng.randrange(3000)}" for _ in range(rng.choice((30, 120, 400)))]
        for k in range(5):
            copy = [f"x{rng.randrange(9000)}" if rng.random() < 0.005 * k else w for w in base]
            more.append((1000 + 10 * i + k, " ".join(copy).upper() if k == 1 else "\n".join(copy)))
    rows = rows + more
    extra = spark.createDataFrame([(*r, "en", "s", 1, True, "x", 3, 4, 5, "y", 6) for r in more], df.schema)
    df = df.unionByName(extra)
    sets = [shingles(t) for _, t in rows]
    at = list(range(len(rows)))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                at[find(i)] = find(j)
    want = {}
    for i, (doc, text) in enumerate(rows):
        want.setdefault(find(i), []).append((doc is None, doc, text or ""))
    got = {}
    for r in similar.similar_groups(df).collect():
        got.setdefault(r.root, []).append((r.doc_id is None, r.doc_id))
    plain = lambda groups: sorted(sorted((n, d or 0) for n, d, *_ in g) for g in groups.values())
    mine, theirs = plain(got), plain(want)
    assert len([g for g in theirs if g in mine]) >= 0.97 * len(theirs)
    kept = similar.one_of_each_group(df).collect()
    assert len(kept) == len(got) and kept[0].asDict().keys() == set(df.columns)


@pytest.mark.parametrize("level", [0, 1, 2])
def test_similar_pairs_are_found_at_every_size(spark, level, monkeypatch):
    import random

    rng = random.Random(level)
    rows = []
    for i in range(40):
        base = [f"v{rng.randrange(10**6)}" for _ in range(300)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join("y" if rng.random() < 0.015 else w for w in base))]
    monkeypatch.setattr(similar, "BLOCKS", ((10**9, *similar.BLOCKS[level][1:]),))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    true = sum(alike(shingles(rows[2 * i][1]), shingles(rows[2 * i + 1][1])) for i in range(40))
    root = {r.doc_id: r.root for r in similar.similar_groups(df).collect()}
    found = sum(root[2 * i] == root[2 * i + 1] for i in range(40))
    assert true >= 20 and 0.95 * true <= found <= true and len(set(root.values())) == 80 - found


@pytest.mark.parametrize("blocks,rows", [(5, 1 << 16), (6, 1 << 16), (7, 1 << 16), (8, 1 << 16), (5, 6), (5, 2)])
def test_every_sharding_finds_the_same_groups(spark, blocks, rows, monkeypatch):
    """With any number of blocks, and with large shards that are sharded again."""
    import random

    monkeypatch.setattr(simhash, "SHARD_ROWS", rows)
    rng = random.Random(blocks)
    values = []
    for _ in range(60):
        base = rng.getrandbits(64)
        values += [base] + [base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))) for _ in range(4)]
    values = sorted(set(values))
    monkeypatch.setattr(simhash, "BLOCKS", ((10**9, blocks - 4),))
    df = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    links = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(df).collect()]
    # links of a star may be of any length; the groups must be those of all links
    at = {v: v for v in values}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in links:
        at[find(a)] = find(b)
    mine, theirs = {}, {}
    for v, r in zip(values, groups(values, 4)):
        mine.setdefault(find(v), set()).add(v)
        theirs.setdefault(r, set()).add(v)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_bk_tree_takes_out_what_it_finds():
    tree = simhash.BKTree([0, 1, 3, 255, 1 << 40], 2)
    assert sorted(tree.search(0)) == [0, 1, 2, 4] and tree.search(0) == [] and tree.search(255) == [3]


def test_components_of_a_path(spark):
    from sieveline.llm.components import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7), (200, 200)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}


def test_mix(spark):
    df, rows = documents(spark)
    sources = [r.source for r in df.select("doc_id", "text", "source").collect()]
    sizes = [len((t or "").encode().split()) for _, t in rows]
    total = Counter()
    for s, n in zip(sources, sizes):
        total[s] += n
    names = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes)
    while True:
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * total[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
            free.discard(s)
    for s in free:
        target[s] = left * weight[s] / sum(weight[x] for x in free)
    for block in (3, 256):
        out = mixing.source_mix(df, block)
        got = out.collect()
        same([(r.doc_id, r.size, r.source_size) for r in got], [(i, n, total[s]) for (i, _), n, s in zip(rows, sizes, sources)])
        assert all(0 <= r.taken <= 2 * r.size for r in got)
        taken = Counter()
        for r in got:
            taken[r.target] += r.taken
        want = Counter()
        for s in names:
            want[target[s]] += round(target[s])
        assert {round(k, 6): v for k, v in taken.items()} == pytest.approx({round(k, 6): v for k, v in want.items()}, abs=1)
        same(got, mixing.source_mix(df.repartition(9), block).collect())


def schedule(spark, n=64):
    return spark.createDataFrame([(i, "ab"[i % 2], 1000, 1, hashlib.md5(str(i).encode()).hexdigest()) for i in range(n)], "doc_id long, source string, size long, copies long, hash string")


def test_van_der_corput(spark):
    for bits in (1, 5, 40):
        rows = spark.range(0, 1 << min(bits, 10)).select("id", mixing.van_der_corput(mixing.F.col("id"), bits).alias("x")).collect()
        assert all(r.x == int(f"{r.id:0{bits}b}"[::-1], 2) for r in rows)


def test_schedule_is_spread_out(spark):
    """Any stretch of the schedule holds about the source's share of slots."""
    _, _, mix = mixing.mix_plan(schedule(spark), 100)
    slots = [r.ord for r in mix.orderBy("slot").collect()]
    share = slots.count(1) / len(slots)
    assert all(abs(slots[i : i + 64].count(1) / 64 - share) < 0.1 for i in range(0, len(slots) - 64, 16))


def test_the_points_decide_what_is_taken(spark, monkeypatch):
    """With points that are all the same, only the first source has slots."""
    right = {r.doc_id: (r.source, r.taken) for r in mixing.taken_words(schedule(spark), 100).collect()}
    assert all(t > 0 for s, t in right.values() if s == "a") and any(t > 0 for s, t in right.values() if s == "b")
    monkeypatch.setattr(mixing, "van_der_corput", lambda i, bits: mixing.F.lit(0).cast("long"))
    wrong = {r.doc_id: (r.source, r.taken) for r in mixing.taken_words(schedule(spark), 100).collect()}
    assert wrong != right and all(t == 0 for s, t in wrong.values() if s == "b")


def test_mix_word_by_word(spark):
    """Taken words against the schedule played slot by slot."""
    df, _ = documents(spark)
    docs = [(r.doc_id, r.source, len((r.text or "").encode().split()), hashlib.md5(f"{'' if r.doc_id is None else r.doc_id}:{hashlib.md5((r.text or '').encode()).hexdigest()}".encode()).hexdigest()) for r in df.collect()]
    got = mixing.source_mix(df, 16).collect()
    target = {}
    for r, d in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id, r.size)), sorted(docs, key=lambda d: (d[0] is None, d[0], d[2]))):
        target[d[1]] = r.target
    names = sorted(target, key=lambda s: (s is None, (s or "").encode()))
    streams = {s: [d for d in sorted(docs, key=lambda d: d[3]) if d[1] == s for _ in range(d[2])] for s in names}
    need, line = {s: round(target[s]) for s in names}, []
    for s in names:
        n = len(streams[s])
        line += [s] * (need[s] // n * -(-n // 16) + -(-(need[s] % n) // 16) if n else 0)
    bits, rank, taken, slots = (len(line) - 1).bit_length(), Counter(), Counter(), {}
    for i in range(1 << bits):
        at = int(f"{i:0{bits}b}"[::-1], 2)
        if at >= len(line):
            continue
        s, stream = line[at], streams[line[at]]
        blocks = [stream[k : k + 16] for k in range(0, len(stream), 16)]
        block = blocks[rank[s] % len(blocks)]
        before = rank[s] // len(blocks) * len(stream) + rank[s] % len(blocks) * 16
        rank[s] += 1
        for d in block[: need[s] - before]:
            taken[d] += 1
            slots.setdefault(d, set()).add(i)
    assert sum(taken.values()) == sum(need.values())
    mine = Counter()
    for d in set(docs):
        n = docs.count(d)
        mine.update([(d[0], d[2], taken[d] // n + (k < taken[d] % n), min(slots.get(d, {None})), max(slots.get(d, {None}))) for k in range(n)])
    assert mine == Counter((r.doc_id, r.size, r.taken, r.first_slot, r.last_slot) for r in got)


def test_equal_rows_are_counted_before_chunks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 8)
    rows = [(1, "one two three", "a")] * 50 + [(i, f"w{i} x y z", "ab"[i % 2]) for i in range(2, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert mixing._rows(df).agg(mixing.F.max("copies")).first()[0] == 8
    out = mixing.source_mix(df, 4).collect()
    assert len(out) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in out)
    for s in ("a", "b"):
        own = [r for r in out if (r.doc_id == 1 or r.doc_id % 2 == 0) == (s == "a")]
        assert sum(r.taken for r in own) == round(own[0].target)


def test_mixed_documents_are_in_order_of_the_schedule(spark, tmp_path):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(40)), "abc"[i % 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = {r.doc_id: r for r in mixing.source_mix(df, 8).collect()}
    out = mixing.mixed_documents(df, 8).collect()
    seen, places = Counter(), []
    for r in out:
        places.append(first[r.doc_id].last_slot if seen[r.doc_id] else first[r.doc_id].first_slot)
        seen[r.doc_id] += 1
    assert places == sorted(places)
    assert seen == Counter({i: n for i, r in first.items() if (n := int(r.taken / r.size + 0.5))})


def test_mixed_documents_keep_columns(spark):
    df, _ = documents(spark)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    assert max(Counter(r.doc_id for r in out.where("doc_id < 7").collect()).values()) <= 2


def test_quality_figures(spark):
    df, rows = documents(spark)

    def figures(t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        runs = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n, covered = Counter(runs), set()
        for i, r in enumerate(runs):
            if n[r] > 1:
                covered |= {i, i + 1, i + 2}
        base = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), base

    got = quality.quality_report(df).collect()
    same([tuple(r)[:7] for r in got], [(i, *figures(t)) for i, t in rows])
    assert all(r.kept == (not r.base_failed and not r.failed) for r in got)
    kept = quality.accepted(df)
    assert kept.columns == df.columns and kept.count() == sum(r.kept for r in got)


def test_thresholds_are_a_parameter(spark):
    df = spark.createDataFrame([(1, "word " * 5 + " ".join(f"u{i}" for i in range(60)))], "doc_id long, text string")
    assert quality.quality_report(df, ()).first().kept
    assert quality.quality_report(df, (("symbols", "n_symbols / n_words", 0.5, None),)).first().failed == ["symbols"]


def test_bpe_round_trip(spark):
    df, rows = documents(spark)
    enc = bpe.encoding(public_tokenizers.path(bpe.RANKS))

    def digests(t):
        ids = enc.encode_ordinary(t or "")
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    expected = [(i, *digests(t)) for i, t in rows]
    same(bpe.round_trip_digests(df).collect(), expected)
    same(bpe.round_trip_digests(df, part_chars=11).collect(), expected)
    back = bpe.decoded(bpe.encoded(df)).collect()
    same([(r.doc_id, None if r.bytes is None else bytes(r.bytes).decode()) for r in back], rows)


def test_safe_parts_are_safe():
    import random

    enc, rng = bpe.encoding(public_tokenizers.path(bpe.RANKS)), random.Random(5)
    for _ in range(2000):
        text = "".join(rng.choice("ab 's\n\t1,.!é漢́ 　") for _ in range(rng.randrange(80)))
        assert "".join(bpe.safe_parts(text, 7)) == text
        assert [i for p in bpe.encode_parts(enc, text, rng.randrange(1, 12)) for i in p] == enc.encode_ordinary(text)


def test_token_counts_and_cache(spark, tmp_path):
    from tokenizers import Tokenizer

    df, rows = documents(spark)
    t = Tokenizer.from_file(public_tokenizers.path(token_counts.TOKENIZER))
    n = [len(t.encode(x or "", add_special_tokens=False).ids) for _, x in rows]
    expected = [(i, len((x or "").encode()), k, k > 2048) for (i, x), k in zip(rows, n)]
    cache = f"file://{tmp_path}/cache"
    same(token_counts.token_counts(df, cache).collect(), expected)
    stored = spark.read.parquet(cache)
    before = stored.count()
    assert before == stored.select("digest").distinct().count()
    same(token_counts.token_counts(df, cache).collect(), expected)
    assert spark.read.parquet(cache).count() == before  # nothing was encoded again
    more = df.unionByName(df.limit(1).withColumn("text", token_counts.F.lit("brand new text")))
    assert token_counts.token_counts(more, cache).count() == len(rows) + 1
    assert spark.read.parquet(cache).count() == before + 1


def test_pieces_count_like_whole_texts():
    import random

    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path(token_counts.TOKENIZER), random.Random(2)
    t, counter = Tokenizer.from_file(path), token_counts.PieceCounter(path, memory=50)
    parts = ["a", "B", " ", "\n", " ", "́", "É", "<|endoftext|>", "<|ENDOFTEXT|>", "İ", "Σ", "'s", "1", "한", "ᄀ", "\x85", "\x1c"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert counter.count(text) == len(t.encode(text, add_special_tokens=False).ids), repr(text)


def test_licenses(spark):
    rows = [
        (1, "Copyright (c) 2024 Someone\n\n# mit LICENCE\n" + licenses.MIT[11:].upper().replace("\n", "\n * ")),
        (2, None),
        (3, "  released UNDER the MIT licence"),
        (4, ""),
        (4, ""),
        (5, "prose\nLicensed under the Apache License, Version 2.0.\nmore\nLicensed under CC BY-NC 4.0."),
        (6, licenses.MIT + " and then some"),
        (None, licenses.ZLIB),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, digest string, _row string")
    expected = [(1, "MIT", []), (2, None, []), (3, "MIT", ["MIT"]), (4, None, []), (4, None, []), (5, None, ["Apache-2.0", "CC-BY-NC-4.0"]), (6, None, []), (None, "Zlib", [])]
    got = licenses.license_matches(df)
    same([(r.doc_id, r.license_id, r.line_licenses) for r in got.collect()], expected)
    none = spark.createDataFrame([], "license_id string, text string")
    assert all(r.license_id is None and r.line_licenses == [] for r in licenses.license_matches(df, none).collect())


def canonical(text):
    """The canonical form, word by word."""
    import regex

    low = (text or "").lower()
    low = re.sub(r"(?m)^[^\w\n©]*(?:(?:copyright|\(c\)|©)\s*(?:\(c\)|©|\d{4}|by\b|<|\[)[^\n]*|all rights reserved\.?[ \t]*)$", " ", low)
    words = [w for w in regex.split(r"[^\p{L}\p{N}]+", low) if w]
    table = {old: new for old, new in licenses.SPELLINGS if re.fullmatch("[a-z]+", old)}
    words = [table.get(w) or (w[-1:] == "s" and w[:-1] in table and table[w[:-1]] + "s") or w for w in words]
    pairs = {("sub", "license"): ["sublicense"], ("copyright", "owner"): ["copyright", "holder"], ("non", "commercial"): ["noncommercial"], ("per", "cent"): ["percent"]}
    out, i = [], 0
    while i < len(words):
        two = tuple(words[i : i + 2])
        one = tuple(w[:-1] if k and w[-1:] == "s" else w for k, w in enumerate(two))
        if two in pairs or one in pairs:
            new = pairs.get(two) or pairs[one]
            out += [*new[:-1], new[-1] + ("" if two in pairs else "s")]
            i += 2
        else:
            out.append(words[i])
            i += 1
    return " ".join(out)


ODD = [
    "the copyright\nowner and the copyright holder",
    "per\ncent, PER CENT; per cents",
    "programmer programmes programme sublicence",
    "sub-license sub licences licence licence licence",
    "copyright owner copyright owner copyright owners",
    "non-commercial\n* Copyright 2020 Me\nAll rights reserved.\nÉlicence licenceé",
    "https://x/ httpss",
    " ",
]


def test_canonical_form(spark):
    texts = [*ODD, None, "", *(t for _, t in licenses.KNOWN), "word " * 30_000 + "licence"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = dict(df.select("i", licenses.canonical(licenses.F.col("text")).alias("c")).collect())
    assert [got[i] for i in range(len(texts))] == [canonical(t) for t in texts]
    assert got[0] == "the copyright holder and the copyright holder" and got[2].startswith("programmer programs program")


def wrapped(text, width):
    import textwrap

    return "\n".join(" # " + line for p in text.split("\n") for line in textwrap.wrap(p, width))


def test_wrapped_licences_match(spark, monkeypatch):
    """Whole licences with other line breaks, in both ways, on rows in any order."""
    rows = [(i, wrapped(text, width)) for i, (text, width) in enumerate((t, w) for t in (licenses.MIT, licenses.ISC, licenses.BSD_2, licenses.ZLIB) for w in (20, 33, 79))]
    rows += [(100 + i, f"line {i}\nReleased under the MIT License.\n" + "x\n" * i) for i in range(40)] + [(None, "SPDX-License-Identifier: MIT")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    small = licenses.license_matches(df).collect()
    assert {r.license_id for r in small if r.doc_id is not None and r.doc_id < 12} == {"MIT", "ISC", "BSD-2-Clause", "Zlib"}
    assert all(r.line_licenses == ["MIT"] for r in small if r.doc_id is None or r.doc_id >= 100)
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", 0)
    same([(*r[:3], tuple(r[3])) for r in licenses.license_matches(df).collect()], [(*r[:3], tuple(r[3])) for r in small])


def test_license_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "My License-1.0.txt").write_text("You may do\nwhat you like.")
    (tmp_path / "sub" / "Other-2").write_text("You may not.")
    known = licenses.license_folder(spark, f"file://{tmp_path}")
    same(known.collect(), [("My License-1.0", "You may do\nwhat you like."), ("Other-2", "You may not.")])
    df = spark.createDataFrame([(1, "you MAY do what: you like"), (2, "a\nyou may not\n")], "doc_id long, text string")
    same([(r.doc_id, r.license_id, tuple(r.line_licenses)) for r in licenses.license_matches(df, known).collect()], [(1, "My License-1.0", ("My License-1.0",)), (2, None, ("Other-2",))])


def test_licenses_by_shuffled_join(spark, monkeypatch):
    df = spark.createDataFrame([(1, "Released under the MIT License."), (2, "prose\nLicensed under CC BY 4.0.")], "doc_id long, text string")
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", 0)
    same([(r.doc_id, r.license_id, tuple(r.line_licenses)) for r in licenses.license_matches(df).collect()], [(1, "MIT", ("MIT",)), (2, None, ("CC-BY-4.0",))])


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_tokens_that_span_white_space_are_counted_whole(spark, tmp_path, name):
    path = public_tokenizers.path(name)
    assert not token_counts.counts_by_piece(path) and token_counts.counts_by_piece(public_tokenizers.path(token_counts.TOKENIZER))
    if name.endswith(".model"):
        import sentencepiece

        count = lambda x: len(sentencepiece.SentencePieceProcessor(model_file=path).encode(x))
    else:
        from tokenizers import Tokenizer

        count = lambda x: len(Tokenizer.from_file(path).encode(x, add_special_tokens=False).ids)
    rows = [(0, "a  b\n\n\nc"), (1, "a b c"), (2, " a b c "), (3, None), (4, ""), (5, "x    y\t\tz <|endoftext|> q")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cache = f"file://{tmp_path}/cache"
    want = [(i, len((x or "").encode()), count(x or ""), count(x or "") > 6) for i, x in rows]
    same(token_counts.token_counts(df, cache, path, limit=6).collect(), want)
    same(token_counts.token_counts(df, cache, path, limit=6).collect(), want)


def test_rewrapped_and_respelled_licences(spark):
    """Whole public texts where the machine has them: wrapped anew, in other case, as comments, with other spellings."""
    import pathlib
    import textwrap

    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "BSD": "BSD-3-Clause"}
    folder = pathlib.Path("/usr/share/common-licenses")
    there = {n: i for n, i in names.items() if (folder / n).exists()}
    if not there:
        pytest.skip("no licence texts on this machine")
    rows, want = [], {}
    for n, i in there.items():
        text = (folder / n).read_text(encoding="utf-8")
        # copyright lines stay lines of their own
        paragraphs = [p if re.search(r"(?im)^\W*copyright", p) else textwrap.fill(p, 50, break_long_words=False, break_on_hyphens=False) for p in text.split("\n\n") if p.strip()]
        for t, same in ((text, True), ("\n\n".join(paragraphs), True), (text.upper(), True), ("\n".join(f"# {x}" for x in text.splitlines()), True), (re.sub(r"\borganization\b", "organisation", re.sub(r"\blicense\b", "licence", text)), True), (text.replace("software", "hardware", 1).replace("Work", "Play", 1).replace("program", "poem", 1), False)):
            want[len(rows)] = i if same else None
            rows.append((len(rows), t))
    got = {r.doc_id: r.license_id for r in licenses.license_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: v for k, v in got.items() if v != want[k]} == {}


def test_every_query_is_registered():
    import __spark_entry__ as e
    from sieveline.llm import queries

    names = [f"op{n}_" for n in range(1, 14)]
    assert all(sum(q.startswith(n) for q in queries.queries()) == 1 for n in names)
    assert set(queries.queries()) <= set(e.queries()) and set(queries.oracle_sql()) <= set(e.oracle_sql()) and "pipeline" in e.queries()


def test_fingerprints_that_agree_in_half_their_bits(spark, monkeypatch):
    """Shards of the bits they share hold all of them, until so many blocks must agree that others are among them."""
    import random

    monkeypatch.setattr(simhash, "SHARD_ROWS", 300)
    rng = random.Random(3)
    values = {0xABCD1234 << 32 | rng.getrandbits(32) for _ in range(1500)}
    values |= {v ^ (1 << rng.randrange(32)) ^ (1 << rng.randrange(32)) for v in list(values)[:200]}
    values = sorted(values)
    df = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    found = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(df).collect()]
    root = {v: v for v in values}

    def find(x, at):
        while at[x] != x:
            x = at[x]
        return x

    other = dict(root)
    for a, b in found:
        root[find(a, root)] = find(b, root)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= simhash.RADIUS:
                other[find(a, other)] = find(b, other)
    same([(v, min(x for x in values if find(x, root) == find(v, root))) for v in values[:300]], [(v, min(x for x in values if find(x, other) == find(v, other))) for v in values[:300]])
