"""Vector codes and importance resampling against brute force."""

import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from cases import documents, empty, same
from sieveline.llm import queries, resampling, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int, part binary, position int, error string"


def codes_by_hand(rows):
    """vec_id, code, error, label_error, digest of (vec_id, embedding, label) rows, with Python's integers."""
    kept = [(i, [math.floor(1024 * x) for x in v], c) for i, v, c in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for dim in {len(v) for _, v, _ in kept}:
        d = -(-dim // 4)
        some = [(i, [(v + [0] * 3)[k * d : k * d + d] for k in range(4)], c) for i, v, c in kept if len(v) == dim]
        packed = {id(r): [vector_codes._pack(np.array(p, np.int64)) for p in r[1]] for r in some}
        first = sorted(some, key=lambda r: (r[0] is None, r[0] or 0, packed[id(r)]))[:256]
        books = [[r[1][k] for r in first] for k in range(4)]
        for step in range(5):
            got = []
            for _, parts, _ in some:
                far = [[sum((a - b) ** 2 for a, b in zip(p, e)) for e in book] for p, book in zip(parts, books)]
                got.append([(min(f), f.index(min(f))) for f in far])
            for k in range(4) if step < 4 else ():
                for e in range(len(first)):
                    mine = [r[1][k] for r, g in zip(some, got) if g[k][1] == e]
                    if mine:
                        books[k][e] = [sum(x) // len(mine) for x in zip(*mine)]
        digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
        out += [(r[0], "".join(f"{e:02x}" for _, e in g), sum(f for f, _ in g), r[2], digest) for r, g in zip(some, got)]
    return [(i, code, error, sum(e for _, _, e, c, _ in out if c == label), digest) for i, code, error, label, digest in out]


def vectors(seed=3, n=330):
    rng = random.Random(seed)
    rows = [(i * 3 % 1000, [rng.choice((rng.gauss(0, 1), 0.25, -0.5)) for _ in range(8)], rng.choice((0, 1, None))) for i in range(n)]
    rows += [(2000 + i, [0.0] * 8, 0) for i in range(100)]  # one vector many times
    rows += [(5, None, 1), (6, [1.0, None, *[0.0] * 6], 1), (7, [float("nan")] * 8, 1), (8, [float("inf"), *[0.0] * 7], 0), (None, [0.5] * 8, None), (None, [0.25] * 8, None)]
    rows += [(9, [3.0e5] * 8, 2), (9, [-3.0e5] * 8, 2), rows[0], rows[0]]
    return rows + [(3000 + i, [float(i), 1.0, -1.5], 3) for i in range(4)] + [(4000, [], 4)]


def test_codes_are_those_by_hand(spark):
    rows = vectors()
    df = spark.createDataFrame([(*r, b"x", 1, "e") for r in rows], VECTORS).repartition(5)
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], c) for i, v, c in rows]
    same(vector_codes.code_report(df).collect(), codes_by_hand(exact))
    assert vector_codes.code_report(df.limit(0)).collect() == []


def test_nearest_is_exact_at_any_size():
    x = np.array([[2**40, -(2**40)], [2**62, 5]], np.int64)
    book = np.array([[0, 0], [2**40 + 1, -(2**40)], [2**40 - 1, -(2**40)], [2**62, 2]], np.int64)
    codes, errors = vector_codes.nearest(x, book)
    assert codes.tolist() == [1, 3] and errors.tolist() == [1, 9]


def test_decoded_vectors_have_the_error_stated(spark):
    rows = [(i, v, c) for i, v, c in vectors() if v is not None and len(v) == 8 and i in range(10, 900)]
    df = spark.createDataFrame([(*r, b"x", 1, "e") for r in rows], VECTORS)
    coded, books = vector_codes.compressed(df, entries=16)
    got = {(r.vec_id, r.error): r.vector for r in vector_codes.decode(coded, books).collect()}
    for (i, error), v in got.items():
        mine = [[math.floor(1024 * float(np.float32(x))) for x in e] for j, e, _ in rows if j == i]
        assert any(round(sum((a - b * 1024) ** 2 for a, b in zip(m, v))) == error for m in mine)
    with pytest.raises(ValueError):
        vector_codes.compressed(df, entries=257)


def features(text, longest=1):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = "".join(c if c in "0123456789abcdefghijklmnopqrstuvwxyz" or ord(c) > 127 else " " for c in lower).split(" ")
    words = [w for w in words if w]
    return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def resampled_by_hand(rows, target, buckets=10_000, longest=1, least=20, percent=10):
    held = [(i, *features(t, longest)) for i, t in rows]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for f in (f for _, _, fs in held for f in fs):
        s[bucket(f)] += 1
    for f in (f for text in target for f in features(text, longest)[1]):
        t[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out = []
    for i, n, fs in held:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in fs)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for place, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = place + 1
    return [tuple(r[:5]) for r in out]


@pytest.mark.parametrize("longest, percent", [(1, 10), (3, 60)])
def test_resampling_by_hand(spark, longest, percent):
    df, rows = documents(spark, seed=8)
    target = ["w1 w2 W3-w4 日本", None, "", "w1 w1 the é"]
    aim = spark.createDataFrame([(i, t, 1) for i, t in enumerate(target)], "item_id long, text string, ids int")
    got = resampling.resampled(df.repartition(7), aim, longest=longest, percent=percent).collect()
    same(got, resampled_by_hand(rows, target, longest=longest, percent=percent))
    assert resampling.resampled(empty(spark), aim).collect() == []
    same(resampling.resampled(df, aim.limit(0)).collect(), resampled_by_hand(rows, []))
    taken = resampling.sample(df, aim, percent=percent)
    assert taken.columns == [*df.columns, "_drawn"] and taken.count() >= 1


def test_crc_of_spans():
    rng = random.Random(2)
    spans = [bytes(rng.randrange(256) for _ in range(rng.choice((0, 1, 2, 9, 31, 32, 33, 5000)))) for _ in range(200)]
    ends = np.cumsum([len(x) for x in spans])
    starts = ends - np.array([len(x) for x in spans])
    assert resampling.crc32(np.frombuffer(b"".join(spans), np.uint8), starts, ends).tolist() == [zlib.crc32(x) for x in spans]


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_importance_resampling"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    out = queries.queries()[name](spark, "/root/testdata/sf0.001")
    r = con.execute(queries.oracle_sql()[name])
    same(out.select([c[0] for c in r.description]).collect(), r.fetchall())
