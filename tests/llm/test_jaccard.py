"""The light and heavy join against all pairs, whichever sets are light and however lists are dealt."""

import random
import time

import numpy as np
import pytest
from cases import documents, empty, same
from sieveline.llm import jaccard, queries
from test_documents import alike, shingles


def by_hand(rows):
    """doc_id, n_shingles, component_id of (doc_id, text) rows, from all pairs."""
    sets, at = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and alike(sets[i], sets[j]):
                at[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def edited(rng, words, n):
    """words with n of them replaced, deleted or inserted."""
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        words[at : at + (kind < 2)] = [] if kind == 1 else [f"e{rng.randrange(10**6)}"]
    return words


def texts(seed):
    """Copies with other spaces, edits of some originals by a few words each, short notices, and texts with a common part."""
    rng, out = random.Random(seed), []
    common = [f"c{i}" for i in range(40)]
    for size in (1, 2, 4, 5, 6, 7, 8, 9, 12, 20, 40, 90, 250, 700):
        base = [f"b{size}x{rng.randrange(500)}" for _ in range(size)]
        out += [" ".join(base), "  ".join(base).upper(), "\n".join(base)]
        out += [" ".join(edited(rng, base, rng.randrange(1, 2 + size // 25))) for _ in range(6)]
        out.append(" ".join(common + base))
    out += [" ".join([*common, *(f"u{i}x{k}" for k in range(rng.randrange(1, 9)))]) for i in range(25)]
    out += [" ".join([*common[:6], f"n{i}"]) for i in range(12)]
    out += [None, "", "  ", None]
    rng.shuffle(out)
    return list(enumerate(out, 10))


@pytest.mark.parametrize("cost, stars, rounds, list_rows", [(40, 4, 4, 4096), (0, 0, 0, 4096), (10**9, 0, 0, 4096), (0.05, 0, 0, 5), (10**9, 4, 1, 3)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, cost, stars, rounds, list_rows):
    """Also where nothing is contracted first, and everything is left to the join."""
    for name, value in (("SUBSET_COST", cost), ("STARS", stars), ("FEW", 4 if stars else 0), ("ROUNDS", rounds), ("LIST_ROWS", list_rows)):
        monkeypatch.setattr(jaccard, name, value)
    for seed in (1,):
        rows = texts(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        same(jaccard.jaccard_components(df).collect(), by_hand(rows))


def test_odd_rows(spark):
    df, rows = documents(spark, seed=4)
    same(jaccard.jaccard_components(df.repartition(6)).collect(), by_hand(rows))
    assert jaccard.jaccard_components(empty(spark)).collect() == []


def test_one_shingle_in_very_many_heads(spark, monkeypatch):
    """Each text is one common shingle and a few of its own: none is similar to another, but for two pairs."""
    monkeypatch.setattr(jaccard, "LIST_ROWS", 64)
    rows = [(i, f"a b c d e {i}x {i}y") for i in range(1500)]
    rows += [(2000, "a b c d e 7x 7y 7z"), (2001, "k " + " ".join(f"m{k}" for k in range(90))), (2002, " ".join(f"m{k}" for k in range(90)))]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    want = {i: i for i, _ in rows} | {2002: 2001}
    assert {i: c for i, c in got.items() if want[i] != c} == {}


def test_the_boundary_is_the_cheapest():
    rng = random.Random(5)
    for _ in range(200):
        light = {c: rng.randrange(1000) for c in rng.sample(range(12), 6)}
        heavy = {c: rng.randrange(20_000) for c in rng.sample(range(12), 6)}
        total = lambda b: sum(20 * n for c, n in light.items() if c <= b) + sum(n for c, n in heavy.items() if c > b)
        assert total(jaccard.cheapest_boundary(light, heavy, 20)) == min(total(b) for b in range(-1, 12))


def test_folded_sketches_are_those_of_half_the_length():
    """And 32 MB of them take some tenths of a second; bit by bit it was four."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 64, n, np.uint64)) for n in (0, 1, 50, 3000, 9000)]
    for size in (8, 9, 13, 17):
        longer = jaccard._Sketches([jaccard._sketch(s, size).tobytes() for s in sets])
        assert (longer._folded(1 << size - 3) == np.stack([jaccard._sketch(s, size - 1) for s in sets])).all()
    many = jaccard._Sketches([x.tobytes() for x in rng.integers(0, 256, (1 << 13, 1 << 12), np.uint8)])
    began = time.process_time()
    assert many._folded(1 << 12).shape == (1 << 13, 1 << 11)
    assert time.process_time() - began < 2


def test_query_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    same(queries.queries()["op13_jaccard_join"](spark, sf).collect(), by_hand(rows))
