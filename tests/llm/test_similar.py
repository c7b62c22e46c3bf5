"""Groups of similar documents against all pairs, where the first links miss some."""

import random

import pytest
from sieveline.llm import similar
from test_documents import alike, shingles


def partition(labels):
    out = {}
    for i, x in labels.items():
        out.setdefault(x, set()).add(i)
    return sorted(map(sorted, out.values()))


def all_pairs(rows):
    sets, at = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and alike(sets[i], sets[j]):
                at[find(i)] = find(j)
    return partition({rows[i][0]: find(i) for i in range(len(rows))})


def grouped(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return partition({r.doc_id: r.root for r in similar.similar_groups(df).collect()})


def test_edits_of_one_original_are_one_group(spark):
    rng = random.Random(1)
    base = [f"v{rng.randrange(10**6)}" for _ in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 301):
        edited = list(base)
        for k in rng.sample(range(0, 300, 10), 6):
            edited[k + 4] = f"e{i}x{k}"
        rows.append((i, " ".join(edited)))
    sets = [shingles(t) for _, t in rows]
    assert all(alike(sets[0], s) for s in sets) and not alike(sets[1], sets[2])
    assert grouped(spark, rows) == [list(range(301))]


def altered(rng, base, kind, share):
    """base with a stretch appended, cut off or replaced."""
    n = round(len(base) * share)
    new = [f"n{rng.randrange(10**9)}" for _ in range(n)]
    at = rng.randrange(len(base) - n)
    return {"appended": base + new, "cut": base[: len(base) - n], "replaced": base[:at] + new + base[at + n :]}[kind]


def stretches(seed, kind):
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        base = [f"v{rng.randrange(10**6)}" for _ in range(rng.choice((60, 200, 400)))]
        share = rng.uniform(0.02, 0.12) if kind == "replaced" else rng.uniform(0.15, 0.26)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(altered(rng, base, kind, share)))]
    return rows


@pytest.mark.parametrize("kind", ["appended", "cut", "replaced"])
def test_differing_stretches_at_the_threshold(spark, kind):
    rows = stretches(3, kind)
    want = all_pairs(rows)
    assert 20 <= sum(len(g) == 2 for g in want) < 60
    assert grouped(spark, rows) == want


def test_shared_passages_and_short_texts(spark):
    """Common shingles come last in the order; texts with one shingle, of a few words or none take part."""
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, passage + " " + " ".join(f"v{rng.randrange(10**6)}" for _ in range(rng.choice((3, 8, 13, 40))))) for i in range(250)]
    rows += [(1000 + i, " ".join(["One two three four five six"[: rng.randrange(28)], *["x"] * rng.randrange(3)])) for i in range(60)]
    rows += [(2000 + i, t) for i, t in enumerate([None, "", " ", "\n\t", "a", "A", "a b", "A  B"])]
    assert grouped(spark, rows) == all_pairs(rows)


@pytest.mark.parametrize("level", [0, 1, 2])
def test_groups_are_the_same_at_every_size(spark, level, monkeypatch):
    """The choice of blocks, by the number of texts, changes nothing in the result: synthetic pairs and a whole table."""
    monkeypatch.setattr(similar, "BLOCKS", ((10**9, *similar.BLOCKS[level][1:]),))
    rows = stretches(5, "appended")
    assert grouped(spark, rows) == all_pairs(rows)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(100_000 + i, t) for i, t in rows] + [tuple(r) for r in docs.collect()]
    assert grouped(spark, rows) == whole_table(rows)


TABLE = []


def whole_table(rows):
    if not TABLE:
        TABLE.append(all_pairs(rows))
    return TABLE[0]


def test_a_bridge_between_texts_that_are_not_similar(spark):
    """Three texts within the radius of each other, of which one pair only is similar enough."""
    rng = random.Random(3)
    base = [f"v{rng.randrange(10**6)}" for _ in range(200)]
    near = ["x" if k in (40, 120) else w for k, w in enumerate(base)]
    far = ["y" if k in (4, 25, 45, 66, 86, 106, 130, 165) else w for k, w in enumerate(base)]
    rows = [(0, " ".join(far)), (1, " ".join(base)), (2, " ".join(near))]
    a, b, c = (shingles(t) for _, t in rows)
    assert alike(b, c) and not alike(a, b) and not alike(a, c)
    for order in ((0, 1, 2), (2, 0, 1), (1, 2, 0)):
        assert grouped(spark, [(k, rows[i][1]) for k, i in enumerate(order)]) == sorted([[order.index(0)], sorted(order.index(i) for i in (1, 2))])


def test_clashing_names_stay(spark):
    df = spark.createDataFrame([(i, "one two three four five six " + str(i // 2), *range(6)) for i in range(6)], "doc_id long, text string, w0 int, key int, root int, size int, head int, gram int")
    kept = similar.one_of_each_group(df).collect()
    assert [r.doc_id for r in sorted(kept)] == [0, 2, 4] and all(tuple(r)[2:] == tuple(range(6)) for r in kept)


def test_order_of_shingles_is_counted_over_all_texts(spark, monkeypatch):
    seen, count = [], similar.levels

    def counted(docs, n):
        seen.append(docs.count())
        return count(docs, n)

    monkeypatch.setattr(similar, "levels", counted)
    docs = spark.createDataFrame([(i, f"text number {i} of some words that differ {i * i}") for i in range(40)], "doc_id long, text string")
    assert similar.similar_groups(docs).count() == 40 and seen == [40]
