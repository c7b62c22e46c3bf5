"""Rows that operators must handle: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, _ranges string, size int, fp long, ord int, digest string, _row int"


def documents(spark, seed=0, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["the", "é", "日本", "a b", "###", "<|endoftext|>", "İ", "'s"]
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice((0, 1, 3, 19, 20, 21, 60, 200)))]
        text = "".join(w + rng.choice((" ", "\n", "  ", "\t", "\x0b")) for w in words)
        if i % 5 == 0:
            text += passage
        if i % 7 == 0 and rows:
            text = rows[rng.randrange(len(rows))][1]
        rows.append((i, text, "en", rng.choice(["src1", "src2", None, "é"]), None if text is None else len(text)))
    rows.append((500, " ".join(rng.choice(vocabulary) for _ in range(5000)) + "x" * 3000, None, "src1", None))
    rows.append((501, None, None, None, None))
    rows.append((502, "", "en", "src1", 0))
    rows.append((None, passage + " tail", "en", "src2", 3))
    rows.append((None, passage + " tail", "en", "src2", 3))
    rows.append((7, passage, "en", "src2", 3))  # an id that occurs again, with another text
    rows.append(rows[20])
    rows.append(rows[20])
    full = [(*r, True, "x", 3, 4, 5, "y", 6) for r in rows]
    return spark.createDataFrame(full, SCHEMA), [r[:2] for r in rows]


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(a, b):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a, b = sorted(map(tuple, a), key=key), sorted(map(tuple, b), key=key)
    assert a == b, [(x, y) for x, y in zip(a, b) if x != y][:3]
