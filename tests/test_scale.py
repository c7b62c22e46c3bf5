"""Operators that are made for sizes at which one task can't hold a group: quantiles, places, corrections, bootstrap, spans."""

import math
import os
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from sieveline.functions import stats, text
from sieveline.operators import bootstrap, collate, evaluate, generate, leakage, models, pairs, qc, quantiles, ranking, step_up
from sieveline.plans import catalog
from sieveline.sources import files, snapshots
from sieveline.streaming import dedup as streaming


def quantile(values, p):
    v = sorted(values, key=lambda x: (math.isnan(x), x))
    at = p * (len(v) - 1)
    low, high = v[math.floor(at)], v[math.ceil(at)]
    return low if low == high or math.isnan(low) else low * (math.ceil(at) - at) + high * (at - math.floor(at))


@pytest.mark.parametrize("fine", [1 << 16, 3])
def test_quantiles_by_hand(spark, monkeypatch, fine):
    monkeypatch.setattr(quantiles, "FINE", fine)
    rng, inf, nan = random.Random(3), float("inf"), float("nan")
    groups = {
        "spread": [rng.choice((-1, 1)) * math.exp(rng.uniform(-200, 200)) for _ in range(800)],
        "near": [1000 + rng.random() * 1e-9 for _ in range(500)],
        "ties": [rng.choice((0.0, -0.0, 1.0, 5.0)) for _ in range(300)],
        "odd": [inf, -inf, nan, 5e-324, -5e-324, 1.7e308, 0.0, nan, inf],
        "one": [7.0],
        None: [float(i) for i in range(101)],
    }
    rows = [(g, x, 1) for g, v in groups.items() for x in v] + [("one", None, 1), ("none", None, 1)]
    rng.shuffle(rows)
    ps = (0.0, 0.013, 0.25, 0.5, 0.95, 1.0)
    df = spark.createDataFrame(rows, "g string, x double, _v int").repartition(5)
    out = quantiles.exact_quantiles(df, F.col("x"), ps, ["g"])
    got = {r.g: r.quantiles for r in out.collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        for have, p in zip(got[g], ps):
            want = quantile(v, p)
            assert (math.isnan(have) and math.isnan(want)) or have == pytest.approx(want, rel=1e-12), (g, p)
    every = quantiles.exact_quantiles(df.where("x < 1e300"), F.col("x"), (0.5,)).first().quantiles[0]
    assert every == pytest.approx(quantile([x for _, x, _ in rows if x is not None and x < 1e300], 0.5))
    assert quantiles.exact_quantiles(df.limit(0), F.col("x"), ps, ["g"]).collect() == []
    plan = qc.qc_summary(df.withColumn("t", F.col("g")), "t", by=["_v"])._jdf.queryExecution().toString().lower()
    assert "percentile" not in plan


def outcomes(spark, n, seed):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, rng.random() < 0.6, rng.random() < 0.75, rng.choice("xy")) for i in range(n)], "id long, a boolean, b boolean, kind string").select("id", F.col("a").cast("int"), F.col("b").cast("int"), "kind")


def test_bootstrap_is_that_of_the_cells(spark):
    df = outcomes(spark, 900, 5)
    one, two = (bootstrap.bootstrap_lift(x, "id", "a", "b", samples=2000).first() for x in (df, df.repartition(7)))
    cells = evaluate.lift_by_cells(df, "a", "b", samples=4000).first()
    assert one == two and one.estimate == pytest.approx(cells.lift)
    assert one.low == pytest.approx(cells.low, abs=0.01) and one.high == pytest.approx(cells.high, abs=0.01) and one.mean == pytest.approx(cells.lift, abs=0.005)
    by = bootstrap.bootstrap_lift(df, "id", "a", "b", samples=200, by=["kind"]).collect()
    assert sorted(r.kind for r in by) == ["x", "y"] and all(r.low < r.estimate < r.high for r in by)
    none = bootstrap.bootstrap_lift(df.limit(0), "id", "a", "b", samples=10).collect()
    assert [r.estimate for r in none] == [None]


def test_bootstrap_intervals_cover(spark):
    """Of 60 samples with a true lift of 0.15, about 95 % of the intervals hold it."""
    rng = random.Random(11)
    rows = [(g * 1000 + i, int(rng.random() < 0.6), int(rng.random() < 0.75), g) for g in range(60) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a int, b int, g int")
    out = bootstrap.bootstrap_lift(df, "id", "a", "b", samples=200, by=["g"]).collect()
    assert sum(r.low <= 0.15 <= r.high for r in out) >= 52


def test_bootstrap_of_any_statistic(spark):
    """A ratio of two sums; weights are Poisson(1): their mean and variance are 1."""
    df = spark.range(4000).select("id", (F.col("id") % 7).cast("double").alias("x"))
    each = bootstrap.replicates(df, F.col("id"), {"x": F.col("x"), "n2": F.lit(1.0)}, 50).where("replicate >= 0").collect()
    assert len(each) == 50 and all(abs(r.n - 4000) < 4 * 63.3 for r in each)
    r = bootstrap.bootstrap(df, F.col("id"), {"x": F.col("x"), "xx": F.col("x") * F.col("x")}, F.sqrt(F.col("xx") / F.col("n") - F.pow(F.col("x") / F.col("n"), F.lit(2))), 300).first()
    assert r.low < r.estimate < r.high and r.estimate == pytest.approx(2.0, abs=0.01)


def test_places_and_totals(spark):
    rng = random.Random(9)
    rows = [(rng.choice((rng.getrandbits(62), 5)), i, rng.choice((None, 1, 2))) for i in range(3000)]
    df = spark.createDataFrame(rows, "h long, i long, x int").repartition(6)
    out = sorted(ranking.scanned(df, ["h", "i"], {"total": F.col("x")}).collect(), key=lambda r: r.rank)
    assert [(r.h, r.i) for r in out] == sorted((h, i) for h, i, _ in rows) and [r.rank for r in out] == list(range(1, 3001))
    xs = {i: x for _, i, x in rows}
    total = 0
    for r in out:
        total += xs[r.i] or 0
        assert r.total == total
    assert ranking.scanned(df.limit(0), ["h"]).collect() == []


def test_step_up_is_the_window_form(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice((rng.random(), rng.random() ** 6, 0.01))) for i in range(700)]
    df = spark.createDataFrame(rows, "k long, p double")
    key = lambda r: r.k
    one = sorted(stats.benjamini_hochberg(df, "p", 0.1, "k").collect(), key=key)
    two = sorted(step_up.step_up(df.repartition(5), "p", "k").collect(), key=key)
    for a, b in zip(one, two):
        assert (a.k, a.rank, a.significant, a.significant_per_rank) == (b.k, b.rank, b.significant, b.significant_per_rank)
        assert a.p_adjusted == pytest.approx(b.p_adjusted) and a.threshold == pytest.approx(b.threshold)
    assert any(a.significant for a in one) and not all(a.significant for a in one)
    assert step_up.step_up(df.limit(0), "p", "k").collect() == []


def spans(text, item, n):
    a, b = text.lower().split(), item.lower().split()
    out = []
    for i in range(len(a)):
        for j in range(len(b)):
            if i and j and a[i - 1] == b[j - 1]:
                continue
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            if k >= n:
                out.append((i, j, k))
    return out


@pytest.mark.parametrize("bits", [leakage.MOST_BITS, 1 << 10])
def test_spans_by_hand(spark, monkeypatch, bits):
    monkeypatch.setattr(leakage, "MOST_BITS", bits)
    rng = random.Random(6)
    items = [" ".join(rng.choice("abc") for _ in range(rng.randrange(30))) for _ in range(8)] + ["a a a a a a a a a", "", None]
    texts = [" ".join(rng.choice("ABcd") for _ in range(rng.randrange(60))) for _ in range(20)] + ["x " + items[0] + " y\n" + items[0], "a " * 15, None, ""]
    texts += [f"{t} z {rng.choice(items[:8])}" for t in texts[:10]]
    for n in (3, 8):
        got = leakage.leak_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), spark.createDataFrame(list(enumerate(items)), "item_id int, text string"), n)
        want = [(i, j, *s) for i, t in enumerate(texts) for j, x in enumerate(items) if t and x for s in spans(t, x, n)]
        assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_every_combination_and_draws(spark):
    t = spark.createDataFrame([(1, "a {x} b {y}{x}."), (2, "no place"), (3, "{z} {x}"), (4, "{y}")], "template_id int, template string")
    values = {"x": ["2", "1", "{y}"], "y": ["p", "q"]}
    f = spark.createDataFrame([(n, v) for n, vs in values.items() for v in [*vs, vs[0]]] + [(None, "v"), ("x", None)], "name string, value string")
    got = sorted(map(tuple, generate.fill_templates(t, f).collect()))
    x, y = sorted(values["x"]), sorted(values["y"])
    want = [(1, i + 3 * (j + 2 * k), f"a {x[i]} b {y[j]}{x[k]}.") for k in range(3) for j in range(2) for i in range(3)] + [(4, i, y[i]) for i in range(2)]
    assert got == sorted(want)
    every = {r.k: r.instruction for r in generate.fill_templates(t.where("template_id = 1"), f).collect()}
    some = generate.draw_templates(t.where("template_id = 1"), f, 11, start=5).collect()
    assert len({r.k for r in some}) == 11 and all(every[r.k] == r.instruction for r in some)
    assert generate.draw_templates(t.where("template_id = 1"), f, 1000).count() == 18
    many = spark.range(2000).select(F.lit("x").alias("name"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("value"))
    wide = spark.createDataFrame([(7, "{x} {x} {x} {x}")], "template_id int, template string")
    big = generate.draw_templates(wide, many, 300).collect()
    assert len({r.k for r in big}) == 300 == len({r.instruction for r in big}) and max(r.k for r in big) > 10**10
    assert generate.fill_templates(t.where("template_id = 2"), f).collect() == []


def test_batches_stay_within_the_budget(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice((1, 2, 3, 7, 40, 41, 300, 301, 900, 5000, None, 0))) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, n int").repartition(5)
    out = collate.token_batches(df, "n", "id", 1000).collect()
    assert sorted(r.id for r in out) == sorted(i for i, n in rows if n)
    batches = {}
    for r in out:
        batches.setdefault((r.batch_class, r.batch), []).append(r)
    for some in batches.values():
        longest = max(r.n for r in some)
        assert all(r.longest == longest for r in some) and (longest * len(some) <= 1000 or len(some) == 1)
        assert min(r.n for r in some) > longest * 7 / 8 - 1
    assert len(batches) < 1.3 * sum(n or 0 for _, n in rows if n and n <= 900) / 1000 + sum(n == 5000 for _, n in rows) + 12


def test_labels_end_at_the_marker(spark):
    rows = [([5, 9, 8, 1, 9, 8, 2], 3), ([9, 8], 1), ([9, 1, 8, 2], 2), ([], 2), ([4, 5, 9], 9)]
    df = spark.createDataFrame(rows, "ids array<int>, prompt int")
    got = [r[0] for r in df.select(collate.marker_labels(F.col("ids"), (9, 8), F.col("prompt"))).collect()]
    assert got == [[-100, -100, -100, 1, 9, 8, 2], [-100, -100], [-100, -100, 8, 2], [], [-100, -100, -100]]
    padded = collate.collated(df.limit(1).withColumn("labels", collate.marker_labels(F.col("ids"), (9, 8), F.col("prompt"))).withColumn("longest", F.lit(9)), "ids", "labels").first()
    assert padded.ids == [5, 9, 8, 1, 9, 8, 2, 0, 0] and padded.labels[-2:] == [-100, -100] and len(padded.labels) == 9


def test_labels_of_a_long_row_take_one_pass(spark):
    n = 30_000
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: x * 2).alias("ids"))
    began = time.monotonic()
    got = df.select(collate.marker_labels(F.col("ids"), (2 * n - 2, 2 * n), F.lit(2)).alias("x"), collate.marker_labels(F.col("ids"), (6, 8), F.lit(2)).alias("y")).first()
    # a search for the marker at each token compares 900,000,000 pairs for each of the two
    assert time.monotonic() - began < 30
    assert got.x == [-100] * n and got.y == [-100] * 4 + list(range(10, 2 * n + 1, 2))


def test_loss_mask_at_its_ends(spark):
    df = spark.createDataFrame([([7, None, 9], 2), ([7, 8], 5), ([7], 0), ([7], -3), ([7, 8], None), ([], 2), (None, 1)], "ids array<int>, prompt long")
    got = [r[0] for r in df.select(text.loss_mask(F.col("ids"), F.col("prompt"))).collect()]
    assert got == [[-100, -100, 9], [-100, -100], [7], [7], [7, 8], [], None]


def test_lines_stay_in_order(spark, tmp_path):
    rng = random.Random(1)
    shards, said = [], []
    for k in range(4):
        lines = [f"{k} {i} " + rng.choice(("", "x" * 300, "a\rb", "é")) for i in range(rng.randrange(1, 400))]
        (tmp_path / f"shard_{k}.txt").write_bytes("\n".join(lines).encode())
        shards.append(f"file://{tmp_path}/shard_{k}.txt")
        said += lines
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        files.concat_lines(spark, list(reversed(shards)), f"file://{tmp_path}/all")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    parts = sorted((tmp_path / "all").glob("part-*"))
    assert len(parts) > 1 and b"".join(p.read_bytes() for p in parts) == "".join(x + "\n" for x in said).encode()
    lines, order = files.lines_in_order(spark, [f"file://{tmp_path}/all"])
    assert [r.value for r in ranking.scanned(lines, order).orderBy("rank").collect()] == said


def test_snapshots_are_whole_or_nothing(spark, tmp_path):
    table, df = f"file://{tmp_path}/t", spark.range(20)
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, table)
    assert snapshots.publish(df, table, 0, rows=20) == 1
    first = snapshots.read(spark, table)
    with pytest.raises(ValueError, match="20 rows instead of 21"):
        snapshots.publish(df, table, 1, rows=21)
    with pytest.raises(snapshots.Conflict):
        snapshots.publish(df, table, 0)
    # two writers that both saw version 1: the second to create the pointer is refused
    from unittest import mock

    assert snapshots.publish(df.limit(5), table, 1) == 2
    with mock.patch.object(snapshots, "latest", return_value=1), pytest.raises(snapshots.Conflict):
        snapshots.publish(df.limit(7), table, 1)
    assert (first.count(), snapshots.read(spark, table).count(), snapshots.read(spark, table, 1).count(), snapshots.latest(spark, table)) == (20, 5, 20, 2)
    said = snapshots.entry(spark, table, 2)
    assert said["rows"] == 5 and int(said["digest"]) == snapshots.contents(snapshots.read(spark, table, 2).repartition(3))[1]


def test_examples_are_drawn_without_repeats(spark):
    pool = spark.range(7).select("id", F.concat(F.lit("i"), F.col("id").cast("string")).alias("instruction"))
    asked = spark.range(40).select(F.col("id").cast("string").alias("key"))
    out = pairs.drawn_examples(asked, "key", pool, ["id"], 3).collect()
    assert len(out) == 40 and all(len({e.id for e in r.examples}) == 3 for r in out) and len({e.id for r in out for e in r.examples}) == 7
    assert all(len(r.examples) == 7 for r in pairs.drawn_examples(asked, "key", pool, ["id"], 9).collect())
    assert all(r.examples == [] for r in pairs.drawn_examples(asked, "key", pool.limit(0), ["id"]).collect())


def test_bad_prompts_cost_no_others(spark):
    rows = [(i, f"p{i}") for i in range(50)] + [(99, None)]

    def backend(prompts):
        if any(p in ("p3", "p40") for p in prompts):
            raise ValueError("bad")
        if len(prompts) > 1 and "p17" in prompts:
            return prompts[:-1]
        return [p.upper() for p in prompts]

    out = models.generate_in_batches(spark.createDataFrame(rows, "id int, prompt string").coalesce(2), "prompt", backend, batch_size=8, attempts=2).collect()
    assert {r.id: (r.response, r.error) for r in out} == {i: (None, "bad") if i in (3, 40) else (p and p.upper(), None) for i, p in rows}


def test_ids_of_a_local_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [("Hello  there\n",), ("",), (None,), ("x <|endoftext|> y" * 50,)]
    df = spark.createDataFrame(rows, "text string")
    local = models.LocalTokenizer(path)
    out = models.token_ids(models.token_counts(df, "text", local), "text", local.ids).collect()
    want = [Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids for (t,) in rows]
    assert [(r.ids, r.n_tokens) for r in out] == [(w, len(w)) for w in want]


def test_abort_rules(spark):
    rates = [("base_formatted", 10, 6), ("alt_base", 10, 5), ("instruct", 10, 7), ("other", 10, 10)]
    df = spark.createDataFrame(rates, "condition string, n long, n_success long")
    r = evaluate.abort_reasons(df, evaluate.ABORT_RULES).first()
    assert r.aborted and r.reasons == ["conversation isn't hard enough", "too hard even for the instruct model"]
    r = evaluate.abort_reasons(df.where("condition = 'alt_base'"), evaluate.ABORT_RULES).first()
    assert not r.aborted and r.reasons == []


def test_pool_takes_a_shard_as_one_batch(spark, tmp_path, monkeypatch):
    """Files of a shard that were ended out of order: the first row of a key goes out all the same."""
    (tmp_path / "t").mkdir()
    rows = [(i, f"text {i % 3}" if i % 5 else "pool") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/t/documents.parquet")
    batches, write = [], files.write_jsonl

    def backwards(df, path, *more):
        write(df.repartitionByRange(4, "doc_id"), path, *more)
        parts = sorted(Path(path.removeprefix("file://")).glob("part-*"))
        for n, part in enumerate(parts):
            os.utime(part, (part.stat().st_mtime - n - 1,) * 2)
        batches.append(len(parts))

    monkeypatch.setattr(files, "write_jsonl", backwards)
    got = sorted(r.doc_id for r in catalog.queries()["pool_stream"](spark, f"file://{tmp_path}/t").collect())
    assert max(batches) > 1 and got == [1, 2, 3]


@pytest.mark.parametrize("cuts", [[40], [1, 2, 30]])
def test_pool_over_any_batches(spark, tmp_path, cuts):
    """The rows that go out are those of the batch form, however the arrivals are split, and after a restart."""
    rng = random.Random(2)
    rows = [(i, rng.choice(("A", " a", "b", "C ", None, f"k{i}", "")), rng.random()) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, text string, x double")
    pool = spark.createDataFrame([("B",), ("c",), ("b ",)], "text string")
    edges = [0, *[c for c in cuts if 0 < c < 40], 40]
    for n, (a, b) in enumerate(zip(edges, edges[1:])):
        files.write_jsonl(df.where((F.col("id") >= a) & (F.col("id") < b)), f"file://{tmp_path}/in/{n}")
        if n % 2 or n == len(edges) - 2:
            stream = streaming.read_shards(spark, f"file://{tmp_path}/in/*", df.schema)
            streaming.append_to(streaming.unseen_in_pool(stream, "text", "id", pool), f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination()
    got = sorted(r.id for r in spark.read.schema(df.schema).parquet(f"file://{tmp_path}/out").collect())
    firsts = {}
    for i, t, _ in rows:
        firsts.setdefault((t or "").strip().lower() if t is not None else None, i)
    assert got == sorted(i for k, i in firsts.items() if k not in ("b", "c"))
