"""Operators on crafted rows: order, ties, empty groups, files and streams."""

import json

import pytest
from pyspark.sql import functions as F
from sieveline import schemas
from sieveline.operators import capability, conversation, dedup, evaluate, generate, leakage, models, pairs, provenance, qc, ranking, validate
from sieveline.sources import files
from sieveline.streaming import dedup as streaming


def test_keep_first_by_order(spark):
    df = spark.createDataFrame([(2, "a"), (1, "a"), (3, None), (4, None), (5, "b")], "id int, k string")
    assert sorted(r.id for r in dedup.keep_first(df, F.col("k"), ["id"]).collect()) == [1, 3, 5]


def test_union_prefers_existing(spark):
    old = spark.createDataFrame([(9, "Hello ")], "id int, k string")
    new = spark.createDataFrame([(1, "hello"), (2, " WORLD"), (3, "world")], "id int, k string")
    assert sorted((r.id, r.source_rank) for r in dedup.normalized_union(old, new, "k", ["id"]).collect()) == [(2, 1), (9, 0)]
    assert dedup.new_unique(old, new, "k").first().n_new_unique == 1
    r = dedup.merge_analysis(old, new, "k", 5).first()
    assert (r.n_existing, r.n_new, r.n_new_unique, r.n_merged_unique, r.target_met, r.n_missing) == (1, 3, 1, 2, False, 3)


def test_reports_of_nothing(spark):
    df = spark.createDataFrame([], "id int, k string")
    assert dedup.duplication_report(df, "k").first().duplication_rate is None
    assert dedup.top_duplicates(df, "k", "id").collect() == []
    assert qc.qc_summary(df, "k").first().median_tokens == 0


def test_containment_with_short_items(spark):
    docs = spark.createDataFrame([(1, "x a b c d e f g y"), (2, "a b c"), (3, "zz a b c d e f gg")], "doc_id int, text string")
    items = spark.createDataFrame([(1, "a b c d e f g"), (2, "b c"), (3, "zz")], "item_id int, text string")
    assert sorted(map(tuple, leakage.containment(docs, items).collect())) == [(1, 1), (1, 2), (2, 2), (3, 1), (3, 2), (3, 3)]


@pytest.mark.parametrize("few", [leakage.MOST_BITS, 1 << 10])
def test_containment_against_all_pairs(spark, few, monkeypatch):
    """Items of one to nine words, cut out of texts at any character, with odd white space and ends inside longer words."""
    import random

    monkeypatch.setattr(leakage, "MOST_BITS", few)
    rng = random.Random(11)
    vocabulary = ["one", "two", "three", "four", "five", "cat", "cats", "a", "b", "é", "x\u00a0y"]
    texts = ["".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\n", "  "]) for _ in range(rng.randrange(40))) for _ in range(60)]
    items = ["one two three four five cat", "one two three four five cat a", "cat", "a", " a ", "ne two", "\n", "one  two", "zebra"]
    for n in range(1, 10):
        for _ in range(6):
            words = rng.choice([t for t in texts if len(t.split()) > n]).split(" ")
            at = rng.randrange(max(1, len(words) - n))
            cut = " ".join(words[at : at + n])
            items.append(cut[rng.randrange(2) : len(cut) - rng.randrange(2)])
    texts += ["one two three four five cats y", "xone two three four five cat ab", "", None]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id int, text string, word int")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate([*items, "", None])], "item_id int, text string")
    got = sorted(map(tuple, leakage.containment(docs, bench).collect()))
    assert got == [(i, j) for i, t in enumerate(texts) if t for j, x in enumerate(items) if x and x in t]


@pytest.mark.parametrize("few", [leakage.MOST_BITS, 1 << 10])
def test_ngram_leakage_against_all_pairs(spark, few, monkeypatch):
    monkeypatch.setattr(leakage, "MOST_BITS", few)
    texts, items = ["A b c d e f g", "b c d", "", "x y", None, "a B c a b c"], ["a b c d", "c d e f", "x y", "q"]
    docs, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), spark.createDataFrame(list(enumerate(items)), "item_id int, text string")

    def grams(t, n=3):
        w = (t or "").lower().split()
        return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()

    want = [(i, j, len(grams(t) & grams(x)), len(grams(t) & grams(x)) / len(grams(x))) for i, t in enumerate(texts) for j, x in enumerate(items) if grams(t) & grams(x)]
    assert sorted(map(tuple, leakage.ngram_leakage(docs, bench, 3).collect())) == want


def test_overlap_check(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "k string"), spark.createDataFrame([(" X",)], "k string")
    with pytest.raises(ValueError):
        leakage.check_no_overlap(a, b, "k")
    leakage.check_no_overlap(a.where("k = 'y'"), b, "k")
    assert leakage.without_leaks(a, b, "k", exact=True).count() == 2


def test_gate_variants(spark):
    rows = [("short",)] * 19 + [("x" * 600,)]
    df = spark.createDataFrame(rows, "r string")
    assert "runaway_rate" in qc.gate(qc.qc_summary(df, "r", "pilot"), "pilot").first().failed_reasons
    assert "runaway_rate" not in qc.gate(qc.qc_summary(df, "r", "repair"), "repair").first().failed_reasons
    bad = qc.qc_summary(df.withColumn("g", F.lit(False)), "r", "repair", pair_good=F.col("g"))
    assert qc.gate(bad, "repair").first().failed_reasons == ["pair_acceptance"]


def test_ranks_are_global(spark):
    df = spark.range(1000).withColumn("id", F.col("id") * 131 % 70001).repartition(7)
    got = {r.id: r.rank for r in ranking.by_id(df, "id", width=64).collect()}
    assert got == {x: i + 1 for i, x in enumerate(sorted(got))}
    slices = ranking.balanced_slices(df, "id", 7).groupBy("slice").count().orderBy("slice").collect()
    assert [r["count"] for r in slices] == [143] * 6 + [142]
    split = ranking.train_test_split(df, "id", 0.25).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in split} == {"test": 250, "train": 750}
    assert ranking.sample(df, "id", 5).collect() == ranking.sample(df.repartition(3), "id", 5).collect()


def test_quotas():
    assert ranking.quotas(11, "abc") == {"a": 4, "b": 4, "c": 3}
    assert sum(ranking.weighted_quotas(41, {"a": 30, "b": 25, "c": 25, "d": 20}).values()) == 41
    assert generate.candidate_limit(7) == 11


def test_draws(spark):
    df = spark.range(4000)
    shares = {"a": 0.5, "b": 0.3, "c": 0.2}
    got = {r.k: r["count"] / 4000 for r in df.select(ranking.weighted_draw(F.col("id"), shares).alias("k")).groupBy("k").count().collect()}
    assert got == pytest.approx(shares, abs=0.03)
    three = df.limit(50).select(ranking.distinct_draws(F.col("id"), "abcd", 3).alias("x")).collect()
    assert all(len(set(r.x)) == 3 for r in three) and len({tuple(r.x) for r in three}) > 5


def test_positional_pairs_must_match(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "i int, v string")
    assert pairs.positional_pairs(a, a, "i").count() == 2
    with pytest.raises(ValueError):
        pairs.positional_pairs(a, a.limit(1), "i")


def test_pair_builders(spark):
    df = spark.createDataFrame([("i", "a", "b", True, False), ("i", "a", "b", True, True), ("i", "a", "b", False, False), ("i", "a ", "a", True, True)], "instruction string, original string, improved string, original_good boolean, improved_good boolean")
    assert [(r.chosen, r.rejected) for r in pairs.improvement_pairs(df).collect()] == [("a", "b"), ("b", "a")]
    n = pairs.normalized_pairs(spark.createDataFrame([("i", "c", "r", None), ("j", "c", "r", False)], "instruction string, chosen string, rejected string, confident boolean")).collect()
    assert [(r.prompt, r.instruction_type, r.margin) for r in n] == [("Instruction: i\nResponse:", "unknown", 0.0)]
    e = spark.createDataFrame([("i", "o", "m", None, None), ("i", "o", "m", "x", None)], "instruction string, original string, improved string, critique_error string, improve_error string")
    assert pairs.critiqued_pairs(e).count() == 1
    r = spark.createDataFrame([(True, "o", "m"), (False, "o", "m"), (False, "o", None)], "success boolean, original string, improved string")
    assert [x.final for x in pairs.repaired_responses(r).collect()] == ["o", "m", "o"]
    assert spark.range(1).select(pairs.sequence_margin(F.lit(-1.0), F.lit(-2.0)).alias("s")).first().s.confident
    m = spark.createDataFrame([("p", "c", "r", ("en", 1))], "prompt string, chosen string, rejected string, metadata struct<lang:string,n:int>")
    assert pairs.flattened(m).columns == ["prompt", "chosen", "rejected", "lang", "n"]


def test_compare_with_a_missing_side(spark):
    df = spark.createDataFrame([("base", "x", False), ("sft", "x", True), ("sft", "y", True)], "model string, kind string, success boolean")
    got = {r.kind: r for r in evaluate.compare(df, "kind").collect()}
    assert got["x"].relative_improvement == float("inf") and got["y"].base_total == 0 and got[None].failures_eliminated == 1
    rates = evaluate.type_rates(df.where("model = 'sft'"), "kind").withColumnRenamed("kind", "type")
    base = spark.createDataFrame([("old_x", 0.25)], "category string, rate double")
    assert evaluate.against_baseline(rates, base, {"x": "old_x"}).first().improvement == 0.75


def test_runs_and_advice(spark):
    tests, models_ = spark.createDataFrame([(1,), (2,)], "test int"), spark.createDataFrame([("a",), ("b",)], "model string")
    assert capability.fan_out_runs(tests, models_).count() == 12
    got = spark.createDataFrame([(0.9, 0.9, 0.9), (0.1, 0.1, 0.1)], "i double, a double, c double").select(capability.advice(F.col("i"), F.col("a"), F.col("c")).alias("x")).collect()
    assert got[0].x == ["ready for the next stage"] and len(got[1].x) == 3


def test_validators(spark):
    df = spark.createDataFrame([("i", "r", "Instruction: i Response: r END", "qa"), ("i", None, "x", "zz")], schemas.SFT_VALIDATED)
    checked = validate.sft(df)
    good, bad = validate.split(checked)
    assert good.count() == 1 and bad.first().violations == ["missing response", "no instruction prefix", "no response section", "no end suffix", "unknown instruction type"]
    assert not validate.all_valid(checked)
    with pytest.raises(Exception, match="sft: missing response"):
        validate.fail_on(checked, "sft").collect()
    with pytest.raises(ValueError):
        validate.fail_on(validate.sft(df.limit(0)), "sft")
    p = spark.createDataFrame([(1, "Instruction: x", "i", "good one", "bad one"), (2, "y", "i", "same", "same")], "o int, prompt string, instruction string, chosen string, rejected string")
    assert validate.pair_format(p, "o") == "prompt" and validate.pair_format(p.drop("prompt"), "o") == "instruction"
    assert [r.violations for r in validate.preference_pairs(p, "prompt").orderBy("o").collect()] == [[], ["identical chosen and rejected", "no instruction prefix"]]
    t = spark.createDataFrame([("1", "long enough", "qa"), ("1", "abc", "qa"), ("", "long enough", "qa")], "id string, instruction string, expected_type string")
    assert sorted(map(tuple, validate.violation_counts(validate.test_instructions(t)).collect())) == [("duplicate id", 2), ("empty id", 1), ("instruction too short", 1)]
    with pytest.raises(ValueError):
        validate.training_gate(p.drop("instruction"))


def test_conversations(spark):
    t = spark.createDataFrame([(1, 0, "user", "I am Ann"), (1, 1, "assistant", "Hi"), (1, 2, "user", "Who am I"), (1, 3, "assistant", "You are ANN")], schemas.TURN)
    h = {r.turn: r.history for r in conversation.with_history(t).collect()}
    assert h[0] == "" and h[3] == "User: I am Ann\nAssistant: Hi\nUser: Who am I\n"
    e = spark.createDataFrame([(1, 0, "Ann")], "conv_id long, turn long, entity string")
    assert {r.turn: r.recalled for r in conversation.entity_recall(t, e).collect()} == {1: False, 3: True}
    j = spark.createDataFrame([('{"turn_2": {"result": "PASS"}, "turn_3": {"result": "FAIL"}, "overall": "FAIL"}',), ("nonsense",)], "t string").select(conversation.parse_judgement(F.col("t")).alias("j")).collect()
    assert j[0].j.all_turns_pass is False and j[0].j.overall_pass is False and j[1].j is None


def test_negatives(spark):
    df = spark.createDataFrame([(i, "Write one sentence", ("qa", "completion", "generation", "response", None)[i % 5], "The sun rises in the east early") for i in range(60)], "id int, instruction string, instruction_type string, response string")
    out = generate.negatives(df, "id").collect()
    per = {}
    for r in out:
        per.setdefault(r.id, []).append(r.negative_type)
        assert len(r.negative_response) >= 3
    assert all(len(v) in (2, 3) and len(set(v)) == len(v) for v in per.values())
    assert any("west" in r.negative_response for r in out)
    wrong = spark.createDataFrame([("What is the capital of France?", "qa", "Paris"), ("Say x", "response", "xin in IN inn été"), ("Say x", "response", "none of these"), ("Say x", "response", "")], "i string, k string, r string")
    got = [r[0] for r in wrong.select(generate.incorrect_facts(F.col("i"), F.col("k"), F.col("r"), F.lit("1"), 1)).collect()]
    assert got == ["London", "xin out out inn été", generate.WRONG, generate.WRONG]
    off = spark.createDataFrame([("Name animals",), ("my dog barks",), ("A tree",), ("Is rain wet?",), ("History of tea",)], "i string").select(generate.off_topic(F.col("i"), F.lit("1"), 1).alias("x")).collect()
    assert off[0].x in generate.OFF_TOPIC_BY["animals"] and off[1].x == off[0].x and off[2].x == generate.OF_PLANTS and off[3].x == generate.OF_WATER and off[4].x in generate.OFF_TOPIC_BY["history"]


def test_typed_and_held_out(spark):
    rows = generate.typed_instructions(spark, 600, 3).collect()
    assert [r.type for r in rows[:6]] == list(generate.TYPED_TEMPLATES) and not any("{" in r.instruction for r in rows)
    assert len({r.instruction for r in rows}) > 100
    held = generate.held_out_tests(spark, {"a_b": ["p", "q"], "b": ["r"]}, 6).collect()
    assert [(r.id, r.instruction, r.expected_type) for r in held] == [("test_1", "p", "a_b"), ("test_2", "q", "a_b"), ("test_3", "p", "a_b"), ("test_4", "r", "b"), ("test_5", "r", "b"), ("test_6", "r", "b")]
    assert generate.candidate_batches(5) == 10 and generate.candidate_batches(1000) == 150


def test_yaml_entries():
    text = "a: 1\nlist:\n- id: x\n  text: 'it''s'\n# no\n- id: y\n  text: \"a: \\\"b\\\"\"  \n  more: plain # remark\nother:\n- id: z\n"
    assert files.yaml_entries(text, "list") == [{"id": "x", "text": "it's"}, {"id": "y", "text": 'a: "b"', "more": "plain"}]
    assert files.yaml_entries(text, "none") == []


def test_models_plug_in(spark):
    df = spark.createDataFrame([("a",), ("bb",)], "prompt string")
    assert [r.response for r in models.generate(df, "prompt", lambda s: s.str.upper()).collect()] == ["A", "BB"]
    table = spark.createDataFrame([("a", "one")], "prompt string, response string")
    assert {r.prompt: r.response for r in models.generate(df, "prompt", table).collect()} == {"a": "one", "bb": None}
    assert [r.n_tokens for r in models.token_counts(df, "prompt", len).collect()] == [1, 2]

    def logps(s):
        import pandas as pd

        return pd.DataFrame({"logp_a": -s.str.len().astype(float), "logp_b": -1.5})

    got = models.judged(models.label_logps(df, "prompt", logps), F.col("logp_a"), F.col("logp_b"), 0.5).collect()
    assert [r.verdict.is_good for r in got] == [True, False]


def test_provenance(spark, tmp_path):
    assert provenance.git_info(str(tmp_path))["commit"] == "unknown"
    assert provenance.environment_info(spark)["spark"] == spark.version
    path = f"file://{tmp_path}/manifest"
    provenance.record(spark, path, "s", "qc.json", "qc_summary", "2025-01-01", parameters={"thresholds_passed": "true"})
    provenance.record(spark, path, "s", "x", "data", "2025-01-02", success=False, error="e")
    m = provenance.manifest(spark, path)
    assert provenance.session_summary(m).first().n_failed == 1 and provenance.passed_gate(m).count() == 1
    with pytest.raises(ValueError):
        provenance.passed_gate(m.where("type = 'data'"))
    with pytest.raises(ValueError):
        provenance.required({"a": None}, "a")
    r = spark.range(1).select(provenance.merged(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(1)), F.create_map(F.lit("b"), F.lit(2))).alias("m")).first()
    assert r.m == {"a": 1, "b": 2}
    assert provenance.run_steps([("a", "x", lambda: None), ("b", "y", lambda: 1 / 0), ("c", "z", lambda: None)], lambda p: p == "x") == [("a", "skipped"), ("b", "failed: division by zero")]
    df = spark.createDataFrame([("i", "r", None, None, None, None, None)], schemas.SFT_EXAMPLE)
    assert provenance.stamped(df, ["dedup"], "now").first().metadata.repair_operations == ["dedup"]
    doc = provenance.qc_record(spark.createDataFrame([(1,)], "n int"), "now").first().document
    assert json.loads(doc)["qc"] == {"n": 1}


def test_files(spark, tmp_path):
    schema = schemas.struct(a=schemas.L, b=schemas.S)
    (tmp_path / "shard_1.jsonl").write_text('{"a": 1, "b": "é👍"}\n\n{"a": 2}\n')
    (tmp_path / "shard_2.jsonl").write_text('{"a": 3}\nnot json\n')
    root = f"file://{tmp_path}"
    one = f"{root}/shard_1.jsonl"
    assert files.read_strict(spark, one, schema).count() == 2 and files.read_tolerant(spark, one, schema).count() == 2
    with pytest.raises(Exception):
        files.read_strict(spark, f"{root}/shard_2.jsonl", schema).collect()
    rows, bad = files.read_checked(spark, f"{root}/shard_*.jsonl", schema)
    assert sorted(r.a for r in rows.collect()) == [1, 2, 3] and [(r.line, r.text) for r in bad.collect()] == [(2, "not json")]
    shards = files.read_shards(spark, root, schema).where("a is not null")
    assert dedup.F.col and {r._file[-13:] for r in shards.collect()} == {"shard_1.jsonl", "shard_2.jsonl"}
    assert files.latest_by_name(spark, f"{root}/shard_*").endswith("shard_2.jsonl") and files.latest_by_time(spark, f"{root}/none*") is None
    assert files.present_shards(spark, root, ["shard_1.jsonl", "x"]) == (["shard_1.jsonl"], ["x"])
    with pytest.raises(FileNotFoundError):
        files.require_shards(spark, root, ["x"])
    df = rows.where("a = 1")
    files.write_jsonl(df, f"{root}/ascii", 1, ascii_only=True)
    line = [r.value for r in spark.read.text(f"{root}/ascii").collect()]
    assert line == [json.dumps({"a": 1, "b": "é👍"}, separators=(",", ":"))]
    files.write_jsonl(df, f"{root}/utf8", 1)
    assert spark.read.schema(schema).json(f"{root}/utf8").first().b == "é👍"
    files.write_csv(spark.createDataFrame([("m", 0.12345)], "Model string, Primary double"), f"{root}/csv")
    assert {r.value for r in spark.read.text(f"{root}/csv").collect()} == {"Model,Primary", "m,0.123"}
    files.write_document(spark.createDataFrame([(1, "x")], "n int, s string"), f"{root}/doc")
    assert json.loads("\n".join(r.value for r in spark.read.text(f"{root}/doc").collect())) == {"n": 1, "s": "x"}
    files.write_text(spark, "two\nlines", f"{root}/report")
    assert spark.read.text(f"{root}/report").count() == 2
    fixed = files.rewrite_with_backup(spark, one, f"{root}/backup", schema, lambda d: d.where("a = 2"), f"{root}/fixed")
    assert fixed.count() == 1 and spark.read.text(f"{root}/backup").count() == 3
    with pytest.raises(ValueError):
        files.rewrite_with_backup(spark, one, f"{root}/b", schema, lambda d: d, one)
    with pytest.raises(ValueError):
        files.load_or_create(spark, f"{root}/leaky", schema, lambda: rows.withColumn("b", F.lit("x")), 2, "a", rows.withColumn("b", F.lit(" X")), "b")
    with pytest.raises(FileNotFoundError):
        files.require_files(spark, root, ["adapter_config.json"])
    made = files.load_or_create(spark, f"{root}/made", schema, lambda: rows, 2, "a")
    assert [r.a for r in made.collect()] == [1, 2] and files.load_or_create(spark, f"{root}/made", schema, lambda: 1 / 0, 1, "a").count() == 1
    assert [r.id for r in files.principles(spark, [(str(i), "t", "c") for i in range(6)]).collect()] == ["0", "1", "2", "3"]
    assert files.distinct_instructions(spark.createDataFrame([("A ",), ("a",)], "instruction string")).count() == 1


def test_streaming_dedup(spark, tmp_path):
    schema = schemas.struct(k=schemas.S)
    src, out, state = tmp_path / "in", f"file://{tmp_path}/out", f"file://{tmp_path}/state"
    src.mkdir()
    (src / "1.json").write_text('{"k": "A"}\n{"k": "b"}\n')
    for more in ('{"k": " a"}\n{"k": "c"}\n', '{"k": "C"}\n'):
        stream = streaming.unseen(streaming.read_shards(spark, f"file://{src}", schema), "k")
        streaming.append_to(stream, out, state).awaitTermination()
        (src / f"{len(more)}.json").write_text(more)
    streaming.append_to(streaming.unseen(streaming.read_shards(spark, f"file://{src}", schema), "k"), out, state).awaitTermination()
    assert sorted(r.k.strip().lower() for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
