"""Text rules on the rows that fixtures never hold."""

import random
import re

import pytest
from pyspark.sql import functions as F
from sieveline.functions import scorers, text


def values(spark, build, *rows):
    names = [f"c{i}" for i in range(len(rows[0]) if isinstance(rows[0], tuple) else 1)]
    data = [r if isinstance(r, tuple) else (r,) for r in rows]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "i int, " + ", ".join(f"{n} string" for n in names))
    return [r.v for r in df.select("i", build(*[F.col(n) for n in names]).alias("v")).orderBy("i").collect()]


def test_strip_is_pythons(spark):
    rows = [" x ", " x ", "\tx\n", "", "   ", "a b", "　é "]
    assert values(spark, text.strip, *rows) == [r.strip() for r in rows]
    assert values(spark, text.n_words, *rows) == [len(r.split()) for r in rows]
    assert values(spark, text.norm_key, "  İX ", "É") == ["i̇x", "é"]


@pytest.mark.parametrize("pattern", text.RUNAWAY_BASE + text.RUNAWAY_CHAT)
def test_runaway_patterns(spark, pattern):
    assert values(spark, text.is_runaway, f"ok{pattern}more", "plain") == [True, False]
    six = lambda x: text.is_runaway(x, text.RUNAWAY_BASE)
    assert values(spark, six, f"ok{pattern}more") == [pattern in text.RUNAWAY_BASE]


def test_runaway_length(spark):
    assert values(spark, text.is_runaway, "x" * 500, "x" * 501) == [False, True]


def test_clean_response(spark):
    rows = ["a###END###b", "a\n\nb", "a\nQ: b", "a\nInstruction: b\nc", "a\nAnd now for b", "### a ###", "Q: all", "", " a \n b ", "a\n\nb###END###c", "x\nqa: no"]
    assert values(spark, text.clean_response, *rows) == ["a", "a", "a", "a", "a", "a", "", "", "a \n b", "a", "x\nqa: no"]


def test_strip_markers(spark):
    rows = ["a###", "a## ##", "a###END###b", "a###b", "#####", "a ### \n"]
    assert values(spark, text.strip_stop_markers, *rows) == ["a", "a##", "a", "a###b", "", "a ###"]


def test_truncation(spark):
    rows = ["a long enough text:", "5) Biomass Energy -", "7. Professionalism -", "Yes.", "No idea", "True", "a long enough text", "well - known things -x"]
    assert values(spark, text.is_truncated, *rows) == [True, True, True, False, True, False, False, False]
    strict = lambda x: text.is_truncated(x, text.SHORT_ANSWERS_STRICT)
    assert values(spark, strict, "True", "Yes") == [True, False]


def test_truncation_of_long_texts(spark):
    """The pattern of before, whose group repeats for each word, took the stack of the task."""
    long = ["5. " + "word " * 100_000 + end for end in ("-", "- ", "x", "x-")] + ["1 " * 100_000 + "x", "1 " * 100_000 + "-", "a " * 100_000 + "-", "1" + " " * 10_000 + "-"]
    assert values(spark, text.is_truncated, *long) == [True, True, False, True, False, True, False, False]
    assert values(spark, text.route, *[("Name a colour", x) for x in long])[:3] == ["truncated", "truncated", "kept"]


def test_truncation_is_the_pattern(spark):
    rng, pattern = random.Random(4), re.compile(r"[\d).]\s+\w+(?:\s+\w+)*\s*-\s*\Z")
    rows = ["long enough" + "".join(rng.choice("11aé٣_  \n).-,") for _ in range(rng.randrange(12))) + rng.choice(["-", "a-", "", " - "]) for _ in range(3000)]
    want = [pattern.search(x.strip()) is not None for x in rows]
    assert 200 < sum(want) < 2800
    assert values(spark, text.is_truncated, *rows) == want


def test_routing_order(spark):
    rows = [("The sky is green", "True"), ("Is this true?", "True"), ("Name a colour", "Red"), ("Name a colour", "Red is a colour")]
    assert values(spark, text.route, *rows) == ["true_false", "kept", "truncated", "kept"]
    other = lambda i, r: text.route(i, r, False, text.SHORT_ANSWERS_STRICT)
    assert values(spark, other, *rows) == ["true_false", "truncated", "truncated", "kept"]


def test_numbered_lists(spark):
    listing = "1. One thing\n2) Another thing\n\nx. nothing\n3. Here are some\n 4 . Spaced\n5.\n٣. arabic digit"
    assert values(spark, text.parse_numbered, listing) == [["One thing", "Another thing", "Spaced", "arabic digit"]]
    assert values(spark, lambda x: text.parse_numbered(x, 2), listing) == [["One thing", "Another thing"]]
    assert values(spark, text.parse_numbered_regex, "1. Explain the tides\n2) The tides\n3. short\n4. Follow this example well\n5. An odd example here") == [["Explain the tides", "Follow this example well"]]
    assert values(spark, lambda x: text.parse_numbered_diverse(x, 5), "1. Write a haiku now\n2. Write another instruction\nno digit here\n3) tiny") == [["Write a haiku now"]]
    assert values(spark, text.parse_numbered_eval, "1. Explain the tides\n2. List the colours\n3. Say it in French\n4. Left out of it all") == [["Explain the tides", "Say it in French"]]


def test_labels_and_json(spark):
    assert values(spark, text.label_of, "Good.", "bad, not good", "it is good", "so bad", "hm", " GOOD") == ["good", "bad", "good", "bad", "unclear", "good"]
    assert values(spark, lambda x: F.coalesce(text.has_json(x), F.lit(False)), '{"a": 1}', 'so: {"a": [1]} ok', "{a", "{a: }", "none") == [True, True, False, False, False]
    assert values(spark, lambda x: text.section(x, "Summary"), "**Summary**:\nline one\nline two\n**Next**:\nno", "## Summary\nyes\n## Next\nno", "none") == ["line one\nline two", "yes", ""]
    assert values(spark, text.first_answer_line, "\nAnother one\n yes \nno", "another") == ["yes", "another"]


def test_layers(spark):
    r = values(spark, text.layered_cleanup, "a b###END###c", "a\n\nQ: c", "a\nWhat now", "a <|im_end|> b")
    assert [x.text for x in r] == ["a b", "a", "a", "a <|im_end|> b"]
    assert [x.delimiter_found for x in r] == [True, False, False, False] and [x.heuristic_cutoff for x in r] == [False, True, True, False]
    assert [x.forbidden_markers for x in r] == [False, False, False, True]


def test_verdicts(spark):
    df = spark.createDataFrame([(-1.0, -2.0, -3.0), (-2.0, -2.0, -5.0), (-4.0, -1.0, -0.5)], "a double, b double, b2 double")
    got = [r.v for r in df.select(text.critique([F.col("a")], [F.col("b"), F.col("b2")], 1.0).alias("v")).collect()]
    assert [(v.is_good, v.predicted_label, v.margin, v.confident) for v in got] == [(True, "A", 1.0, True), (False, "B", 0.0, False), (False, "B", 3.5, True)]


def test_inferred_critique_and_sentinels(spark):
    from sieveline.schemas import SENTINEL, SFT_EXAMPLE
    from pyspark.sql import types as T

    c = (True, "A", -1.0, -2.0, 1.0, True, 1.0, None, None)
    df = spark.createDataFrame([("i", "r", None, None, None, c, None), ("i", "r", None, None, c, None, None), ("i", "r", None, None, None, None, None)], SFT_EXAMPLE)
    got = [r.v for r in df.select(text.inferred_critique(F.col("instruction_critique"), F.col("pair_critique")).alias("v")).collect()]
    assert [v and v["_inferred"] for v in got] == [True, False, None] and got[0].margin == 1.0
    s = spark.createDataFrame([([("x", "p", "ok", "pass", False, None), ("y", "p", "", "pass", False, None)],)], T.StructType([T.StructField("s", T.ArrayType(SENTINEL))]))
    r = s.select(text.relaxed_sentinels(F.col("s"), "x").alias("s")).select("s", text.all_passed(F.col("s")).alias("all")).first()
    assert [x.passed for x in r.s] == [True, False] and r.all is False


def test_current_scorer(spark):
    rows = [("i", ""), ("i", "I cannot"), ("i", "I can't say. " + "x" * 60), ("i", "y" * 501), ("i", "a fine answer")]
    assert [r.reason for r in values(spark, scorers.score_current, *rows)] == ["empty_response", "inappropriate_refusal", "", "too_long", ""]


def test_keywords_decide(spark):
    df = spark.createDataFrame([("Q", "It is Paris", ["paris"]), ("Q", "Lyon", ["paris"])], "i string, r string, k array<string>")
    got = [r.s.reason for r in df.select(scorers.score_typed(F.col("i"), F.col("r"), F.lit("qa"), F.col("k")).alias("s")).collect()]
    assert got == ["Contains expected content", "Answer too short"]


def test_strict_patterns_are_the_intended_ones(spark):
    rows = [("Describe spring", "in the summer it rains"), ("Water boils at", "100 degrees"), ("Water boils at", "quite hot")]
    kinds = ["generation", "completion", "completion"]
    df = spark.createDataFrame([(*r, k) for r, k in zip(rows, kinds)], "i string, r string, k string")
    got = [r.s.success for r in df.select(scorers.score_strict(F.col("i"), F.col("r"), F.col("k")).alias("s")).collect()]
    assert got == [False, True, False]


def test_sequential_variant_differs(spark):
    df = spark.createDataFrame([("Explain step by step, in one word", "could you specify")], "i string, r string")
    a = df.select(scorers.score_six(F.col("i"), F.col("r")).alias("s")).first().s
    b = df.select(scorers.score_six(F.col("i"), F.col("r"), True).alias("s")).first().s
    assert a.deflection == pytest.approx(0.2) and b.deflection == 1.0 and a.instruction == 0.3 and b.instruction == 0.4 and a.format == 0.2 and b.format == 0.5


def test_counts(spark):
    rows = ["a?b??", "", "...a...", "....."]
    assert values(spark, lambda x: text.count_of(x, "?"), *rows) == [r.count("?") for r in rows]
    assert values(spark, lambda x: text.count_of(x, "..."), *rows) == [r.count("...") for r in rows]
    assert [bool(re.search("x", r)) for r in rows] == [False] * 4


def test_prompts(spark):
    df = spark.createDataFrame([([("i1", "r1")], "i2", "r2")], "e array<struct<instruction:string,response:string>>, i string, r string")
    r = df.select(text.few_shot_prompt(F.col("e"), F.col("i")).alias("f"), text.critic_prompt(F.col("i"), F.col("r")).alias("c"), text.padded(F.array(F.lit(1)), F.lit(3), -100).alias("p")).first()
    assert r.f == "Instruction: i1\nResponse: r1\n###END###\n\nInstruction: i2\nResponse:" and r.c.startswith("Instruction: i2\nResponse: r2\n") and r.p == [1, -100, -100]
    assert [bool(x) for x in values(spark, lambda a: text.template_free(F.array(F.lit(1)), F.array(F.lit(1), F.lit(9)), [9]), "x")] == [False]
