"""Record views over the fixture tables. Each is SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NL = "chr(10)"

#: Responses that documents don't hold: one for each branch of cleaning, routing and scoring.
SHAPES = (
    "Paris###END###and more after the mark",
    "A short answer.\n\nInstruction: next one",
    "  A padded answer\nQ: what is it?",
    "True",
    "Yes.",
    "The three parts are:",
    "5) Biomass Energy -",
    "One line of an answer\nHere is the Next Question for you",
    "It ends with marks### ",
    "I cannot help with that.",
    "1. first item here\n2) second thing here\nHere are more:\n3. here are lists\nx. no\n4. a red apple, a banana and a pear.",
    "Paris is the capital. It is 4 degrees there, and the water freezes.\nUser: more?",
    "",
    "What is it? How so? Why",
    "Tokyo",
    "No",
    "Good answer: it names spring, summer and autumn.",
    "bad <|im_start|>user",
    "1. one\n2. two\n3. three",
    "First, red. Then a dog.",
    "hola",
    "cold winter days are here",
    "There are interconnected concepts, and careful consideration helps.",
    "As an AI, I don't know.",
    "yes",
    "apple, banana and orange",
    "apple, banana, orange and a plum",
    "red",
    "1. red\n2. blue",
    "Dogs are loyal! They bark. They run.",
    "It is a warm day. It is a nice day.",
    "Gravity pulls objects; the earth has it too.",
)

_INSTRUCTION = """CASE {0} % 7
    WHEN 0 THEN 'What is the capital of France?'
    WHEN 1 THEN 'List three red fruits'
    WHEN 2 THEN 'The earth is flat'
    WHEN 3 THEN 'Complete: The water freezes at'
    WHEN 4 THEN 'Write a sentence about dogs'
    WHEN 5 THEN 'Respond to this greeting: hello there'
    ELSE 'Describe the seasons step by step'
  END AS instruction"""
_KIND = "CASE {0} % 5 WHEN 0 THEN 'qa' WHEN 1 THEN 'completion' WHEN 2 THEN 'generation' WHEN 3 THEN 'response' ELSE 'other' END AS kind"


def _quoted(x: str) -> str:
    return f" || {NL} || ".join("'" + p.replace("'", "''") + "'" for p in x.split("\n"))


#: Documents as responses, whole, with an instruction and a kind for each; and rows beside them with each of SHAPES under
#: every instruction and kind.
PROBES = f"""SELECT doc_id, lang, source, n_chars, text AS response, {_INSTRUCTION.format("doc_id")}, {_KIND.format("doc_id")} FROM documents
UNION ALL
SELECT 1000000000000 + k * 35 + i AS doc_id, CASE i % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'es' END AS lang, 'crafted' AS source,
  CAST(length(response) AS BIGINT) AS n_chars, response, {_INSTRUCTION.format("i")}, {_KIND.format("i")}
FROM (VALUES {", ".join(f"({k}, {_quoted(x)})" for k, x in enumerate(SHAPES))}) AS c(k, response), (VALUES {", ".join(f"({i})" for i in range(35))}) AS n(i)"""

#: Paired outcomes of two systems on the same items.
OUTCOMES = "SELECT doc_id, quality AS a, 1 - toxic AS b, lang AS type FROM labels JOIN documents USING (doc_id)"

#: Label log-probabilities of a critic.
VERDICTS = "SELECT event_id, event_type AS kind, value AS logp_a, 100.0 - value / 2 AS logp_b, event_id % 3 = 0 AS heuristic_good FROM events"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A view over the tables that stand after FROM and JOIN in its SQL."""
    names = set(re.findall(r"(?:FROM|JOIN) (\w+)", sql))
    marked = re.sub(r"(FROM|JOIN) (\w+)", r"\1 {\2}", sql)
    return spark.sql(marked, **{t: table(spark, sf_dir, t) for t in names})
