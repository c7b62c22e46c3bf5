"""Record validators: each adds a column of violations; callers quarantine rows, or fail."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

NEGATIVE_TYPES = ("unwarranted_refusal", "format_violation", "incorrect_factual", "off_topic", "verbose_vague")
INSTRUCTION_TYPES = ("qa", "completion", "generation", "response")


def _with(df: DataFrame, tests: list[tuple[Column, str]]) -> DataFrame:
    """df with violations: the names of tests that hold, in order. A null test holds nothing."""
    return df.withColumn("violations", F.array_compact(F.array(*[F.when(bad, F.lit(name)) for bad, name in tests])))


def _missing(df: DataFrame, *keys: str) -> list[tuple[Column, str]]:
    return [((F.col(k).isNull() if k in df.columns else F.lit(True)), f"missing {k}") for k in keys]


def sft(df: DataFrame, suffix: str = "END", types: tuple[str, ...] = INSTRUCTION_TYPES) -> DataFrame:
    text = F.col("formatted_text")
    return _with(
        df,
        [
            *_missing(df, "instruction", "response", "formatted_text", "instruction_type"),
            (~F.startswith(text, F.lit("Instruction:")), "no instruction prefix"),
            (~F.contains(text, F.lit("Response:")), "no response section"),
            (~F.endswith(text, F.lit(suffix)), "no end suffix"),
            (~F.col("instruction_type").isin(*types), "unknown instruction type"),
        ],
    )


def pair_format(df: DataFrame, order: str) -> str:
    """prompt or instruction, as the first row by order has it."""
    if "prompt" not in df.columns:
        return "instruction"
    first = df.orderBy(order).select("prompt").first()
    return "prompt" if first is not None and first.prompt is not None else "instruction"


def preference_pairs(df: DataFrame, form: str) -> DataFrame:
    """form: of pair_format."""
    keys = ("prompt", "chosen", "rejected", "instruction") if form == "prompt" else ("instruction", "chosen", "rejected")
    tests = [
        *_missing(df, *keys),
        (F.col("chosen") == F.col("rejected"), "identical chosen and rejected"),
        (F.length(strip(F.col("chosen"))) < 3, "chosen too short"),
        (F.length(strip(F.col("rejected"))) < 3, "rejected too short"),
    ]
    if form == "prompt":
        tests.append((~F.startswith("prompt", F.lit("Instruction:")), "no instruction prefix"))
    return _with(df, tests)


def negatives(df: DataFrame) -> DataFrame:
    return _with(
        df,
        [
            *_missing(df, "instruction", "negative_response", "negative_type"),
            (~F.col("negative_type").isin(*NEGATIVE_TYPES), "unknown negative type"),
            (F.length(strip(F.col("negative_response"))) < 3, "negative response too short"),
        ],
    )


def test_instructions(df: DataFrame) -> DataFrame:
    """Ids that occur again are violations too; they are counted first, then joined, so a hot id is one row of counts."""
    again = df.groupBy("id").agg(F.count("*").alias("_n")).where("_n > 1")
    joined = df.join(again, "id", "left")
    out = _with(
        joined,
        [
            *_missing(df, "instruction", "expected_type", "id"),
            (F.length(strip(F.col("instruction"))) < 5, "instruction too short"),
            (F.col("id") == "", "empty id"),
            (F.col("_n").isNotNull(), "duplicate id"),
        ],
    )
    return out.select(*df.columns, "violations")


def _filled(df: DataFrame, *keys: str) -> list[tuple[Column, str]]:
    return [(strip(F.col(k).cast("string")) == "", f"empty {k}") for k in keys if k in df.columns]


def instructions(df: DataFrame) -> DataFrame:
    """Rows of an instruction table: id, instruction (not blank) and instruction_type."""
    return _with(df, [*_missing(df, "id", "instruction", "instruction_type"), *_filled(df, "instruction")])


def filled_pairs(df: DataFrame) -> DataFrame:
    """Preference pairs whose prompt, chosen and rejected aren't blank."""
    return _with(df, [*_missing(df, "prompt", "chosen", "rejected"), *_filled(df, "prompt", "chosen", "rejected")])


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows) of a validator's result."""
    good = F.size("violations") == 0
    return checked.where(good).drop("violations"), checked.where(~good)


def all_valid(checked: DataFrame) -> bool:
    return checked.where(F.size("violations") > 0).isEmpty()


def fail_on(checked: DataFrame, what: str) -> DataFrame:
    """The rows, which raise when one with violations is read; raises at once on an empty table."""
    if checked.isEmpty():
        raise ValueError(f"{what}: no rows")
    text = F.concat(F.lit(f"{what}: "), F.array_join("violations", ", "))
    return checked.where(F.when(F.size("violations") > 0, F.raise_error(text).cast("boolean")).otherwise(True)).drop("violations")


def violation_counts(checked: DataFrame) -> DataFrame:
    return checked.select(F.explode("violations").alias("violation")).groupBy("violation").agg(F.count("*").alias("n"))


def apply(df: DataFrame, validator: Callable[[DataFrame], DataFrame], what: str) -> DataFrame:
    """Any validator, failing on violations."""
    return fail_on(validator(df), what)


def training_gate(df: DataFrame) -> DataFrame:
    """df if it has the two columns and rows; raises otherwise."""
    lacking = {"instruction", "response"} - set(df.columns)
    if lacking or df.isEmpty():
        raise ValueError(f"training data: {'missing ' + ', '.join(sorted(lacking)) if lacking else 'no rows'}")
    return df
