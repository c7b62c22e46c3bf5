"""Instruction and response pairs, preference pairs, and their statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import DPO_PROMPTS, dpo_prompt, first_paragraph, strip
from ..sources.files import kept
from .ranking import STEPS, draw_key, scanned


def turn_pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, instruction, response): each user turn with the assistant turn right after it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = turns.withColumn("_role", F.lead("role").over(w)).withColumn("response", F.lead("text").over(w))
    return t.where((F.col("role") == "user") & (F.col("_role") == "assistant")).select("conv_id", "turn", F.col("text").alias("instruction"), "response")


def positional_pairs(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of a and b by the same position key, as structs a and b. Raises unless both have the same keys (D-26)."""
    x, y = a.select(F.col(key), F.struct("*").alias("a")), b.select(F.col(key), F.struct("*").alias("b"))
    n_a, n_b, n = x.count(), y.count(), x.join(y, key).count()
    if not n_a == n_b == n:
        raise ValueError(f"results can't be paired: {n_a} and {n_b} rows, {n} with the same {key}")
    return x.join(y, key)


def join_negatives(good: DataFrame, negatives: DataFrame, key: str = "instruction") -> DataFrame:
    """Each good row with each of its negatives; rows without any are left out."""
    return good.join(negatives, key)


def capped(pairs: DataFrame, order: Sequence[str], cap: int = 500) -> DataFrame:
    """The first cap pairs by order: a top-k, not a sort of all."""
    return pairs.orderBy(*order).limit(cap)


def preference_pairs(joined: DataFrame, variant: str = "response") -> DataFrame:
    """joined (instruction, good_response, negative_response, ...) as prompt, chosen, rejected; equal ones are left out."""
    pairs = joined.where(strip(F.col("good_response")) != strip(F.col("negative_response")))
    rest = [c for c in joined.columns if c not in ("good_response", "negative_response", "prompt", "chosen", "rejected")]
    return pairs.select(dpo_prompt(F.col("instruction"), variant).alias("prompt"), F.col("good_response").alias("chosen"), F.col("negative_response").alias("rejected"), *rest)


def normalized_pairs(pairs: DataFrame) -> DataFrame:
    """prompt, chosen, rejected, instruction_type, margin: with defaults, and only confident ones. The prompt is made
    from the instruction where there is none."""
    has = pairs.columns
    col = lambda n, default: F.coalesce(F.col(n), F.lit(default)) if n in has else F.lit(default)
    prompt = [F.col("prompt")] * ("prompt" in has) + [dpo_prompt(F.col("instruction"))] * ("instruction" in has)
    return pairs.where(col("confident", True)).select(F.coalesce(*prompt).alias("prompt"), "chosen", "rejected", col("instruction_type", "unknown").alias("instruction_type"), col("margin", 0.0).cast("double").alias("margin"))


def flattened(pairs: DataFrame, metadata: str = "metadata") -> DataFrame:
    return pairs.select("prompt", "chosen", "rejected", f"{metadata}.*")


# Templates that stand for a bad and a good answer of each type.
BAD_TEMPLATES = {
    "qa": ("I don't know.", "That is a good question.", "What do you mean?"),
    "completion": ("...", "I cannot complete that.", "What comes next?"),
    "generation": ("I can't write that.", "Here is something.", "What should I write?"),
    "response": ("Okay.", "I can't respond to that.", "Why do you ask?"),
}
GOOD_TEMPLATES = {"qa": "Here is a clear and direct answer.", "completion": "Here is a fitting completion.", "generation": "Here is the text you asked for.", "response": "Here is a helpful reply."}


def fan_out(rows: DataFrame, bad_per_good: int = 2) -> DataFrame:
    """rows (id, instruction, instruction_type, response, is_good, margin) as pairs: a good response against so many
    bad templates, a bad one against the good template. Types without templates get those of response."""
    bad = F.create_map(*[x for k, v in BAD_TEMPLATES.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])
    good = F.create_map(*[x for k, v in GOOD_TEMPLATES.items() for x in (F.lit(k), F.lit(v))])
    pick = lambda m: F.coalesce(F.try_element_at(m, F.col("instruction_type")), F.element_at(m, F.lit("response")))
    first = first_paragraph(F.col("response"))
    keep = ["id", "instruction", "instruction_type", F.col("margin").alias("confidence_margin")]
    a = rows.where("is_good").select(*keep, strip(first).alias("chosen"), F.explode(F.slice(pick(bad), 1, bad_per_good)).alias("rejected"), F.lit("good_response").alias("source"))
    b = rows.where("NOT is_good").select(*keep, pick(good).alias("chosen"), strip(first).alias("rejected"), F.lit("bad_response").alias("source"))
    return a.unionByName(b)


def improvement_pairs(rows: DataFrame) -> DataFrame:
    """rows (instruction, original, improved, original_good, improved_good) as chosen, rejected, reason: the improved
    response wins unless only the original is good; none if both are bad or the same."""
    rows = rows.where((strip(F.col("original")) != strip(F.col("improved"))) & (F.col("original_good") | F.col("improved_good")))
    keep = F.col("original_good") & ~F.col("improved_good")
    reason = F.when(keep, "only the original is good").when(F.col("original_good"), "both good, improved preferred").otherwise("only the improved is good")
    return rows.select("instruction", F.when(keep, F.col("original")).otherwise(F.col("improved")).alias("chosen"), F.when(keep, F.col("improved")).otherwise(F.col("original")).alias("rejected"), reason.alias("reason"))


def critiqued_pairs(rows: DataFrame) -> DataFrame:
    """rows (instruction, original, improved, critique_error, improve_error): pairs where neither step failed."""
    return rows.where(F.col("critique_error").isNull() & F.col("improve_error").isNull()).select("instruction", F.col("improved").alias("chosen"), F.col("original").alias("rejected"))


def repaired_responses(rows: DataFrame) -> DataFrame:
    """rows (success, original, improved) with final: the improved one where the original failed."""
    return rows.withColumn("final", F.when(F.col("success"), F.col("original")).otherwise(F.coalesce("improved", "original")))


def sequence_margin(chosen_logp: Column, rejected_logp: Column, threshold: float = 0.5) -> Column:
    gap = chosen_logp - rejected_logp
    return F.struct(F.abs(gap).alias("margin"), (gap > threshold).alias("confident"))


def preference_stats(pairs: DataFrame, kind: str = "negative_type") -> DataFrame:
    """(total, n_confident, confident_rate, mean_margin) over all pairs and for each kind (null: all)."""
    out = pairs.rollup(kind).agg(F.count("*").alias("total"), F.count_if("confident").alias("n_confident"), F.avg("margin").alias("mean_margin"))
    return out.withColumn("confident_rate", F.try_divide(F.col("n_confident").cast("double"), F.col("total")))


def verdict_summary(rows: DataFrame, kind: str) -> DataFrame:
    """For all rows and each kind: confidence, verdicts, agreement with the heuristic, mean margin of confident rows.
    rows: is_good, confident, margin, heuristic_good."""
    agree = F.col("is_good") == F.col("heuristic_good")
    out = rows.rollup(kind).agg(
        F.count("*").alias("n"),
        F.count_if("confident").alias("n_confident"),
        F.count_if("is_good").alias("n_good"),
        F.count_if(~F.col("is_good")).alias("n_bad"),
        F.avg(agree.cast("double")).alias("agreement_rate"),
        F.avg(F.when(F.col("confident"), F.col("margin"))).alias("mean_confident_margin"),
    )
    return out.withColumn("confidence_rate", F.try_divide(F.col("n_confident").cast("double"), F.col("n")))


def best_of(rows: DataFrame, group: str, margin: str, order: str) -> DataFrame:
    """Of several responses to one prompt the one with the largest margin; ties: the first by order."""
    row = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(F.col(group).alias("_g")).agg(F.min_by(row, F.struct(-F.col(margin), F.col(order))).alias("_row")).select("_row.*")


def prompt_variants(df: DataFrame, instruction: str) -> DataFrame:
    """df with one row for each prompt format."""
    forms = F.array(*[F.struct(F.lit(v).alias("variant"), dpo_prompt(F.col(instruction), v).alias("prompt")) for v in DPO_PROMPTS])
    return df.withColumn("_f", F.explode(forms)).select("*", "_f.*").drop("_f")


def drawn_examples(targets: DataFrame, key: str, pool: DataFrame, order: Sequence[str], k: int = 3, seed: int = 42) -> DataFrame:
    """targets with examples: k different rows of the pool (all, where it has fewer) as an array of structs, drawn by the
    hash of key. The pool is numbered in order; a row's draws are steps of one prime, modulo the pool's size, from where
    its hash points: different, evenly spread over the pool, and found by joins on numbers. No pool is collected."""
    numbered = kept(scanned(pool, list(order), name="_at"), "pool")
    n = numbered.count()
    if not n:
        return targets.withColumn("examples", F.array().cast(f"array<{pool.schema.simpleString()}>"))
    step = next(p for p in STEPS if n % p)
    rows = kept(targets.withColumn("_row", F.monotonically_increasing_id()), "targets")
    start = F.pmod(F.conv(F.substring(draw_key(F.col(key), seed), 1, 8), 16, 10).cast("long"), F.lit(n))
    draws = rows.select("_row", start.alias("_start"), F.explode(F.sequence(F.lit(0), F.lit(min(k, n) - 1))).alias("_place"))
    draws = draws.withColumn("_at", F.pmod(F.col("_start") + F.col("_place") * F.lit(step).cast("long"), F.lit(n)) + 1)
    found = draws.join(numbered.select("_at", F.struct(*pool.columns).alias("_example")), "_at")
    shots = found.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "_example"))), lambda x: x["_example"]).alias("examples"))
    return rows.join(shots, "_row").drop("_row")
