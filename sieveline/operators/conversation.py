"""Multi-turn conversations: history, checks of later turns, and verdicts on whole conversations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import cohens_kappa
from ..functions.text import contains_any

NAMES = {"user": "User", "assistant": "Assistant", "system": "System"}
CLARIFICATIONS = ("which", "what do you mean", "could you clarify")


def with_history(turns: DataFrame) -> DataFrame:
    """turns with history: what was said before in the conversation, one line a turn. It is as long as the conversation
    so far; conversations are bounded by the model's context."""
    name = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in NAMES.items() for x in (F.lit(k), F.lit(v))]), F.col("role")), F.col("role"))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    lines = F.collect_list(F.concat(name, F.lit(": "), F.col("text"), F.lit("\n"))).over(w)
    return turns.withColumn("history", F.array_join(lines, ""))


def entity_recall(turns: DataFrame, entities: DataFrame) -> DataFrame:
    """(conv_id, turn, entity, recalled): for each assistant turn, whether it names each entity (conv_id, turn, entity)
    of an earlier turn. Compared within conversations only."""
    later = turns.where("role = 'assistant'").select("conv_id", F.col("turn"), "text")
    e = entities.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), "entity")
    both = later.join(e, (F.col("conv_id") == F.col("_c")) & (F.col("_t") < F.col("turn")))
    return both.select("conv_id", "turn", "entity", F.contains(F.lower("text"), F.lower("entity")).alias("recalled"))


def respects(text: Column, forbidden: Column) -> Column:
    """No forbidden word (an array) is in the text."""
    return ~F.exists(forbidden, lambda w: F.contains(F.lower(text), F.lower(w)))


def asks_to_clarify(text: Column) -> Column:
    return contains_any(F.lower(text), CLARIFICATIONS)


def sane_length(text: Column, least: int = 10, most: int = 1000) -> Column:
    return F.length(text).between(least, most)


def conversation_pass(turns: DataFrame, passed: str = "passed", first: int = 2) -> DataFrame:
    """(conv_id, n_checked, passed): all turns from first on pass. Conversations without such turns pass."""
    late = F.col("turn") >= first
    return turns.groupBy("conv_id").agg(F.count_if(late).alias("n_checked"), F.coalesce(F.bool_and(F.when(late, F.col(passed))), F.lit(True)).alias("passed"))


def disagreement(rows: DataFrame, heuristic: str, judge: str, most: float = 0.10) -> DataFrame:
    out = rows.agg(F.count("*").alias("n"), F.avg((F.col(heuristic) != F.col(judge)).cast("double")).alias("rate"))
    return out.withColumn("passed", F.coalesce(F.col("rate") <= most, F.lit(False)))


def kappa(rows: DataFrame, first: str, second: str, least: float = 0.7) -> DataFrame:
    """(n, kappa, passed) for two raters' 0/1 verdicts."""
    a, b = F.col(first) == 1, F.col(second) == 1
    c = rows.agg(F.count("*").alias("n"), F.count_if(a & b).alias("_11"), F.count_if(a & ~b).alias("_10"), F.count_if(~a & b).alias("_01"), F.count_if(~a & ~b).alias("_00"))
    out = c.select("n", F.when(F.col("n") > 0, cohens_kappa(F.col("_11"), F.col("_10"), F.col("_01"), F.col("_00"))).alias("kappa"))
    return out.withColumn("passed", F.coalesce(F.col("kappa") >= least, F.lit(False)))


JUDGEMENT = "turns map<string,struct<result:string,reason:string>>, overall string"


def parse_judgement(text: Column) -> Column:
    """struct(overall_pass, all_turns_pass) of a judge's JSON: turn results under turn_k keys, and overall. Null for
    what isn't JSON."""
    turns = F.from_json(text, "map<string,string>")
    results = F.map_filter(turns, lambda k, v: F.startswith(k, F.lit("turn_")))
    passed = F.forall(F.map_values(results), lambda v: F.upper(F.coalesce(F.get_json_object(v, "$.result"), v)) == "PASS")
    return F.when(turns.isNotNull(), F.struct((F.upper(turns["overall"]) == "PASS").alias("overall_pass"), passed.alias("all_turns_pass")))


def quota_mix(df: DataFrame, group: str, order: Sequence[str], total: int, weights: dict[str, float]) -> DataFrame:
    """Rows of each category by its share of total."""
    from .ranking import take_quotas, weighted_quotas

    return take_quotas(df, group, order, weighted_quotas(total, weights))
