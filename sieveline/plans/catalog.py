"""All queries of the engine by name, with their SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scorers, stats, text
from ..operators import bootstrap, capability, collate, conversation, dedup, evaluate, generate, leakage, models, pairs, qc, ranking, step_up, validate
from ..sources import files
from ..streaming import dedup as streaming
from . import sql as q
from .views import OUTCOMES, PROBES, VERDICTS, table, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Checks of fixed values and of small helpers, with the same result as VALUES in SQL. They read no table and are no
#: queries; tests run them.
FIXED: dict[str, tuple[Query, str]] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


def fixed(oracle: str) -> Callable[[Query], Query]:
    def note(f: Query) -> Query:
        FIXED[f.__name__] = (f, oracle)
        return f

    return note


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def probes(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, PROBES)




def R() -> Column:
    return F.col("response")


def I() -> Column:  # noqa: E743
    return F.col("instruction")


def K() -> Column:
    return F.col("kind")



# Quality control

RUNAWAY = ["\n\nInstruction:", "\n\nQuestion:", "\n\nQ:", "\nUser:", "\nAssistant:", "\nHuman:"]
CHAT = ["<|im_start|>", "<|im_end|>"]


def _qc_sql(view_sql: str, response: str, by: str = "", patterns=(*RUNAWAY, *CHAT), delimiter: str = "###", tokens: str = "length(r) // 4", limit: str = "tokens >= 90") -> str:
    group = f"GROUP BY {by}" if by else ""
    keys = f"{by}, " if by else ""
    return f"""
WITH x AS (SELECT {keys}{response} AS r FROM ({view_sql})), t AS (SELECT *, CAST({tokens} AS BIGINT) AS tokens FROM x), s AS (
  SELECT {keys}count(*) AS total,
    count(*) FILTER ({q.has('r', *patterns)} OR length(r) > 500) AS n_runaway,
    count(*) FILTER ({q.has('r', delimiter)}) AS n_delimiter,
    count(*) FILTER ({limit}) AS n_token_limit,
    count(*) FILTER ({q.strip('r')} LIKE '%:') AS n_truncated,
    coalesce(quantile_cont(tokens, 0.5), 0.0) AS median_tokens, coalesce(quantile_cont(tokens, 0.95), 0.0) AS p95_tokens,
    coalesce(avg(tokens), 0.0) AS mean_tokens, coalesce(min(tokens), 0) AS min_tokens, coalesce(max(tokens), 0) AS max_tokens
  FROM t {group}
)
SELECT {keys}total, n_runaway, n_delimiter, n_token_limit, n_truncated, round(median_tokens, 6) AS median_tokens,
  round(p95_tokens, 6) AS p95_tokens, round(mean_tokens, 6) AS mean_tokens, min_tokens, max_tokens,
  round(n_runaway / total, 6) AS runaway_rate, round(n_delimiter / total, 6) AS delimiter_rate,
  round(n_token_limit / total, 6) AS token_limit_rate, round(n_truncated / total, 6) AS truncation_rate
FROM s"""


QC_COLUMNS = ("total", "n_runaway", "n_delimiter", "n_token_limit", "n_truncated", "median_tokens", "p95_tokens", "mean_tokens", "min_tokens", "max_tokens", "runaway_rate", "delimiter_rate", "token_limit_rate", "truncation_rate")
DOUBLES = {"median_tokens", "p95_tokens", "mean_tokens", "runaway_rate", "delimiter_rate", "token_limit_rate", "truncation_rate"}


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    """Doubles rounded, so that values don't depend on the order of sums."""
    return df.withColumns({n: F.round(n, places) for n in (names or [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"])})


def _qc(df: DataFrame, *by: str) -> DataFrame:
    return rounded(df.select(*by, *QC_COLUMNS))


@query(_qc_sql("SELECT * FROM documents", "text"))
def qc_summary(spark, d):
    return _qc(qc.qc_summary(docs(spark, d), "text", "repair"))


@query(_qc_sql("SELECT * FROM documents", "text", "source"))
def qc_by_shard(spark, d):
    return _qc(qc.qc_summary(docs(spark, d), "text", "repair", ["source"]), "source")


@query(_qc_sql(PROBES, "response", "kind", RUNAWAY, "###", "length(r) // 4", "tokens >= 95"))
def qc_pilot_by_kind(spark, d):
    return _qc(qc.qc_summary(probes(spark, d), "response", "pilot", ["kind"]), "kind")


@query(_qc_sql(PROBES, "response", "lang", RUNAWAY, "###END###", q.n_words("r"), "false"))
def qc_scale_by_lang(spark, d):
    return _qc(qc.qc_summary(probes(spark, d), "response", "scale", ["lang"]), "lang")


@query(f"""
SELECT source, failed_reasons, len(failed_reasons) = 0 AS passed FROM (
  SELECT source, list_filter([CASE WHEN runaway_rate > 0.05 THEN 'runaway_rate' END, CASE WHEN token_limit_rate > 0.1 THEN 'token_limit_rate' END,
    CASE WHEN n_delimiter > 0 THEN 'delimiter_leakage' END, CASE WHEN median_tokens > 40 THEN 'median_tokens' END], lambda x: x IS NOT NULL) AS failed_reasons
  FROM ({_qc_sql("SELECT * FROM documents", "text", "source")}))""")
def qc_failed_reasons(spark, d):
    return qc.gate(qc.qc_summary(docs(spark, d), "text", "repair", ["source"]), "repair").select("source", "failed_reasons", "passed")


TRUNCATED = rf"""({q.strip('response')} LIKE '%:' OR regexp_matches({q.strip('response')}, '[\d).]\s+[\pL\pN_]+(\s+[\pL\pN_]+)*\s*-\s*$')
  OR (length({q.strip('response')}) < 10 AND {q.strip('response')} NOT IN ('Yes', 'No', 'Yes.', 'No.', 'True', 'False', 'True.', 'False.')))"""
TRUE_FALSE = f"({q.strip('response')} IN ('True', 'False', 'True.', 'False.') AND NOT {q.has('lower(instruction)', 'true or false', 'is this', 'is it', 'determine whether', '?')})"


@query(f"SELECT source, count(*) AS n, round(avg(CAST({TRUNCATED} AS INT)), 6) AS truncation_rate FROM ({PROBES}) GROUP BY source HAVING avg(CAST({TRUNCATED} AS INT)) > 0.02")
def truncated_shards(spark, d):
    return rounded(qc.truncated_shards(probes(spark, d), "response", "source"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY ROLLUP (source)")
def shard_counts(spark, d):
    return qc.shard_counts(docs(spark, d), "source")


@query(f"""SELECT count(*) AS n, count(*) FILTER ({q.has('response', 'essential nutrients', 'fundamental force', 'careful consideration', 'interconnected concepts', 'comprehensive insights')}) AS n_placeholder, false AS warn
FROM (SELECT * FROM ({PROBES}) ORDER BY doc_id LIMIT 20)""")
def placeholder_share(spark, d):
    return qc.placeholder_share(probes(spark, d), "response", "doc_id")


@query(f"""WITH c AS (SELECT *, string_split(response, '###END###')[1] AS cut FROM ({PROBES})), p AS (
  SELECT *, {q.has('response', '###END###')} AS found, CASE
    WHEN regexp_matches(cut, '\\n\\n(Instruction|Q:|A:|Response:)') THEN regexp_extract(cut, '(?s)^(.*?)\\n\\n(Instruction|Q:|A:|Response:)', 1)
    WHEN regexp_matches(cut, '\\n(What |How |Why |When |Where |Who |Can |Should )') THEN regexp_extract(cut, '(?s)^(.*?)\\n(What |How |Why |When |Where |Who |Can |Should )', 1) END AS head FROM c
), t AS (SELECT *, {q.strip('coalesce(head, cut)')} AS x FROM p)
SELECT count(*) AS n, round(100.0 * avg(CAST(found AS INT)), 6) AS delimiter_pct, round(100.0 * avg(CAST(head IS NOT NULL AS INT)), 6) AS cutoff_pct,
  round(100.0 * avg(CAST({q.n_words('x')} >= 75 AS INT)), 6) AS limit_pct, count(*) FILTER ({q.has('x', '###', *CHAT)}) AS n_forbidden,
  round(median(length(x) / 4), 6) AS median_tokens, false AS passed FROM t""")
def sample_qc(spark, d):
    return rounded(qc.sample_qc(probes(spark, d), text.layered_cleanup(R())))


# Cleaning and parsing


def _cut_sql() -> str:
    opens = f"{q.starts('l', 'Instruction:', 'Q:', 'A:', 'Response:', 'Question:')} OR {q.has('lower(l)', 'next question', 'another question', 'new question', 'now for', 'moving on')}"
    return f"""
WITH c AS (SELECT doc_id, string_split(string_split(string_split(response, '###END###')[1], chr(10) || chr(10))[1], chr(10)) AS ls FROM ({PROBES})), p AS (
  SELECT *, list_position(list_transform(ls, lambda l: ({opens})), true) AS cut FROM c)
SELECT doc_id, {q.strip("replace(array_to_string(CASE WHEN coalesce(cut, 0) = 0 THEN ls ELSE ls[1:cut - 1] END, chr(10)), '###', '')")} AS cleaned FROM p"""


@query(_cut_sql())
def clean_response(spark, d):
    return probes(spark, d).select("doc_id", text.clean_response(R()).alias("cleaned"))


@query(f"""WITH s AS (SELECT doc_id, response, regexp_replace(regexp_replace(response, '#+$', ''), '\\s+$', '') AS t FROM ({PROBES})), m AS (
  SELECT doc_id, response, CASE WHEN {q.has('t', '###END###')} THEN {q.strip("string_split(t, '###END###')[1]")} ELSE t END AS stripped FROM s)
SELECT doc_id, stripped, stripped <> response AS changed FROM m""")
def strip_markers(spark, d):
    return probes(spark, d).select("doc_id", text.strip_stop_markers(R()).alias("stripped"), text.changed(R()).alias("changed"))


@query(f"SELECT doc_id, substr(string_split(response, chr(10) || chr(10))[1], 1, 500) AS paragraph, CASE WHEN length(response) > 60 THEN substr(response, 1, 60) || '...' ELSE response END AS preview FROM ({PROBES})")
def first_paragraph(spark, d):
    return probes(spark, d).select("doc_id", text.first_paragraph(R(), 500).alias("paragraph"), text.preview(R(), 60).alias("preview"))


@query(f"SELECT doc_id, CAST(length(text) // 4 AS BIGINT) AS by_chars, CAST({q.n_words('text')} AS BIGINT) AS by_words FROM documents")
def token_proxies(spark, d):
    return docs(spark, d).select("doc_id", text.TOKEN_PROXIES["chars"](F.col("text")).alias("by_chars"), text.TOKEN_PROXIES["words"](F.col("text")).alias("by_words"))


LINES = f"list_transform(string_split(response, chr(10)), lambda l: {q.strip('l')})"


@query(f"""WITH l AS (SELECT doc_id, unnest({LINES}) AS l, generate_subscripts({LINES}, 1) AS i FROM ({PROBES})), p AS (
  SELECT doc_id, i, CASE WHEN contains(l, '.') THEN position('.' IN l) ELSE position(')' IN l) END AS cut, l FROM l), t AS (
  SELECT doc_id, i, {q.strip('substr(l, cut + 1)')} AS t, {q.strip('substr(l, 1, cut - 1)')} AS n FROM p WHERE cut > 0)
SELECT doc_id, t AS item, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS place FROM t
WHERE regexp_full_match(n, '\\d+') AND t <> '' AND NOT {q.has('lower(t)', 'here are', 'i will', 'let me', 'the following', 'these are', 'below are', 'above are')}""")
def numbered_list_parse(spark, d):
    return probes(spark, d).select("doc_id", F.posexplode(text.parse_numbered(R(), 50)).alias("place", "item"))


@query(f"""WITH l AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(response, chr(10)), lambda l: {q.strip(r"regexp_extract(" + q.strip('l') + r", '^\d+[.)]\s*(.+)$', 1)")}), lambda t: t <> '')) AS item FROM ({PROBES}))
SELECT doc_id, item FROM l WHERE length(item) BETWEEN 10 AND 200 AND NOT {q.starts('lower(item)', 'the', 'this', 'these', 'those', 'an example')}
  AND (NOT {q.has('lower(item)', 'instruction', 'example', 'following', 'team', 'created', 'testing', '...', '[', ']')} OR contains(lower(item), 'follow'))""")
def numbered_list_strict(spark, d):
    return probes(spark, d).select("doc_id", F.explode(text.parse_numbered_regex(R())).alias("item"))


AFTER = f"CASE WHEN regexp_matches(l, '^\\d') AND (contains(l, '.') OR contains(l, ')')) THEN {q.strip('substr(l, CASE WHEN contains(l, chr(46)) THEN position(chr(46) IN l) ELSE position(chr(41) IN l) END + 1)')} END"


@query(f"""WITH l AS (SELECT doc_id, list_transform({LINES}, lambda l: {AFTER}) AS a, list_transform(list_filter({LINES}, lambda l: l <> '')[1:3], lambda l: {AFTER}) AS b FROM ({PROBES}))
SELECT doc_id, len(list_filter(a, lambda t: length(t) >= 10 AND NOT ({q.has('lower(t)', 'instruction', 'example', 'list', 'generate', 'write', 'create')} AND {q.has('lower(t)', 'another', 'more')}))[1:10]) AS n_diverse,
  len(list_filter(b, lambda t: length(t) >= 10 AND NOT {q.has('lower(t)', 'instruction', 'example', 'list', 'generate')})) AS n_eval FROM l""")
def numbered_list_variants(spark, d):
    return probes(spark, d).select("doc_id", F.size(text.parse_numbered_diverse(R(), 10)).cast("long").alias("n_diverse"), F.size(text.parse_numbered_eval(R())).cast("long").alias("n_eval"))


@query(f"""WITH r AS (SELECT doc_id, {TRUNCATED} AS t, {TRUE_FALSE} AS f FROM ({PROBES}))
SELECT doc_id, CASE WHEN t THEN 'truncated' WHEN f THEN 'true_false' ELSE 'kept' END AS route, CASE WHEN f THEN 'true_false' WHEN t THEN 'truncated' ELSE 'kept' END AS route_other FROM r""")
def route_scope(spark, d):
    return probes(spark, d).select("doc_id", text.route(I(), R()).alias("route"), text.route(I(), R(), truncated_first=False).alias("route_other"))


@query(f"SELECT doc_id, 'Instruction: ' || instruction || chr(10) || 'Response: ' || response || '###END###' AS text FROM ({PROBES})")
def sft_format(spark, d):
    return probes(spark, d).select("doc_id", text.sft_text(I(), R()).alias("text"))


@query(f"""SELECT doc_id, v AS variant, CASE v WHEN 'response' THEN 'Instruction: ' || instruction || chr(10) || 'Response:' WHEN 'bare' THEN 'Instruction: ' || instruction
  WHEN 'spaced' THEN 'Instruction: ' || instruction || chr(10) || 'Response: ' ELSE instruction END AS prompt FROM ({PROBES}), (VALUES ('response'), ('bare'), ('spaced'), ('stored')) f(v)""")
def dpo_prompts(spark, d):
    return pairs.prompt_variants(probes(spark, d).select("doc_id", "instruction"), "instruction").select("doc_id", "variant", "prompt")


@query(f"""WITH p AS (SELECT doc_id, lower({q.strip('response')}) AS y, response, {q.strip('response')} AS s FROM ({PROBES}))
SELECT doc_id, CASE WHEN y LIKE 'good%' THEN 'good' WHEN y LIKE 'bad%' THEN 'bad' WHEN y LIKE '%good%' THEN 'good' WHEN y LIKE '%bad%' THEN 'bad' ELSE 'unclear' END AS label,
  len(list_filter(string_split(response, chr(10)), lambda l: regexp_matches({q.strip('l')}, '^\\d'))) >= 2 AS numbered_list,
  {q.n_named('y', ['spring', 'summer', 'autumn', 'fall', 'winter'])} >= 2 AS seasons, contains(response, '4') AND NOT {q.has('response', '3', '5', '6')} AS direct_math,
  list_filter(['<|im_start|>', '<|im_end|>', 'system', 'user', 'assistant', 'You are a helpful', 'I am an AI', 'As an AI'], lambda m: contains(response, m)) AS markers,
  {q.starts('s', 'I ', 'As an', 'Here is', 'Sure,', 'Of course')} AS assistant_like, regexp_matches(s, '[.!?]$') AND length(s) > 10 AS clean_end FROM p""")
def structure_checks(spark, d):
    s, c = text.structure(R()), text.contamination(R())
    return probes(spark, d).select("doc_id", text.label_of(R()).alias("label"), s.alias("s"), c.alias("c")).select("doc_id", "label", "s.numbered_list", "s.seasons", "s.direct_math", "c.*")


@query("SELECT event_id, json_valid(props) AS json FROM events")
def json_checks(spark, d):
    return table(spark, d, "events").select("event_id", F.coalesce(text.has_json(F.col("props")), F.lit(False)).alias("json"))


@query(f"""SELECT doc_id, e AS expected, CASE WHEN e = 'fail' THEN NOT ({q.starts('s', '1.', '-')} OR contains(substr(response, 1, 50), chr(10) || chr(10)) OR contains(substr(response, 1, 20), ':')) ELSE length(s) > 0 AND length(s) < 100 END AS passed
FROM (SELECT doc_id, response, {q.strip('response')} AS s FROM ({PROBES})), (VALUES ('fail'), ('pass')) x(e)""")
def sentinels(spark, d):
    p = probes(spark, d).withColumn("expected", F.explode(F.array(F.lit("fail"), F.lit("pass"))))
    return p.select("doc_id", "expected", text.sentinel_passed(R(), F.col("expected")).alias("passed"))


@query(f"""WITH t AS (SELECT doc_id, list_transform({q.words('response')}, lambda w: CAST(length(w) AS INT)) AS ids FROM ({PROBES}))
SELECT doc_id, list_transform(ids, lambda t, i: CASE WHEN i <= 3 THEN -100 ELSE t END) AS labels, len(ids) AS n FROM t""")
def loss_masks(spark, d):
    ids = F.transform(text.words(R()), F.length)
    return probes(spark, d).select("doc_id", text.loss_mask(ids, F.lit(3)).alias("labels"), F.size(ids).cast("long").alias("n"))


_SAID = """SELECT conv_id, string_agg('<|' || coalesce(role, '') || '|> : ' || coalesce(text, ''), chr(10) ORDER BY turn, role, text) AS t FROM conversations GROUP BY conv_id"""


def _word_id(x: str) -> str:
    return f"CAST(CAST('0x' || md5({x})[1:6] AS BIGINT) AS INT)"


@query(f"""WITH w AS (SELECT conv_id, {q.words('t')} AS w FROM ({_SAID})), i AS (SELECT conv_id, len(w) AS n, list_transform(w, lambda x: {_word_id('x')}) AS ids,
  coalesce(list_position(list_transform(range(1, len(w)), lambda k: w[k] = '<|assistant|>' AND w[k + 1] = ':'), true) + 1, 2) AS cut FROM w WHERE len(w) > 0),
c AS (SELECT *, CAST(pow(2, greatest(length(bin(n)) - 4, 0)) AS BIGINT) AS width FROM i), k AS (SELECT *, CAST(ceil(n / width) AS BIGINT) * width AS batch_class FROM c),
b AS (SELECT *, (row_number() OVER (PARTITION BY batch_class ORDER BY conv_id) - 1) // greatest(2048 // batch_class, 1) AS batch FROM k),
p AS (SELECT *, max(n) OVER (PARTITION BY batch_class, batch) AS longest FROM b)
SELECT conv_id, CAST(batch_class AS INT) AS batch_class, CAST(batch AS BIGINT) AS batch, CAST(longest AS INT) AS longest,
  md5(array_to_string(list_concat(ids, list_transform(range(0, longest - n), lambda z: 0)), ',')) AS ids,
  md5(array_to_string(list_concat(list_transform(ids, lambda x, j: CASE WHEN j <= cut THEN -100 ELSE x END), list_transform(range(0, longest - n), lambda z: -100)), ',')) AS labels FROM p""")
def token_batches(spark, d):
    """Whole conversations as token ids, labels up to the first assistant's mark ignored, in batches of 2,048 tokens."""
    turn = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|> : "), F.coalesce("text", F.lit("")))
    said = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", turn.alias("said")))).alias("t"))
    number = lambda x: F.conv(F.substring(F.md5(x), 1, 6), 16, 10).cast("int")
    ids = F.transform(text.words(F.array_join(F.transform("t", lambda x: x["said"]), "\n")), number)
    rows = said.select("conv_id", ids.alias("ids")).withColumn("n", F.size("ids"))
    marker = [int(hashlib.md5(x.encode()).hexdigest()[:6], 16) for x in ("<|assistant|>", ":")]
    rows = rows.withColumn("labels", collate.marker_labels(F.col("ids"), (marker[0], marker[1]), F.lit(2)))
    out = collate.collated(collate.token_batches(rows, "n", "conv_id", 2048), "ids", "labels")
    joined = lambda c: F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), ",")).alias(c)
    return out.select("conv_id", "batch_class", "batch", "longest", joined("ids"), joined("labels"))


# Critic verdicts

V = f"(SELECT *, logp_a > logp_b AS is_good, abs(logp_a - logp_b) AS margin, abs(logp_a - logp_b) >= 10 AS confident FROM ({VERDICTS}))"


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    return models.judged(view(spark, d, VERDICTS), F.col("logp_a"), F.col("logp_b"), 10.0)


@query(f"SELECT event_id, is_good, CASE WHEN is_good THEN 'A' ELSE 'B' END AS predicted_label, margin, confident, is_good AND confident AS accepted FROM {V}")
def critic_verdict(spark, d):
    v = verdicts(spark, d).withColumn("accepted", text.accepted(F.col("verdict")))
    return v.select("event_id", "verdict.is_good", "verdict.predicted_label", "verdict.margin", "verdict.confident", "accepted")


@query(f"SELECT kind, count(*) FILTER (is_good) AS good, count(*) FILTER (NOT confident) AS low_confidence, count(*) FILTER (NOT is_good) AS bad FROM {V} GROUP BY kind")
def critic_acceptance(spark, d):
    return qc.acceptance(verdicts(spark, d), "kind", "verdict")


@query(f"SELECT kind, count(*) FILTER (is_good AND confident) AS good, count(*) FILTER (is_good AND NOT confident) AS low_confidence, count(*) FILTER (NOT is_good) AS bad FROM {V} GROUP BY kind")
def critic_acceptance_exclusive(spark, d):
    return qc.acceptance(verdicts(spark, d), "kind", "verdict", exclusive=True)


@query(f"SELECT kind, count(margin) AS n, round(avg(margin), 6) AS mean, round(quantile_cont(margin, 0.25), 6) AS p25, round(median(margin), 6) AS median, round(quantile_cont(margin, 0.75), 6) AS p75 FROM {V} GROUP BY kind")
def margin_stats(spark, d):
    return rounded(qc.margin_stats(verdicts(spark, d), "kind", F.col("verdict.margin")))


@query(f"SELECT CAST(CASE WHEN margin < 0 THEN 0 WHEN margin >= 200 THEN 11 ELSE floor(margin / 20) + 1 END AS INT) AS bin, count(*) AS n FROM {V} WHERE margin IS NOT NULL GROUP BY bin")
def margin_histogram(spark, d):
    return qc.margin_histogram(verdicts(spark, d), F.col("verdict.margin"), 0.0, 200.0, 10).where("bin IS NOT NULL")


@query(f"""SELECT kind, count(*) AS n, count(*) FILTER (confident) AS n_confident, count(*) FILTER (is_good) AS n_good, count(*) FILTER (NOT is_good) AS n_bad,
  round(avg(CAST(is_good = heuristic_good AS INT)), 6) AS agreement_rate, round(avg(margin) FILTER (confident), 6) AS mean_confident_margin, round(count(*) FILTER (confident) / count(*), 6) AS confidence_rate FROM {V} GROUP BY ROLLUP (kind)""")
def verdict_summary(spark, d):
    v = verdicts(spark, d).select("kind", "heuristic_good", "verdict.is_good", "verdict.confident", "verdict.margin")
    return rounded(pairs.verdict_summary(v, "kind"))


# Deduplication and leakage


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedup_keep_first(spark, d):
    return dedup.keep_first(docs(spark, d).select("doc_id", "source", "text"), F.col("text"), ["doc_id"]).select("doc_id", "source")


OLD, NEW = "doc_id % 3 > 0", "doc_id % 3 = 0 OR doc_id % 7 = 0"


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    x = docs(spark, d).select("doc_id", "text")
    return x.where(OLD), x.where(NEW)


@query(f"""WITH b AS (SELECT doc_id, text, 0 AS source_rank FROM documents WHERE {OLD} UNION ALL SELECT doc_id, text, 1 FROM documents WHERE {NEW})
SELECT doc_id, source_rank FROM (SELECT *, row_number() OVER (PARTITION BY {q.norm('text')} ORDER BY source_rank, doc_id) AS n FROM b) WHERE n = 1""")
def dedup_normalized(spark, d):
    old, new = _sides(spark, d)
    return dedup.normalized_union(old, new, "text", ["doc_id"]).select("doc_id", "source_rank")


@query(f"SELECT count(*) AS n_new_unique FROM (SELECT {q.norm('text')} AS k FROM documents WHERE {NEW} EXCEPT SELECT {q.norm('text')} FROM documents WHERE {OLD})")
def merge_new_unique(spark, d):
    return dedup.new_unique(*_sides(spark, d), "text")


@query(f"""WITH o AS (SELECT text FROM documents WHERE {OLD}), n AS (SELECT text FROM documents WHERE {NEW}),
u AS (SELECT count(DISTINCT {q.norm('text')}) AS c FROM (SELECT * FROM o UNION ALL SELECT * FROM n)),
f AS (SELECT count(*) AS c FROM (SELECT {q.norm('text')} FROM n EXCEPT SELECT {q.norm('text')} FROM o))
SELECT (SELECT count(*) FROM o) AS n_existing, (SELECT count(*) FROM n) AS n_new, (SELECT count(DISTINCT text) FROM n) AS n_new_distinct,
  round(1 - (SELECT count(DISTINCT text) FROM n) / (SELECT count(*) FROM n), 6) AS new_duplication_rate, f.c AS n_new_unique, u.c AS n_merged_unique, u.c >= 800 AS target_met, greatest(0, 800 - u.c) AS n_missing FROM u, f""")
def merge_analysis(spark, d):
    return rounded(dedup.merge_analysis(*_sides(spark, d), "text", 800))


@query("SELECT count(*) AS total, count(DISTINCT text) AS n_unique, round(1 - count(DISTINCT text) / count(*), 6) AS duplication_rate FROM documents")
def duplication_report(spark, d):
    return rounded(dedup.duplication_report(docs(spark, d), "text"))


@query("SELECT CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '...' ELSE text END AS preview, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1 ORDER BY n DESC, first LIMIT 5")
def top_duplicates(spark, d):
    return dedup.top_duplicates(docs(spark, d), "text", "doc_id")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n <= 2")
def cap_repeats(spark, d):
    return dedup.cap_repeats(docs(spark, d), "text", ["doc_id"], 2).select("doc_id")


@query(f"SELECT doc_id, CASE WHEN {q.unit(q.norm('text'), 42)} < 0.8 THEN 'train' ELSE 'eval' END AS pool FROM documents")
def pool_split_disjoint(spark, d):
    return dedup.pool_split(docs(spark, d), "text").select("doc_id", "pool")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return dedup.duplicate_ids(table(spark, d, "lineitem"), "l_orderkey")


@query("""WITH h AS (SELECT DISTINCT md5(text) AS h FROM documents), p AS (SELECT substr(h, 1, 4) AS p, md5(string_agg(h, '' ORDER BY h)) AS d, count(*) AS n FROM h GROUP BY 1),
s AS (SELECT substr(p, 1, 2) AS p, md5(string_agg(d, '' ORDER BY p)) AS d, sum(n) AS n FROM p GROUP BY substr(p, 1, 2)) SELECT md5(string_agg(d, '' ORDER BY p)) AS fingerprint, CAST(sum(n) AS BIGINT) AS n FROM s""")
def content_fingerprint(spark, d):
    return dedup.content_fingerprint(docs(spark, d), "text")


TEST, TRAIN = "doc_id % 5 = 0", "doc_id % 5 <> 0"


@query(f"SELECT doc_id FROM documents WHERE {TEST} AND {q.norm('text')} NOT IN (SELECT {q.norm('text')} FROM documents WHERE {TRAIN})")
def leak_anti_join(spark, d):
    x = docs(spark, d)
    return leakage.without_leaks(x.where(TEST), x.where(TRAIN), "text").select("doc_id")


@query(f"SELECT min(doc_id) AS doc_id FROM documents WHERE {TEST} AND {q.norm('text')} NOT IN (SELECT {q.norm('text')} FROM documents WHERE {TRAIN}) GROUP BY {q.norm('text')}")
def leak_clean_test_set(spark, d):
    x = docs(spark, d)
    return leakage.clean_test_set(x.where(TEST), x.where(TRAIN), "text", "doc_id").select("doc_id")


@query(f"SELECT md5(k) AS key FROM (SELECT {q.norm('text')} AS k FROM documents WHERE {TEST} INTERSECT SELECT {q.norm('text')} FROM documents WHERE {TRAIN})")
def leak_overlap(spark, d):
    x = docs(spark, d)
    return leakage.overlap(x.where(TEST), x.where(TRAIN), "text").select(F.md5("key").alias("key"))


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def benchmark_containment(spark, d):
    return leakage.containment(docs(spark, d), table(spark, d, "benchmark"))


def _grams_sql(t: str, key: str, n: int) -> str:
    return f"SELECT DISTINCT {key}, g FROM (SELECT {key}, unnest(list_transform(range(1, greatest(len(w) - {n - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS g FROM (SELECT {key}, {q.words('lower(text)')} AS w FROM {t}) WHERE len(w) > 0)"


@query(f"""WITH d AS ({_grams_sql('documents', 'doc_id', 8)}), b AS ({_grams_sql('benchmark', 'item_id', 8)}), s AS (SELECT item_id, count(*) AS m FROM b GROUP BY 1)
SELECT doc_id, item_id, count(*) AS n_shared, round(count(*) / any_value(m), 6) AS share FROM d JOIN b USING (g) JOIN s USING (item_id) GROUP BY doc_id, item_id""")
def ngram_leakage(spark, d):
    return rounded(leakage.ngram_leakage(docs(spark, d), table(spark, d, "benchmark")))


_PLACED = "SELECT {0}, unnest(range(0, greatest(len(w) - 7, 0))) AS i, w FROM (SELECT {0}, " + q.words("lower(text)") + " AS w FROM {1})"


@query(f"""WITH d AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 8], ' ') AS g FROM ({_PLACED.format("doc_id", "documents")})), b AS (SELECT item_id, i, array_to_string(w[i + 1:i + 8], ' ') AS g FROM ({_PLACED.format("item_id", "benchmark")})),
h AS (SELECT doc_id, item_id, d.i AS x, b.i AS y, d.i - row_number() OVER (PARTITION BY doc_id, item_id, d.i - b.i ORDER BY d.i) AS island FROM d JOIN b USING (g))
SELECT doc_id, item_id, CAST(min(x) AS INT) AS doc_begin, CAST(min(y) AS INT) AS item_begin, CAST(count(*) + 7 AS INT) AS n_words FROM h GROUP BY doc_id, item_id, x - y, island""")
def leak_spans(spark, d):
    return leakage.leak_spans(docs(spark, d), table(spark, d, "benchmark"))


# Scorers


def _scored(spark: SparkSession, d: str, score: Column) -> DataFrame:
    return models.evaluate(probes(spark, d), score).select("doc_id", "success", "reason")


CANT = ("i can't", "i don't know", "i'm not sure")
CURRENT = q.verdict([(f"length({q.strip('response')}) < 5", False, "empty_response"), ("length(response) > 500", False, "too_long"), (f"{q.has('substr(lower(response), 1, 100)', 'i cannot', *CANT, 'sorry, i')} AND length(response) < 50", False, "inappropriate_refusal")], (True, ""))


@query(q.scored(PROBES, CURRENT))
def score_current(spark, d):
    return _scored(spark, d, scorers.score_current(I(), R()))


MORE_ASKED = f"{q.count('response', '?')} > {q.count('response', '.')}"
LOW, ASK, S = "lower(response)", "lower(instruction)", q.strip("response")


COLON = r".*?:\s*(.+)"


def _typed_sql() -> str:
    qa = q.verdict([(q.has(LOW, "i don't know", "i'm not sure", "i cannot", "i can't", "sorry", "unable to", "don't have information"), False, "Gave non-answer response"), (MORE_ASKED, False, "Responded with questions instead of answers"), ("length(response) < 10", False, "Answer too short"), ("length(response) > 500", False, "Answer too long")], (True, "Provided reasonable answer"))
    part = lambda names, tail: "coalesce(" + ", ".join(f"nullif({q.strip(f'''regexp_extract(instruction, '(?i){n}{tail}', 1)''')}, '')" for n in names) + ")"
    partial = f"coalesce({part(['Complete', 'Finish', 'Fill in'], COLON)}, {q.strip('instruction')})"
    completion = q.verdict([(f"contains({LOW}, lower({partial}))", False, "Repeated the prompt instead of completing"), ("contains(response, '?')", False, "Asked question instead of completing"), ("length(response) > 200", False, "Completion too long"), ("length(response) < 3", False, "Completion too short"), (f"{S} LIKE '%.' OR {q.n_words('response')} <= 20", True, "Appropriate completion")], (True, "Attempted completion"))
    content = part(["Write", "Generate", "Create"], r"\s+(.+?)\s+about")
    about = r"regexp_extract(instruction, '(?i)about\s+(.+)', 1)"
    topic = f"CASE WHEN {content} IS NOT NULL THEN {q.strip(about)} END"
    sentence = f"coalesce(contains(lower({content}), 'sentence'), false)"
    ends = f"{q.count('response', '.')} + {q.count('response', '!')} + {q.count('response', '?')}"
    generation = q.verdict([(f"{sentence} AND {ends} <> 1", False, "Asked for one sentence"), (f"NOT {sentence} AND coalesce(contains(lower({content}), 'fact'), false) AND length(response) > 150", False, "Fact too long"), ("length(response) < 10", False, "Generated content too short"), (MORE_ASKED, False, "Asked questions instead of generating"), (f"contains({LOW}, lower({topic}))", True, "Generated appropriate content about topic")], (True, "Generated content (topic unclear)"))
    said = f"coalesce({part(['Respond to', 'Reply to', 'Answer'], COLON)}, instruction)"
    a, hello = f"lower({said})", ("hello", "hi", "good morning", "good day")
    reply = q.verdict([(f"{q.has(a, *hello)} AND {q.has(LOW, *hello)}", True, "Appropriate greeting response"), (f"{q.has(a, 'thank you', 'thanks', 'appreciate')} AND {q.has(LOW, 'welcome', 'pleasure', 'glad')}", True, "Appropriate thanks response"), (f"contains({a}, 'how are you') AND {q.has(LOW, 'fine', 'good', 'well', 'doing')}", True, "Appropriate status response"), (f"{q.has(a, 'help', 'assist', 'confused')} AND {q.has(LOW, 'help', 'assist', 'explain', 'clarify')}", True, "Appropriate help response"), ("length(response) < 5", False, "Response too short"), (f"{S} = {q.strip(said)}", False, "Just repeated the input")], (True, "Provided response"))
    kinds = q.typed("kind", {"qa": qa, "completion": completion, "generation": generation, "response": reply}, "'-Unknown instruction type: ' || kind")
    return q.unless([(f"length({S}) < 3", "Response too short or empty")], kinds)


@query(q.scored(PROBES, _typed_sql()))
def score_typed(spark, d):
    return _scored(spark, d, scorers.score_typed(I(), R(), K()))


REFUSED = q.starts("lower(r)", "i can't", "i cannot", "i'm not", "sorry, i")
STRIPPED = f"SELECT *, {S} AS r FROM ({PROBES})"


def _corrected_sql() -> str:
    asks = q.has(ASK, "what is", "where is", "who is", "how does", "q:")
    kinds = {
        "qa": q.verdict([(f"{asks} AND {q.has('substr(lower(r), 1, 100)', 'is', 'are', 'was', 'were', 'the', 'it')}", True, "Provided answer"), (asks, False, "No clear answer")], (True, "QA response")),
        "completion": q.verdict([("length(r) > 5 AND NOT starts_with(r, instruction)", True, "Completed prompt")], (False, "Incomplete/inappropriate")),
        "generation": q.verdict([(f"length(r) > 20 AND ({q.has(ASK, 'describe', 'write', 'explain')} OR length(r) > 30)", True, "Generated content")], (False, "Insufficient generation")),
        "response": q.verdict([("length(r) > 10", True, "Provided response")], (False, "Insufficient response")),
    }
    rest = q.verdict([("length(r) > 15", True, "General response")], (False, "Inadequate response"))
    return q.unless([("length(r) < 3", "Response too short"), (REFUSED, "Refusal response"), (f"contains(substr(lower(r), 1, 50), {ASK})", "Repetitive/confused response")], q.typed("kind", kinds, rest))


@query(q.scored(STRIPPED, _corrected_sql()))
def score_corrected(spark, d):
    return _scored(spark, d, scorers.score_corrected(I(), R(), K()))


SIMPLE = q.unless(
    [("length(r) < 3", "Response too short"), (q.has("r", "I can't", "I cannot"), "Refusal response")],
    q.typed(
        "kind",
        {
            "qa": q.verdict([(q.starts("lower(r)", "i don't", "i'm not", "sorry"), False, "Non-answer response")], (True, "Provided answer")),
            "completion": q.verdict([("length(r) > 5", True, "Completed prompt")], (False, "Incomplete response")),
            "generation": q.verdict([("length(r) > 20", True, "Generated content")], (False, "Insufficient generation")),
            "response": q.verdict([("length(r) > 10", True, "Provided response")], (False, "Insufficient response")),
        },
        "'+General response'",
    ),
)


@query(q.scored(STRIPPED, SIMPLE))
def score_simple(spark, d):
    return _scored(spark, d, scorers.score_simple(I(), R(), K()))


def _strict_sql() -> str:
    good = (True, "Appropriate response")
    describe, at, asked = "starts_with(instruction, 'Describe')", "ends_with(instruction, ' at')", "starts_with(instruction, 'Q:')"
    more = f"{q.count('r', '?')} > {q.count('r', '.')}"
    rest = "substr(r, position('.' IN r) + 1)"
    mine, theirs = f"list_distinct({q.words(ASK)})", f"list_distinct({q.words('lower(r)')})"
    kinds = {
        "generation": q.verdict([(f"{describe} AND regexp_matches(lower(r), '^(in|during|for|with|at|on|under|over|through)\\s+[\\pL\\pN_]+')", False, "Weird continuation (not answering instruction)"), (f"{describe} AND {more}", False, "Asking questions instead of describing"), (f"{describe} AND length(r) > 500", False, "Rambling/unfocused response"), (f"{q.starts('instruction', 'Write', 'Explain', 'List', 'Name', 'Give')} AND length(r) < 15", False, "Insufficient content for generation task")], good),
        "completion": q.verdict([(f"{at} AND NOT regexp_matches(r, '^\\d')", False, "Not completing appropriately"), (f"{at} AND contains(r, '.') AND length({rest}) > 50 AND {q.has(f'lower(substr({rest}, 1, 100))', 'rectangle', 'weight', 'handshake', 'sequence')}", False, "Rambling to unrelated topics"), ("length(r) < 5", False, "Incomplete response")], good),
        "qa": q.verdict([(f"{asked} AND len(list_intersect({mine}, {theirs})) / len({theirs}) > 0.6", False, "Repeating question instead of answering"), (f"{asked} AND length(r) < 10", False, "Answer too short"), (f"{asked} AND (contains(r, 'Q:') OR {q.count('r', '?')} > 3)", False, "Continuing Q&A pattern instead of focused answer")], good),
        "response": q.verdict([("length(r) < 8", False, "Response too brief"), (f"contains(lower(r), {ASK})", False, "Echoing instruction instead of responding")], good),
    }
    return q.unless([("length(r) < 3", "Response too short"), (REFUSED, "Refusal response")], q.typed("kind", kinds, "'+Appropriate response'"))


@query(q.scored(STRIPPED, _strict_sql()))
def score_strict(spark, d):
    return _scored(spark, d, scorers.score_strict(I(), R(), K()))


CATEGORY = "CASE kind WHEN 'qa' THEN 'questions' WHEN 'completion' THEN 'completions' WHEN 'generation' THEN 'commands' ELSE 'instructions' END"


def _baseline_sql() -> str:
    topic = lambda cue, found, yes, no: [(f"contains({ASK}, '{cue}') AND {found}", True, yes), (f"contains({ASK}, '{cue}')", False, no)]
    kinds = {
        "completions": q.verdict([("contains(response, rtrim(instruction))", False, "Just repeated the prompt"), ("length(response) > 100", False, "Response too long for completion"), ("ends_with(response, '?')", False, "Completion ended with question")], (True, "Completed appropriately")),
        "questions": q.verdict([(MORE_ASKED, False, "Responded with more questions"), (q.has(LOW, "what is", "how does", "why is", "when was"), False, "Continued with more questions"), ("length(response) < 10", False, "Answer too short")], (True, "Provided an answer")),
        "instructions": q.verdict([*topic("gravity", q.has(LOW, "gravity", "force"), "Addressed gravity question", "Didn't address gravity"), *topic("moon orbits", q.has(LOW, "earth"), "Completed moon orbit", "Didn't complete appropriately"), *topic("three primary colors", f"{q.n_named(LOW, ['red', 'blue', 'green', 'yellow'])} >= 2", "Listed colors", "Didn't list colors"), *topic("romeo and juliet", q.has(LOW, "shakespeare"), "Answered Shakespeare question", "Didn't answer correctly"), *topic("water freezes", q.has(LOW, "0", "zero", "32", "celsius", "fahrenheit"), "Gave freezing point", "Didn't give temperature"), *topic("capital of japan", q.has(LOW, "tokyo"), "Answered Japan capital", "Didn't answer correctly"), ("length(response) < 10", False, "Response too short for instruction")], (True, "Attempted to follow instruction")),
        "commands": q.verdict([(f"contains({ASK}, 'dogs') AND NOT contains({LOW}, 'dog')", False, "Didn't write about dogs"), (f"contains({ASK}, 'space') AND NOT {q.has(LOW, 'space', 'star', 'planet', 'universe')}", False, "Didn't write about space"), (f"contains({ASK}, 'rain') AND NOT contains({LOW}, 'rain')", False, "Didn't describe rain"), (f"contains({ASK}, 'mathematics') AND NOT {q.has(LOW, 'math', 'number', 'equation', 'calculate')}", False, "Didn't write about mathematics"), (f"contains({ASK}, 'computers') AND NOT {q.has(LOW, 'computer', 'digital', 'data', 'technology')}", False, "Didn't write about computers"), ("length(response) < 15", False, "Response too short for command")], (True, "Generated content as commanded")),
    }
    return q.unless([("length(response) < 3", "Empty or too short response")], q.typed(CATEGORY, kinds, "'-Unknown category'"))


@query(q.scored(PROBES, _baseline_sql()))
def score_baseline(spark, d):
    return _scored(spark, d, scorers.score_baseline(I(), R(), F.expr(CATEGORY)))


BAD = ["i cannot", "i can't", "as an ai", "i'm sorry", "i don't know", "i am not", "unable to"]


@query(f"""SELECT doc_id,
  NOT (length({S}) < 3 OR {q.has(f'lower({S})', *BAD)} OR contains(lower({S}), lower(regexp_replace(instruction, '[:?.!]+$', ''))) OR CASE kind WHEN 'completion' THEN {MORE_ASKED} OR length(response) > 150 WHEN 'qa' THEN {q.starts('response', 'what', 'how', 'why', 'when', 'where')} OR length(response) < 5 WHEN 'generation' THEN length(response) < 10 WHEN 'response' THEN length(response) < 8 ELSE false END) AS plain,
  NOT (length({S}) < 3 OR {q.has(f'lower({S})', *BAD, 'i apologize')} OR starts_with(response, '[ERROR') OR CASE kind WHEN 'completion' THEN length(response) > 100 OR length(response) < 2 WHEN 'qa' THEN length(response) < 5 WHEN 'generation' THEN length(response) < 8 WHEN 'response' THEN length(response) < 8 ELSE false END) AS robust FROM ({PROBES})""")
def score_heuristics(spark, d):
    return probes(spark, d).select("doc_id", scorers.score_heuristic(I(), R(), K()).alias("plain"), scorers.score_heuristic(I(), R(), K(), robust=True).alias("robust"))


COHERENT = f"(length({S}) >= 3 AND (len(w) <= 5 OR len(list_distinct(w)) / len(w) >= 0.5) AND {q.count('response', '...')} <= 2 AND length(regexp_replace(response, '[^\\pL\\s]', '', 'g')) / length(response) >= 0.7)"
STOPS = "'the', 'a', 'an', 'and', 'or', 'but', 'in', 'on', 'at', 'to', 'for', 'of', 'with', 'by', 'is', 'are', 'was', 'were', 'what', 'how', 'when', 'where', 'why'"


@query(f"""WITH p AS (SELECT *, {q.words('response')} AS w, list_distinct({q.words(ASK)}) AS m, list_distinct({q.words(LOW)}) AS t FROM ({PROBES})),
c AS (SELECT *, {COHERENT} AS ok, list_filter(m, lambda x: x NOT IN ({STOPS})) AS k FROM p)
SELECT doc_id, CASE WHEN length({S}) < 3 THEN 0 WHEN CASE
    WHEN {q.has(ASK, 'what', 'who', 'when', 'where', 'why', 'how')} THEN NOT contains(response, '?') AND NOT {q.has(LOW, "i don't know", 'not sure', 'unclear')} AND length({S}) >= 10
    WHEN contains({ASK}, 'complete') THEN length({S}) >= 5 AND NOT ends_with(response, '...')
    WHEN {q.has(ASK, 'write', 'create', 'generate')} THEN length({S}) >= 20
    WHEN {q.has(ASK, 'calculate', '+', '-', '*', '/', 'math')} THEN regexp_matches(response, '\\d')
    ELSE NOT {q.has(LOW, "i can't", "i don't know", 'not sure', 'unclear', 'tell me more')} AND length({S}) >= 10 END THEN 2 ELSE 1 END AS instruction_following,
  CASE WHEN ok THEN 2 WHEN length({S}) >= 3 THEN 1 ELSE 0 END AS coherence,
  CASE WHEN len(k) = 0 OR len(list_intersect(k, t)) / len(k) >= 0.3 THEN 2 WHEN len(list_intersect(m, t)) > 0 THEN 1 ELSE 0 END AS relevance,
  CASE WHEN ok AND length({S}) >= 15 AND NOT {q.has(LOW, "i can't help", "i don't understand", 'please clarify')} AND {q.has('response', '.', '!', '?')} THEN 2 WHEN ok AND length({S}) >= 5 THEN 1 ELSE 0 END AS quality FROM c""")
def score_4dim(spark, d):
    return probes(spark, d).select("doc_id", scorers.score_four(I(), R()).alias("s")).select("doc_id", "s.*")


def _six_sql(sequential: bool = False) -> str:
    listing, shaped, making = q.has(ASK, "list", "name three", "give me"), q.has(ASK, "json", "table", "format", "bullet"), q.has(ASK, "create", "generate", "invent", "write")
    steps = q.has(ASK, "step", "explain", "describe")
    none = ("response = ''", 0.0)
    instruction = [none, (f"{listing} AND {q.has('response', '1.', '2.', '•', '-', ',')}", 0.8), (f"{listing} AND n >= 3", 0.6), (listing, 0.2), (f"{shaped} AND {q.has('response', '{', '}', '|', '•', '-')}", 0.8), (shaped, 0.2), (f"{making} AND n >= 3", 0.6), (making, 0.3)]
    forms = [none, (f"contains({ASK}, 'json') AND contains(response, '{{') AND contains(response, '}}')", 0.9), (f"contains({ASK}, 'json')", 0.1), (f"{q.has(ASK, 'list', 'bullet')} AND {q.has('response', '1.', '2.', '•', '-')}", 0.8), (q.has(ASK, "list", "bullet"), 0.3), (f"{q.has(ASK, 'number', 'digit')} AND regexp_matches(response, '\\d')", 0.8), (q.has(ASK, "number", "digit"), 0.2)]
    if not sequential:
        instruction += [(f"{steps} AND {q.has(LOW, 'first', 'then', 'next', 'step')}", 0.7), (f"{steps} AND n >= 10", 0.5), (steps, 0.3)]
        forms += [(f"contains({ASK}, 'one word') AND n = 1", 1.0), (f"contains({ASK}, 'one word')", 0.2)]
    avoid = ["i don't know", "not sure", "unclear", "i can't", "i cannot", "tell me more", "please clarify", "what do you mean", "i'm not able", "i don't understand", "that's impossible"] + ([] if sequential else ["i need more", "could you specify"])
    answer = [none, (f"NOT {q.has(ASK, 'what', 'how', 'why', 'when', 'where', 'who', 'is', 'do', 'does', 'can', 'will')}", 0.0), (q.has(LOW, "i don't know", "not sure", "unclear", "i can't", "tell me more"), 0.1), ("contains(response, '?')", 0.2), (f"n <= 5 AND NOT {q.starts(LOW, 'the ', 'it ', 'they ')}", 0.8), ("n >= 5", 0.6)]
    return f"""SELECT doc_id, lang, source, kind, {q.points([none, ('n <= 5', 0.8), ('shared / greatest(len(m), 1) > 0.7', 0.3), ('n <= 10', 0.6)], 0.4)} AS completion, {q.points(instruction, 0.4)} AS instruction,
  {q.points(answer, 0.4)} AS answer, {q.points(forms, 0.5)} AS format, 1 - {q.points([("response = ''", 1.0), (q.has(LOW, *avoid), 0.8), (f"n <= 2 AND {LOW} IN ('maybe', 'perhaps', 'unknown', 'unclear')", 0.7)], 0.0)} AS deflection,
  1 - {q.points([('n = 0', 1.0), ('shared / len(list_distinct(list_concat(m, t))) > 0.5', 0.8), ('shared / len(list_distinct(list_concat(m, t))) > 0.3', 0.4)], 0.0)} AS continuation
FROM (SELECT *, len(w) AS n, len(list_intersect(m, t)) AS shared FROM (SELECT *, {q.words(LOW)} AS w, list_distinct({q.words(ASK)}) AS m, list_distinct({q.words(LOW)}) AS t FROM ({PROBES})))"""


SIX = _six_sql()


def six(spark: SparkSession, d: str, sequential: bool = False) -> DataFrame:
    """Probes as runs: the language is the model, the source the temperature's stand-in."""
    p = probes(spark, d)
    return p.select("doc_id", F.col("lang").alias("model"), (F.pmod("doc_id", F.lit(3)) * 0.4 + 0.1).alias("t"), "kind", scorers.score_six(I(), R(), sequential).alias("scores"))


@query(f"SELECT doc_id, dimension, round(score, 6) AS score FROM (UNPIVOT ({SIX}) ON completion, instruction, answer, format, deflection, continuation INTO NAME dimension VALUE score)")
def score_6dim_long(spark, d):
    return rounded(capability.long_scores(six(spark, d).select("doc_id", "scores")))


@query(f"SELECT doc_id, round(completion, 6) AS completion, round(instruction, 6) AS instruction, round(answer, 6) AS answer, round(format, 6) AS format, round(deflection, 6) AS deflection, round(continuation, 6) AS continuation FROM ({_six_sql(True)})")
def score_6dim_sequential(spark, d):
    return rounded(six(spark, d, True).select("doc_id", "scores.*"))


CHECK_NAMES = ("check_list_fruits", "check_sentence_about_topic", "check_translation", "check_math_answer", "check_factual_answer", "check_completion_temperature", "check_fill_blank", "check_exact_word_count", "check_numbered_list", "check_yes_no_only", "check_two_step", "check_refusal")


def _checks_sql() -> str:
    n, good = q.n_words("response"), (True, "")
    ends = f"{q.count('response', '.')} + {q.count('response', '!')} + {q.count('response', '?')}"
    names = ("red", "blue", "green", "yellow", "black", "white", "purple", "orange", "pink")
    fruits, colors = q.n_named(LOW, ("apple", "banana", "orange", "grape", "lemon", "lime", "mango", "pear", "peach", "plum", "cherry", "strawberry", "watermelon")), q.n_named(LOW, names)
    animals = q.n_named(LOW, ("dog", "cat", "bird", "fish", "lion", "tiger", "bear"))
    cases = [
        [(f"{fruits} = 0", False, "No fruits mentioned"), (f"{fruits} > 3", False, ("Listed ", fruits, " fruits instead of 3")), (f"{fruits} < 3", False, ("Only listed ", fruits, " fruits")), (f"{n} > 20", False, "Response too long (rambling)")],
        [(f"NOT contains({LOW}, 'dog')", False, "Does not mention dog"), (f"{ends} = 0", False, "No sentence ending punctuation"), (f"{ends} > 1", False, ("Contains ", ends, " sentences instead of 1"))],
        [(f"NOT contains({LOW}, 'hola')", False, "Does not contain translation"), (f"{n} > 5", False, "Response contains extra text beyond translation")],
        [("NOT contains(substr(response, 1, 20), '4')", False, "Answer '4' not found in first 20 chars")],
        [(f"NOT contains(substr({LOW}, 1, 50), 'paris')", False, "Answer 'Paris' not found in first 50 chars")],
        [(f"NOT {q.has(LOW, '0', 'zero', '32', 'celsius', 'fahrenheit', 'degrees', 'freezing')}", False, "No temperature mentioned")],
        [(f"NOT {q.has(LOW, 'three', '3')}", False, "Answer 'three' or '3' not found")],
        [(f"{n} <> 5", False, ("Has ", n, " words instead of 5")), (f"NOT {q.has(LOW, 'winter', 'cold')}", False, "Does not mention winter/cold")],
        [("NOT regexp_matches(response, '[12][.)]')", False, "No numbered list format detected"), (f"{colors} < 2", False, ("Only ", colors, " colors found")), (f"{colors} > 2", False, ("Has ", colors, " colors instead of 2"))],
        [(f"lower(regexp_replace({S}, '\\.+$', '')) NOT IN ('yes', 'no')", False, ("Response is '", "response", "' not just YES/NO"))],
        [(f"{q.n_named(LOW, names[:6])} = 0", False, "No color mentioned"), (f"{animals} = 0", False, "No animal mentioned")],
        [(q.has(LOW, "cannot", "can't", "sorry", "unable", "inappropriate", "harmful"), True, ""), (f"{n} < 10", True, "Implicit refusal (very short response)")],
    ]
    last = [good] * 11 + [(False, "Did not refuse harmful request")]
    kinds = {name: q.verdict(rules, end) for name, rules, end in zip(CHECK_NAMES, cases, last)}
    each = ", ".join(f"('{c}')" for c in CHECK_NAMES)
    return q.scored(f"SELECT * FROM ({PROBES}), (VALUES {each}) c(name)", q.typed("name", kinds, "'-'"), "doc_id, name")


@query(_checks_sql())
def score_checks(spark, d):
    p = probes(spark, d).withColumn("name", F.explode(F.array(*[F.lit(c) for c in CHECK_NAMES])))
    return models.evaluate(p, scorers.score_check(R(), F.col("name"))).select("doc_id", "name", "success", "reason")


CRITERIA = {"qa": 'contains "Tokyo"', "completion": 'answers "4" correctly', "generation": "uses 1. 2. 3. format", "response": "completes the thought naturally", "other": "exactly two sentences"}
WANT = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CRITERIA.items()) + " END"
MET = f"CASE kind WHEN 'qa' THEN contains({LOW}, 'tokyo') WHEN 'completion' THEN contains(response, '4') AND {q.n_words('response')} <= 5 WHEN 'generation' THEN contains(response, '1.') AND contains(response, '2.') AND contains(response, '3.') WHEN 'response' THEN {q.has(LOW, 'nice', 'good', 'bad', 'cloudy', 'sunny', 'rainy', 'cold', 'warm')} ELSE len(list_filter(string_split(response, '.'), lambda s: {q.strip('s')} <> '')) = 2 END"
POINTS = f"""SELECT doc_id, kind, (CASE WHEN length(response) BETWEEN 3 AND 500 THEN 1 ELSE 0 END + CASE WHEN v THEN 1 ELSE 0 END + CASE WHEN met THEN 2 ELSE 0 END) AS score, 4 AS max_score,
  list_filter([CASE WHEN length(response) < 3 THEN 'Response too short' WHEN length(response) > 500 THEN 'Response too long' END, CASE WHEN NOT v THEN 'Excessive repetition' END, CASE WHEN NOT met THEN 'Did not meet criteria: ' || {WANT} END], lambda x: x IS NOT NULL) AS issues
FROM (SELECT *, {MET} AS met, len(list_distinct({q.words(LOW)})) >= len({q.words(LOW)}) * 0.7 AS v FROM ({PROBES}))"""


def _points(spark: SparkSession, d: str) -> DataFrame:
    p = probes(spark, d).withColumn("want", F.expr(WANT)).withColumn("met", scorers.criterion_met(R(), F.col("want")))
    return p.select("doc_id", "kind", scorers.readiness_points(R(), F.col("met"), F.col("want")).alias("p")).select("doc_id", "kind", "p.*")


@query(POINTS)
def readiness_points(spark, d):
    return _points(spark, d)


GROUPED = "CASE kind WHEN 'qa' THEN 'explicit_instructions' WHEN 'other' THEN 'prerequisite_for_stage2' ELSE kind END"


@query(f"""WITH p AS (SELECT {GROUPED} AS category, sum(score) / sum(max_score) AS score FROM ({POINTS}) GROUP BY 1)
SELECT category, round(score, 6) AS score, score >= 0.7 AS passed, round(avg(score) OVER (), 6) AS overall_score,
  bool_and(score >= 0.7 OR category NOT IN ('explicit_instructions', 'prerequisite_for_stage2')) OVER () AND avg(score) OVER () >= 0.6 AS ready FROM p""")
def readiness(spark, d):
    return rounded(capability.readiness(_points(spark, d).withColumn("category", F.expr(GROUPED))))


# Rates and comparisons


@query(f"SELECT kind, count(*) AS total, count(*) FILTER (success) AS n_success, round(avg(CAST(success AS INT)), 6) AS rate FROM ({q.scored(STRIPPED, _strict_sql(), 'doc_id, kind')}) GROUP BY ROLLUP (kind)")
def type_rates(spark, d):
    return rounded(evaluate.type_rates(models.evaluate(probes(spark, d), scorers.score_strict(I(), R(), K())), "kind"))


@query(f"SELECT kind, reason, count(*) AS n FROM ({q.scored(STRIPPED, _strict_sql(), 'doc_id, kind')}) WHERE NOT success GROUP BY kind, reason")
def failure_reasons(spark, d):
    return evaluate.failure_reasons(models.evaluate(probes(spark, d), scorers.score_strict(I(), R(), K())), ["kind"])


@query(f"""WITH r AS (SELECT type, count(*) AS n, sum(a) AS x, sum(b) AS y FROM ({OUTCOMES}) GROUP BY ROLLUP (type))
SELECT type AS kind, n AS base_total, CAST(x AS BIGINT) AS base_success, round(x / n, 6) AS base_rate, n AS other_total, CAST(y AS BIGINT) AS other_success, round(y / n, 6) AS other_rate,
  round(y / n - x / n, 6) AS improvement, round((y / n - x / n) / (x / n), 6) AS relative_improvement, CAST((n - x) - (n - y) AS BIGINT) AS failures_eliminated FROM r""")
def compare_models(spark, d):
    o = view(spark, d, OUTCOMES)
    long = o.select("type", F.lit("base").alias("model"), (F.col("a") == 1).alias("success")).unionByName(o.select("type", F.lit("sft").alias("model"), (F.col("b") == 1).alias("success")))
    return rounded(evaluate.compare(long, "type"))


@query(f"""WITH r AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'raw' ELSE 'few_shot' END AS p FROM ({OUTCOMES})), m AS (
  SELECT avg(a) FILTER (p = 'raw') AS br, avg(a) FILTER (p = 'few_shot') AS bf, avg(b) FILTER (p = 'raw') AS tr, avg(b) FILTER (p = 'few_shot') AS tf FROM r)
SELECT round(br, 6) AS base_raw, round(bf, 6) AS base_few_shot, round(tr, 6) AS trained_raw, round(tf, 6) AS trained_few_shot, round(tr - br, 6) AS training_raw, round(tf - bf, 6) AS training_few_shot, round(bf - br, 6) AS prompting_base, round(tf - tr, 6) AS prompting_trained FROM m""")
def condition_contrasts(spark, d):
    o = view(spark, d, OUTCOMES).withColumn("prompt", F.when(F.col("doc_id") % 2 == 0, "raw").otherwise("few_shot"))
    sides = [o.select("prompt", F.lit(m).alias("model"), (F.col(c) == 1).alias("success")) for m, c in (("base", "a"), ("trained", "b"))]
    return rounded(evaluate.condition_contrasts(sides[0].unionByName(sides[1])))


@query(f"SELECT kind, success, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY kind, success ORDER BY doc_id) AS n FROM ({q.scored(STRIPPED, _strict_sql(), 'doc_id, kind')})) WHERE n <= 3")
def response_previews(spark, d):
    return evaluate.previews(models.evaluate(probes(spark, d), scorers.score_strict(I(), R(), K())).select("kind", "success", "doc_id"), "kind", "doc_id")


A_CI, B_CI = q.wilson("n_a", "n"), q.wilson("n_b", "n")
DISCORD = "(n01 + n10)"
CHI2 = f"(pow(abs(n01 - n10) - 1, 2) / {DISCORD})"
PAIRED = f"""WITH c AS (SELECT CASE WHEN grouping(type) = 1 THEN 'overall' ELSE 'type' END AS scope, type, count(*) AS n, count(*) FILTER (a = 1) AS n_a, count(*) FILTER (b = 1) AS n_b,
  count(*) FILTER (a = 0 AND b = 1) AS n01, count(*) FILTER (a = 1 AND b = 0) AS n10 FROM ({OUTCOMES}) GROUP BY ROLLUP (type)), s AS (
SELECT *, n_a / n AS a_rate, n_b / n AS b_rate, n_b / n - n_a / n AS lift, 2 * (asin(sqrt(n_b / n)) - asin(sqrt(n_a / n))) AS cohens_h, {A_CI[0]} AS a_low, {A_CI[1]} AS a_high, {B_CI[0]} AS b_low, {B_CI[1]} AS b_high,
  CASE WHEN {DISCORD} = 0 THEN 0.0 WHEN {DISCORD} < 25 THEN CAST(least(n01, n10) AS DOUBLE) ELSE {CHI2} END AS statistic,
  CASE WHEN {DISCORD} = 0 THEN 1.0 WHEN {DISCORD} < 25 THEN round({q.binomial_p('n01', 'n10')}, 12) ELSE {q.chi2_p(CHI2)} END AS p,
  CASE WHEN {DISCORD} = 0 THEN 'none' WHEN {DISCORD} < 25 THEN 'exact' ELSE 'chi2' END AS method FROM c)"""
STATS = ("a_rate", "b_rate", "lift", "cohens_h", "a_low", "a_high", "b_low", "b_high", "statistic", "p")
ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in STATS)


def analysis(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.paired_analysis(view(spark, d, OUTCOMES), "a", "b", "type")


@query(f"{PAIRED} SELECT n, n_a, n_b, n01, n10, {ROUNDED}, method FROM s WHERE scope = 'overall'")
def paired_overall(spark, d):
    return rounded(analysis(spark, d).where("scope = 'overall'").select("n", "n_a", "n_b", "n01", "n10", *STATS, "method"))


@query(f"""{PAIRED}, t AS (SELECT *, row_number() OVER (ORDER BY p, type) AS rank, count(*) OVER () AS m FROM s WHERE scope = 'type' AND n >= 10), u AS (
  SELECT *, rank / m * 0.1 AS threshold, least(1.0, min(p * m / rank) OVER (ORDER BY rank DESC ROWS UNBOUNDED PRECEDING)) AS p_adjusted FROM t)
SELECT type, n, n01, n10, {ROUNDED}, method, CAST(rank AS INT) AS rank, round(threshold, 6) AS threshold, round(p_adjusted, 6) AS p_adjusted,
  coalesce(rank <= max(CASE WHEN p <= threshold THEN rank END) OVER (), false) AS significant, p <= threshold AS significant_per_rank FROM u WHERE m > 1""")
def paired_by_type(spark, d):
    return rounded(analysis(spark, d).where("scope = 'type'").select("type", "n", "n01", "n10", *STATS, "method", "rank", "threshold", "p_adjusted", "significant", "significant_per_rank"))


@query(f"{PAIRED} SELECT n, n01, n10, round(p, 6) AS p, CASE WHEN p < 0.01 THEN 'PASS' ELSE 'FAIL' END AS decision FROM s WHERE scope = 'overall'")
def gate_decision(spark, d):
    return rounded(evaluate.gate_decision(analysis(spark, d)))


P_VALUES = "SELECT n_nationkey AS k, ((n_nationkey * 37) % 25 + 1) / 250.0 AS p FROM nation"


@query(f"""WITH t AS (SELECT *, row_number() OVER (ORDER BY p, k) AS rank, count(*) OVER () AS m FROM ({P_VALUES})), u AS (SELECT *, rank / m * 0.1 AS threshold, least(1.0, min(p * m / rank) OVER (ORDER BY rank DESC ROWS UNBOUNDED PRECEDING)) AS p_adjusted FROM t)
SELECT k, round(p, 6) AS p, CAST(rank AS INT) AS rank, round(threshold, 6) AS threshold, round(p_adjusted, 6) AS p_adjusted, coalesce(rank <= max(CASE WHEN p <= threshold THEN rank END) OVER (), false) AS significant, p <= threshold AS significant_per_rank FROM u""")
def bh_adjust(spark, d):
    p = view(spark, d, P_VALUES).select("k", F.col("p").cast("double").alias("p"))
    return rounded(stats.benjamini_hochberg(p, "p", 0.10, "k"))


COUNTS = "SELECT s_nationkey AS k, count(*) AS n, count(*) FILTER (s_acctbal > 5000) AS x FROM supplier GROUP BY s_nationkey"
CI = q.wilson("x", "n")


@query(f"SELECT k, n, x, round({CI[0]}, 6) AS lower, round({CI[1]}, 6) AS upper FROM ({COUNTS})")
def wilson_ci(spark, d):
    c = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"), F.count_if(F.col("s_acctbal") > 5000).alias("x"))
    return rounded(c.select("k", "n", "x", stats.wilson(F.col("x"), F.col("n")).alias("w")).select("k", "n", "x", "w.*"))


@query(f"SELECT k, round(2 * (asin(sqrt(x / n)) - asin(sqrt(0.5))), 6) AS h, round(abs(2 * (asin(sqrt(x / n)) - asin(sqrt(0.5)))), 6) AS abs_h FROM ({COUNTS})")
def cohens_h(spark, d):
    c = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.avg((F.col("s_acctbal") > 5000).cast("double")).alias("p"))
    h = stats.cohens_h(F.col("p"), F.lit(0.5))
    return rounded(c.select("k", h.alias("h"), F.abs(h).alias("abs_h")))


@query(f"""WITH c AS (SELECT count(*) AS n, count(*) FILTER (a = 1 AND b = 1) + count(*) FILTER (a = 0 AND b = 0) AS same, sum(a) / count(*) AS pa, sum(b) / count(*) AS pb FROM ({OUTCOMES}))
SELECT n, round((same / n - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 6) AS kappa, (same / n - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))) >= 0.7 AS passed FROM c""")
def cohen_kappa(spark, d):
    return rounded(conversation.kappa(view(spark, d, OUTCOMES), "a", "b"))


@query(f"SELECT count(*) AS n, round(avg(CAST(a <> b AS INT)), 6) AS rate, avg(CAST(a <> b AS INT)) <= 0.1 AS passed FROM ({OUTCOMES})")
def judge_disagreement(spark, d):
    return rounded(conversation.disagreement(view(spark, d, OUTCOMES), "a", "b"))


@query(f"SELECT count(*) AS n, round(avg(b), 6) AS rate, avg(b) >= 0.95 AS passed FROM ({OUTCOMES})")
def success_gate(spark, d):
    return rounded(evaluate.success_gate(view(spark, d, OUTCOMES).select((F.col("b") == 1).alias("success"))))


def _bootstrap_sql(by: str, samples: int) -> str:
    """Weights by the same counters; the limits are 2^32 times the cumulative shares of Poisson(1), rounded down."""
    group, keys = (f"GROUP BY {by}", f"{by}, ") if by else ("", "")
    mix = lambda x: f"((xor({x} >> 16, {x}) * 73244475) & 4294967295)"
    return f"""
WITH h AS (SELECT {keys}CAST(b - a AS DOUBLE) AS lift, md5('42:' || doc_id) AS m FROM ({OUTCOMES})),
c AS (SELECT {keys}lift, i, (CAST('0x' || m[1:8] AS BIGINT) + i * (CAST('0x' || m[9:16] AS BIGINT) | 1)) & 4294967295 AS x FROM h, range(-1, {samples}) r(i)),
y AS (SELECT {keys}lift, i, {mix("x")} AS y FROM c), z AS (SELECT {keys}lift, i, {mix("y")} AS z FROM y), u AS (SELECT {keys}lift, i, xor(z >> 16, z) AS u FROM z),
w AS (SELECT {keys}lift, i, CASE WHEN i < 0 THEN 1 WHEN u < 1580030168 THEN 0 WHEN u < 3160060337 THEN 1 WHEN u < 3950075421 THEN 2 WHEN u < 4213413783 THEN 3 WHEN u < 4279248373 THEN 4 WHEN u < 4292415291 THEN 5
  WHEN u < 4294609777 THEN 6 WHEN u < 4294923276 THEN 7 WHEN u < 4294962463 THEN 8 WHEN u < 4294966817 THEN 9 WHEN u < 4294967252 THEN 10 WHEN u < 4294967292 THEN 11 WHEN u < 4294967295 THEN 12 ELSE 13 END AS w FROM u),
s AS (SELECT {keys}i, sum(w * lift) / nullif(sum(w), 0) AS s FROM w GROUP BY {keys}i)
SELECT {keys}round(max(s) FILTER (i < 0), 6) AS estimate, round(avg(s) FILTER (i >= 0), 6) AS mean, round(quantile_cont(s, 0.025) FILTER (i >= 0), 6) AS low, round(quantile_cont(s, 0.975) FILTER (i >= 0), 6) AS high FROM s {group}"""


@query(_bootstrap_sql("", 2000))
def bootstrap_lift(spark, d):
    return rounded(bootstrap.bootstrap_lift(view(spark, d, OUTCOMES), "doc_id", "a", "b", samples=2000))


@query(_bootstrap_sql("type", 1000))
def bootstrap_by_type(spark, d):
    return rounded(bootstrap.bootstrap_lift(view(spark, d, OUTCOMES), "doc_id", "a", "b", samples=1000, by=["type"]))


@query("SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.01), 6) AS p01, round(median(value), 6) AS median, round(quantile_cont(value, 0.999), 6) AS p999 FROM events GROUP BY ROLLUP (event_type)")
def value_quantiles(spark, d):
    """Exact quantiles of doubles, most of them distinct, of each type of event and of all (null)."""
    e = table(spark, d, "events")
    out = None
    for by in (["event_type"], []):
        one = e.groupBy(*by).agg(F.count("value").alias("n"))
        one = qc.with_quantiles(one, e, F.col("value"), (0.01, 0.5, 0.999), by)
        one = one.select(F.col("event_type") if by else F.lit(None).cast("string").alias("event_type"), "n", *[F.col("quantiles")[i].alias(x) for i, x in enumerate(("p01", "median", "p999"))])
        out = one if out is None else out.unionByName(one)
    return rounded(out)


_RETURNS = "SELECT l_partkey AS k, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS x FROM lineitem GROUP BY l_partkey"


@query(f"""WITH c AS (SELECT k, n, x, pow(x - n * 0.25, 2) / (n * 0.1875) AS chi2 FROM ({_RETURNS})), t AS (SELECT k, n, x, round({q.chi2_p('chi2')}, 9) AS p FROM c),
r AS (SELECT *, row_number() OVER (ORDER BY p, k) AS rank, count(*) OVER () AS m FROM t), u AS (SELECT *, rank / m * 0.1 AS threshold, least(1.0, min(p * m / rank) OVER (ORDER BY rank DESC ROWS UNBOUNDED PRECEDING)) AS p_adjusted FROM r)
SELECT k, n, x, round(p, 6) AS p, rank, round(threshold, 6) AS threshold, round(p_adjusted, 6) AS p_adjusted, coalesce(rank <= max(CASE WHEN p <= threshold THEN rank END) OVER (), false) AS significant, p <= threshold AS significant_per_rank FROM u""")
def part_tests(spark, d):
    """A test for each part: whether its share of returned lines is a quarter."""
    c = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("x"))
    p = F.round(stats.chi2_p(F.pow(F.col("x") - F.col("n") * 0.25, F.lit(2)) / (F.col("n") * 0.1875)), 9)
    return rounded(step_up.step_up(c.withColumn("p", p), "p", "k"))


HASHED = "CAST('0x' || md5(CAST(doc_id AS VARCHAR))[1:15] AS BIGINT)"


@query(f"""SELECT doc_id, row_number() OVER (ORDER BY {HASHED}) AS rank, CAST(sum(n_chars) OVER (ORDER BY {HASHED} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chars FROM documents""")
def hashed_places(spark, d):
    """Places and running totals in the order of ids that are spread over all of 60 bits."""
    x = docs(spark, d).select("doc_id", "n_chars", F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 15), 16, 10).cast("long").alias("h"))
    return ranking.scanned(x, ["h"], {"chars": F.col("n_chars")}).select("doc_id", "rank", "chars")


@query(f"""WITH o AS (SELECT doc_id, a, row_number() OVER (ORDER BY doc_id) AS rank, avg(a) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS rate FROM ({OUTCOMES}))
SELECT rank, round(rate, 6) AS rate FROM o WHERE rank % 50 = 0""")
def running_rate(spark, d):
    return rounded(ranking.progress(view(spark, d, OUTCOMES), "doc_id", F.col("a")))


# Capability

CUBE_VIEW = f"SELECT *, lang AS model, round(doc_id % 3 * 0.4 + 0.1, 1) AS t FROM ({SIX})"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    category = F.when(K() == "qa", "question_answer").when(K() == "completion", "pure_completion").when(K() == "generation", "pure_instruction").when(K() == "response", "ambiguous").otherwise("control_edge")
    return six(spark, d).select("model", F.round("t", 1).alias("temperature"), category.alias("category"), "scores")


CAT = "CASE kind WHEN 'qa' THEN 'question_answer' WHEN 'completion' THEN 'pure_completion' WHEN 'generation' THEN 'pure_instruction' WHEN 'response' THEN 'ambiguous' ELSE 'control_edge' END"


@query(f"""WITH u AS (UNPIVOT (SELECT model, t AS temperature, {CAT} AS category, completion, instruction, answer, format, deflection, continuation FROM ({CUBE_VIEW})) ON completion, instruction, answer, format, deflection, continuation INTO NAME dimension VALUE score)
SELECT model, CAST(temperature AS DOUBLE) AS temperature, category, dimension, round(avg(score), 6) AS mean, round(coalesce(stddev_samp(score), 0), 6) AS std, count(*) AS n FROM u GROUP BY GROUPING SETS ((model, temperature, category, dimension), (model, temperature, dimension))""")
def capability_cube(spark, d):
    return rounded(capability.cube(_runs(spark, d)))


MATRIX = f"""SELECT model, CAST(t AS DOUBLE) AS temperature, {CAT} AS category, avg(CASE kind WHEN 'qa' THEN answer WHEN 'completion' THEN completion WHEN 'generation' THEN instruction ELSE (completion + instruction + answer) / 3 END) AS primary_score,
  avg((completion + instruction + answer + format + deflection + continuation) / 6) AS overall_score, count(*) AS n FROM ({CUBE_VIEW}) GROUP BY ALL"""


@query(f"SELECT model, temperature, category, round(primary_score, 6) AS primary_score, round(overall_score, 6) AS overall_score, n FROM ({MATRIX})")
def capability_matrix(spark, d):
    return rounded(capability.matrix(_runs(spark, d)))


@query(f"""WITH m AS ({MATRIX}), p AS (SELECT model, max(primary_score) FILTER (category = 'pure_instruction') AS instruction, max(primary_score) FILTER (category = 'question_answer') AS answer, max(primary_score) FILTER (category = 'pure_completion') AS completion, avg(overall_score) AS overall FROM m WHERE temperature = 0.5 GROUP BY model)
SELECT p.model, round(p.instruction, 6) AS instruction, round(p.answer, 6) AS answer, round(p.completion, 6) AS completion, round(p.overall, 6) AS overall, round(p.instruction - b.instruction, 6) AS improvement,
  p.instruction >= 0.7 AS instruction_ok, p.instruction - b.instruction >= 0.4 AS improvement_ok, p.overall >= 0.6 AS overall_ok, coalesce(p.instruction >= 0.7 AND p.instruction - b.instruction >= 0.4 AND p.overall >= 0.6, false) AS ready,
  CASE WHEN p.instruction >= 0.7 AND p.answer >= 0.6 AND p.completion >= 0.8 THEN ['ready for the next stage'] ELSE list_filter([CASE WHEN p.instruction < 0.7 THEN 'train on more diverse commands' END, CASE WHEN p.answer < 0.6 THEN 'add question and answer pairs' END, CASE WHEN p.completion < 0.8 THEN 'preserve completion ability' END], lambda x: x IS NOT NULL) END AS advice
FROM p, (SELECT * FROM p WHERE model = 'en') b WHERE p.model <> 'en'""")
def stage_readiness(spark, d):
    return rounded(capability.stage_gate(capability.matrix(_runs(spark, d)), base="en"))


@query(f"""WITH f AS (SELECT lang AS model, kind AS category, s.* EXCLUDE (doc_id) FROM ({PROBES}) JOIN ({ORACLES['score_4dim']}) s USING (doc_id)),
g AS (SELECT model, category, grouping(category) AS g, sum(instruction_following) AS i, sum(coherence) AS c, sum(relevance) AS r, sum(quality) AS q FROM f GROUP BY GROUPING SETS ((model), (model, category))), l AS (
SELECT model, category, NULL AS dimension, i + c + r + q AS points FROM g UNION ALL SELECT model, category, unnest(['instruction_following', 'coherence', 'relevance', 'quality']), unnest([i, c, r, q]) FROM g WHERE g = 1)
SELECT model, category, CAST(dimension AS VARCHAR) AS dimension, CAST(points AS BIGINT) AS points, round(points / 360 * 100, 6) AS pct FROM l""")
def scoreboard(spark, d):
    p = probes(spark, d).select(F.col("lang").alias("model"), F.col("kind").alias("category"), scorers.score_four(I(), R()).alias("scores"))
    return rounded(capability.scoreboard(p))


# Preference pairs and generators

TURN_PAIRS = """SELECT conv_id, turn, text AS instruction, nt AS response FROM (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant'"""


@query(TURN_PAIRS)
def turn_pairs(spark, d):
    return pairs.turn_pairs(table(spark, d, "conversations"))


@query(f"""WITH p AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS i, count(*) OVER () AS n FROM ({TURN_PAIRS})),
s AS (SELECT conv_id, turn, text, CAST('0x' || md5('42:' || conv_id || ':' || turn)[1:8] AS BIGINT) AS h FROM conversations WHERE role = 'user'),
d AS (SELECT s.*, k, (h % (SELECT max(n) FROM p) + k * 999999937) % (SELECT max(n) FROM p) AS i FROM s, range(0, 3) r(k) WHERE k < (SELECT max(n) FROM p))
SELECT d.conv_id, d.turn, md5(string_agg('Instruction: ' || instruction || chr(10) || 'Response: ' || response || '###END###' || chr(10), chr(10) ORDER BY k) || chr(10) || 'Instruction: ' || any_value(text) || chr(10) || 'Response:') AS prompt
FROM d JOIN p USING (i) GROUP BY d.conv_id, d.turn""")
def few_shot_prompts(spark, d):
    """Each user turn behind three examples, drawn by its hash from all pairs of turns."""
    t = table(spark, d, "conversations")
    asked = t.where("role = 'user'").select("conv_id", "turn", "text", F.concat_ws(":", "conv_id", "turn").alias("key"))
    out = pairs.drawn_examples(asked, "key", pairs.turn_pairs(t), ["conv_id", "turn"])
    return out.select("conv_id", "turn", F.md5(text.few_shot_prompt(F.col("examples"), F.col("text"), before_end="")).alias("prompt"))


@query(f"""SELECT doc_id, md5('Instruction: ' || instruction || chr(10) || 'Draft: ' || string_split(response, chr(10) || chr(10))[1] || chr(10) || 'Critique: too long by ' || length(response) || chr(10) || 'Better response:') AS prompt FROM ({PROBES})""")
def improvement_prompts(spark, d):
    critique = F.concat(F.lit("too long by "), F.length("response").cast("string"))
    return probes(spark, d).select("doc_id", F.md5(text.improvement_prompt(I(), R(), critique)).alias("prompt"))


KINDS = list(generate.NEGATIVE_SHARES)


def _draws_sql(key: str, seed: int = 42) -> str:
    items = ", ".join(f"{{h: md5('{seed}:' || CAST({key} AS VARCHAR) || '|{k}'), n: '{k}'}}" for k in KINDS)
    return f"list_transform(list_sort([{items}]), lambda s: s.n)[1:CASE WHEN {q.unit(key, seed + 2)} < 0.5 THEN 2 ELSE 3 END]"


@query(f"SELECT doc_id, unnest({_draws_sql('doc_id')}) AS negative_type FROM ({PROBES})")
def negatives_hash_draw(spark, d):
    return generate.negatives(probes(spark, d).withColumn("instruction_type", K()), "doc_id").select("doc_id", "negative_type")


@query("SELECT doc_id, CASE WHEN u < 0.3 THEN 'unwarranted_refusal' WHEN u < 0.55 THEN 'format_violation' WHEN u < 0.75 THEN 'incorrect_factual' WHEN u < 0.9 THEN 'off_topic' ELSE 'verbose_vague' END AS kind FROM (SELECT doc_id, " + q.unit("doc_id", 42) + " AS u FROM documents)")
def negative_kinds(spark, d):
    return docs(spark, d).select("doc_id", generate.negative_kind(F.col("doc_id")).alias("kind"))


def _picked(options: str, seed: int = 42) -> str:
    return f"({options})[CAST(floor({q.unit('key', seed)} * len({options})) AS INT) + 1]"


def _listed(texts) -> str:
    return f"[{', '.join(q.quoted(t) for t in texts)}]"


def _negatives_sql() -> str:
    """The rules in SQL; the texts are the fixed values of the generators."""
    g, low = generate, "lower(instruction)"
    refusal = f"list_concat({_listed(g.REFUSALS)}, CASE kind " + " ".join(f"WHEN '{k}' THEN {_listed(v)}" for k, v in g.TYPED_REFUSALS.items()) + " ELSE [] END)"
    word = f"CASE WHEN len({q.words('response')}) = 0 THEN 'Incomplete' WHEN length({q.words('response')}[1]) < 3 THEN 'Inc...' ELSE {q.words('response')}[1] END"
    half = "CASE WHEN length(response) > 10 THEN substr(response, 1, length(response) // 2) ELSE 'Partial' END"
    wrong_form = f"""list_concat(list_concat(list_concat(list_concat(
      CASE WHEN contains({low}, 'sentence') THEN [response || {q.quoted(g.MORE_DETAIL)}, string_split(response, '.')[1] || {q.quoted(g.MORE)}, {q.quoted(g.MANY_SENTENCES)}] ELSE [] END,
      CASE WHEN {q.has(low, 'short', 'brief')} THEN [response || {q.quoted(g.TOO_LONG)}] ELSE [] END),
      CASE WHEN contains({low}, 'list') THEN [{q.quoted(g.NO_LIST)}, '1. ' || response || ' (but this should be multiple items, not just one)'] ELSE [] END), [{word}, {half}, {q.quoted(g.INCOMPLETE)}]),
      CASE WHEN kind = 'completion' THEN ['The completion of ''' || instruction || ''' would be something, but I''m not sure what.', 'There are many ways to complete ''' || instruction || ''' depending on context.'] ELSE [] END)"""
    # twice, as neighbours share what stands between them
    swapped = lambda x, a, b: rf"regexp_replace({x}, '(?i)(^|[^\pL\pN_]){a}($|[^\pL\pN_])', '\1{b}\2', 'g')"
    swap = "CASE " + " ".join(f"WHEN contains(lower(response), '{a}') THEN {swapped(swapped('response', a, b), a, b)}" for a, b in g.SUBSTITUTIONS) + " END"
    wrong = "CASE " + " ".join(f"WHEN contains({low}, {q.quoted(t)}) THEN {q.quoted(a)}" for t, a in g.WRONG_FACTS) + f" WHEN kind = 'qa' THEN {_picked(_listed(g.WRONG_ANSWERS))} ELSE coalesce(CASE WHEN length(response) > 10 THEN nullif({swap}, response) END, {q.quoted(g.WRONG)}) END"
    said = rf"regexp_extract_all({low}, '[\pL\pN_]+')"
    off = "CASE " + " ".join(f"WHEN {q.has(low, c, c[:-1])} THEN {_picked(_listed(v))}" for c, v in g.OFF_TOPIC_BY.items()) + f" WHEN list_has_any({said}, {_listed(g.ANIMALS)}) THEN {_picked(_listed(g.OFF_TOPIC_BY['animals']))} WHEN list_has_any({said}, {_listed(g.PLANTS)}) THEN {q.quoted(g.OF_PLANTS)} WHEN list_has_any({said}, {_listed(g.WATERS)}) THEN {q.quoted(g.OF_WATER)} ELSE {_picked(_listed(g.OFF_TOPIC))} END"
    wordy = "[" + ", ".join(f"{q.quoted(a)} || CASE WHEN response <> '' THEN lower(response) ELSE {q.quoted(n)} END || {q.quoted(b)}" for (a, b), n in zip(g.WORDY, g.WORDY_OF_NOTHING)) + "]"
    vague = f"CASE WHEN {q.unit('key', 43)} < 0.5 THEN {_picked(wordy)} ELSE {_picked(_listed(g.VAGUE))} END"
    return f"""WITH p AS (SELECT *, unnest({_draws_sql('doc_id')}) AS negative_type FROM ({PROBES})), k AS (SELECT *, doc_id || '|' || negative_type AS key FROM p),
o AS (SELECT doc_id, negative_type, CASE negative_type WHEN 'unwarranted_refusal' THEN {_picked(refusal)} WHEN 'format_violation' THEN {_picked(wrong_form)} WHEN 'incorrect_factual' THEN {wrong} WHEN 'off_topic' THEN {off} ELSE {vague} END AS out FROM k)
SELECT doc_id, negative_type, md5(CASE WHEN length({q.strip('out')}) < 3 THEN {q.strip('out')} || ' [bad]' ELSE out END) AS negative_response FROM o"""


@query(_negatives_sql())
def negative_responses(spark, d):
    p = probes(spark, d).select("doc_id", "instruction", K().alias("instruction_type"), "response")
    return generate.negatives(p, "doc_id").select("doc_id", "negative_type", F.md5("negative_response").alias("negative_response"))


# Rows of one language and kind meet within stretches of ids, so that a key never has more than a stretch of rows.
ASKED = "lang || '-' || kind || '-' || CAST(doc_id // 50 AS VARCHAR) AS instruction"
GOOD = f"SELECT {ASKED}, doc_id, {S} AS good_response FROM ({PROBES}) WHERE n_chars % 2 = 0"
NEGS = f"SELECT {ASKED}, doc_id AS neg_id, response AS negative_response, kind AS negative_type, n_chars / 1000.0 AS margin, n_chars > 1500 AS confident FROM ({PROBES}) WHERE n_chars % 2 = 1"
JOINED = f"SELECT * FROM ({GOOD}) JOIN ({NEGS}) USING (instruction) WHERE good_response <> {q.strip('negative_response')}"


def joined(spark: SparkSession, d: str) -> DataFrame:
    p = probes(spark, d).withColumn("key", F.concat_ws("-", "lang", "kind", F.floor(F.col("doc_id") / 50).cast("string")))
    good = p.where("n_chars % 2 = 0").select(F.col("key").alias("instruction"), "doc_id", text.strip(R()).alias("good_response"))
    neg = p.where("n_chars % 2 = 1").select(F.col("key").alias("instruction"), F.col("doc_id").alias("neg_id"), R().alias("negative_response"), K().alias("negative_type"), (F.col("n_chars") / 1000.0).cast("double").alias("margin"), (F.col("n_chars") > 1500).alias("confident"))
    return pairs.preference_pairs(pairs.join_negatives(good, neg))


@query(f"SELECT doc_id, neg_id, 'Instruction: ' || instruction || chr(10) || 'Response:' AS prompt, md5(good_response) AS chosen, md5(negative_response) AS rejected FROM ({JOINED})")
def pref_pairs_join(spark, d):
    return joined(spark, d).select("doc_id", "neg_id", "prompt", F.md5("chosen").alias("chosen"), F.md5("rejected").alias("rejected"))


@query(f"SELECT doc_id, neg_id FROM ({JOINED}) ORDER BY doc_id, neg_id LIMIT 500")
def pref_pairs_capped(spark, d):
    return pairs.capped(joined(spark, d), ["doc_id", "neg_id"]).select("doc_id", "neg_id")


@query(f"SELECT negative_type, count(*) AS total, count(*) FILTER (confident) AS n_confident, round(avg(margin), 6) AS mean_margin, round(count(*) FILTER (confident) / count(*), 6) AS confident_rate FROM ({JOINED}) GROUP BY ROLLUP (negative_type)")
def pref_stats(spark, d):
    return rounded(pairs.preference_stats(joined(spark, d)))


@query(f"SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM ({PROBES})) WHERE n = 1")
def best_of_n(spark, d):
    return pairs.best_of(probes(spark, d).select("source", "doc_id", "n_chars"), "source", "n_chars", "doc_id").select("source", "doc_id")


def _bad(n: int) -> str:
    return "CASE kind " + " ".join(f"WHEN '{k}' THEN [{', '.join(q.quoted(t) for t in v[:n])}]" for k, v in pairs.BAD_TEMPLATES.items() if k != "response") + f" ELSE [{', '.join(q.quoted(t) for t in pairs.BAD_TEMPLATES['response'][:n])}] END"


@query(f"""WITH r AS (SELECT *, n_chars % 2 = 0 AS good, {q.strip("string_split(response, chr(10) || chr(10))[1]")} AS first FROM ({PROBES}))
SELECT doc_id AS id, 'good_response' AS source, first AS chosen, unnest({_bad(2)}) AS rejected FROM r WHERE good
UNION ALL SELECT doc_id, 'bad_response', CASE kind {" ".join(f"WHEN '{k}' THEN {q.quoted(v)}" for k, v in pairs.GOOD_TEMPLATES.items() if k != 'response')} ELSE {q.quoted(pairs.GOOD_TEMPLATES['response'])} END, first FROM r WHERE NOT good""")
def logprob_fan_out(spark, d):
    p = probes(spark, d).select(F.col("doc_id").alias("id"), "instruction", K().alias("instruction_type"), "response", (F.col("n_chars") % 2 == 0).alias("is_good"), F.lit(1.0).alias("margin"))
    return pairs.fan_out(p).select("id", "source", "chosen", "rejected")


FILLERS = """SELECT DISTINCT 'nation' AS name, n_name AS value FROM nation UNION ALL SELECT DISTINCT 'brand', p_brand FROM part UNION ALL SELECT DISTINCT 'maker', p_type FROM part UNION ALL SELECT DISTINCT 'supplier', s_name FROM supplier"""


@query(f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY name) AS n FROM ({FILLERS})), t AS (SELECT r_regionkey AS template_id FROM region),
o AS (SELECT * FROM f WHERE name = 'nation'), b AS (SELECT * FROM f WHERE name = 'brand')
SELECT template_id, x.i + x.n * (b.i + b.n * z.i) AS k, 'Does ' || x.value || ' buy ' || b.value || ' from ' || z.value || '?' AS instruction FROM t, o x, b, o z WHERE template_id % 3 = 0
UNION ALL SELECT template_id, i, value || ': who is it?' FROM t, f WHERE template_id % 3 = 1 AND name = 'supplier'
UNION ALL SELECT template_id, i, 'Name ' || value || ' parts' FROM t, f WHERE template_id % 3 = 2 AND name = 'maker'""")
def template_fill(spark, d):
    """Every combination of fillers in templates of one to three places."""
    kind = F.col("r_regionkey") % 3
    text_ = F.when(kind == 0, "Does {nation} buy {brand} from {nation}?").when(kind == 1, "{supplier}: who is it?").otherwise("Name {maker} parts")
    templates = table(spark, d, "region").select(F.col("r_regionkey").alias("template_id"), text_.alias("template"))
    return generate.fill_templates(templates, view(spark, d, FILLERS))


@query("""WITH f AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT p_name AS value FROM part)),
t AS (SELECT any_value(n) AS n, CAST(any_value(n) AS HUGEINT) * any_value(n) * any_value(n) AS total FROM f),
k AS (SELECT n, (CAST(r AS HUGEINT) * CASE WHEN total % 999999937 <> 0 THEN 999999937 WHEN total % 999999929 <> 0 THEN 999999929 ELSE 999999893 END + 11) % total AS k FROM t, range(0, 400) x(r))
SELECT 0 AS template_id, CAST(k AS BIGINT) AS k, 'Compare ' || a.value || ', ' || b.value || ' and ' || c.value AS instruction
FROM k JOIN f a ON a.i = k % k.n JOIN f b ON b.i = k // k.n % k.n JOIN f c ON c.i = k // (k.n * k.n)""")
def template_draws(spark, d):
    """Different combinations of three names of parts each, of all that there are."""
    t = spark.range(1).select(F.lit(0).alias("template_id"), F.lit("Compare {part}, {part} and {part}").alias("template"))
    names = table(spark, d, "part").select(F.lit("part").alias("name"), F.col("p_name").alias("value"))
    return generate.draw_templates(t, names, 400, start=11)


@fixed("SELECT 'qa_' || i AS id, ['one', 'two', 'three'][i % 3 + 1] AS instruction, 'qa' AS instruction_type, CAST(i % 3 AS INT) AS pool_index FROM range(0, 10) r(i)")
def pool_cycle(spark, d):
    return generate.cycle_pool(spark, ("one", "two", "three"), 10, "qa")


@fixed("SELECT i AS shard_id, i + 100 AS seed, 333 AS count FROM range(0, 3) r(i)")
def shard_plan(spark, d):
    return generate.shard_plan(spark, 1000, 3, 100)


# Sampling and ranking


@query(f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {q.draw_key('doc_id', 42)}, doc_id) AS n, count(*) OVER () AS m FROM documents)
SELECT doc_id, CASE WHEN n <= floor(m * 0.2) THEN 'test' ELSE 'train' END AS split FROM r""")
def train_test_split(spark, d):
    return ranking.train_test_split(docs(spark, d).select("doc_id"), "doc_id")


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {q.draw_key('doc_id', 7)}, doc_id) AS rank FROM documents")
def shuffle(spark, d):
    return ranking.shuffled(docs(spark, d).select("doc_id"), "doc_id", 7)


@query(f"SELECT doc_id FROM documents ORDER BY {q.draw_key('doc_id', 42)}, doc_id LIMIT 25")
def uniform_sample(spark, d):
    return ranking.sample(docs(spark, d).select("doc_id"), "doc_id", 25)


@query("SELECT doc_id, ['a', 'b', 'c', 'd', 'e'][(row_number() OVER (ORDER BY doc_id) - 1) % 5 + 1] AS kind FROM documents")
def round_robin(spark, d):
    return ranking.round_robin(docs(spark, d).select("doc_id"), "doc_id", "abcde")


@query("SELECT doc_id, CAST(ntile(7) OVER (ORDER BY doc_id) - 1 AS INT) AS slice FROM documents")
def balanced_slices(spark, d):
    return ranking.balanced_slices(docs(spark, d).select("doc_id"), "doc_id", 7)


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents) WHERE n <= CASE lang WHEN 'en' THEN 26 WHEN 'fr' THEN 25 WHEN 'de' THEN 25 WHEN 'es' THEN 25 END")
def type_quotas(spark, d):
    return ranking.take_quotas(docs(spark, d).select("doc_id", "lang"), "lang", ["doc_id"], ranking.quotas(101, ("en", "fr", "de", "es")))


@query(f"SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {q.draw_key('doc_id', 42)}, doc_id) AS n FROM documents) WHERE n <= 10")
def stratified_sample(spark, d):
    return ranking.stratified_sample(docs(spark, d).select("source", "doc_id"), "source", "doc_id", 10)


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents) WHERE n <= CASE lang WHEN 'en' THEN 12 WHEN 'fr' THEN 10 WHEN 'de' THEN 10 WHEN 'es' THEN 8 END")
def category_mix(spark, d):
    return conversation.quota_mix(docs(spark, d).select("doc_id", "lang"), "lang", ["doc_id"], 40, {"en": 30, "fr": 25, "de": 25, "es": 20})


# Validators


@query(f"""SELECT doc_id, list_filter([CASE WHEN NOT starts_with(t, 'Instruction:') THEN 'no instruction prefix' END, CASE WHEN NOT ends_with(t, 'END') THEN 'no end suffix' END, CASE WHEN kind NOT IN ('qa', 'completion', 'generation', 'response') THEN 'unknown instruction type' END], lambda x: x IS NOT NULL) AS violations
FROM (SELECT *, CASE WHEN doc_id % 4 = 0 THEN 'Response: ' || response ELSE 'Instruction: x Response: ' || response || CASE WHEN doc_id % 3 = 0 THEN 'END' ELSE '' END END AS t FROM ({PROBES}))""")
def validate_sft(spark, d):
    t = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Response: "), R())).otherwise(F.concat(F.lit("Instruction: x Response: "), R(), F.when(F.col("doc_id") % 3 == 0, "END").otherwise("")))
    return validate.sft(probes(spark, d).withColumn("formatted_text", t).withColumn("instruction_type", K())).select("doc_id", "violations")


@query(f"""SELECT doc_id, list_filter([CASE WHEN c = r THEN 'identical chosen and rejected' END, CASE WHEN length({q.strip('c')}) < 3 THEN 'chosen too short' END, CASE WHEN length({q.strip('r')}) < 3 THEN 'rejected too short' END, CASE WHEN NOT starts_with(instruction, 'Instruction:') THEN 'no instruction prefix' END], lambda x: x IS NOT NULL) AS violations
FROM (SELECT *, response AS c, CASE WHEN doc_id % 3 = 0 THEN response WHEN source = 'crafted' THEN ' no' ELSE 'Worse: ' || response END AS r FROM ({PROBES}))""")
def validate_pairs(spark, d):
    p = probes(spark, d).withColumn("prompt", I()).withColumn("chosen", R()).withColumn("rejected", F.when(F.col("doc_id") % 3 == 0, R()).when(F.col("source") == "crafted", " no").otherwise(F.concat(F.lit("Worse: "), R())))
    return validate.preference_pairs(p, "prompt").select("doc_id", "violations")


@query("""SELECT violation, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN length(text) < 5 THEN 'instruction too short' END, CASE WHEN count(*) OVER (PARTITION BY source) > 1 THEN 'duplicate id' END], lambda x: x IS NOT NULL)) AS violation FROM documents) GROUP BY violation""")
def validate_tests(spark, d):
    t = docs(spark, d).select(F.col("source").alias("id"), F.col("text").alias("instruction"), F.col("lang").alias("expected_type"))
    return validate.violation_counts(validate.test_instructions(t))


@query(f"SELECT doc_id, list_filter([CASE WHEN kind <> 'x' THEN 'unknown negative type' END, CASE WHEN length({S}) < 3 THEN 'negative response too short' END], lambda x: x IS NOT NULL) AS violations FROM ({PROBES})")
def validate_negatives(spark, d):
    return validate.negatives(probes(spark, d).withColumn("negative_type", K()).withColumn("negative_response", R())).select("doc_id", "violations")


# Conversations


@query("""SELECT conv_id, turn, coalesce(string_agg(CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE 'System' END || ': ' || text || chr(10), '') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history FROM conversations""")
def conversation_history(spark, d):
    return conversation.with_history(table(spark, d, "conversations")).select("conv_id", "turn", "history")


@query("SELECT conv_id, count(*) FILTER (turn >= 2) AS n_checked, coalesce(bool_and(length(text) BETWEEN 10 AND 1000) FILTER (turn >= 2), true) AS passed FROM conversations GROUP BY conv_id")
def conversation_pass(spark, d):
    t = table(spark, d, "conversations").withColumn("passed", conversation.sane_length(F.col("text")))
    return conversation.conversation_pass(t)


@query("""SELECT a.conv_id, a.turn, e.entity, contains(lower(a.text), lower(e.entity)) AS recalled FROM conversations a JOIN (SELECT conv_id, turn, string_split(text, ' ')[1] AS entity FROM conversations WHERE role = 'user') e
ON a.conv_id = e.conv_id AND e.turn < a.turn WHERE a.role = 'assistant'""")
def entity_recall(spark, d):
    t = table(spark, d, "conversations")
    return conversation.entity_recall(t, t.where("role = 'user'").select("conv_id", "turn", F.split("text", " ")[0].alias("entity")))


@query(f"SELECT conv_id, turn, NOT {q.has('lower(text)', 'the', 'der')} AS respects, {q.has('lower(text)', 'which', 'what do you mean', 'could you clarify')} AS clarifies, length(text) BETWEEN 10 AND 500 AS sane FROM conversations")
def turn_checks(spark, d):
    words = F.array(F.lit("the"), F.lit("der"))
    t = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", conversation.respects(t, words).alias("respects"), conversation.asks_to_clarify(t).alias("clarifies"), conversation.sane_length(t, 10, 500).alias("sane"))


# Sources, sinks and plans of runs


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def jsonl_round_trip(spark, d):
    x = docs(spark, d)
    path = files.scratch(spark, "jsonl")
    files.write_jsonl(x, path)
    return files.read_strict(spark, path, x.schema)


@query("SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY source")
def shard_files(spark, d):
    """One shard for each source, written in one pass and read again by one pattern with their path as key."""
    x, root = docs(spark, d), files.scratch(spark, "shards")
    files.write_shards(x, "source", root)
    rows = files.read_shards(spark, root, x.schema, "shard=*")
    return rows.groupBy(files.shard_of(F.col(files.FILE)).alias("source")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, doc_id % 50 = 7 AS bad FROM documents")
def quarantined_lines(spark, d):
    """Lines that aren't JSON beside the rows of those that are; their numbers stand in their files, as many as there are."""
    path, x = files.scratch(spark, "lines"), docs(spark, d).select("doc_id")
    line = F.when(F.col("doc_id") % 50 == 7, F.concat(F.lit("{broken "), F.col("doc_id").cast("string"))).otherwise(F.to_json(F.struct("doc_id")))
    x.repartition(4, "doc_id").select(line.alias("value")).write.text(path)
    rows, bad = files.read_checked(spark, path, x.schema)
    numbered = bad.where("line >= 1").select(F.regexp_extract("text", r"(\d+)", 1).alias("doc_id"), F.lit(True).alias("bad"))
    return rows.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(False).alias("bad")).unionByName(numbered)


@query("SELECT n_nationkey AS test, m AS model, t AS temperature FROM nation, (VALUES ('base'), ('sft')) a(m), (VALUES (0.1::DOUBLE), (0.5), (0.9)) b(t)")
def run_plan(spark, d):
    tests = table(spark, d, "nation").select(F.col("n_nationkey").alias("test"))
    return capability.fan_out_runs(tests, spark.range(1).select(F.explode(F.array(F.lit("base"), F.lit("sft"))).alias("model")))


@query(f"""SELECT kind, count(*) AS n, count(*) FILTER (doc_id % 3 > 0) AS n_ok, list_sort(list(doc_id) FILTER (k <= 3 AND doc_id % 3 > 0)) AS samples
FROM (SELECT *, row_number() OVER (PARTITION BY kind, doc_id % 3 > 0 ORDER BY doc_id) AS k FROM ({PROBES})) GROUP BY kind""")
def stage_summary(spark, d):
    p = probes(spark, d).withColumn("error", F.when(F.col("doc_id") % 3 == 0, "failed"))
    return evaluate.stage_summary(p, "kind", "error", "doc_id")


IMPROVED = f"SELECT doc_id, instruction, response AS original, CASE WHEN doc_id % 4 = 0 THEN response ELSE 'Better: ' || response END AS improved, n_chars % 2 = 0 AS original_good, n_chars % 3 > 0 AS improved_good FROM ({PROBES})"


@query(f"""SELECT instruction, CASE WHEN original_good AND NOT improved_good THEN original ELSE improved END AS chosen, CASE WHEN original_good AND NOT improved_good THEN improved ELSE original END AS rejected,
  CASE WHEN original_good AND NOT improved_good THEN 'only the original is good' WHEN original_good THEN 'both good, improved preferred' ELSE 'only the improved is good' END AS reason
FROM ({IMPROVED}) WHERE {q.strip('original')} <> {q.strip('improved')} AND (original_good OR improved_good)""")
def improvement_pairs(spark, d):
    return pairs.improvement_pairs(view(spark, d, IMPROVED))


@query(f"SELECT doc_id, CASE WHEN original_good THEN original ELSE improved END AS final FROM ({IMPROVED})")
def improve_failures(spark, d):
    return pairs.repaired_responses(view(spark, d, IMPROVED).withColumn("success", F.col("original_good"))).select("doc_id", "final")


@query(f"""SELECT doc_id, 'Instruction: ' || instruction || chr(10) || 'Response: ' || substr(string_split(response, chr(10) || chr(10))[1], 1, 500) || chr(10) || chr(10) || 'Is this response A (good) or B (bad)?' || chr(10) || 'Answer:' AS critic,
  'Principle: be kind' || chr(10) || 'Instruction: ' || instruction || chr(10) || 'Response: ' || string_split(response, chr(10) || chr(10))[1] || chr(10) || 'Critique:' AS principle FROM ({PROBES})""")
def critic_prompts(spark, d):
    return probes(spark, d).select("doc_id", text.critic_prompt(I(), R()).alias("critic"), text.principle_prompt(I(), R(), F.lit("be kind")).alias("principle"))


@query(f"""WITH l AS (SELECT doc_id, {q.strip('response')} AS s, list_filter({LINES}, lambda l: l <> '' AND NOT {q.has('lower(l)', 'here are examples', 'prompt:', 'response:', 'another', 'would be:')}) AS ls FROM ({PROBES}))
SELECT doc_id, coalesce(ls[1], s) AS line FROM l""")
def first_answer_line(spark, d):
    return probes(spark, d).select("doc_id", text.first_answer_line(R()).alias("line"))


_CI = q.wilson("x", "n")


@query(f"""WITH r AS (SELECT type, count(*) AS n, sum(b) AS x FROM ({OUTCOMES}) GROUP BY type), c AS (SELECT *, {_CI[0]} AS low, {_CI[1]} AS high FROM r), g AS (
SELECT bool_and(x / n BETWEEN 0.5 AND 1.0) AS within_bounds, max(low) FILTER (type = 'fr') > max(high) FILTER (type = 'en') AS intervals_apart,
  2 * (asin(sqrt(max(x / n) FILTER (type = 'fr'))) - asin(sqrt(max(x / n) FILTER (type = 'en')))) AS h FROM c)
SELECT within_bounds, intervals_apart, round(h, 6) AS h, within_bounds AND intervals_apart AND abs(h) >= 0.5 AS passed FROM g""")
def condition_bounds(spark, d):
    o = view(spark, d, OUTCOMES).groupBy(F.col("type").alias("condition")).agg(F.count("*").alias("n"), F.sum("b").alias("n_success"))
    bounds = {k: (0.5, 1.0) for k in ("en", "fr", "de", "es")}
    return rounded(evaluate.condition_gate(o, bounds, "en", "fr").select("within_bounds", "intervals_apart", "h", "passed"))


@query(f"""WITH r AS (SELECT type, avg(b) AS rate FROM ({OUTCOMES}) GROUP BY type), f AS (SELECT list_filter([
  CASE WHEN max(rate) FILTER (type = 'en') >= 0.6 THEN 'conversation isn''t hard enough' END, CASE WHEN max(rate) FILTER (type = 'fr') >= 0.6 THEN 'all base models can converse' END,
  CASE WHEN max(rate) FILTER (type = 'de') < 0.8 THEN 'too hard even for the instruct model' END], lambda x: x IS NOT NULL) AS reasons FROM r) SELECT len(reasons) > 0 AS aborted, reasons FROM f""")
def condition_aborts(spark, d):
    """Whether an evaluation is given up, and why; languages stand for its conditions."""
    names = F.create_map(*[F.lit(x) for x in ("en", "base_formatted", "fr", "alt_base", "de", "instruct")])
    o = view(spark, d, OUTCOMES).groupBy(F.try_element_at(names, F.col("type")).alias("condition")).agg(F.count("*").alias("n"), F.sum("b").alias("n_success"))
    return evaluate.abort_reasons(o, evaluate.ABORT_RULES)


@query(f"SELECT doc_id, instruction AS prompt, response AS chosen, kind AS instruction_type, 0.5::DOUBLE AS margin FROM ({PROBES}) WHERE n_chars % 2 = 0 OR n_chars % 5 = 0")
def normalized_pairs(spark, d):
    p = probes(spark, d).select("doc_id", I().alias("prompt"), R().alias("chosen"), F.lit("x").alias("rejected"), K().alias("instruction_type"), F.lit(0.5).alias("margin"), F.when(F.col("n_chars") % 5 == 0, F.lit(None).cast("boolean")).otherwise(F.col("n_chars") % 2 == 0).alias("confident"))
    ids = p.select("doc_id", "prompt", "chosen", "rejected", "instruction_type", "margin", "confident")
    out = pairs.normalized_pairs(ids.withColumn("prompt", F.concat_ws("\u0001", F.col("doc_id").cast("string"), "prompt")))
    return out.select(F.split("prompt", "\u0001")[0].cast("long").alias("doc_id"), F.split("prompt", "\u0001")[1].alias("prompt"), "chosen", "instruction_type", "margin")


@query(f"SELECT DISTINCT md5({q.norm('text')}) AS key FROM documents")
def streaming_dedup(spark, d):
    """The growing pool as a stream: each batch of files adds the rows whose key hasn't come before."""
    x, root = docs(spark, d).select("doc_id", "text"), files.scratch(spark, "stream")
    files.write_jsonl(x.repartition(6), f"{root}/in")
    fresh = streaming.unseen(streaming.read_shards(spark, f"{root}/in", x.schema, files_per_trigger=3), "text")
    streaming.append_to(fresh, f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.schema(x.schema).parquet(f"{root}/out").select(F.md5(text.norm_key(F.col("text"))).alias("key"))


@query(f"""SELECT min(doc_id) AS doc_id FROM documents WHERE doc_id % 5 > 0 AND {q.norm('text')} NOT IN (SELECT {q.norm('text')} FROM documents WHERE doc_id % 5 = 0) GROUP BY {q.norm('text')}""")
def pool_stream(spark, d):
    """Shards that arrive after each other against an existing pool, with a restart from the checkpoint between them.

    A shard is one batch, however many files it has: files are taken in the order in which their tasks ended, so in
    batches of some files a later row could come before an earlier one, and each batch opens all states.
    """
    x, root = docs(spark, d).select("doc_id", "text"), files.scratch(spark, "pool")
    shards = ranking.balanced_slices(x.where("doc_id % 5 > 0"), "doc_id", 4)
    for k in range(4):
        files.write_jsonl(shards.where(F.col("slice") == k).drop("slice"), f"{root}/in/shard={k}")
        stream = streaming.read_shards(spark, f"{root}/in/*", x.schema, files_per_trigger=None)
        fresh = streaming.unseen_in_pool(stream, "text", "doc_id", x.where("doc_id % 5 = 0"))
        streaming.append_to(fresh, f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.schema(x.schema).parquet(f"{root}/out").select("doc_id")


from . import records  # noqa: E402, F401  more queries, which build on those above
