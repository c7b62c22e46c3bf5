"""Queries on record files, gates, statistics, provenance and plug-in points, with their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import stats, text
from ..operators import capability, conversation, dedup, evaluate, generate, leakage, models, pairs, provenance, qc, ranking, validate
from ..sources import files, snapshots
from . import sql as q
from .catalog import MATRIX, PAIRED, PROBES, TEST, TRAIN, TRUE_FALSE, I, R, _qc_sql, _runs, analysis, docs, fixed, probes, query, rounded
from .views import OUTCOMES, table, view


def _strings(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A small table of fixed rows, without Python rows in the plan."""
    fields = [n.split() for n in names.split(", ")]
    entries = [F.struct(*[F.lit(v).cast(kind).alias(n) for v, (n, kind) in zip(r, fields)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*entries)))


# Sources


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 4 THEN NULL ELSE lang END AS lang, md5(text) AS text FROM documents")
def tolerant_lines(spark, d):
    """Lines that lack a key, and blank lines between them."""
    path, x = files.scratch(spark, "tolerant"), docs(spark, d)
    line = F.when(F.col("doc_id") % 10 == 4, F.to_json(F.struct("doc_id", "text"))).otherwise(F.to_json(F.struct("doc_id", "lang", "text")))
    x.select(F.concat(line, F.when(F.col("doc_id") % 3 == 0, "\n").otherwise("")).alias("value")).write.text(path)
    rows = files.read_tolerant(spark, path, schemas.struct(doc_id=schemas.L, lang=schemas.S, text=schemas.S))
    return rows.select("doc_id", "lang", F.md5("text").alias("text"))


@query("SELECT 'data_20250301.jsonl' AS by_name, 'data_20250201.jsonl' AS by_time, r_name FROM region")
def latest_files(spark, d):
    """The latest of three files by name, which is read, and by time."""
    root = files.scratch(spark, "latest")
    for day in ("20250101", "20250301", "20250201"):
        files.write_jsonl(table(spark, d, "region").select("r_name", F.lit(day).alias("day")), f"{root}/data_{day}.jsonl")
    name, time = files.latest_by_name(spark, f"{root}/data_*.jsonl"), files.latest_by_time(spark, f"{root}/data_*.jsonl")
    rows = files.read_strict(spark, name, schemas.struct(r_name=schemas.S, day=schemas.S)).where("day = '20250301'")
    return rows.select(F.lit(name.rsplit("/", 1)[-1]).alias("by_name"), F.lit(time.rsplit("/", 1)[-1]).alias("by_time"), "r_name")


@query(f"SELECT DISTINCT md5({q.norm('text')}) AS key FROM documents")
def distinct_instructions(spark, d):
    return files.distinct_instructions(docs(spark, d), "text").select(F.md5("key").alias("key"))


@query("SELECT md5(text) AS text FROM documents")
def scoped_instructions(spark, d):
    path = files.scratch(spark, "scoped")
    files.write_jsonl(docs(spark, d), path)
    rows = files.read_strict(spark, path, schemas.struct(text=schemas.S))
    return files.column(rows, "text").select(F.md5("text").alias("text"))


@query(f"SELECT doc_id FROM documents WHERE {TEST} AND {q.norm('text')} NOT IN (SELECT {q.norm('text')} FROM documents WHERE {TRAIN}) ORDER BY doc_id LIMIT 50")
def persistent_eval_set(spark, d):
    """Made when it is asked for first, read (and checked against the training rows) after that."""
    x, path = docs(spark, d).select("doc_id", "text"), files.scratch(spark, "eval")
    train = x.where(TRAIN)
    for _ in range(2):
        out = files.load_or_create(spark, path, x.schema, lambda: leakage.without_leaks(x.where(TEST), train, "text"), 50, "doc_id", train, "text")
    return out.select("doc_id")


CONFIGURATION = """# principles
version: 1.0
principles:
  - id: first
    text: "Say what is asked: no more."
    category: help

  - id: second
    text: 'It''s fine to say "no".'
    category: honesty
  - id: third
    text: Plain words  # a remark
    category: help
  - id: fourth
    text: "A \\"quoted\\" word"
    category: care
  - id: fifth
    text: "left out"
    category: care
categories:
  - help: 2
"""


@fixed("""SELECT * FROM (VALUES ('stored', 0, 'first', 'Say what is asked: no more.', 'help'), ('stored', 1, 'second', 'It''s fine to say "no".', 'honesty'), ('stored', 2, 'third', 'Plain words', 'help'), ('stored', 3, 'fourth', 'A "quoted" word', 'care'),
  ('default', 0, 'follow_instruction', 'Follow the instruction exactly as given', NULL), ('default', 1, 'be_accurate', 'Provide accurate and factual information', NULL), ('default', 2, 'be_complete', 'Fully address what was requested', NULL), ('default', 3, 'be_concise', 'Be concise and avoid unnecessary elaboration', NULL)) p(origin, ord, id, text, category)""")
def principles(spark, d):
    """The first four of a stored configuration, and the default ones where none is stored."""
    path = files.scratch(spark, "principles")
    files.write_text(spark, CONFIGURATION, path)
    stored, default = (files.principles(spark, files.read_principles(spark, p)) for p in (path, path + "-none"))
    return stored.select(F.lit("stored").alias("origin"), "*").unionByName(default.select(F.lit("default").alias("origin"), "*"))


@query("SELECT CAST(row_number() OVER (ORDER BY item_id) - 1 AS INT) AS ord, 'item_' || item_id AS id, regexp_replace(text, '\\s+', ' ', 'g') AS text, CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS category FROM benchmark WHERE trim(coalesce(text, '')) <> ''")
def stored_principles(spark, d):
    """A configuration that holds the benchmark's items, quoted, read again in its order."""
    path = files.scratch(spark, "items")
    items = table(spark, d, "benchmark").where("trim(coalesce(text, '')) <> ''").select("item_id", F.regexp_replace("text", r"\s+", " ").alias("text"))
    entry = F.concat(F.lit("  - id: item_"), F.col("item_id").cast("string"), F.lit("\n    text: '"), F.replace("text", F.lit("'"), F.lit("''")), F.lit("'\n    category: "), F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd"))
    # a configuration is one small document
    whole = items.groupBy().agg(F.concat(F.lit("principles:\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", entry.alias("e")))), lambda x: x["e"]), "\n")).alias("value"))
    whole.coalesce(1).write.text(path)
    rows = files.read_principles(spark, path)
    return files.principles(spark, rows, first=len(rows))


# Sinks


@query("""SELECT lang AS session, count(*) AS n, count(*) FILTER (n < 5) AS n_failed, max(printf('2025-01-%02d', 1 + n % 28)) AS last FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source) GROUP BY lang""")
def shard_manifest(spark, d):
    """One entry for each shard of a run, in a manifest that is written and read again; a shard of few rows has failed."""
    path = files.scratch(spark, "entries")
    shards = docs(spark, d).groupBy("lang", "source").agg(F.count("*").alias("n"))
    day = F.format_string("2025-01-%02d", 1 + F.col("n") % 28)
    entries = {"session": F.col("lang"), "path": F.col("source"), "type": F.lit("data"), "timestamp": day, "success": F.col("n") >= 5, "error": F.when(F.col("n") < 5, "few rows"), "parameters": F.create_map(F.lit("rows"), F.col("n").cast("string"))}
    names = schemas.MANIFEST_ENTRY.fields
    shards.select(*[entries.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in names]).write.parquet(path)
    return provenance.session_summary(provenance.manifest(spark, path))


@query("SELECT doc_id, md5(text) AS text, true AS is_ascii FROM documents")
def ascii_lines(spark, d):
    path, x = files.scratch(spark, "ascii"), docs(spark, d).select("doc_id", "text")
    files.write_jsonl(x, path, ascii_only=True)
    rows = spark.read.text(path).select((~F.col("value").rlike(r"[^\x00-\x7F]")).alias("is_ascii"), F.from_json("value", x.schema).alias("r"))
    return rows.select("r.doc_id", F.md5("r.text").alias("text"), "is_ascii")


@query("""SELECT '{"doc_id":' || doc_id || ',"n_chars":' || n_chars || '}' AS line, 1 AS n_missing, row_number() OVER (ORDER BY doc_id) AS place FROM documents""")
def concatenated_lines(spark, d):
    """Lines of all shards as they are, in the order of shards and lines, with their places in the target; a shard that
    isn't there is told."""
    root, target = files.scratch(spark, "shards"), files.scratch(spark, "lines")
    rows = ranking.balanced_slices(docs(spark, d).select("doc_id", "n_chars"), "doc_id", 5)
    for k in range(5):
        files.write_jsonl(ranking.sorted_output(rows.where(F.col("slice") == k).drop("slice"), "doc_id"), f"{root}/shard={k}")
    lacking = files.concat_present(spark, [*(p for p, _ in files.files(spark, f"{root}/shard=*")), f"{root}/none"], target)
    lines, order = files.lines_in_order(spark, [target])
    return ranking.scanned(lines, order, name="place").select(F.col("value").alias("line"), F.lit(len(lacking)).alias("n_missing"), "place")


@query("""WITH n AS (SELECT count(*) AS n, count(*) FILTER (doc_id % 3 < 2) AS two FROM documents)
SELECT 'first' AS step, 1 AS version, two AS n_rows, CAST([] AS VARCHAR[]) AS warnings FROM n UNION ALL SELECT 'missing slice', NULL, two, ['missing slice=9'] FROM n
UNION ALL SELECT 'wrong count', NULL, two, [n || ' rows instead of ' || (n + 1)] FROM n UNION ALL SELECT 'second', 2, n, [] FROM n UNION ALL SELECT 'stale writer', NULL, n, ['refused'] FROM n UNION ALL SELECT 'pinned reader', 1, two, [] FROM n""")
def published_slices(spark, d):
    """Merges of slices that publish a version or nothing, and the rows that a reader sees after each."""
    x, root, table_ = docs(spark, d).select("doc_id", "text"), files.scratch(spark, "slices"), files.scratch(spark, "published")
    for k in range(3):
        files.write_jsonl(x.where(F.col("doc_id") % 3 == k), f"{root}/slice={k}")
    n, names, out = x.count(), [f"slice={k}" for k in range(3)], []

    def step(name, *args):
        try:
            version, said = snapshots.publish_slices(spark, root, args[0], x.schema, table_, *args[1:])
        except snapshots.Conflict:
            version, said = None, ["refused"]
        out.append((name, version, snapshots.read(spark, table_).count(), said))

    step("first", names[:2], 0)
    pinned = snapshots.read(spark, table_)
    step("missing slice", [*names, "slice=9"], 1)
    step("wrong count", names, 1, n + 1)
    step("second", names, 1, n)
    step("stale writer", names[:1], 1)
    out.append(("pinned reader", 1, pinned.count(), []))
    return spark.createDataFrame(out, "step string, version int, n_rows long, warnings array<string>")


@query("""WITH n AS (SELECT count(*) AS n FROM documents) SELECT 'all' AS slices, true AS done, n AS n_rows, CAST([] AS VARCHAR[]) AS warnings FROM n
UNION ALL SELECT 'other count', true, n, [n || ' rows instead of ' || (n + 1)] FROM n UNION ALL SELECT 'one missing', false, 0, ['missing shard=9'] FROM n""")
def merged_slices(spark, d):
    x, root = docs(spark, d).select("doc_id"), files.scratch(spark, "slices")
    files.write_shards(ranking.balanced_slices(x, "doc_id", 3), "slice", root)
    n, names, out = x.count(), [f"shard={k}" for k in range(3)], []
    for case, some, expected in (("all", names, n), ("other count", names, n + 1), ("one missing", [*names, "shard=9"], n)):
        target = files.scratch(spark, "merged")
        done, said = files.merge_slices(spark, root, some, x.schema, target, expected)
        out.append((case, done, files.read_strict(spark, target, x.schema).count() if done else 0, said))
    return spark.createDataFrame(out, "slices string, done boolean, n_rows long, warnings array<string>")


@query("SELECT count(*) AS total, count(DISTINCT text) AS n_unique FROM documents")
def summary_document(spark, d):
    path = files.scratch(spark, "summary")
    files.write_document(dedup.duplication_report(docs(spark, d), "text"), path)
    whole = spark.read.text(path, wholetext=True).where("trim(value) <> ''")
    return whole.select(F.from_json("value", "total long, n_unique long").alias("s")).select("s.*")


@query(f'SELECT model AS "Model", temperature AS "Temperature", category AS "Category", round(primary_score, 3) AS "Primary", round(overall_score, 3) AS "Overall", n AS "Count" FROM ({MATRIX})')
def matrix_csv(spark, d):
    """The capability matrix as CSV with three decimals, read again."""
    path = files.scratch(spark, "csv")
    m = capability.matrix(_runs(spark, d)).select(F.col("model").alias("Model"), F.col("temperature").alias("Temperature"), F.col("category").alias("Category"), F.col("primary_score").alias("Primary"), F.col("overall_score").alias("Overall"), F.col("n").alias("Count"))
    files.write_csv(m, path)
    return spark.read.schema("Model string, Temperature double, Category string, Primary double, Overall double, Count long").option("header", "true").csv(path)


_LINE = """printf('%s: n=%d, %.1f%% [%.1f%%, %.1f%%] -> %.1f%% [%.1f%%, %.1f%%], lift %+.1f%%, n01=%d, n10=%d, p=%.3g (%s), h=%+.2f',
  coalesce(type, 'overall'), n, 100 * a_rate, 100 * a_low, 100 * a_high, 100 * b_rate, 100 * b_low, 100 * b_high, 100 * lift, n01, n10, p, method, cohens_h)"""


@query(f"""{PAIRED}, t AS (SELECT *, row_number() OVER (ORDER BY p, type) AS rank, count(*) OVER () AS m FROM s WHERE scope = 'type' AND n >= 10),
u AS (SELECT *, coalesce(rank <= max(CASE WHEN p <= rank / m * 0.1 THEN rank END) OVER (), false) AS significant FROM t WHERE m > 1)
SELECT {_LINE} || CASE WHEN significant THEN ', significant' ELSE '' END AS line FROM u UNION ALL SELECT {_LINE} FROM s WHERE scope = 'overall'""")
def paired_report(spark, d):
    """A text report of a paired analysis, written and read again."""
    path = files.scratch(spark, "report")
    files.write_text(spark, evaluate.report(analysis(spark, d)), path)
    return spark.read.text(path).where("value <> ''").select(F.col("value").alias("line"))


@query("SELECT doc_id, md5(text || '!') AS text, (SELECT count(*) FROM documents) AS n_backup FROM documents")
def repaired_with_backup(spark, d):
    x = docs(spark, d).select("doc_id", "text")
    path, backup, target = (files.scratch(spark, n) for n in ("records", "backup", "repaired"))
    files.write_jsonl(x, path)
    fixed = files.rewrite_with_backup(spark, path, backup, x.schema, lambda r: r.withColumn("text", F.concat("text", F.lit("!"))), target)
    return fixed.select("doc_id", F.md5("text").alias("text"), F.lit(files.read_strict(spark, backup, x.schema).count()).alias("n_backup"))


# Manifests, gates and steps


def _manifest(spark: SparkSession) -> DataFrame:
    path = files.scratch(spark, "manifest")
    provenance.record(spark, path, "s1", "qc.json", "qc_summary", "2025-01-01", parameters={"thresholds_passed": "true"})
    provenance.record(spark, path, "s1", "data.jsonl", "data", "2025-01-02", success=False, error="no rows")
    provenance.record(spark, path, "s2", "qc.json", "qc_summary", "2025-01-03", parameters={"thresholds_passed": "false"})
    provenance.record(spark, path, "s2", "TRAINING_SUCCESS", "marker", "2025-01-04", parameters={"epochs": "2"})
    return provenance.manifest(spark, path)


@fixed("""SELECT * FROM (VALUES ('s1', 'qc.json', 'qc_summary', '2025-01-01', true, NULL, 'thresholds_passed=true'), ('s1', 'data.jsonl', 'data', '2025-01-02', false, 'no rows', ''),
  ('s2', 'qc.json', 'qc_summary', '2025-01-03', true, NULL, 'thresholds_passed=false'), ('s2', 'TRAINING_SUCCESS', 'marker', '2025-01-04', true, NULL, 'epochs=2')) m(session, path, type, timestamp, success, error, parameters)""")
def run_manifest(spark, d):
    said = F.array_join(F.transform(F.map_entries("parameters"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return _manifest(spark).select("session", "path", "type", "timestamp", "success", "error", said.alias("parameters"))


@fixed("SELECT * FROM (VALUES ('s1', 2, 1, '2025-01-02'), ('s2', 2, 0, '2025-01-04')) s(session, n, n_failed, last)")
def session_summary(spark, d):
    return provenance.session_summary(_manifest(spark))


@fixed("SELECT 's1' AS session, 'qc.json' AS path")
def pilot_gate(spark, d):
    """Only a summary that passed its thresholds lets later stages run."""
    return provenance.passed_gate(_manifest(spark)).select("session", "path")


def _judged_sql() -> str:
    return "SELECT d.*, CASE WHEN quality IS NULL THEN NULL ELSE quality = 1 END AS good, CASE WHEN toxic IS NULL THEN NULL ELSE toxic = 0 END AS fine FROM documents d LEFT JOIN labels USING (doc_id)"


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).join(table(spark, d, "labels"), "doc_id", "left")


_PILOT = ["\n\nInstruction:", "\n\nQuestion:", "\n\nQ:", "\nUser:", "\nAssistant:", "\nHuman:"]
_ACCEPTED = f"SELECT lang, avg(CAST(good AS INT)) AS instruction_acceptance, avg(CAST(fine AS INT)) AS pair_acceptance FROM ({_judged_sql()}) GROUP BY lang"


@query(f"""SELECT lang, failed_reasons, len(failed_reasons) = 0 AS passed FROM (SELECT lang, list_filter([CASE WHEN runaway_rate >= 0.05 THEN 'runaway_rate' END, CASE WHEN token_limit_rate >= 0.1 THEN 'token_limit_rate' END,
  CASE WHEN n_delimiter > 0 THEN 'delimiter_leakage' END, CASE WHEN n_truncated > 0 THEN 'truncation' END, CASE WHEN median_tokens >= 40 THEN 'median_tokens' END, CASE WHEN instruction_acceptance < 0.5 THEN 'instruction_acceptance' END,
  CASE WHEN pair_acceptance < 0.5 THEN 'pair_acceptance' END], lambda x: x IS NOT NULL) AS failed_reasons FROM ({_qc_sql("SELECT * FROM documents", "text", "lang", _PILOT, "###", "length(r) // 4", "tokens >= 95")}) JOIN ({_ACCEPTED}) USING (lang))""")
def qc_gate_pilot(spark, d):
    s = qc.qc_summary(_judged(spark, d), "text", "pilot", ["lang"], F.col("quality") == 1, F.col("toxic") == 0)
    return qc.gate(s, "pilot").select("lang", "failed_reasons", "passed")


@query(f"""SELECT kind, failed_reasons, len(failed_reasons) = 0 AS passed FROM (SELECT kind, list_filter([CASE WHEN runaway_rate >= 0.05 THEN 'runaway_rate' END, CASE WHEN n_delimiter > 0 THEN 'delimiter_leakage' END,
  CASE WHEN median_tokens >= 40 THEN 'median_tokens' END], lambda x: x IS NOT NULL) AS failed_reasons FROM ({_qc_sql(PROBES, "response", "kind", _PILOT, "###END###", q.n_words("r"), "false")}))""")
def qc_gate_scale(spark, d):
    return qc.gate(qc.qc_summary(probes(spark, d), "response", "scale", ["kind"]), "scale").select("kind", "failed_reasons", "passed")


@query("SELECT count(*) AS n, md5(min(text)) AS first FROM documents")
def training_gate(spark, d):
    """Training rows that pass the gate (the two columns are there, and rows)."""
    x = docs(spark, d).select(F.concat_ws(" ", "lang", "source").alias("instruction"), F.col("text").alias("response"))
    return validate.training_gate(x).agg(F.count("*").alias("n"), F.md5(F.min("response")).alias("first"))


@query("SELECT lang, bool_and(trim(coalesce(text, '')) <> '' AND doc_id % 97 <> 5) AS instructions_valid, bool_and(trim(coalesce(text, '')) <> '' AND doc_id % 89 <> 3) AS pairs_valid FROM documents GROUP BY lang")
def boolean_validators(spark, d):
    """Whether all instructions, and all pairs, of a language are valid; some are blanked."""
    x = docs(spark, d)
    a = validate.instructions(x.select("lang", F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 97 == 5, " \n").otherwise(F.col("text")).alias("instruction"), F.col("source").alias("instruction_type")))
    b = validate.filled_pairs(x.select("lang", F.concat_ws(" ", F.lit("Instruction:"), "source", "lang").alias("prompt"), F.col("text").alias("chosen"), F.when(F.col("doc_id") % 89 == 3, " ").otherwise(F.concat(F.lit("Not: "), F.col("text"))).alias("rejected")))
    ok = lambda df, name: df.groupBy("lang").agg(F.bool_and(F.size("violations") == 0).alias(name))
    return ok(a, "instructions_valid").join(ok(b, "pairs_valid"), "lang")


@fixed("SELECT * FROM (VALUES ('whole', CAST([] AS VARCHAR[])), ('cut', ['adapter_model.safetensors']), ('none', ['adapter_config.json', 'adapter_model.safetensors'])) c(checkpoint, missing)")
def checkpoint_files(spark, d):
    root = files.scratch(spark, "checkpoints")
    for name in ("whole/adapter_config.json", "whole/adapter_model.safetensors", "cut/adapter_config.json"):
        files.write_text(spark, "{}", f"{root}/{name}")
    return spark.createDataFrame([(c, files.missing_files(spark, f"{root}/{c}")) for c in ("whole", "cut", "none")], "checkpoint string, missing array<string>")


@fixed("SELECT * FROM (VALUES ('whole', CAST([] AS VARCHAR[])), ('without version', ['loader_version']), ('empty', ['loader_version', 'quantization', 'template_disabled', 'sentinel_tests_passed', 'add_special_tokens'])) r(record, missing)")
def required_fields(spark, d):
    whole = provenance.loader_record("m", [])
    rows = [("whole", provenance.missing(whole)), ("without version", provenance.missing(whole | {"loader_version": None})), ("empty", provenance.missing({}))]
    return spark.createDataFrame(rows, "record string, missing array<string>")


@fixed("SELECT * FROM (VALUES (0, 'load', 'skipped'), (1, 'clean', 'done'), (2, 'train', 'failed: no rows')) s(place, step, outcome)")
def step_log(spark, d):
    """Steps in order: one whose artifact is there is skipped, and the first failure is the last."""
    root = files.scratch(spark, "steps")
    files.write_text(spark, "done", f"{root}/load")

    def fail() -> None:
        raise ValueError("no rows")

    steps = [("load", f"{root}/load", fail), ("clean", f"{root}/clean", lambda: files.write_text(spark, "done", f"{root}/clean")), ("train", f"{root}/train", fail), ("report", f"{root}/report", fail)]
    log = provenance.run_steps(steps, lambda p: files.exists(spark, p))
    return spark.createDataFrame([(i, *r) for i, r in enumerate(log)], "place int, step string, outcome string")


# Provenance


@fixed("SELECT * FROM (VALUES ('branch', true), ('commit', true), ('dirty', true), ('master', true), ('platform', true), ('python', true), ('shuffle_partitions', true), ('spark', true)) f(field, known)")
def run_facts(spark, d):
    """What a run records of the repository and its environment; the values differ from machine to machine."""
    facts = provenance.git_info() | provenance.environment_info(spark)
    return spark.createDataFrame([(k, v is not None and v != "") for k, v in sorted(facts.items())], "field string, known boolean")


@fixed("""SELECT * FROM (VALUES ('add_special_tokens', 'False'), ('device_map', 'auto'), ('loader_version', 'known'), ('model_name', 'm'), ('quantization', '4bit-nf4'), ('sentinel_results', '2'),
  ('sentinel_tests_passed', 'False'), ('template_disabled', 'True'), ('torch_dtype', 'bfloat16'), ('artifact_type', 'pairs'), ('dirty', 'known'), ('seed', '7')) f(field, value)""")
def loader_record(spark, d):
    """What a loader records of itself, in the record of an artifact."""
    loader = provenance.loader_record("m", [{"name": "a", "passed": True}, {"name": "b", "passed": False}], load_in_4bit=True)
    record = provenance.artifact_record("pairs", "pairs.py", "other", loader, "2025-01-01", more={"seed": 7})
    shown = {"loader_version": "known", "dirty": "known", "sentinel_results": len(record["sentinel_results"])}
    names = [*loader, "artifact_type", "dirty", "seed"]
    return spark.createDataFrame([(n, str(shown.get(n, record[n]))) for n in names], "field string, value string")


@query(f"""SELECT lang, total, n_runaway, median_tokens, 0.05::DOUBLE AS runaway_max, runaway_rate <= 0.05 AND token_limit_rate <= 0.1 AND n_delimiter = 0 AND median_tokens <= 40 AS passed, '2025-01-01' AS timestamp, true AS has_commit
FROM ({_qc_sql("SELECT * FROM documents", "text", "lang")})""")
def qc_document(spark, d):
    """The record of a quality gate as one JSON document for each language, read again."""
    gated = qc.gate(qc.qc_summary(docs(spark, d), "text", "repair", ["lang"]), "repair")
    rules = qc.RULES["repair"]
    out = provenance.qc_document(gated, {"runaway_max": rules.runaway_max, "token_limit_max": rules.token_limit_max, "median_max": rules.median_max}, "2025-01-01")
    form = "timestamp string, git struct<commit:string>, counts struct<total:long,n_runaway:long>, token_stats struct<median_tokens:double>, thresholds struct<runaway_max:double>, thresholds_passed boolean"
    r = out.select("lang", F.from_json("document", form).alias("r"))
    return rounded(r.select("lang", "r.counts.total", "r.counts.n_runaway", "r.token_stats.median_tokens", "r.thresholds.runaway_max", F.col("r.thresholds_passed").alias("passed"), "r.timestamp", F.col("r.git.commit").isNotNull().alias("has_commit")))


def _critiques() -> tuple:
    one = lambda sign: F.struct(
        (F.col("quality") == 1).alias("is_good"),
        F.when(F.col("quality") == 1, "A").otherwise("B").alias("predicted_label"),
        (F.col("doc_id") * sign).cast("double").alias("logp_a"),
        F.lit(-1.0).alias("logp_b"),
        F.abs(F.col("doc_id") * sign + 1).cast("double").alias("margin"),
        (F.col("doc_id") > 10).alias("confident"),
    )
    return F.when(F.col("doc_id") % 3 == 0, one(-1)), F.when(F.col("doc_id") % 5 != 0, one(-2))


@query("""SELECT doc_id, quality = 1 AS is_good, CAST(CASE WHEN doc_id % 3 = 0 THEN -doc_id ELSE -2 * doc_id END AS DOUBLE) AS logp_a, doc_id % 3 <> 0 AS inferred, CASE WHEN doc_id % 3 <> 0 THEN 'Inferred from pair critique' END AS note
FROM labels WHERE doc_id % 3 = 0 OR doc_id % 5 <> 0 UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL FROM labels WHERE doc_id % 3 <> 0 AND doc_id % 5 = 0""")
def inferred_critiques(spark, d):
    own, pair = _critiques()
    c = table(spark, d, "labels").select("doc_id", text.inferred_critique(own, pair).alias("c"))
    return c.select("doc_id", "c.is_good", "c.logp_a", F.col("c._inferred").alias("inferred"), F.col("c._note").alias("note"))


@query(f"SELECT doc_id, length({q.strip('text')}) > 0 AND length({q.strip('text')}) < 100 AS relaxed, toxic = 0 AS other, length({q.strip('text')}) > 0 AND length({q.strip('text')}) < 100 AND toxic = 0 AS all_passed FROM documents JOIN labels USING (doc_id)")
def nested_sentinels(spark, d):
    """Probes in an array: the named one is judged by length, and then all."""
    probe = lambda name, passed: F.struct(F.lit(name).alias("name"), F.col("text").alias("response"), passed.alias("passed"))
    s = _judged(spark, d).where("toxic IS NOT NULL").withColumn("s", F.array(probe("greeting", F.lit(False)), probe("sum", F.col("toxic") == 0)))
    s = s.withColumn("s", text.relaxed_sentinels(F.col("s"), "greeting"))
    return s.select("doc_id", F.col("s")[0]["passed"].alias("relaxed"), F.col("s")[1]["passed"].alias("other"), text.all_passed(F.col("s")).alias("all_passed"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id END AS seed, CASE WHEN doc_id % 2 = 0 THEN source END AS shard_id, true AS repaired, '2025-01-01' AS repair_timestamp, ['strip', 'infer'] AS repair_operations FROM documents")
def metadata_upsert(spark, d):
    """Stamps in nested metadata, which are made where there are none."""
    m = F.when(F.col("doc_id") % 2 == 0, F.from_json(F.to_json(F.struct(F.col("doc_id").alias("seed"), F.col("source").alias("shard_id"))), schemas.METADATA))
    out = provenance.stamped(docs(spark, d).select("doc_id", m.alias("metadata")), ["strip", "infer"], "2025-01-01")
    return out.select("doc_id", "metadata.seed", "metadata.shard_id", "metadata.repaired", "metadata.repair_timestamp", "metadata.repair_operations")


@query("SELECT n_nationkey AS k, unnest(['name', 'seed', 'shard', 'run']) AS field, unnest([n_name, CAST(n_regionkey AS VARCHAR), 'x', CAST(n_nationkey AS VARCHAR)]) AS value FROM nation")
def merged_provenance(spark, d):
    """Three maps in one; later keys win."""
    as_map = lambda **c: F.create_map(*[x for k, v in c.items() for x in (F.lit(k), v.cast("string"))])
    n, key, region = F.col("n_name"), F.col("n_nationkey"), F.col("n_regionkey")
    m = provenance.merged(as_map(name=F.lower(n), seed=key), as_map(name=n, shard=F.lit("y")), as_map(seed=region, shard=F.lit("x"), run=key))
    return table(spark, d, "nation").select(key.alias("k"), F.explode(m).alias("field", "value"))


# Texts


_SECTIONED = "'# Review' || chr(10) || '**Strengths**: see below' || chr(10) || text || chr(10) || '## Issues' || chr(10) || 'none' || chr(10) || lang || chr(10) || '**Verdict**' || chr(10) || source"


def _section_sql(head: str) -> str:
    rest = f"substr(t, position({q.quoted(head)} IN t) + length({q.quoted(head)}))"
    body = f"substr({rest}, position(chr(10) IN {rest}) + 1)"
    cut = f"least(coalesce(nullif(position(chr(10) || '**' IN chr(10) || {body}), 0), 1000000000), coalesce(nullif(position(chr(10) || '##' IN chr(10) || {body}), 0), 1000000000))"
    return q.strip(f"substr({body}, 1, greatest(0, {cut} - 2))")


@query(f"SELECT doc_id, md5({_section_sql('**Strengths**')}) AS strengths, {_section_sql('**Verdict**')} AS verdict FROM (SELECT doc_id, {_SECTIONED} AS t FROM documents)")
def markdown_sections(spark, d):
    t = docs(spark, d).select("doc_id", F.concat(F.lit("# Review\n**Strengths**: see below\n"), "text", F.lit("\n## Issues\nnone\n"), "lang", F.lit("\n**Verdict**\n"), "source").alias("t"))
    return t.select("doc_id", F.md5(text.section(F.col("t"), "Strengths")).alias("strengths"), text.section(F.col("t"), "Verdict").alias("verdict"))


_Y = q.strip("response")
_CUT_SHORT = rf"({_Y} LIKE '%:' OR regexp_matches({_Y}, '[\d).]\s+[\pL\pN_]+(\s+[\pL\pN_]+)*\s*-\s*$') OR (length({_Y}) < 10 AND {_Y} NOT IN ('Yes', 'No', 'Yes.', 'No.')))"


@query(f"SELECT doc_id, {_CUT_SHORT} AS truncated, CASE WHEN {TRUE_FALSE} THEN 'true_false' WHEN {_CUT_SHORT} THEN 'truncated' ELSE 'kept' END AS route FROM ({PROBES})")
def route_scope_strict(spark, d):
    """With the shorter list of short answers, and bare verdicts first."""
    strict = text.SHORT_ANSWERS_STRICT
    return probes(spark, d).select("doc_id", text.is_truncated(R(), strict).alias("truncated"), text.route(I(), R(), False, strict).alias("route"))


@query(f"SELECT doc_id, len(w) > 0 AND doc_id % 5 > 0 AND doc_id % 7 > 0 OR len(w) = 0 AND doc_id % 5 > 0 AS template_free FROM (SELECT doc_id, {q.words('text')} AS w FROM documents)")
def template_delta(spark, d):
    """Token ids with a chat template's beside those without: some rows get a token more, some one of the template's."""
    plain = F.transform(text.words(F.col("text")), F.length)
    t = docs(spark, d).select("doc_id", plain.alias("plain"))
    chat = F.when(F.size("plain") > 0, F.concat(F.array(F.lit(900001)), F.slice("plain", F.lit(2), F.size("plain")))).otherwise(F.col("plain"))
    special = F.when(F.col("doc_id") % 5 == 0, F.concat("plain", F.array(F.lit(1)))).when(F.col("doc_id") % 7 == 0, chat).otherwise(F.col("plain"))
    return t.select("doc_id", text.template_free(F.col("plain"), special, [900001, 900002]).alias("template_free"))


@query("SELECT doc_id, CAST(len(string_split(text, ' ')) AS BIGINT) AS n_tokens FROM documents")
def true_token_counts(spark, d):
    """Counts of any tokenizer, here one that cuts at spaces."""
    return models.token_counts(docs(spark, d).select("doc_id", "text"), "text", lambda t: len(t.split(" "))).select("doc_id", "n_tokens")


@query()
def bpe_token_counts(spark, d):
    """Counts of a local byte-level tokenizer over whole texts, with a special string planted in some."""
    import public_tokenizers

    x = docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 9 == 4, F.concat("text", F.lit("<|endoftext|> more"))).otherwise(F.col("text")).alias("text"))
    return models.token_counts(x, "text", models.LocalTokenizer(public_tokenizers.path("byte_bpe_50k.json"))).select("doc_id", "n_tokens")


# Pairs, plans and generators


@query("SELECT doc_id, quality AS a, toxic AS b FROM labels")
def positional_pairs(spark, d):
    x = table(spark, d, "labels")
    both = pairs.positional_pairs(x.select("doc_id", F.col("quality").alias("v")), x.select("doc_id", F.col("toxic").alias("v")), "doc_id")
    return both.select("doc_id", F.col("a.v").alias("a"), F.col("b.v").alias("b"))


@query(f"""SELECT type, category, round(avg(b), 6) AS rate, baseline_rate, round(avg(b) - baseline_rate, 6) AS improvement FROM ({OUTCOMES})
JOIN (VALUES ('en', 'english', 0.5::DOUBLE), ('fr', 'french', 0.25)) m(type, category, baseline_rate) USING (type) GROUP BY type, category, baseline_rate""")
def baseline_gains(spark, d):
    """Rates beside stored ones by a mapping of types; those that one side lacks are left out."""
    rates = evaluate.type_rates(view(spark, d, OUTCOMES).select("type", (F.col("b") == 1).alias("success")), "type").where("type IS NOT NULL")
    stored = _strings(spark, [("english", 0.5), ("french", 0.25), ("italian", 0.9)], "category string, rate double")
    return rounded(evaluate.against_baseline(rates, stored, {"en": "english", "fr": "french", "de": "german"}).select("type", "category", "rate", "baseline_rate", "improvement"))


@query("SELECT doc_id, 15 AS n_batches FROM documents ORDER BY doc_id LIMIT 150")
def over_generated(spark, d):
    """Half as many candidates again as are asked for."""
    some = ranking.sorted_output(docs(spark, d).select("doc_id"), "doc_id").limit(generate.candidate_limit(100))
    return some.withColumn("n_batches", F.lit(generate.candidate_batches(100)))


@query("SELECT source, count(*) AS n, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM documents GROUP BY source")
def sorted_counts(spark, d):
    """Counts in order of their key, with the place that each has in the output."""
    counts = ranking.sorted_output(docs(spark, d).groupBy("source").agg(F.count("*").alias("n")), "source")
    return counts.withColumn("_at", F.monotonically_increasing_id()).select("source", "n", F.expr("row_number() OVER (ORDER BY _at)").alias("place"))


@fixed("SELECT i AS index, ['list', 'count', 'sort', 'filter', 'classify', 'extract'][i % 6 + 1] AS type, replace(replace(CASE i % 6 "
    + " ".join(f"WHEN {n} THEN [{', '.join(q.quoted(t) for t in options)}][CAST(floor({q.unit('i', 9)} * {len(options)}) AS INT) + 1]" for n, options in enumerate((
        ("List {count} {topic}", "Name {count} types of {topic}", "Give me {count} examples of {topic}"),
        ("How many {item} are in {context}?", "Count the number of {item} in: {context}"),
        ("Sort these items: {items}", "Arrange in order: {items}", "Put in alphabetical order: {items}"),
        ("From this list, select only {criteria}: {items}", "Filter for {criteria}: {items}"),
        ("Is this {category}? {item}", "Classify as {options}: {item}"),
        ("Extract {target} from: {text}", "Find the {target} in: {text}"),
    )))
    + " END, 'x', 'x'), 'y', 'y') AS instruction FROM range(0, 60) r(i)")
def typed_templates(spark, d):
    """Types in turn with a template each, places not filled."""
    return generate.typed_instructions(spark, 60, 9, fillers={})


@query("""WITH n AS (SELECT count(*) AS n FROM documents) SELECT i AS index, ['list', 'count', 'sort', 'filter', 'classify', 'extract'][i % 6 + 1] AS type, CASE i % 6
    WHEN 0 THEN replace(['List {topic}', 'Name types of {topic}'][CAST(floor(""" + q.unit("i", 9) + """ * 2) AS INT) + 1], '{topic}', ['animals', 'fruits', 'cities'][CAST(floor(""" + q.unit("i || '|topic'", 9) + """ * 3) AS INT) + 1])
    WHEN 1 THEN 'Count the words' WHEN 2 THEN 'Sort these' WHEN 3 THEN 'Filter these' WHEN 4 THEN 'Classify this' ELSE 'Extract names' END AS instruction FROM n, range(0, (SELECT count(*) FROM documents)) r(i)""")
def instructions_for_documents(spark, d):
    """As many instructions as there are documents, types in turn, a template and a filler by hash."""
    templates = {"list": ("List {topic}", "Name types of {topic}"), "count": ("Count the words",), "sort": ("Sort these",), "filter": ("Filter these",), "classify": ("Classify this",), "extract": ("Extract names",)}
    return generate.typed_instructions(spark, docs(spark, d).count(), 9, templates, {"list": {"topic": ("animals", "fruits", "cities")}})


@fixed(f"""SELECT i AS index, 'Sort these items: ' || ['b, a', 'd, c', 'f, e'][CAST(floor({q.unit("i || '|items'", 4)} * 3) AS INT) + 1] AS instruction FROM range(0, 40) r(i)""")
def typed_instructions(spark, d):
    """A template whose place is filled by the hash of seed, index and place."""
    return generate.typed_instructions(spark, 40, 4, {"sort": ("Sort these items: {items}",)}, {"sort": {"items": ("b, a", "d, c", "f, e")}}).select("index", "instruction")


@fixed("""SELECT 'test_' || (i + 1) AS id, CASE i // 5 WHEN 0 THEN ['p', 'q'][i % 2 + 1] WHEN 1 THEN ['r'][1] ELSE ['s', 't', 'u'][(i - 10) % 3 + 1] END AS instruction, ['qa', 'instruction_following', 'creative_text'][i // 5 + 1] AS expected_type
FROM (SELECT i FROM range(0, 15) r(i))""".replace("['p', 'q'][i % 2 + 1]", "['p', 'q'][i % 5 % 2 + 1]").replace("(i - 10) % 3", "i % 5 % 3"))
def held_out_tests(spark, d):
    return generate.held_out_tests(spark, {"qa": ("p", "q"), "instruction_following": ("r",), "creative_text": ("s", "t", "u")}, 16)


@fixed("""SELECT * FROM (VALUES ('explicit_list', 'check_list_fruits'), ('explicit_generation', 'check_sentence_about_topic'), ('explicit_translation', 'check_translation'), ('qa_math', 'check_math_answer'), ('qa_factual', 'check_factual_answer'), ('completion', 'check_completion_temperature'),
  ('completion_blank', 'check_fill_blank'), ('constrained_length', 'check_exact_word_count'), ('constrained_format', 'check_numbered_list'), ('constrained_answer', 'check_yes_no_only'), ('multi_step', 'check_two_step'), ('harmful_refusal', 'check_refusal')) s(instruction_type, check_name)""")
def check_suite(spark, d):
    return generate.check_suite(spark).where("instruction <> ''").select("instruction_type", "check_name")


@fixed("SELECT * FROM (VALUES ('completions', 10, 'The capital of France is'), ('questions', 10, 'What is the capital of France?'), ('instructions', 10, 'Answer this question: What is gravity?'), ('commands', 10, 'Write a sentence about dogs.')) b(category, n, first)")
def baseline_prompts(spark, d):
    return generate.baseline_prompts(spark).groupBy("category").agg(F.count("*").alias("n"), F.min_by("prompt", "place").alias("first"))


@query("SELECT 't' || n_nationkey AS test_id, n_name AS category FROM nation")
def stored_suite(spark, d):
    """A test suite of any size from JSON lines."""
    path = files.scratch(spark, "suite")
    rows = table(spark, d, "nation").select(F.concat(F.lit("t"), F.col("n_nationkey").cast("string")).alias("test_id"), F.col("n_name").alias("category"), F.lit("p").alias("prompt"), F.lit("e").alias("expected"))
    files.write_jsonl(rows, path)
    return generate.suite(spark, path).select("test_id", "category")


# Models by plug-in


@query("SELECT conv_id, turn, 'Echo: ' || text AS response, n.text AS stored FROM conversations c LEFT JOIN (SELECT conv_id, turn - 1 AS turn, text FROM conversations) n USING (conv_id, turn)".replace("'Echo: ' || text", "'Echo: ' || c.text"))
def generated_responses(spark, d):
    """Responses of a function of batches of prompts, and of a table of stored outputs."""
    t = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("prompt"))
    made = models.generate(t, "prompt", lambda p: "Echo: " + p)
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    stored = t.select(F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string")).alias("key"), F.col("prompt").alias("stored"))
    return models.generate(made.withColumn("key", key), "key", stored, "stored").select("conv_id", "turn", "response", "stored")


@query("""SELECT conv_id, turn, CASE WHEN length(text) % 7 <> 3 THEN 'Said: ' || text END AS response, CASE WHEN length(text) % 7 = 3 THEN 'no answer to ' || length(text) END AS error FROM conversations""")
def retried_responses(spark, d):
    """A function of 16 prompts at most that fails for some prompts, and once for each batch: the others are answered."""
    seen: set[str] = set()

    def backend(prompts: list[str]) -> list[str]:
        if prompts[0] not in seen:
            seen.add(prompts[0])
            raise TimeoutError("busy")
        bad = [p for p in prompts if len(p) % 7 == 3]
        if bad:
            raise ValueError(f"no answer to {len(bad[0])}")
        return [f"Said: {p}" for p in prompts]

    rows = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("prompt"))
    return models.generate_in_batches(rows, "prompt", backend, batch_size=16).select("conv_id", "turn", "response", "error")


@query("SELECT conv_id, turn, length(text) < 200 AS is_good, CAST(abs(200 - length(text)) AS DOUBLE) AS margin FROM conversations")
def label_logps(spark, d):
    """Verdicts from log-probabilities that a function gives for batches of prompts."""

    def logps(prompts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"logp_a": -prompts.str.len().astype(float), "logp_b": -200.0})

    rows = models.label_logps(table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("prompt")), "prompt", logps)
    return models.judged(rows, F.col("logp_a"), F.col("logp_b")).select("conv_id", "turn", "verdict.is_good", "verdict.margin")


@query("SELECT event_id, round(abs(value - 50), 6) AS margin, value - 50 > 0.5 AS confident FROM events")
def sequence_margins(spark, d):
    rows = table(spark, d, "events").select("event_id", pairs.sequence_margin(F.col("value"), F.lit(50.0)).alias("s"))
    return rounded(rows.select("event_id", "s.margin", "s.confident"))


@query("SELECT CAST(doc_id AS VARCHAR) AS instruction, md5(text) AS rejected, md5(text || '?') AS chosen FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 7 <> 0")
def critiqued_pairs(spark, d):
    """Pairs of a critique and an improvement, unless one of the steps failed."""
    failed = lambda n: F.when(F.col("doc_id") % n == 0, "failed")
    rows = docs(spark, d).select(F.col("doc_id").cast("string").alias("instruction"), F.col("text").alias("original"), F.concat("text", F.lit("?")).alias("improved"), failed(11).alias("critique_error"), failed(7).alias("improve_error"))
    return pairs.critiqued_pairs(rows).select("instruction", F.md5("rejected").alias("rejected"), F.md5("chosen").alias("chosen"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 4 < 3 THEN length(text) % 2 = 0 END AS overall_pass, CASE WHEN turn % 4 < 3 THEN length(text) > 100 AND turn % 3 <> 1 END AS all_turns_pass FROM conversations""")
def judge_json(spark, d):
    """A judge's verdicts as JSON; every fourth isn't."""
    word = lambda c: F.when(c, "PASS").otherwise("fail")
    n, turn = F.length("text"), F.col("turn")
    said = F.concat(F.lit('{"turn_2": {"result": "'), word(n > 100), F.lit('", "reason": "x"}, "turn_3": "'), word(turn % 3 != 1), F.lit('", "overall": "'), word(n % 2 == 0), F.lit('"}'))
    j = table(spark, d, "conversations").select("conv_id", "turn", conversation.parse_judgement(F.when(turn % 4 < 3, said).otherwise("no JSON")).alias("j"))
    return j.select("conv_id", "turn", "j.overall_pass", "j.all_turns_pass")


# Statistics


_COUNTS = "SELECT s_nationkey AS k, count(*) AS n, count(*) FILTER (s_acctbal > 5000) AS x FROM supplier GROUP BY s_nationkey"
_Z = 1.959963984540054
_MID = f"((x / n + {_Z * _Z} / (2.0 * n)) / (1 + {_Z * _Z} / n))"
_WIDE = f"({_Z} * sqrt((x / n * (1 - x / n) + {_Z * _Z} / (4.0 * n)) / n) * sqrt(1 / (1 + {_Z * _Z} / n)))"


@query(f"SELECT k, round(greatest(0.0, {_MID} - {_WIDE}), 6) AS lower, round(least(1.0, {_MID} + {_WIDE}), 6) AS upper FROM ({_COUNTS})")
def wilson_wide(spark, d):
    """The wider interval of an earlier formula."""
    c = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"), F.count_if(F.col("s_acctbal") > 5000).alias("x"))
    return rounded(c.select("k", stats.wilson(F.col("x"), F.col("n"), variant="wide").alias("w")).select("k", "w.*"))


_GRID = "SELECT n_nationkey AS k, n_nationkey % 13 AS n01, CASE WHEN n_nationkey = 0 THEN 0 ELSE 24 + n_nationkey % 2 - n_nationkey % 13 END AS n10 FROM nation"
_X1, _X0 = "(pow(abs(n01 - n10) - 1, 2) / (n01 + n10))", "(pow(abs(n01 - n10), 2) / (n01 + n10))"
_EXACT = "method = 'exact' OR method = 'auto' AND n01 + n10 < 25"


@query(f"""SELECT k, method AS asked, CASE WHEN n01 + n10 = 0 THEN 'none' WHEN {_EXACT} THEN 'exact' WHEN method = 'auto' THEN 'chi2' ELSE method END AS used,
  round(CASE WHEN n01 + n10 = 0 THEN 0.0 WHEN {_EXACT} THEN least(n01, n10) WHEN method = 'chi2_no_continuity' THEN {_X0} ELSE {_X1} END, 6) AS statistic,
  round(CASE WHEN n01 + n10 = 0 THEN 1.0 WHEN {_EXACT} THEN {q.binomial_p('n01', 'n10')} WHEN method = 'chi2_no_continuity' THEN {q.chi2_p(_X0)} ELSE {q.chi2_p(_X1)} END, 6) AS p
FROM ({_GRID}), (VALUES ('auto'), ('exact'), ('chi2'), ('chi2_no_continuity')) m(method)""")
def mcnemar_variants(spark, d):
    """All forms of the test on both sides of the 25 discordant pairs that decide between them, and on none."""
    g, out = view(spark, d, _GRID), None
    for method in ("auto", "exact", "chi2", "chi2_no_continuity"):
        one = g.select("k", F.lit(method).alias("asked"), stats.mcnemar(F.col("n01"), F.col("n10"), method).alias("m")).select("k", "asked", F.col("m.method").alias("used"), "m.statistic", "m.p")
        out = one if out is None else out.unionByName(one)
    return rounded(out)
