"""Registered queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, chat, jaccard, licenses, mixing, quality, resampling, simhash, substring_dedup, token_counts, vector_codes, warc

WORDS = r"[^\x20\x09-\x0D]+"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal_digests(_table(spark, sf_dir, "documents"))


OP1 = rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS words FROM documents
), s AS (
  SELECT doc_id, words, unnest(range(1, greatest(len(words) - 18, 1))) AS i FROM w
), e AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(words[i:i + 19], ' ') ORDER BY doc_id, i) AS n FROM s
), gone AS (
  SELECT doc_id, list(i) AS starts FROM e WHERE n > 1 GROUP BY doc_id
), covered AS (
  SELECT w.doc_id, words, flatten(list_transform(coalesce(starts, []), lambda x: range(x, x + 20))) AS c FROM w LEFT JOIN gone USING (doc_id)
), kept AS (
  SELECT doc_id, len(words) AS n, list_filter(words, lambda x, k: NOT list_contains(c, k)) AS k
  FROM (SELECT doc_id, words, list_distinct(c) AS c FROM covered)
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n - len(k) AS BIGINT) AS n_removed,
       sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""

def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.source_mix(_table(spark, sf_dir, "documents"))


# doc_ids don't occur again in the table
OP2 = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) AS size,
         md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))) AS h FROM documents
), z AS (
  SELECT source, sum(size) AS n, row_number() OVER (ORDER BY source NULLS LAST) AS ord FROM d GROUP BY source
), w AS (
  SELECT *, CASE (ord - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, 2.0::DOUBLE * n AS cap FROM z
), v AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(n) FROM w) - coalesce(sum(cap) OVER (ORDER BY cap / weight, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT source, ord, CAST(n AS BIGINT) AS n, least(cap, (SELECT max(level) FROM v) * weight) AS target FROM w
), g AS (
  SELECT *, CAST(ceil(n / 256) AS BIGINT) AS n_blocks, CAST(round(target) AS BIGINT) AS goal FROM t
), c AS (
  SELECT *, coalesce(goal // nullif(n, 0), 0) * n_blocks + CAST(ceil(coalesce(goal % nullif(n, 0), 0) / 256) AS BIGINT) AS n_slots FROM g
), e AS (
  SELECT *, CAST(sum(n_slots) OVER (ORDER BY ord) AS BIGINT) AS high FROM c
), b AS (
  SELECT min(k) AS bits FROM range(1, 62) r(k) WHERE (1::BIGINT << k) >= (SELECT sum(n_slots) FROM c)
), s AS (
  SELECT i AS slot, CAST(list_sum(list_transform(range(0, bits), lambda k: ((i >> k) & 1) << (bits - 1 - k))) AS BIGINT) AS cell
  FROM b, range(0, (SELECT 1::BIGINT << bits FROM b)) r(i)
), k AS (
  SELECT slot, e.*, row_number() OVER (PARTITION BY ord ORDER BY slot) - 1 AS r FROM s JOIN e ON cell >= high - n_slots AND cell < high
), m AS (
  SELECT slot, ord, r % n_blocks * 256 AS start, least(r % n_blocks * 256 + 256, n, goal - r // n_blocks * n) AS stop FROM k
), p AS (
  SELECT d.*, n, target, ord, coalesce(sum(size) OVER (PARTITION BY ord ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(any_value(size) AS BIGINT) AS size, any_value(n) AS source_size, any_value(target) AS target,
       CAST(coalesce(sum(CASE WHEN slot IS NOT NULL THEN least(stop, begin + size) - greatest(start, begin) END), 0) AS BIGINT) AS taken, min(slot) AS first_slot, max(slot) AS last_slot
FROM p LEFT JOIN m ON p.ord = m.ord AND start < begin + size AND stop > begin AND size > 0 GROUP BY doc_id
"""


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_matches(_table(spark, sf_dir, "documents"))


# Constants of the SQL, written out apart from those of the operator. Equivalent spellings, with plurals.
_SPELLED = """MAP {
  'licence': 'license', 'licences': 'licenses', 'acknowledgement': 'acknowledgment', 'acknowledgements': 'acknowledgments',
  'analogue': 'analog', 'analogues': 'analogs', 'authorisation': 'authorization', 'authorisations': 'authorizations',
  'centre': 'center', 'centres': 'centers', 'favour': 'favor', 'favours': 'favors',
  'fulfilment': 'fulfillment', 'fulfilments': 'fulfillments', 'initialise': 'initialize', 'initialises': 'initializes',
  'judgement': 'judgment', 'judgements': 'judgments', 'modernise': 'modernize', 'modernises': 'modernizes',
  'organisation': 'organization', 'organisations': 'organizations', 'practise': 'practice', 'practises': 'practices',
  'programme': 'program', 'programmes': 'programs', 'utilisation': 'utilization', 'utilisations': 'utilizations',
  'whilst': 'while', 'whilsts': 'whiles', 'wilful': 'willful', 'wilfuls': 'willfuls', 'https': 'http', 'httpss': 'https'}"""
_PHRASES = (("sub license", "sublicense"), ("copyright owner", "copyright holder"), ("non commercial", "noncommercial"), ("per cent", "percent"))


def _canonical_sql(x: str) -> str:
    lines = r"(?m)^[^\p{L}\p{N}\n©]*(?:(?:copyright|\(c\)|©)\s*(?:\(c\)|©|\d{4}|by\b|<|\[)[^\n]*|all rights reserved\.?[ \t]*)$"
    x = f"regexp_replace(lower(coalesce({x}, '')), '{lines}', ' ', 'g')"
    x = f"trim(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ')"
    x = f"' ' || array_to_string(list_transform(string_split({x}, ' '), lambda w: coalesce({_SPELLED}[w], w)), ' ') || ' '"
    for old, new in _PHRASES * 2:
        x = f"replace(replace({x}, ' {old} ', ' {new} '), ' {old}s ', ' {new}s ')"
    return f"trim({x}, ' ')"


# Digests of the canonical forms of the built-in licence texts.
_KNOWN_DIGESTS = """
  ('35a446201226de6b27cfb7106d0f6c697f63bfeac2913dcf89024911e66ef164', 'MIT'),
  ('f172f90a892d869d5d840d5f4363218a9b21bdb1bd3925ba9c752d1660134fee', 'ISC'),
  ('a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30', 'BSD-2-Clause'),
  ('1b8c5cd52eceb19ab0bc3cb40be110b1c0e7fa2671a3fe5866e59dd1502e69c7', 'Zlib'),
  ('123a3b9fdc300d1b6f077f74b288de15d7f2c5b0b3b11e89fd799b48bfad5940', 'MIT'),
  ('00217f00b903e5911b513ea1f36a2aeb7b8999ee6622cd67b2e675f98285e541', 'MIT'),
  ('28de6b6f31af692f3276f4c7d7f809bc7d39d3206a71fe090d61d943447aabc6', 'Apache-2.0'),
  ('37d45dc3b9135ed58bd277e14112dfea95629cda77a8d62cdb6bcd862e7b5bf5', 'GPL-3.0-only'),
  ('e34399ae0e957e9bb9b4a0e3f615d05722861801f4e0718f35cefc762c349a16', 'CC-BY-NC-4.0'),
  ('5aee400278b51606c2353a854f7d936ffffe555bf9c67e56d5db376a76b63bb2', 'CC-BY-4.0'),
  ('2b112a6fd54caf2eae8e23516b628ad8ac20c00e407e568c503a16ef1eabaec2', 'CC-BY-SA-4.0'),
  -- whole texts
  ('036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b', 'Apache-2.0'),
  ('08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702', 'Artistic-1.0-Perl'),
  ('21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651', 'BSD-3-Clause'),
  ('96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f', 'CC0-1.0'),
  ('15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b', 'GFDL-1.2-only'),
  ('2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d', 'GFDL-1.3-only'),
  ('8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224', 'GPL-1.0-only'),
  ('efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821', 'GPL-2.0-only'),
  ('eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a', 'GPL-3.0-only'),
  ('61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908', 'LGPL-2.0-only'),
  ('4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891', 'LGPL-2.1-only'),
  ('aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be', 'LGPL-3.0-only'),
  ('cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6', 'MPL-1.1'),
  ('f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a', 'MPL-2.0')
"""

# Ids that a line can name.
_SPDX = """('MIT'), ('MIT-0'), ('Apache-2.0'), ('BSD-2-Clause'), ('BSD-3-Clause'), ('ISC'), ('Zlib'), ('0BSD'), ('Unlicense'), ('BSL-1.0'), ('MPL-1.1'), ('MPL-2.0'), ('EPL-2.0'),
  ('GPL-2.0-only'), ('GPL-2.0-or-later'), ('GPL-3.0-only'), ('GPL-3.0-or-later'), ('LGPL-2.1-only'), ('LGPL-2.1-or-later'), ('LGPL-3.0-only'), ('LGPL-3.0-or-later'),
  ('AGPL-3.0-only'), ('AGPL-3.0-or-later'), ('CC0-1.0'), ('CC-BY-4.0'), ('CC-BY-SA-4.0')"""

OP3 = rf"""
WITH known(digest, license_id) AS (VALUES {_KNOWN_DIGESTS} UNION ALL SELECT sha256({_canonical_sql("'SPDX-License-Identifier: ' || i")}), i FROM (VALUES {_SPDX}) s(i)), d AS (
  SELECT row_number() OVER () AS r, doc_id, sha256({_canonical_sql("text")}) AS digest, text FROM documents
), l AS (
  SELECT r, list_sort(list(DISTINCT license_id)) AS ids
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) JOIN known ON sha256({_canonical_sql("line")}) = known.digest GROUP BY r
)
SELECT doc_id, d.digest, license_id, coalesce(ids, []) AS line_licenses
FROM d LEFT JOIN l USING (r) LEFT JOIN known ON d.digest = known.digest
"""


def op4_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repaired_chats(_table(spark, sf_dir, "conversations"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_table(spark, sf_dir, "documents"))


# The stop words, written out apart from those of the operator.
_STOP_WORDS = """
  'the', 'of', 'and', 'to', 'in', 'is', 'that', 'was', 'with', 'for', 'on', 'as', 'are', 'by', 'this',
  'le', 'la', 'les', 'de', 'des', 'et', 'en', 'un', 'une', 'que', 'est', 'dans', 'pour', 'par', 'au',
  'der', 'die', 'das', 'und', 'zu', 'den', 'von', 'mit', 'ist', 'nicht', 'ein', 'eine', 'sich', 'auf',
  'el', 'los', 'y', 'se', 'por', 'con', 'para', 'es', 'las'
"""

OP6 = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORDS}')) AS l FROM documents
), g AS (
  SELECT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k, i FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM t)
), r AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g) WHERE c > 1
  ) GROUP BY doc_id
), f AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(l) AS n_lines,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
         len(list_filter(w, lambda x: lower(x) IN ({_STOP_WORDS}))) AS n_stop_words
  FROM t LEFT JOIN r USING (doc_id)
), v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, list_filter([
    CASE WHEN CAST(word_chars AS DOUBLE) / nullif(n_words, 0) < 2.0 OR CAST(word_chars AS DOUBLE) / nullif(n_words, 0) > 15.0 THEN 'word_length' END,
    CASE WHEN CAST(n_symbols AS DOUBLE) / nullif(n_words, 0) > 0.1 THEN 'symbols' END,
    CASE WHEN CAST(n_stop_words AS DOUBLE) / nullif(n_words, 0) < 0.005 THEN 'stop_words' END,
    CASE WHEN CAST(n_dup_lines AS DOUBLE) / nullif(n_lines, 0) > 0.5 THEN 'repeated_lines' END
  ], lambda x: x IS NOT NULL) AS failed FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND len(failed) = 0 AS kept, failed FROM v
"""


def op7_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_audit(_table(spark, sf_dir, "pages"))


def op8_one_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


OP8 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p
)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op10_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_groups(_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_report(_table(spark, sf_dir, "embeddings"))


def _lloyd_sql(k: int) -> str:
    """Round k of the SQL: assignments by entry numbers b, then the entries of the next round."""
    return f"""
a{k} AS MATERIALIZED (
  SELECT vec_id, part, any_value(x) AS x, CAST(min(d * 256 + b) % 256 AS BIGINT) AS b, min(d) AS d
  FROM (SELECT vec_id, p.part, x, b, CAST(list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c) AS BIGINT) AS d FROM p JOIN c{k} c ON p.part = c.part)
  GROUP BY vec_id, part
), m{k} AS (
  SELECT part, b, list(CAST(floor(s / n) AS DOUBLE) ORDER BY j) AS c
  FROM (SELECT part, b, j, sum(x) AS s, count(*) AS n FROM (SELECT part, b, unnest(x) AS x, unnest(range(1, len(x) + 1)) AS j FROM a{k}) GROUP BY part, b, j) GROUP BY part, b
), c{k + 1} AS MATERIALIZED (
  SELECT c.part, c.b, coalesce(m.c, c.c) AS c FROM c{k} c LEFT JOIN m{k} m ON c.part = m.part AND c.b = m.b
),"""


OP11 = f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT vec_id, part, v[part * (len(v) // 4) + 1:(part + 1) * (len(v) // 4)] AS x FROM v, range(0, 4) r(part)
), c0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS b, x AS c FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 256)
),{"".join(_lloyd_sql(k) for k in range(5))} h AS (
  SELECT sha256(string_agg(CAST(CAST(c AS BIGINT) AS VARCHAR), ',' ORDER BY part, b, j)) AS h FROM (SELECT part, b, unnest(c) AS c, unnest(range(1, len(c) + 1)) AS j FROM c4)
), e AS (
  SELECT vec_id, string_agg(printf('%02x', b), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM e JOIN v USING (vec_id), h
"""


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP12 = r"""
WITH t AS (
  SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(n, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(0, 256) r(n))
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), g AS (
  SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark
), e AS (
  SELECT doc_id, unnest(w) AS w FROM d
), u AS MATERIALIZED (
  SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(x) // 2), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS b
  FROM (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM e UNION SELECT w FROM g)), t
), s AS (
  SELECT b, count(*) AS s FROM e JOIN u USING (w) GROUP BY b
), z AS (
  SELECT b, count(*) AS t FROM g JOIN u USING (w) GROUP BY b
), k AS (
  SELECT b, floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * ((SELECT sum(s) FROM s) + 10000) / ((CAST(s AS DOUBLE) + 1) * ((SELECT coalesce(sum(t), 0) FROM z) + 10000)))) AS gain FROM s LEFT JOIN z USING (b)
), x AS (
  SELECT doc_id, sum(gain) AS weight FROM e JOIN u USING (w) JOIN k USING (b) GROUP BY doc_id
), y AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || doc_id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN x USING (doc_id)
), r AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () * 10 // 100 AS most FROM y WHERE n_features >= 20
)
SELECT y.*, CASE WHEN r <= most THEN r END AS rank FROM y LEFT JOIN r USING (doc_id)
"""


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


_QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_source_mix": op2_source_mix,
    "op3_license_scan": op3_license_scan,
    "op4_chat_repair": op4_chat_repair,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_quality_rules": op6_quality_rules,
    "op7_warc_audit": op7_warc_audit,
    "op8_one_bit_neighbours": op8_one_bit_neighbours,
    "op9_token_counts": op9_token_counts,
    "op10_simhash_bktree": op10_simhash_bktree,
    "op11_vector_codes": op11_vector_codes,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_jaccard_join": op13_jaccard_join,
}
_ORACLES = {
    "op1_substring_dedup": OP1,
    "op2_source_mix": OP2,
    "op3_license_scan": OP3,
    "op6_quality_rules": OP6,
    "op8_one_bit_neighbours": OP8,
    "op11_vector_codes": OP11,
    "op12_importance_resampling": OP12,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
