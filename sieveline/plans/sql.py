"""Fragments of DuckDB SQL for oracles. They are written from the rules, not from the Spark expressions."""

from __future__ import annotations

from collections.abc import Sequence


def quoted(x: str) -> str:
    parts = x.split("\n")
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in parts)


def has(x: str, *phrases: str) -> str:
    return "(" + " OR ".join(f"contains({x}, {quoted(p)})" for p in phrases) + ")"


def starts(x: str, *prefixes: str) -> str:
    return "(" + " OR ".join(f"starts_with({x}, {quoted(p)})" for p in prefixes) + ")"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def norm(x: str) -> str:
    return f"lower({strip(x)})"


def words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


def n_words(x: str) -> str:
    return f"len({words(x)})"


def count(x: str, piece: str) -> str:
    return f"((length({x}) - length(replace({x}, {quoted(piece)}, ''))) // {len(piece)})"


def n_named(x: str, names: Sequence[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, {quoted(n)}) AS INT)" for n in names) + ")"


Rule = tuple[str, bool, "str | tuple[str, ...]"]


def verdict(rules: Sequence[Rule], otherwise: tuple[bool, str]) -> str:
    """'+reason' or '-reason' of the first rule that holds. A reason in parts has SQL in every second one."""

    def sign(ok: bool, why: str | tuple[str, ...]) -> str:
        mark = "+" if ok else "-"
        if isinstance(why, str):
            return quoted(mark + why)
        return " || ".join([quoted(mark), *(f"CAST({p} AS VARCHAR)" if i % 2 else quoted(p) for i, p in enumerate(why))])

    if not rules:
        return sign(*otherwise)
    return "CASE " + " ".join(f"WHEN {c} THEN {sign(ok, why)}" for c, ok, why in rules) + f" ELSE {sign(*otherwise)} END"


def typed(kind: str, cases: dict[str, str], otherwise: str) -> str:
    return f"CASE {kind} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in cases.items()) + f" ELSE {otherwise} END"


def unless(bad: Sequence[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {quoted('-' + why)}" for c, why in bad) + f" ELSE {otherwise} END"


def points(steps: Sequence[tuple[str, float]], otherwise: float) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN CAST({v} AS DOUBLE)" for c, v in steps) + f" ELSE CAST({otherwise} AS DOUBLE) END"


def scored(view: str, verdict_sql: str, keys: str = "doc_id") -> str:
    return f"SELECT {keys}, v[1] = '+' AS success, v[2:] AS reason FROM (SELECT *, {verdict_sql} AS v FROM ({view}))"


def draw_key(key: str, seed: int) -> str:
    return f"md5('{seed}:' || CAST({key} AS VARCHAR))"


def unit(key: str, seed: int) -> str:
    return f"(CAST(('0x' || substr({draw_key(key, seed)}, 1, 8)) AS BIGINT) / 4294967296.0)"


def wilson(k: str, n: str, z: float = 1.959963984540054) -> tuple[str, str]:
    center = f"(({k}) / {n} + {z * z} / (2.0 * {n})) / (1 + {z * z} / {n})"
    margin = f"{z} * sqrt(({k}) * 1.0 / {n} * (1 - ({k}) * 1.0 / {n}) / {n} + {z * z} / (4.0 * {n} * {n})) / (1 + {z * z} / {n})"
    return f"CASE WHEN {n} > 0 THEN greatest(0.0, {center} - {margin}) ELSE 0.0 END", f"CASE WHEN {n} > 0 THEN least(1.0, {center} + {margin}) ELSE 0.0 END"


def chi2_p(x: str) -> str:
    """erfc(sqrt(x / 2)) by the series of erf."""
    z = f"sqrt({x} / 2.0)"
    terms = f"list_transform(range(0, 150), lambda n: exp(n * ln(2.0 * {x} / 2.0 + 1e-300) - list_sum(list_transform(range(0, n + 1), lambda j: ln(2.0 * j + 1)))))"
    return f"(CASE WHEN {x} <= 0 THEN 1.0 ELSE 1 - 2 / sqrt(pi()) * exp(-{x} / 2.0) * {z} * list_sum({terms}) END)"


def binomial_p(n01: str, n10: str) -> str:
    """least(1, 2 P(X <= k)) for a fair coin."""
    n, k = f"({n01} + {n10})", f"least({n01}, {n10})"
    term = f"exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) - {n} * ln(2))"
    return f"least(1.0, 2 * list_sum(list_transform(range(0, CAST({k} AS BIGINT) + 1), lambda i: {term})))"
