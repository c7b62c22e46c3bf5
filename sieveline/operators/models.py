"""Where models plug in: batch scorers over Arrow, or tables of precomputed outputs. No model is loaded here."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import critique


def generate(df: DataFrame, prompt: str, backend: Callable[[pd.Series], pd.Series] | DataFrame, output: str = "response") -> DataFrame:
    """df with a response for each prompt. backend: a function of a batch of prompts, or a table (prompt, output)."""
    if isinstance(backend, DataFrame):
        return df.join(backend.select(prompt, output), prompt, "left")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{output}` string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf[output] = backend(pdf[prompt])
            yield pdf

    return df.mapInPandas(run, schema)


def generate_in_batches(df: DataFrame, prompt: str, backend: Callable[[list[str]], list[str]], batch_size: int = 32, attempts: int = 3, output: str = "response", pause: float = 0.0) -> DataFrame:
    """df with a response for each prompt, and an error where there is none.

    backend gets batch_size prompts at most and returns as many responses. A batch that raises, or gives another number,
    is tried again (attempts in all, with growing pauses); if that doesn't help, its prompts are tried one by one, so that
    one bad prompt costs no other its response. Null prompts aren't sent: they have neither response nor error.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{output}` string", "error string"])

    def ask(prompts: list[str]) -> list[str]:
        for attempt in range(attempts):
            try:
                said = list(backend(prompts))
                if len(said) != len(prompts):
                    raise ValueError(f"{len(said)} responses to {len(prompts)} prompts")
                return said
            except Exception:
                if attempt + 1 == attempts:
                    raise
                time.sleep(pause * 2**attempt)
        return []

    def answered(prompts: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            return [(x, None) for x in ask(prompts)]
        except Exception as e:  # noqa: BLE001  what a backend raises is a result here
            if len(prompts) == 1:
                return [(None, str(e) or type(e).__name__)]
            return [answered([p])[0] for p in prompts]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            there = [i for i, p in enumerate(pdf[prompt]) if p is not None]
            out: list[tuple[str | None, str | None]] = [(None, None)] * len(pdf)
            for k in range(0, len(there), batch_size):
                some = there[k : k + batch_size]
                for i, x in zip(some, answered([pdf[prompt].iat[i] for i in some])):
                    out[i] = x
            yield pdf.assign(**{output: [x for x, _ in out], "error": [e for _, e in out]})

    return df.mapInPandas(run, schema)


def label_logps(df: DataFrame, prompt: str, backend: Callable[[pd.Series], pd.DataFrame]) -> DataFrame:
    """df with logp_a and logp_b from a function of a batch of prompts."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "logp_a double", "logp_b double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            scores = backend(pdf[prompt])
            yield pdf.assign(logp_a=scores["logp_a"].to_numpy(), logp_b=scores["logp_b"].to_numpy())

    return df.mapInPandas(run, schema)


def judged(df: DataFrame, logp_a: Column, logp_b: Column, threshold: float = 1.0, name: str = "verdict") -> DataFrame:
    return df.withColumn(name, critique([logp_a], [logp_b], threshold))


def token_counts(df: DataFrame, text: str, count: Callable[[str], int], name: str = "n_tokens") -> DataFrame:
    """df with exact token counts from any tokenizer; nulls have none. count may be made in the worker: a callable object
    that loads its files when it is first called."""

    @F.pandas_udf("long")
    def counted(x: pd.Series) -> pd.Series:
        return x.map(lambda t: count(t) if t is not None else 0)

    return df.withColumn(name, counted(text))


class LocalTokenizer:
    """Ids of whole texts by a tokenizer's file, which each worker loads once. Special strings inside texts count as the
    library's default has them; none are added."""

    def __init__(self, path: str):
        self.path, self.loaded = path, None

    def __getstate__(self):
        return {"path": self.path, "loaded": None}

    def ids(self, text: str) -> list[int]:
        if self.loaded is None:
            from tokenizers import Tokenizer

            self.loaded = Tokenizer.from_file(self.path)
            self.loaded.no_truncation()
            self.loaded.no_padding()
        return self.loaded.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> int:
        return len(self.ids(text))


def token_ids(df: DataFrame, text: str, ids: Callable[[str], list[int]], name: str = "ids") -> DataFrame:
    """df with the token ids of whole texts from any tokenizer; nulls have none."""

    @F.pandas_udf("array<int>")
    def made(x: pd.Series) -> pd.Series:
        return x.map(lambda t: ids(t) if t is not None else [])

    return df.withColumn(name, made(text))


def evaluate(responses: DataFrame, score: Column) -> DataFrame:
    """Long rows (model, ..., response) with success and reason from a scorer."""
    return responses.withColumn("_s", score).select("*", "_s.*").drop("_s")
