"""Caller-supplied functions as columns: tokenizers and observers."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
MAX_TOKENS, MAX_TOKEN_BYTES = 100_000, 4_000_000


def tokenizer(encode: Callable[[str], list]):
    """An Arrow UDF to array<string> from a function that gives ids or strings. Booleans, other types and too many raise.

    A token says what it was: `i:1` for the number and `s:1` for the string, so that the two are never equal.
    """

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else checked(encode(t)))

    return run


def checked(tokens: list) -> list[str]:
    if not isinstance(tokens, list) or any(type(t) not in (int, str) for t in tokens):
        raise TypeError("a tokenizer gives a list of int or str")
    if len(tokens) > MAX_TOKENS or sum(len(str(t).encode()) for t in tokens) > MAX_TOKEN_BYTES:
        raise ValueError("tokenizer output exceeds limit")
    return [f"{type(t).__name__[0]}:{t}" for t in tokens]


def tiktoken(name: str):
    """By encoding name, loaded once in a worker when first used."""

    def encode(text: str) -> list:
        import tiktoken as library

        return library.get_encoding(name).encode(text)

    return tokenizer(encode)


def sentencepiece(path: str):
    def encode(text: str) -> list:
        if path not in _PROCESSORS:
            import sentencepiece as library

            _PROCESSORS[path] = library.SentencePieceProcessor(model_file=path)
        return _PROCESSORS[path].encode(text)

    return tokenizer(encode)


_PROCESSORS: dict = {}


def model_views(docs: DataFrame, of, machine: Column, human: Column) -> DataFrame:
    """doc_id, machine_tokens, human_tokens, equal, token_count_delta; null where a view is."""
    rows = docs.select("doc_id", of(machine).alias("machine_tokens"), of(human).alias("human_tokens"))
    return rows.withColumns({"equal": F.col("machine_tokens") == F.col("human_tokens"), "token_count_delta": F.array_size("machine_tokens") - F.array_size("human_tokens")})


def behaviour(rows: DataFrame) -> DataFrame:
    """rows: doc_id, machine_response, human_response. Answers that differ depend on context; equal ones are nothing."""
    return rows.withColumn("materiality", F.when(F.col("machine_response") == F.col("human_response"), "none").otherwise("context-dependent"))
