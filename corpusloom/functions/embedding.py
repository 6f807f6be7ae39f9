"""Embedding of texts by a pluggable provider, in Arrow batches."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.schema import LARGEST_DIMENSION

BATCH, ATTEMPTS = 32, 6
#: Put in front of a query, never of a document.
QUERY_PREFIX = "Instruct: Given a code search query, retrieve relevant source code snippets\nQuery:"


class RateLimited(Exception):
    """A provider's refusal; retry_after in seconds if it says so."""

    def __init__(self, retry_after: float | None = None) -> None:
        super().__init__("rate limited")
        self.retry_after = retry_after


def hash_provider(dim: int = 96) -> Callable[[list[str]], list[list[float]]]:
    """Deterministic vectors without a model: signed hashing of words, unit length."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = crc32(w.encode("utf-8", "replace"))
                out[i, h % dim] += 1 if h & 0x80000000 else -1
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()

    return embed


def with_retries(embed: Callable, texts: list[str], attempts: int = ATTEMPTS, sleep: Callable = time.sleep) -> list[list[float]]:
    if attempts < 1:
        raise ValueError("at least one attempt")
    for k in range(attempts):
        try:
            return embed(texts)
        except RateLimited as e:
            if k == attempts - 1:
                raise
            sleep(e.retry_after if e.retry_after is not None else min(60, 2 ** (k + 1)))
    raise AssertionError


def embedder(provider: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = BATCH) -> Callable[[Column], Column]:
    """A column function text -> array<float>; PROVIDER is called once a worker."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = provider()
        for s in parts:
            out: list = []
            texts = s.fillna("").tolist()
            for i in range(0, len(texts), batch):
                out += with_retries(embed, texts[i : i + batch])
            yield pd.Series([np.asarray(v, np.float32) for v in out])

    return run


def checked_dimension(provider: Callable[[], Callable]) -> int:
    """The provider's dimension; beyond what an index takes is an error."""
    dim = len(provider()(["probe"])[0])
    if dim > LARGEST_DIMENSION:
        raise ValueError(f"{dim} dimensions; at most {LARGEST_DIMENSION}")
    return dim


def query_vector(provider: Callable[[], Callable], query: str) -> list[float]:
    return [float(x) for x in provider()([QUERY_PREFIX + query])[0]]
