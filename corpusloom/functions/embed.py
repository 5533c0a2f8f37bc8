"""Embedding providers. The built-in one hashes words into a term-frequency vector, so SQL can check its results."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.sources.extract import sanitize

DIMENSION = 1024
#: Texts and tokens of a batch, and the tokens that a text counts at most.
SEQUENCES, BUDGET, CAPPED = 16, 2048, 2000
_CACHE = 300_000


class Embedder(Protocol):
    """Made in each worker. embed() returns a row per text, or raises RuntimeError; tokens(), where there is one, counts a
    text's tokens, else words count."""

    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class _Buckets(dict):
    """The buckets of words in UTF-8, by md5 of the lower-case word."""

    def __init__(self, dimension: int) -> None:
        self.dimension = dimension

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        lower = word.decode("utf-8", "surrogatepass").lower().encode()
        found = self[word] = int.from_bytes(hashlib.md5(lower).digest()[:4]) % self.dimension
        return found


class HashedWords:
    """Counts of words by md5 bucket."""

    def __init__(self, dimension: int = DIMENSION) -> None:
        self.dimension = dimension
        self._buckets = _Buckets(dimension)

    def embed(self, texts: list[str]) -> np.ndarray:
        words = [_words(t) for t in texts]
        sizes = list(map(len, words))
        places = np.fromiter(map(self._buckets.__getitem__, chain.from_iterable(words)), np.int64, sum(sizes))
        at = np.repeat(np.arange(len(texts)) * self.dimension, sizes) + places
        return np.bincount(at, minlength=len(texts) * self.dimension).reshape(len(texts), self.dimension).astype(float)


def _words(text: str | None) -> list[bytes]:
    """In UTF-8, where white space is what the C locale has."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows over their lengths; a row of length at most 1e-12 stays as it is."""
    n = np.sqrt((vectors.astype(float) ** 2).sum(1, keepdims=True))
    return np.where(n > 1e-12, vectors / np.where(n > 1e-12, n, 1), vectors)


def by_budget(sizes: list[int]) -> Iterator[list[int]]:
    """Places of texts in batches, shortest first: at most SEQUENCES of them, and BUDGET tokens, of which a text counts
    CAPPED at most. Texts without tokens are in none."""
    batch: list[int] = []
    used = 0
    for i in sorted((i for i, n in enumerate(sizes) if n > 0), key=lambda i: (sizes[i], i)):
        n = min(sizes[i], CAPPED)
        if batch and (len(batch) == SEQUENCES or used + n > BUDGET):
            yield batch
            batch, used = [], 0
        batch.append(i)
        used += n
    if batch:
        yield batch


def embedded(provider: Embedder, texts: list[str]) -> np.ndarray:
    """Unit vectors of texts. A batch that fails is halved until the texts that fail are alone; those, and blank texts, have
    zero vectors."""
    out = np.zeros((len(texts), provider.dimension), np.float32)
    count = getattr(provider, "tokens", lambda text: len(_words(text)))
    todo = list(by_budget([count(t) for t in texts]))
    while todo:
        some = todo.pop()
        try:
            out[some] = unit(provider.embed([texts[i] for i in some]))
        except RuntimeError:
            if len(some) > 1:
                todo += [some[: len(some) // 2], some[len(some) // 2 :]]
    return out


def embed_column(text: Column, make=HashedWords, dimension: int = DIMENSION) -> Column:
    """Unit vectors of texts as array<float>. `make(dimension)` builds the provider once per worker, and gets texts in batches
    by a budget of tokens. Blank texts and those that it fails on have zero vectors; a provider of another width raises."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        provider = make(dimension)
        if provider.dimension != dimension:
            raise ValueError(f"the provider has {provider.dimension} dimensions, the index {dimension}")
        for part in parts:
            texts = [sanitize(t.encode("utf-8", "surrogatepass")) if t else "" for t in part]
            yield pd.Series(list(embedded(provider, texts)), dtype=object)

    return run(text)
