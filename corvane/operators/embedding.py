"""Texts to vectors, by any model that maps a list of texts to a list of vectors."""

from __future__ import annotations

import hashlib
import math
import re
import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import constants as C

#: A model: called with a list of texts, gives as many vectors. It is sent to the workers, so it should load what is large on first use.
Embedder = Callable[[list[str]], list[list[float]]]


class HashEmbedder:
    """A model without weights: words are hashed to signed places of a unit vector, so that texts that share words are near."""

    def __init__(self, dimension: int = C.EMBEDDING_DIM):
        self.dimension = dimension

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        out = [0.0] * self.dimension
        for word in re.findall(r"\w+", text.lower()):
            value = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
            out[value % self.dimension] += 1.0 if value >> 63 else -1.0
        length = math.sqrt(sum(x * x for x in out))
        return [x / length for x in out] if length else out


class Lazy:
    """A model that is loaded by load() when it is first asked something, once for each process; warm_up() does it ahead of time."""

    def __init__(self, load: Callable[[], Embedder]):
        self.load, self._model, self._lock = load, None, threading.Lock()

    def warm_up(self) -> Embedder:
        with self._lock:  # two threads don't load it both
            if self._model is None:
                self._model = self.load()
            return self._model

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return (self._model or self.warm_up())(texts)

    def __reduce__(self):
        return Lazy, (self.load,)  # sent without what was loaded


def checked(vectors: list[list[float]], texts: int, dimension: int | None) -> list[list[float]]:
    """The vectors, if there are as many as texts and all have the dimension; ValueError else."""
    if len(vectors) != texts:
        raise ValueError(f"{len(vectors)} vectors for {texts} texts")
    wrong = {len(v) for v in vectors} - {dimension}
    if dimension is not None and wrong:
        raise ValueError(f"vectors of {sorted(wrong)} numbers, {dimension} expected")
    return [[float(x) for x in v] for v in vectors]


def embedded(text: Column, model: Embedder, dimension: int | None = C.EMBEDDING_DIM, batch: int = C.EMBEDDING_BATCH) -> Column:
    """The vectors of a column of texts (array<float>), `batch` texts at a time; null texts count as empty."""

    @F.pandas_udf("array<float>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            own, out = texts.fillna("").tolist(), []
            for a in range(0, len(own), batch):
                part = own[a : a + batch]
                out += checked(model(part), len(part), dimension)
            yield pd.Series(out, index=texts.index, dtype=object)

    return run(text)


def model_reranker(model: Callable[[str, list[str]], list[float]], batch: int = C.FUSED) -> Callable[[str, Column], Column]:
    """What a search takes as its reranker, from a model that scores a list of texts for a query."""

    def rerank(query: str, text: Column) -> Column:
        @F.pandas_udf("double")
        def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in series:
                own, out = texts.fillna("").tolist(), []
                for a in range(0, len(own), batch):
                    out += [float(x) for x in model(query, own[a : a + batch])]
                yield pd.Series(out, index=texts.index)

        return run(text)

    return rerank
