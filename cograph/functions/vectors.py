"""Vectors as arrays: norm, cosine, one-hot, hashing embedding, hybrid vector (ARR-*, VEC-1..3)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from cograph.functions import constants as C


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalise(v: Column) -> Column:
    """Length 1; a zero vector stays as it is."""
    # The norm is the only element of an array, so that it is found once and not again for each component.
    scaled = F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))
    return F.element_at(scaled, 1)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def one_hot(value: Column, order: Iterable[str]) -> Column:
    return F.transform(F.array(*map(F.lit, order)), lambda c: F.when(c == value, 1.0).otherwise(0.0))


class Embedder(Protocol):
    """Turns texts into unit vectors; models are plugged in here."""

    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Signed feature hashing of words, brought to length 1: no model, no network, the same everywhere."""

    def __init__(self, dim: int = C.EMBED_DIM):
        self.dim, self._known = dim, {}

    def _place(self, word: str) -> tuple[int, float]:
        if word not in self._known:
            if len(self._known) > 500_000:
                self._known.clear()
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            self._known[word] = ((h >> 1) % self.dim, 1.0 if h & 1 else -1.0)
        return self._known[word]

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for row, text in zip(out, texts):
            for word in (text or "").lower().split():
                at, sign = self._place(word)
                row[at] += sign
            size = np.linalg.norm(row)
            if size:
                row /= size
        return out


class ModelEmbedder:
    """A text-embedding model by an optional library (fastembed), loaded once a worker; vectors are brought to length 1."""

    _loaded: dict[str, object] = {}

    def __init__(self, name: str = "BAAI/bge-small-en", dim: int = C.EMBED_DIM, batch: int = 64):
        self.name, self.dim, self.batch = name, dim, batch

    def embed(self, texts: list[str]) -> np.ndarray:
        if self.name not in self._loaded:
            from fastembed import TextEmbedding

            self._loaded[self.name] = TextEmbedding(model_name=self.name)
        found = list(self._loaded[self.name].embed([t or "" for t in texts], batch_size=self.batch))
        out = np.asarray(found, dtype=np.float32).reshape(len(texts), -1)
        if texts and out.shape[1] != self.dim:
            raise ValueError(f"{self.name} has {out.shape[1]} dimensions, not {self.dim}")
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, size, out=np.zeros_like(out), where=size > 0)


def embedding(text: Column, embedder: Embedder | None = None) -> Column:
    model = embedder or HashEmbedder()

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(model.embed(texts.tolist())))

    return embed(text)


def hybrid(text_vector: Column, graph_vector: Column, whole: bool = False) -> Column:
    """Text and graph parts one after another, the graph part at length 1; `whole`: the result at length 1 too."""
    out = F.concat(F.transform(text_vector, lambda x: x.cast("double")), normalise(graph_vector))
    return normalise(out) if whole else out
