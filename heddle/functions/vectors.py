"""Dense vectors (survey rows I10, J23, C3, C8, 2.M): cosine, model signatures, and a deterministic embedder for tests and parity."""

from __future__ import annotations

from typing import Protocol

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

DENSE_THRESHOLD = 0.15
BUCKETS = 8


class Embedder(Protocol):
    """A text model. It travels to the tasks, so it must be picklable; `embed` is called there with a few texts at a time and gives a vector of `dimension` numbers for each."""

    signature: str
    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Histogram:
    """Counts of a text's characters by code mod 8, scaled to length 1."""

    dimension = BUCKETS

    def __init__(self):
        self.signature = signature("histogram", "code-mod-8", "", self.dimension, "1")

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), BUCKETS))
        for k, t in enumerate(texts):
            out[k] = np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) % BUCKETS, minlength=BUCKETS)
        return out / np.maximum(1e-300, np.sqrt((out * out).sum(1)))[:, None]


def signature(provider: str, model: str, file_signature: str, dimension: int, version: str) -> str:
    """What tells two models apart: vectors of another signature can't be compared."""
    return ":".join((provider, model, file_signature, str(dimension), version))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm2(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ, a vector is empty or a norm is 0."""
    length = F.sqrt(norm2(a) * norm2(b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) <= 0) | (length == 0), F.lit(0.0)).otherwise(dot(a, b) / length)


def compatible(vectors: Column, dimension: int) -> Column:
    """An aggregate: true if every vector has the dimension."""
    return F.bool_and(F.coalesce(F.size(vectors) == dimension, F.lit(False)))
