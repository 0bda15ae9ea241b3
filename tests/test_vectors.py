"""The histogram embedder beside brute force, on texts longer than any prefix; vectors known by their text."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.functions.vectors import Histogram
from heddle.operators import embedding as E


def test_histogram_counts_the_whole_text(spark):
    texts = ["a", "", None, "a" * 400 + "b" * 4000, "ab\n" * 7000 + "漢é" * 500, "x" * 399 + "yz"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r["embedding"] for r in E.embedded(rows, "id", Histogram()).collect()}
    assert got.keys() == {k for k, t in enumerate(texts) if t}
    for k, v in got.items():
        counts = Counter(ord(c) % 8 for c in texts[k])
        norm = math.sqrt(sum(n * n for n in counts.values()))
        assert all(math.isclose(x, counts[b] / norm, abs_tol=1e-12) for b, x in enumerate(v)) and len(v) == 8


def test_unknown_texts_once(spark):
    texts = spark.createDataFrame([(1, "h1", "one"), (2, "h1", "one"), (3, "h2", "two"), (4, "h3", ""), (5, "h4", "four")], "id long, hash string, text string").repartition(3)
    known = spark.createDataFrame([("h2", [1.0])], "hash string, embedding array<double>")
    assert sorted(map(tuple, E.unknown(texts, known).collect())) == [("h1", "one"), ("h4", "four")]


def batches(wrong=None):
    class Batches:
        """Defined here, so that it travels to the tasks by value."""

        signature, dimension = "test", 2

        def embed(self, texts):
            if len(texts) > E.BATCH:
                raise ValueError("too many at once")
            out = np.ones((len(texts), 2))
            if wrong == "width":
                return out[:, :1]
            if wrong == "number":
                return out[1:]
            if wrong == "nan":
                out[0] = float("nan")
            if wrong == "failure":
                raise OSError("the model is away")
            return out

    return Batches()


def test_batches_are_whole_or_nothing(spark):
    rows = spark.range(100).select("id", F.concat(F.lit("text "), "id").alias("text")).repartition(2)
    assert E.embedded(rows, "id", batches()).count() == 100
    for wrong in ("width", "number", "nan", "failure"):
        with pytest.raises(Exception, match="embedder|model is away"):
            E.embedded(rows, "id", batches(wrong)).count()
