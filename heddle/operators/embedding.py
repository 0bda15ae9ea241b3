"""Content-addressed vectors (survey J6, J7, J22, 2.M): a text is embedded once for each model, wherever and whenever it stands.

Vectors are known by the SHA-256 of their text. What a table of known vectors lacks is found by an anti-join of hashes;
only these texts go to the model, `BATCH` at a time in the tasks. A batch that fails, or gives a wrong number or width of
vectors, fails the job, so a build has all of its vectors or none. A text of no characters has no vector.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import Embedder

BATCH = 24


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def embedded(texts: DataFrame, key: str, embedder: Embedder) -> DataFrame:
    """(key, embedding) of the texts (key, text) that have characters."""

    def of_batches(batches):
        for batch in batches:
            texts, out = batch.column("text").to_pylist(), []
            for a in range(0, len(texts), BATCH):
                some = texts[a : a + BATCH]
                got = np.asarray(embedder.embed(some), dtype=float)
                if got.shape != (len(some), embedder.dimension) or not np.isfinite(got).all():
                    raise ValueError(f"the embedder gave an array of {got.shape} for {len(some)} texts of {embedder.dimension} dimensions, or numbers that aren't finite")
                out.append(got)
            flat = np.concatenate([np.zeros((0, embedder.dimension)), *out]).ravel()
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, embedder.dimension, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(key), vectors], names=[key, "embedding"])

    rows = texts.where(F.length("text") > 0).select(key, "text")
    return rows.mapInArrow(of_batches, f"{key} {rows.schema[key].dataType.simpleString()}, embedding array<double>")


def unknown(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(hash, text) of the texts (id, hash, text) whose hash the known vectors (hash, ...) lack, each hash once if ids are unique. Only hashes and ids are exchanged: no text is sorted or moved for that."""
    new = texts.where(F.length("text") > 0).groupBy("hash").agg(F.min("id").alias("id")).join(known.select("hash"), "hash", "left_anti")
    return texts.join(new.select("id"), "id", "left_semi").select("hash", "text")
