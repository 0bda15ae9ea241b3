"""BM25's best chunks, scored where their terms lie (survey E6, G1).

The terms of a chunk stand in one row, so a chunk's scores for all queries are sums within that row. The queries' tokens
go to the tasks; each task keeps the best k of each query, so what is shuffled is k rows for each query and task, not all
pairs of a query and a chunk. A batch is scored some rows at a time, so a task's memory is bounded by `CELLS` and its batch.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lexical as L
from .lexical import K1, B

CELLS = 1 << 18  # pairs of a chunk and a query that are scored at a time
WEIGHTS = 200_000  # weights of queries' tokens that go to the tasks at a time; with more, stored postings are joined and the sums shuffled
NAMES = ("file_name", "source_location", "path")


class _Asked:
    """The queries' weights by token: those of a token stand together."""

    def __init__(self, rows: pa.Table):
        self.qids, query = np.unique(rows["qid"].to_numpy(), return_inverse=True)
        self.tokens = pa.compute.unique(rows["token"])
        token = pa.compute.index_in(rows["token"], value_set=self.tokens).to_numpy()
        order = np.argsort(token, kind="stable")
        self.query, self.gain = query[order], rows["gain"].to_numpy()[order]
        self.first = np.searchsorted(token[order], np.arange(len(self.tokens) + 1))


class _Best:
    """The k best rows of each query so far: higher scores to six digits, then names and ids, nulls first."""

    def __init__(self, k: int, queries: int):
        self.k, self.least = k, np.zeros(queries)
        self.query, self.score, self.rows = np.zeros(0, np.int64), np.zeros(0), None

    def add(self, query: np.ndarray, score: np.ndarray, rows: pa.Table) -> None:
        self.query, self.score = np.r_[self.query, query], np.r_[self.score, score]
        self.rows = rows if self.rows is None else pa.concat_tables([self.rows, rows])
        keys = pa.table({"query": self.query, "score": -np.round(self.score, 6), **{c: self.rows[c] for c in (*NAMES[:2], "chunk_id")}})
        order = pa.compute.sort_indices(keys, [(c, "ascending") for c in keys.column_names], null_placement="at_start").to_numpy()
        q = self.query[order]
        keep = order[np.arange(len(q)) - np.searchsorted(q, q) < self.k]
        self.query, self.score, self.rows = self.query[keep], self.score[keep], self.rows.take(pa.array(keep)).combine_chunks()
        full = np.flatnonzero(np.bincount(self.query, minlength=len(self.least)) >= self.k)
        self.least[full] = np.round(self.score, 6)[np.searchsorted(self.query, full, "right") - 1]


def _scores(asked: _Asked, token: np.ndarray, weight: np.ndarray, row: np.ndarray, length: np.ndarray, average: float) -> np.ndarray:
    """Scores of each row for each query, by the rows' tokens that some query asks for."""
    share = weight * (K1 + 1) / (weight + K1 * (1 - B + B * length[row] / average))
    many = asked.first[token + 1] - asked.first[token]
    at = np.repeat(asked.first[token] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
    cell = np.repeat(row * len(asked.qids), many) + asked.query[at]
    return np.bincount(cell, asked.gain[at] * np.repeat(share, many), minlength=len(length) * len(asked.qids)).reshape(len(length), -1)


def _kept(weights, k: int, average: float):
    def of_batches(batches):
        asked = _Asked(pa.ipc.open_stream(weights.value).read_all())
        n = len(asked.qids)
        best, step = _Best(k, n), max(1, CELLS // max(1, n))
        for batch in batches:
            held = batch.column("terms")
            bounds = held.offsets.to_numpy().astype(np.int64)
            flat = held.values
            token = pa.compute.index_in(flat.field("token"), value_set=asked.tokens).fill_null(-1).to_numpy(zero_copy_only=False)
            weight, length = flat.field("weight").to_numpy(zero_copy_only=False), batch.column("length").to_numpy()
            rows = pa.Table.from_batches([batch.select(["chunk_id", *NAMES])])
            for a in range(0, batch.num_rows, step):
                b = min(a + step, batch.num_rows)
                at = bounds[a] + np.flatnonzero(token[bounds[a] : bounds[b]] >= 0)
                if not len(at):
                    continue
                score = _scores(asked, token[at], weight[at], np.searchsorted(bounds[a : b + 1], at, "right") - 1, length[a:b], average)
                rounded, least = np.round(score, 6), best.least
                if b - a > k:
                    least = np.maximum(least, np.partition(rounded, b - a - k, axis=0)[b - a - k])
                row, query = np.nonzero((rounded >= least) & (score > 0))
                if len(row):
                    best.add(query, score[row, query], rows.take(pa.array(a + row)))
        if best.rows is not None:
            yield pa.RecordBatch.from_arrays([pa.array(asked.qids[best.query]), pa.array(best.score), *[pa.concat_arrays(best.rows[c].chunks) for c in ("chunk_id", *NAMES)]], names=["qid", "bm25", "chunk_id", *NAMES])

    return of_batches


def best(index: L.Index, queries: DataFrame, k: int, extension: str | None = None) -> DataFrame:
    """qid, bm25, chunk_id, file_name, source_location, path of the k best chunks of each analysed query at least. qids are whole numbers."""
    weights = L.weighed(index, L.query_terms(queries))
    passes = max(1, -(-weights.count() // WEIGHTS))
    if passes > 1 and index.by_token:
        found = L.scored(index, weights, extension).where("bm25 > 0")
        return found.join(index.chunks.select("chunk_id", *NAMES), "chunk_id").select("qid", "bm25", "chunk_id", *NAMES)
    parts = [_found(index, weights.where(F.pmod(F.xxhash64("qid"), F.lit(passes)) == p), k, extension) for p in range(passes)]
    return reduce(DataFrame.unionByName, parts)


def _found(index: L.Index, weights: DataFrame, k: int, extension: str | None) -> DataFrame:
    spark = weights.sparkSession
    few = weights.select(F.col("qid").cast("long").alias("qid"), "token", "gain").orderBy("token", "qid").toArrow()
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, few.schema) as writer:
        writer.write_table(few)
    average = index.corpus.first()["avg_length"]
    rows = index.terms.where(L.extension_filter(extension)).select("chunk_id", "length", "terms", *NAMES)
    kind = rows.schema["chunk_id"].dataType.simpleString()
    held = spark.sparkContext.broadcast(out.getvalue().to_pybytes())
    return rows.mapInArrow(_kept(held, k, average), f"qid long, bm25 double, chunk_id {kind}, {', '.join(f'{c} string' for c in NAMES)}")
