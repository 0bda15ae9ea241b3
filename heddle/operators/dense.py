"""Exact dense search (survey D2, C3, C8, G1): blocks of query vectors against all vectors.

Queries are packed into blocks of one width on the executors, vectors into batches. A block meets every batch of its
width; each task keeps the best k of each query, so what is shuffled is k rows for each query and task, not all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import DENSE_THRESHOLD
from ..plans.stored import stored
from .lexical import top

QUERY_BLOCK = 4096
BROADCAST_BLOCKS = 16  # of queries: 32 MB at 64 dimensions
PAIRS_AT_ONCE = 1 << 20
PACKED = "width int, kind string, ids binary, vectors binary"  # kind: of the ids, as NumPy names it


def _ids(column: pa.Array) -> np.ndarray:
    """Whole numbers, or else texts: both sort as they do in Spark."""
    if pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.array(column.to_pylist() or [""])[: len(column)]


def _packed(key: str):
    def of_batches(batches):
        for batch in batches:
            column = batch.column("embedding")
            size = pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
            ids, out = _ids(batch.column(key)), []
            for width in np.unique(size[size > 0]).tolist():
                rows = np.flatnonzero(size == width)
                flat = column.take(pa.array(rows)).flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
                out.append((width, ids.dtype.str, ids[rows].tobytes(), flat.tobytes()))
            schema = pa.schema([("width", pa.int32()), ("kind", pa.string()), ("ids", pa.binary()), ("vectors", pa.binary())])
            yield pa.RecordBatch.from_pydict({c: [x[k] for x in out] for k, c in enumerate(schema.names)}, schema=schema)

    return of_batches


class _Best:
    """The k best of each query of a block so far: higher scores to six digits, then smaller ids."""

    def __init__(self, k: int):
        self.k = k
        self.query, self.ids, self.score = np.zeros(0, np.int64), None, np.zeros(0)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        ids = ids if self.ids is None else np.concatenate([self.ids, ids])
        query, score = np.r_[self.query, query], np.r_[self.score, score]
        order = np.lexsort((ids, -np.round(score, 6), query))
        q = query[order]
        keep = order[np.arange(len(q)) - np.searchsorted(q, q) < self.k]
        self.query, self.ids, self.score = query[keep], ids[keep], score[keep]

    def least(self, n: int) -> np.ndarray:
        """The score that a newcomer must reach, for each query."""
        out = np.full(n, -1.0)
        count = np.bincount(self.query, minlength=n)
        full = np.flatnonzero(count >= self.k)
        out[full] = np.round(self.score, 6)[np.searchsorted(self.query, full, "right") - 1]
        return out


def _joined(batches):
    """The pairs of a block of queries and a pack of vectors that a join has brought together."""
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("width", "qids", "queries", "kind", "ids", "vectors")))


def _beside(asked):
    """The pairs of each block of queries that went to the tasks and each batch of vectors, packed here."""

    def of_batches(batches):
        for packed in _packed("chunk_id")(batches):
            for width, kind, ids, x in zip(*(packed.column(c).to_pylist() for c in ("width", "kind", "ids", "vectors"))):
                yield from ((width, qids, q, kind, ids, x) for w, qids, q in asked.value if w == width)

    return of_batches


def _nearest(k: int, threshold: float, pairs):
    def of_batches(batches):
        best: dict[bytes, _Best] = {}
        for width, qids, q, kind, ids, x in pairs(batches):
            q, x = (np.frombuffer(v).reshape(-1, width) for v in (q, x))
            own, ids = best.setdefault(qids, _Best(k)), np.frombuffer(ids, kind)
            norm = np.sqrt((q * q).sum(1))
            step = max(1, PAIRS_AT_ONCE // len(q))
            for a in range(0, len(x), step):
                y = x[a : a + step]
                length = np.sqrt((y * y).sum(1))[:, None] * norm
                s = np.maximum(0, np.divide(y @ q.T, length, out=np.zeros_like(length), where=length > 0))
                rounded, least = np.round(s, 6), own.least(len(q))
                if len(y) > k:
                    least = np.maximum(least, np.partition(rounded, len(y) - k, axis=0)[len(y) - k])
                row, query = np.nonzero((rounded >= least) & (s >= threshold))
                own.add(query, ids[a + row], s[row, query])
        for qids, found in best.items():
            if found.ids is not None and len(found.ids):
                yield pa.RecordBatch.from_pydict({"qid": np.frombuffer(qids, np.int64)[found.query], "chunk_id": pa.array(found.ids.tolist()), "dense": found.score})

    return of_batches


def nearest(vectors: DataFrame, queries: DataFrame, k: int, threshold: float = DENSE_THRESHOLD) -> DataFrame:
    """qid, chunk_id, dense, rank of the k nearest vectors (chunk_id, embedding) of each query (qid, embedding), among those of its width. qids are whole numbers, chunk_ids may be texts. Null and empty vectors take no part."""
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = queries.where("size(embedding) > 0").select("qid", "embedding")
    asked = stored(asked)
    blocks = -(-max(1, asked.count()) // QUERY_BLOCK)
    # each task packs its rows batch by batch, so dealing by number keeps blocks bounded and about even
    asked = stored(asked.repartition(blocks, "qid").mapInArrow(_packed("qid"), PACKED).select("width", F.col("ids").alias("qids"), F.col("vectors").alias("queries")))
    held = vectors.where("size(embedding) > 0").select("chunk_id", "embedding")
    kind = vectors.schema["chunk_id"].dataType.simpleString()
    kind = "string" if kind == "string" else "bigint"
    schema = f"qid long, chunk_id {kind}, dense double"
    if blocks <= BROADCAST_BLOCKS:  # a task holds the blocks once, and one batch of vectors
        few = spark.sparkContext.broadcast([(r["width"], bytes(r["qids"]), bytes(r["queries"])) for r in asked.collect()])
        found = held.mapInArrow(_nearest(k, threshold, _beside(few)), schema)
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("salt")
        packs = held.mapInArrow(_packed("chunk_id"), PACKED).withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int"))
        pairs = packs.join(asked.select("*", salts), ["width", "salt"]).select("width", "qids", "queries", "kind", "ids", "vectors")
        found = pairs.mapInArrow(_nearest(k, threshold, _joined), schema)
    return top(found, "dense", k, "chunk_id")
