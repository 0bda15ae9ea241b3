"""Blocks of documents and buckets of hashes: how operators exchange hashes without a row for each.

Documents are dealt to blocks by doc_id. A block sends one packed row to each bucket of hashes; a bucket
answers with one packed row to each block. A hash that stands in many documents of a block is sent once, so
a group holds a value at most once for each block, however many documents share it.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCKS_PER_PARTITION = 1  # a block sends a row to each bucket, so fewer and larger blocks mean fewer rows
ROWS_PER_BATCH = 1000
BLOCK_BYTES = 16 << 20  # of texts in a block, by and large
NO_ID = np.iinfo(np.int64).max  # stands for a null doc_id: later than any other


def block_count(spark: SparkSession) -> int:
    """Blocks, and buckets: in proportion to the session's shuffle partitions, which follow the input's size."""
    return BLOCKS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blocks_for(spark: SparkSession, held: int) -> int:
    """Blocks, and buckets, for so many bytes of texts: as many as the session has shuffle partitions, or more, so that what a task holds of a block doesn't grow with the table where their number doesn't follow it."""
    return max(partitions(spark), -(-held // BLOCK_BYTES))


def small_batches(spark: SparkSession) -> None:
    """Texts may be long, so batches to Python hold fewer rows than by default."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ROWS_PER_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def in_blocks(docs: DataFrame) -> DataFrame:
    """(block, id, text) of the documents with a text, dealt by block; id is doc_id, or NO_ID if that is null. The text takes part in the deal, so that a doc_id with many rows isn't one block."""
    n = block_count(docs.sparkSession)
    return docs.where("text <> ''").select(
        F.pmod(F.xxhash64("doc_id", F.col("text").cast("string")), F.lit(n)).cast("int").alias("block"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID))).alias("id"),
        F.col("text").cast("string").alias("text"),
    ).repartition(partitions(docs.sparkSession), "block")


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return (h >> np.uint64(33)) % np.uint64(n)


def sorted_find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in a sorted table, or -1. A bitmap turns most misses away."""
    out = np.full(len(keys), -1, np.int64)
    if not len(table) or not len(keys):
        return out
    bits = max(10, min(24, int(np.log2(len(table))) + 4))
    seen = np.zeros(1 << bits, bool)
    seen[(table & np.uint64((1 << bits) - 1)).astype(np.int64)] = True
    may = np.flatnonzero(seen[(keys & np.uint64((1 << bits) - 1)).astype(np.int64)])
    at = np.minimum(np.searchsorted(table, keys[may]), len(table) - 1)
    hit = table[at] == keys[may]
    out[may[hit]] = at[hit]
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in spark.checkpoint.dir or the session's checkpoint directory. Where none is set, a local session gets a folder of its own; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="heddle-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """The frame written to the shared folder as Parquet and read again: computed once, and safe from lost executors."""
    path = f"{shared_dir(df.sparkSession)}/heddle-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
