"""Incremental index planning and the state of files (survey A8, A10, A11, D5, D6, E15, J5, J7, J15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRINT = ("root", "relative_path", "size", "modified_at", "content_hash")
KEY = ["root", "relative_path"]


def fingerprints(files: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """files (root, relative_path, size, modified_at, content) with content_hash; a hash known from before is taken over where size and time are the same."""
    own = F.sha2("content", 256)
    if before is None:
        return files.withColumn("content_hash", own).drop("content")
    known = before.select(*KEY, F.col("size").alias("_size"), F.col("modified_at").alias("_time"), F.col("content_hash").alias("_hash"))
    same = (F.col("_size") == F.col("size")) & (F.col("_time") == F.col("modified_at"))
    return files.join(known, KEY, "left").withColumn("content_hash", F.when(same, F.col("_hash")).otherwise(own)).drop("content", "_size", "_time", "_hash")


def plan(entries: DataFrame, files: DataFrame, chunking_version: int, compatible: bool = True) -> DataFrame:
    """(root, relative_path, action): reused if all of the fingerprint, reader and versions agree, else modified; added and deleted on one side only."""
    parts = ("size", "modified_at", "content_hash", "reader_id", "reader_version")
    old = entries.select(*KEY, *[F.col(c).alias(f"old_{c}") for c in (*parts, "chunking_version")], F.lit(True).alias("was"))
    new = files.select(*KEY, *parts, F.lit(True).alias("is"))
    same = F.lit(compatible) & (F.col("old_chunking_version") == chunking_version)
    for c in parts:
        same = same & F.col(c).eqNullSafe(F.col(f"old_{c}"))
    action = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "deleted").when(same, "reused").otherwise("modified")
    return old.join(new, KEY, "full_outer").select(*KEY, action.alias("action"))


def reusable(entries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(root, relative_path, whole) of entries (…, chunk_ids): whole if none of their chunks is missing."""
    ids = entries.select(*KEY, F.explode_outer("chunk_ids").alias("id"))
    found = ids.join(chunks.select("id", F.lit(True).alias("found")).distinct(), "id", "left")
    return found.groupBy(*KEY).agg(F.bool_and(F.col("id").isNull() | F.col("found").isNotNull()).alias("whole"))


def set_hash(files: DataFrame, *by: str) -> DataFrame:
    """One hash of all (relative_path, size, modified_at) of each `by`. Files are hashed, gathered by the first three digits, and the 4096 bundles hashed again, so no task holds all names."""
    own = F.sha2(F.concat_ws("\0", "relative_path", F.col("size").cast("string"), F.col("modified_at").cast("string")), 256)
    bundle = files.select(*by, own.alias("h")).groupBy(*by, F.substring("h", 1, 3).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"), F.count("*").alias("n"))
    return bundle.groupBy(*by).agg(F.sum("n").alias("files"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ""), 256).alias("set_hash"))


def unsupported(files: DataFrame, supported: list[str]) -> DataFrame:
    """One row: how many files no reader takes, and the six commonest extensions among them."""
    counts = files.where(~F.lower("extension").isin(*supported)).groupBy("extension").count()
    top = counts.orderBy(F.col("count").desc(), "extension").limit(6)
    listed = top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("c"), "extension"))), lambda x: F.concat_ws(" ", x["extension"], -x["c"])), ", ").alias("listed"))
    return counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("skipped")).crossJoin(F.broadcast(listed))


def file_state(policy: Column, supported: Column, oversized: Column, known: Column, present: Column, same: Column) -> Column:
    return F.when(~present, "DELETED").when(policy, "IGNORED").when(~supported, "UNSUPPORTED").when(oversized, "OVERSIZED").when(~known, "NOT_INDEXED").when(same, "INDEXED").otherwise("MODIFIED")


def descendants(files: DataFrame) -> DataFrame:
    """(folder, n): files below each folder of the paths."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    return files.select(F.explode(above).alias("folder")).where("folder <> ''").groupBy("folder").agg(F.count("*").alias("n"))
