"""Small tables beside the index (survey C9, D16, E16, F10, G6, H4, I22, J16): as joins, windows and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEPT_EVENTS, PREVIEW_LINES, PREVIEW_CHARS = 300, 20_000, 400_000


def owner_root(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """paths (path, ...) with the longest root (root) that is the path or one of its folders; null if none is. Paths meet roots by equality with their own folders, so no pair is tried in vain."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    met = paths.select("path").distinct().select("path", F.explode(above).alias("root")).join(roots.select("root").distinct(), "root")
    best = met.groupBy("path").agg(F.max_by("root", F.length("root")).alias("owner"))
    return paths.join(best, "path", "left")


def source_sync(requested: DataFrame, existing: DataFrame) -> DataFrame:
    """(source, action): what to add and what to remove."""
    new, old = requested.select("source").distinct().withColumn("new", F.lit(True)), existing.select("source").distinct().withColumn("old", F.lit(True))
    both = new.join(old, "source", "full_outer").where("new IS NULL OR old IS NULL")
    return both.select("source", F.when(F.col("new").isNull(), "remove").otherwise("add").alias("action"))


def newest(events: DataFrame, key: str, order: str, most: int = KEPT_EVENTS) -> DataFrame:
    """The newest events of each key: what a ring buffer of that size holds."""
    over = Window.partitionBy(key).orderBy(F.col(order).desc())
    return events.withColumn("_n", F.row_number().over(over)).where(F.col("_n") <= most).drop("_n")


def usage_total(usage: DataFrame, *by: str) -> DataFrame:
    """Sums of prompt and completion tokens; what is unknown adds nothing, and a sum of unknowns alone is unknown."""
    return usage.groupBy(*by).agg(F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"))


def key(text: Column) -> Column:
    """Trimmed and lower case; null is empty."""
    return F.lower(F.trim(F.coalesce(text, F.lit(""))))


def ready(status: Column, published: Column, revision: Column, expected: Column, freshness: Column) -> Column:
    """Whether a knowledge base may be asked: its present revision is published, expected and verified."""
    return F.coalesce((status == "READY") & (published == revision) & (revision == expected) & (freshness == "VERIFIED"), F.lit(False))


def listed(entries: DataFrame) -> DataFrame:
    """entries (folder, name, is_folder) with their position in the folder: folders first, then by name whatever the case."""
    return entries.withColumn("position", F.row_number().over(Window.partitionBy("folder").orderBy(F.col("is_folder").desc(), F.lower("name"), "name")))


def preview(texts: DataFrame, name: str = "doc_id") -> DataFrame:
    """(name, number, line) of the lines to show of each text: the first ones, up to a number of lines and of characters, which is what a preview is."""
    lines = texts.select(name, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("k", "line")).where(F.col("k") < PREVIEW_LINES)
    upto = Window.partitionBy(name).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("chars", F.sum(F.length("line") + 1).over(upto)).where(F.col("chars") <= PREVIEW_CHARS).select(name, (F.col("k") + 1).alias("number"), "line")
