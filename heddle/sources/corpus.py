"""The driver's tables as chunks of a knowledge base (survey §1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.stored import small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one chunk: chunk_id, path, file_name, extension, start_line, end_line, source_location, content."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    content = F.coalesce(F.col("text"), F.lit(""))
    lines = F.size(F.split(content, "\n"))
    return docs.select(
        F.col("doc_id").alias("chunk_id"),
        F.concat(F.lit("/kb/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("path"),
        F.concat(F.col("doc_id").cast("string"), F.lit("."), "lang").alias("file_name"),
        F.col("lang").alias("extension"),
        F.lit(1).alias("start_line"),
        lines.alias("end_line"),
        F.concat(F.lit("L1-"), lines.cast("string")).alias("source_location"),
        content.alias("content"),
    )


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item as a query: qid, query."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.coalesce("text", F.lit("")).alias("query"))


def indexed_text() -> F.Column:
    """What is indexed and embedded of a chunk: its file name, its location and its content."""
    return F.concat_ws("\n", "file_name", "source_location", "content")
