"""A corpus from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns a DataFrame that is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents:

1. quality rules: documents that a rule rejects go;
2. n-gram Jaccard join: of each class of near duplicates the smallest doc_id stays;
3. benchmark decontamination: documents with a hit go;
4. PII: spans are blanked out of the texts;
5. best-fit packing: the pieces of the documents with their sequences.

Nulls: a null text has no words, so it goes at stage 1. At stage 2 rows of one doc_id share their fate, and rows without
one are in no class, so they stay; of a class the smallest doc_id stays, so there are no ties. Repeated rows are judged
alike at the other stages. Texts are judged whole, however long, and cut only by the packing. Where nothing is labelled, or with one class
alone, the fixed rules of stage 1 decide; without benchmark items stage 3 keeps all. An empty table passes through as an
empty one. Extra columns of the documents are kept up to the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heddle.llm import blocks, decontaminate, jaccard_join, packing, pii, quality_rules


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_first(docs)


def _benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_rules", _quality),
    ("ngram_jaccard_join", _near_duplicates),
    ("benchmark_decontamination", _benchmark),
    ("pii", _personal_data),
    ("best_fit_packing", _packing),
]

#: The stages learn a model, find components and search for packings, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = blocks.saved(stage(spark, docs, sf_dir))
    return docs
