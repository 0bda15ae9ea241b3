"""The gate before retrieval, and what is left without vectors (survey C7, C9, J22, J24, L10).

A question is admitted if its knowledge base is ready at the revision that it was prepared for and the newest state of the
sources proves them unchanged for that revision; else it is refused with the reason. Admitted questions are searched by
both branches; where the index is of another model, or the model can't embed the questions, by words alone, and a
diagnostic row says so.
"""

from __future__ import annotations

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.stored import stored
from . import control as N
from . import lexical as L
from . import retrieval as R
from .published import Knowledge

DIAGNOSTIC = "kind string, component string, message string"


def newest(states: DataFrame) -> DataFrame:
    """(kb, fresh_revision, fresh, fresh_reason): of each knowledge base the last of its states (kb, epoch, seq, state, reason); an epoch is a revision. What came last counts, a timer's state (seq null) after the events before it."""
    last = F.max_by(F.struct("epoch", "state", "reason"), F.struct("epoch", "generation", F.col("seq").isNull().alias("timer"), "seq"))
    return states.groupBy("kb").agg(last.alias("s")).select("kb", F.col("s.epoch").alias("fresh_revision"), F.col("s.state").alias("fresh"), F.col("s.reason").alias("fresh_reason"))


def admitted(questions: DataFrame, control: DataFrame, states: DataFrame) -> DataFrame:
    """The questions (qid, kb, revision, query), of a table or a stream, with admitted and refusal. control: (kb, status, published, source_revision); states as `freshness.watched` tells them."""
    rows = questions.withColumn("kb", N.key(F.col("kb"))).join(control.withColumn("kb", N.key(F.col("kb"))), "kb", "left").join(newest(states.withColumn("kb", N.key(F.col("kb")))), "kb", "left")
    fresh = F.when(F.col("fresh_revision") == F.col("source_revision"), F.col("fresh"))
    ready = N.ready(F.col("status"), F.col("published"), F.col("source_revision"), F.col("revision"), fresh)
    why = (
        F.when(ready, F.lit(None).cast("string"))
        .when(F.col("status").isNull(), "no such knowledge base")
        .when((F.col("status") != "READY") | ~F.col("published").eqNullSafe(F.col("source_revision")), F.concat(F.lit("the index is "), "status"))
        .when(F.col("revision") != F.col("source_revision"), "the question is of another revision")
        .when(fresh.isNull(), "the sources haven't been checked")
        .otherwise(F.coalesce("fresh_reason", F.lower("fresh")))
    )
    return rows.select(*questions.columns, ready.alias("admitted"), why.alias("refusal"))


def answered(kb: Knowledge, questions: DataFrame, limit: int = 10) -> tuple[DataFrame, DataFrame]:
    """Results of the admitted questions (as `retrieval.search`, with semantic_available), and diagnostics (DIAGNOSTIC): one for each refused question, and one if vectors couldn't be used."""
    spark, notes = questions.sparkSession, []
    refused = questions.where("NOT admitted").select(F.lit("refused").alias("kind"), F.lit("gate").alias("component"), T.redact(F.concat("kb", F.lit(": "), "refusal")).alias("message"))
    asked, loaded = L.analysed(questions.where("admitted").select("qid", "query")), kb.load()
    empty = spark.createDataFrame([], "qid long, rank int, chunk_id string, path string, file_name string, score double, reason string, semantic_available boolean")
    if loaded is None:
        return empty, refused.unionByName(spark.createDataFrame([("missing", "index", "no revision is published")], DIAGNOSTIC))
    vectors = None
    if loaded.model != kb.embedder.signature:
        kb.store.mark_incompatible("the vectors are of another model")
        notes.append(("vector fallback", "retrieval", "the vectors are of another model"))
    else:
        try:
            vectors = stored(R.embedded_queries(asked, kb.embedder))
        except (OSError, PySparkException, Py4JError) as failure:  # the search goes on without the model
            notes.append(("vector fallback", "retrieval", type(failure).__name__))
    usable = vectors is not None
    none = spark.createDataFrame([], "qid long, embedding array<double>")
    found = R.search(loaded.index, asked, "RRF_RERANK" if usable else "RRF", limit, asked=vectors if usable else none)
    return found.withColumn("semantic_available", F.lit(usable)), refused.unionByName(spark.createDataFrame(notes, DIAGNOSTIC))
