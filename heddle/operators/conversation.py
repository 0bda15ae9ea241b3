"""Chat history (survey F7, F8, I19, I25, L12): trimming, references to earlier turns, calibration of token estimates."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

MESSAGES, BUDGET = 12, 600
SHORT, RESOLVED = 24, 300
PRONOUN = r"(?i)(这个|那个|它|上述|前面|刚才|\b(it|its|this|that|these|those|they|them|above|previous)\b)"
KEEP, LOW, HIGH, LEAST_TOKENS = 0.7, 0.25, 4.0, 50


def trimmed(messages: DataFrame, most: int = MESSAGES, budget: int = BUDGET) -> DataFrame:
    """Of each conversation (conv_id, turn, role, text) the last messages within the budget, from a user's turn on. A last message that is too long for it alone stays if it is a user's."""
    newest = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    rows = messages.withColumn("age", F.row_number().over(newest)).where(F.col("age") <= most).withColumn("tokens", T.message_tokens(F.col("text")))
    rows = rows.withColumn("held", F.sum("tokens").over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    opens = F.when((F.col("role") == "user") & ((F.col("held") <= budget) | (F.col("age") == 1)), F.col("turn"))
    rows = rows.withColumn("first", F.min(opens).over(Window.partitionBy("conv_id")))
    return rows.where(F.col("turn") >= F.col("first")).drop("age", "first")


def resolved(messages: DataFrame) -> DataFrame:
    """User turns with the user's turn before, and the query that results: a short one, or one that points back, gets that turn in front."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = messages.where("role = 'user'").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("before", before)
    back = F.col("before").isNotNull() & ((F.length("text") <= SHORT) | F.col("text").rlike(PRONOUN))
    return rows.withColumn("resolved", F.when(back, F.substring(F.concat_ws("\n", "before", "text"), 1, RESOLVED)).otherwise(F.col("text")))


def _fold(batches):
    """Keys come sorted, so what is kept between batches is one key's factor."""
    key, factor = None, 1.0
    for batch in batches:
        out = []
        for k, estimate, actual in zip(*(batch.column(c).to_pylist() for c in ("key", "estimate", "actual"))):
            if k != key:
                key, factor = k, 1.0
            if estimate is not None and actual is not None and estimate >= LEAST_TOKENS:
                factor = min(HIGH, max(LOW, KEEP * factor + (1 - KEEP) * min(HIGH, max(LOW, actual / estimate))))
            out.append(factor)
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("seq"), pa.array(out, pa.float64())], names=["key", "seq", "factor"])


def calibrated(usage: DataFrame) -> DataFrame:
    """(key, seq, factor) after each observation (key, seq, estimate, actual): a moving average in the order of seq."""
    rows = usage.select("key", F.col("seq").cast("long").alias("seq"), F.col("estimate").cast("double").alias("estimate"), F.col("actual").cast("double").alias("actual"))
    return rows.repartition("key").sortWithinPartitions("key", "seq").mapInArrow(_fold, "key long, seq long, factor double")
