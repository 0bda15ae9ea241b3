"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled quality 1; all other text is unlabelled web text. The model is a
linear score of hashed n-grams that minimises the non-negative unbiased risk: the positives' loss weighted by
the class prior, plus the unlabelled texts' negative loss less the positives' share in it, which is held at
zero or more (when it falls below, the step goes the other way).

The class prior of the web text is estimated from scores alone: a first model tells positives from web text, and
on rows kept apart the prior is at most the ratio of the web text's share above a score to the positives', at
whatever score; the least ratio counts, with a margin for the size of the samples.

A last step calibrates the scores to probabilities (Platt) on labelled rows that no model was fitted to: labelled rows
are dealt to fitting and to calibration, and the web text is drawn from neither the calibration's rows nor the positives.

Rows whose crc32(doc_id as text) mod 5 is 0 are held out: neither their labels nor their texts are learnt
from. Samples are bounded by `POSITIVES`, `UNLABELLED` and `CALIBRATION` rows and `hashed.SAMPLE_BYTES` of text (see
`hashed.fitted`), taken by hash, texts of any length alike, and are learnt from in one task; every document is scored.

Nulls: a null text scores as an empty one, by the bias alone; a null doc_id counts as the empty string for the
fold. Without positive training labels or web text the score is the labels' share of 1, 0.5 without labels.
Repeated rows are scored each for itself; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import hashed as H
from .quality_rules import labelled
from .textarrays import Words, slices, space_split_table

POSITIVES, UNLABELLED, CALIBRATION = 2000, 4000, 2000
FOLDS = 5
THRESHOLD = 0.3
STEPS = 80
_TABLE = space_split_table()


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS == 0


def class_prior(positive: np.ndarray, web: np.ndarray) -> float:
    """Estimated share of positives in the web text, by scores of rows kept apart: the least ratio of the shares above a score, with a margin."""
    if not len(positive) or not len(web):
        return 0.5
    at = np.unique(positive)
    above_p = 1 - np.searchsorted(np.sort(positive), at, "left") / len(positive)
    above_w = 1 - np.searchsorted(np.sort(web), at, "left") / len(web)
    margin = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(web)))
    use = above_p > 2 * margin
    if not use.any():
        return 0.5
    best = np.argmin((above_w[use] + margin) / above_p[use])
    return float(np.clip(above_w[use][best] / above_p[use][best], 0.05, 0.95))


def pu_risk(sp: np.ndarray, su: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray, bool]:
    """The non-negative risk of the scores of positives and web texts, the derivatives to follow by score, and whether the negative part is at zero or more. Below zero it counts as zero and the step leads away from it."""
    # logistic loss: of the positive class log(1+e^-s), of the negative class log(1+e^s)
    positive = prior * np.logaddexp(0, -sp).mean()
    negative = np.logaddexp(0, su).mean() - prior * np.logaddexp(0, sp).mean()
    p_plus, p_minus, u_minus = (H.sigmoid(sp) - 1) / len(sp), H.sigmoid(sp) / len(sp), H.sigmoid(su) / len(su)
    if negative >= 0:
        return positive + negative, prior * (p_plus - p_minus), u_minus, True
    return positive, prior * p_minus, -u_minus, False


def pu_weights(positive: H.Sample, unlabelled: H.Sample, prior: float, steps: int = STEPS) -> np.ndarray:
    """Weights and bias that minimise the non-negative risk."""
    adam = H.Adam()
    for _ in range(steps):
        _, rp, ru, _ = pu_risk(positive.score(adam.w) + adam.w[-1], unlabelled.score(adam.w) + adam.w[-1], prior)
        adam.step(np.r_[positive.gradient(rp) + unlabelled.gradient(ru), rp.sum() + ru.sum()] + 1e-6 * adam.w)
    return adam.w


def _fit(sample: H.Sample) -> bytes | None:
    """label: 1 positive, 0 web text, 2 and 3 labelled 0 and 1 for the calibration. part 0 is kept apart for the prior."""
    aside = sample.part == 0
    positive, web = (sample.only((sample.label == k) & ~aside) for k in (1, 0))
    if not len(positive) or not len(web):
        return None
    first = pu_weights(positive, web, 0.5, steps=20)
    prior = class_prior(*(sample.only((sample.label == k) & aside).score(first) for k in (1, 0)))
    w = pu_weights(positive, web, prior)
    known = sample.only(sample.label >= 2)
    a, b = H.platt(known.score(w) + w[-1], known.label - 2)
    return H.as_bytes(w[:-1], a, b + a * float(w[-1]))


def train(docs: DataFrame, labels: DataFrame) -> tuple[bytes | None, float]:
    """The model, and the score to give if there is none."""
    B.small_batches(docs.sparkSession)
    fold = ~held_out()
    row = labels.where(fold).where("quality IN (0, 1)").agg(F.count("*").alias("n"), F.sum("quality").alias("k")).first()
    if not row["n"]:
        return None, 0.5
    # labels are dealt to fitting and to calibration by hash of their doc_id, so a document serves one of them
    role = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(3))
    positive = labelled(docs, labels.where("quality = 1"), POSITIVES, fold & (role > 0))
    known = labelled(docs, labels, CALIBRATION, fold & (role == 0)).withColumn("label", F.col("label") + 2)
    used = labels.where(fold & ((role == 0) | (F.col("quality") == 1))).where("quality IN (0, 1)").select("doc_id")
    few = docs.where(fold).select("doc_id").join(used, "doc_id", "left_anti").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(UNLABELLED).distinct()
    web = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select(F.lit(0).alias("label"), F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(5)).cast("int").alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return H.fitted(positive.unionByName(known).unionByName(web), POSITIVES + UNLABELLED + CALIBRATION, _fit), (row["k"] + 1) / (row["n"] + 2)


def _scored(model):
    def of_batches(batches):
        for batch in batches:
            for a, b, buf, off in slices(batch.column("text")):
                score = H.probabilities(Words(buf, off, _TABLE), *model.value)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(score)], names=["doc_id", "score"])

    return of_batches


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score) of every document: the probability that its label would be 1."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scored(model), "doc_id long, score double")


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return scores(docs, labels).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
