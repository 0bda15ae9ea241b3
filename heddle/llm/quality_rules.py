"""Quality rules: fixed text rules, then a hashed n-gram logistic regression with calibrated probabilities.

The regression is trained on labelled quality rows, `TRAIN_ROWS` of them at most (and those of them that begin within
`hashed.SAMPLE_BYTES` of text, see `hashed.fitted`; texts of any length alike), taken by the hash of their doc_id, in one task on an executor; a fifth of these is kept apart to calibrate
the probabilities (Platt). Every document is scored in Arrow batches by its whole text and kept if its probability
is `KEEP` or more and no fixed rule fails.

Nulls: a null text has no words, so it fails the word-count rule; labels with a null id or quality are not
used. With no labelled rows, or one class alone, the probability is 1 and the fixed rules decide. Repeated
rows are judged each for itself. An empty table gives no rows. Extra columns are ignored; `keep_good` returns
the columns it is given.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import hashed as H
from .textarrays import U64, Words, mix, ngram_hashes, slices, space_split_table, span_hashes

TRAIN_ROWS = 3000
KEEP = 0.5
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words
STEPS = 60
_TABLE = space_split_table()
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_DOC = U64(0xA0761D6478BD642F)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _again(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions sorted by (text, key) without regard to order among them, and whether each equals the one before."""
    own = mix(keys + doc.astype(U64) * _DOC)
    order = np.argsort(own, kind="stable")
    s = own[order]
    same = np.zeros(len(s), bool)
    same[1:] = s[1:] == s[:-1]
    return order, same


def measures(words: Words) -> dict[str, np.ndarray]:
    """The figures that the fixed rules use, of each text."""
    buf, off, n = words.buf, words.doc_off, len(words.off) - 1
    inside = np.r_[0, np.cumsum(_TABLE[buf])]
    points = np.r_[0, np.cumsum(_TABLE[buf] & ((buf & 0xC0) != 0x80))]
    symbols = np.r_[0, np.cumsum(_SYMBOL[buf])]
    out = {"n_words": words.counts(), "word_chars": np.diff(points[off]), "n_symbols": np.diff(symbols[off])}
    feed = np.flatnonzero(buf == 10)
    starts = np.sort(np.r_[off[:-1], feed + 1])
    of = np.r_[np.arange(n), np.searchsorted(off, feed, "right") - 1]
    ends = np.sort(np.r_[off[1:], feed])
    of = np.sort(of)  # lines stand in the order of their texts, as starts and ends do
    full = inside[ends] > inside[starts]
    starts, ends, of = starts[full], ends[full], of[full]
    order, same = _again(span_hashes(buf, starts, ends), of)
    out["n_dup_lines"] = np.bincount(of[order[same]], minlength=n)
    at = np.flatnonzero(words.left() >= 3)
    doc = words.doc()
    order, same = _again(ngram_hashes(words.hashes(), 3)[at] if len(at) else np.zeros(0, U64), doc[at])
    twice = same.copy()
    twice[:-1] |= same[1:]
    edge = np.zeros(len(words) + 4, np.int64)
    hit = at[order[twice]]
    edge[: len(words)] += np.bincount(hit, minlength=len(words))
    edge[3:] -= np.bincount(hit, minlength=len(words) + 1)[: len(words) + 1]
    out["n_repeat_words"] = np.diff(np.r_[0, np.cumsum(np.cumsum(edge)[: len(words)] > 0)][words.off])
    return {k: v.astype(np.int64) for k, v in out.items()}


def labelled(docs: DataFrame, labels: DataFrame, rows: int, where=None) -> DataFrame:
    """(label, part, text) of the documents of `rows` labels, those whose doc_id hashes lowest. part: 0 to 4 by another hash, to keep some apart."""
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)")
    if where is not None:
        known = known.where(where)
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)).cast("int"))
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("label", "part", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _fit(sample: H.Sample) -> bytes | None:
    """Weights, slope and offset, of which the last two are the end of the bytes."""
    y, aside = (sample.label == 1).astype(float), sample.part == 0
    if len(set(y[~aside])) < 2:
        return None
    weight = np.where(y == 1, 0.5 / y[~aside].mean(), 0.5 / (1 - y[~aside].mean())) * ~aside / (~aside).sum()
    adam = H.Adam()
    for _ in range(STEPS):
        r = (H.sigmoid(sample.score(adam.w) + adam.w[-1]) - y) * weight
        adam.step(np.r_[sample.gradient(r), r.sum()] + 1e-6 * adam.w)
    a, b = H.platt(sample.score(adam.w)[aside] + adam.w[-1], y[aside])
    return H.as_bytes(adam.w[:-1], a, b + a * float(adam.w[-1]))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> bytes | None:
    """The calibrated regression; None if the labels hold one class or none."""
    B.small_batches(docs.sparkSession)
    return H.fitted(labelled(docs, labels, rows), rows, _fit)


def _scored(model):
    def of_batches(batches):
        for batch in batches:
            for a, b, buf, off in slices(batch.column("text")):
                words = Words(buf, off, _TABLE)
                out = measures(words)
                out["probability"] = H.probabilities(words, model.value, 1.0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *[pa.array(x) for x in out.values()]], names=["doc_id", *out])

    return of_batches


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, the measures, probability, base_failed, kept) of every document."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(docs, labels))
    schema = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES) + ", probability double"
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scored(model), schema)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= KEEP))


def _good(model):
    def of_batches(batches):
        for batch in batches:
            keep = []
            for _, _, buf, off in slices(batch.column("text")):
                words = Words(buf, off, _TABLE)
                m, p = measures(words), H.probabilities(words, model.value, 1.0)
                keep.append((m["n_words"] >= LEAST_WORDS) & (100 * m["n_repeat_words"] <= MOST_REPEATED * m["n_words"]) & (p >= KEEP))
            yield batch.filter(pa.array(np.concatenate([np.zeros(0, bool), *keep])))

    return of_batches


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that no rule rejects, with all their columns. They pass through in one scan: no join is needed."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return docs.mapInArrow(_good(model), docs.schema)


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return verdicts(docs, labels).select("doc_id", *MEASURES, "base_failed", "kept", "probability")
