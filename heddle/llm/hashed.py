"""Hashed word and character n-gram features, and linear models over them.

A text's features are the frequencies of its hashed word 1- and 2-grams and character 3- and 4-grams (over
UTF-8 bytes), each family summing to one. A linear score is then the mean weight of each family's n-grams,
which needs no feature vector: weights are looked up n-gram by n-gram and averaged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import saved
from .textarrays import U64, Words, ngram_hashes, slices, space_split_table

BITS = 18
RUN = 1 << 19  # features that are multiplied at a time
SAMPLE_BYTES = 24 << 20  # of texts in a sample
_TABLE = space_split_table()
_BYTE = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


def families(words: Words):
    """(feature numbers, first position of each text, end position) of each family of n-grams."""
    h = words.hashes()
    n = np.diff(words.off)
    shift = U64(64 - BITS)
    yield (h >> shift).astype(np.int32), words.off[:-1], words.off[1:]
    yield (ngram_hashes(h, 2, salt=7) >> shift).astype(np.int32), words.off[:-1], np.where(n >= 2, words.off[1:] - 1, words.off[:-1])
    b, off = words.buf.astype(np.uint32), words.doc_off
    size = np.diff(off)
    for k in (3, 4):
        m = max(0, len(b) - k + 1)
        x = np.zeros(m, np.uint32)
        for j in range(k):
            x += (b[j : j + m] + np.uint32(k)) * np.uint32(_BYTE[j])
            x ^= x >> np.uint32(15)
        x *= np.uint32(0x2545F491)
        yield (x >> np.uint32(32 - BITS)).astype(np.int32), off[:-1], np.where(size >= k, off[1:] - (k - 1), off[:-1])


def raw_scores(words: Words, weights: np.ndarray) -> np.ndarray:
    """Sum over the families of the mean weight of a text's n-grams."""
    out = np.zeros(len(words.off) - 1)
    for feature, a, b in families(words):
        total = np.zeros(len(feature) + 1)
        np.cumsum(weights[feature], out=total[1:])
        out += (total[b] - total[a]) / np.maximum(1, b - a)
    return out


def as_bytes(weights: np.ndarray, slope: float, offset: float) -> bytes:
    return np.r_[weights, slope, offset].astype(np.float32).tobytes()


def probabilities(words: Words, model: bytes | None, default: float) -> np.ndarray:
    """Calibrated scores of the texts; the default without a model."""
    if model is None:
        return np.full(len(words.off) - 1, default)
    w = np.frombuffer(model, np.float32)
    return sigmoid(raw_scores(words, w[:-2]) * float(w[-2]) + float(w[-1]))


def fitted(rows: DataFrame, limit: int, fit) -> bytes | None:
    """What `fit` makes of a bounded sample of rows (label, part, text): it gets a `Sample` and gives bytes, or None.

    The sample is at most `limit` rows, the first by the hash of their texts, so that it is the same each time, and of
    these the ones that begin within `SAMPLE_BYTES` of text, whatever their length. It is chosen by hash and size alone;
    only then are the chosen texts gathered and learnt from, in one task on an executor; the driver gets the bytes.
    """
    rows = saved(rows.select("label", "part", F.xxhash64("text", "part", "label").alias("at"), F.octet_length("text").cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row"), "text"))
    few = rows.select("at", "row", "bytes").orderBy("at", "row").limit(limit)  # rows with the same hash are equal
    before = F.sum("bytes").over(Window.orderBy("at", "row").rowsBetween(Window.unboundedPreceding, -1))  # over `limit` rows at most
    chosen = few.withColumn("before", before).where(F.coalesce("before", F.lit(0)) < SAMPLE_BYTES).select("row")
    texts = rows.join(F.broadcast(chosen), "row").select("label", "part", "at", "text")
    got = texts.groupBy(F.lit(0).alias("all")).applyInArrow(lambda t: pa.table({"model": pa.array([fit(Sample(t))], pa.binary())}), "model binary").collect()
    return got[0]["model"] if got else None


class Sample:
    """Feature vectors of a bounded number of texts, in the order of their hashes."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([("at", "ascending"), ("label", "ascending")])
        self.label, self.part = (table[c].to_numpy() for c in ("label", "part"))
        keys, values, size = [], [], []
        for a, b, buf, off in slices(table["text"]):
            fam = list(families(Words(buf, off, _TABLE)))
            for d in range(b - a):
                found = [np.unique(f[s[d] : e[d]], return_counts=True) for f, s, e in fam]
                keys.append(np.concatenate([u for u, _ in found]).astype(np.int32))
                values.append(np.concatenate([c / max(1, c.sum()) for _, c in found]).astype(np.float32))
                size.append(len(keys[-1]))
        self.bounds = np.r_[0, np.cumsum(np.array(size, np.int64))]
        self.key = np.concatenate([np.zeros(0, np.int32), *keys])
        keys.clear()  # each copy goes before the next is made
        self.value = np.concatenate([np.zeros(0, np.float32), *values])

    def only(self, rows: np.ndarray) -> Sample:
        """The rows where the mask is set."""
        out = object.__new__(Sample)
        out.label, out.part = self.label[rows], self.part[rows]
        size = np.diff(self.bounds)
        out.bounds = np.r_[0, np.cumsum(size[rows])]
        each = np.repeat(rows, size)
        out.key, out.value = self.key[each], self.value[each]
        return out

    def __len__(self) -> int:
        return len(self.label)

    def _runs(self):
        """Rows a to b, some at a time, so that what a step allocates does not grow with the sample."""
        a = 0
        while a < len(self):
            b = max(a + 1, int(np.searchsorted(self.bounds, self.bounds[a] + RUN, "right")) - 1)
            yield a, b, self.bounds[a], self.bounds[b], np.repeat(np.arange(b - a), np.diff(self.bounds[a : b + 1]))
            a = b

    def score(self, weights: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0), *[np.bincount(row, self.value[s:e] * weights[self.key[s:e]], minlength=b - a) for a, b, s, e, row in self._runs()]])

    def gradient(self, by_row: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << BITS)
        for a, b, s, e, row in self._runs():
            out += np.bincount(self.key[s:e], self.value[s:e] * by_row[a:b][row], minlength=1 << BITS)
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Adam:
    """Full-batch steps for the weights and the bias."""

    def __init__(self, rate: float = 0.5):
        self.rate, self.t = rate, 0
        self.w = np.zeros((1 << BITS) + 1)
        self.m, self.v = np.zeros_like(self.w), np.zeros_like(self.w)

    def step(self, g: np.ndarray) -> None:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.99 * self.v + 0.01 * g * g
        self.w -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-8)


def platt(raw: np.ndarray, label: np.ndarray, steps: int = 40) -> tuple[float, float]:
    """Slope and offset that turn raw scores into probabilities: Newton steps on smoothed targets."""
    pos, neg = (label == 1).sum(), (label != 1).sum()
    target = np.where(label == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * raw + b)
        r, w = p - target, p * (1 - p) + 1e-9
        g = np.array([(r * raw).sum() + 1e-3 * (a - 1), r.sum()])
        h = np.array([[(w * raw * raw).sum() + 1e-3, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        d *= min(1.0, 2.0 / max(1e-12, np.abs(d).max()))
        a, b = a - d[0], b - d[1]
        if np.abs(d).max() < 1e-7:
            break
    return float(a), float(b)
