"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is a set of windows of `WINDOW` consecutive words (a shorter item is one window). A window
holds shingles of `SHINGLE` words; they are ordered by rarity, counted over all documents, rarest first. A
document can only contain a window if it has every shingle of it, so the necessary prefix is one token, the
rarest shingle: it is all that is joined. A match gives the window's place in the document by the token's
offset; places that would leave the document at either end are dropped, those whose hash over all words differs from
the window's are dropped, too, and the rest are verified by comparing the words themselves: a hit is exact.

The benchmark is taken in parts of about `PART_BYTES` of text. A part's index is bounded by that, and is
broadcast; the documents pass through `PARTS_AT_ONCE` parts one after the other in a single scan, without a shuffle.
Where there are more, what is found so far is written and the parts' indexes are dropped before the next ones are
made, so that neither the driver nor a task holds more than these, however large the benchmark is.

Nulls: a null text has no words, nor has an empty one; items with a null item_id are left out; items with the
same item_id count as one. An item's windows that repeat in other items count for each. A null doc_id is
returned as it is. Repeated rows are judged each for itself. An empty table gives no rows; without a benchmark nothing
is hit. Extra columns are ignored; `keep_clean` returns the columns it is given.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .textarrays import _STEP, U64, Words, alnum_table, lower_ascii, mix, ngram_hashes, slices

WINDOW = 10
SHINGLE = 3
PART_BYTES = 16 << 20
PARTS_AT_ONCE = 4
PAIRS_AT_ONCE = 1 << 16
_TABLE = alnum_table()


def _words(buf: np.ndarray, off: np.ndarray) -> Words:
    return Words(lower_ascii(buf), off, _TABLE)


def _window_hash(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    out = h[at].copy()
    for k in range(1, n):
        out = out * _STEP + h[at + k]
    return mix(out)


class Spans(NamedTuple):
    """Words as places in a buffer."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def same_words(a: Words | Spans, at: np.ndarray, b: Words | Spans, bt: np.ndarray, n: int) -> np.ndarray:
    """Whether the n words of `a` from each word `at` are those of `b` from the word `bt`."""
    out = np.ones(len(at), bool)
    for k in range(n):
        out &= a.ends[at + k] - a.starts[at + k] == b.ends[bt + k] - b.starts[bt + k]
    for k in range(n):
        rows = np.flatnonzero(out)
        for r in np.split(rows, range(PAIRS_AT_ONCE, len(rows), PAIRS_AT_ONCE)):
            if len(r):
                i, j = at[r] + k, bt[r] + k
                size = (a.ends[i] - a.starts[i]).astype(np.int64)
                first = np.cumsum(size) - size
                inner = np.arange(size.sum()) - np.repeat(first, size)
                differs = a.buf[np.repeat(a.starts[i], size) + inner] != b.buf[np.repeat(b.starts[j], size) + inner]
                out[r] = ~np.logical_or.reduceat(differs, first)
    return out


class Index:
    """Windows of a part of the benchmark: lengths, hashes, words, items; and for each its shingles, of which one will be its token."""

    def __init__(self, items: pa.Table):
        self.names = [str(x) for x in items["item_id"].to_pylist()]
        found, held, base, seen = [], [(np.zeros(0, np.uint8), np.zeros(0, np.int32), np.zeros(0, np.int32))], 0, 0
        for a, _, buf, off in slices(items["text"]):
            words = _words(buf, off)
            held.append((words.buf, (words.starts + base).astype(np.int32), (words.ends + base).astype(np.int32)))
            h, n, doc = words.hashes(), words.counts(), words.doc()
            size = np.minimum(n, WINDOW)[doc]
            at = np.flatnonzero(words.left() >= size)
            for length in np.unique(size[at]):
                s = at[size[at] == length]
                width = SHINGLE if length >= SHINGLE else 1
                shingles = np.zeros((len(s), WINDOW), U64)
                for k in range(length - width + 1):
                    shingles[:, k] = _window_hash(h, s + k, width)
                found.append((np.full(len(s), length), _window_hash(h, s, length), a + doc[s], seen + s, shingles))
            base, seen = base + len(words.buf), seen + len(words)
        self.words = Spans(*(np.concatenate(x) for x in zip(*held)))
        none = np.zeros(0, np.int64)
        length, whole, item, place, shingles = (np.concatenate(x) for x in zip(*found)) if found else (none, np.zeros(0, U64), none, none, np.zeros((0, WINDOW), U64))
        order = np.lexsort((item, whole, length))
        length, whole, item, place, shingles = length[order], whole[order], item[order], place[order], shingles[order]
        new = np.r_[True, (whole[1:] != whole[:-1]) | (length[1:] != length[:-1])][: len(whole)]
        for n in np.unique(length[~new]):
            k = np.flatnonzero(~new & (length == n))
            new[k] = ~same_words(self.words, place[k], self.words, place[k - 1], int(n))
        first = np.flatnonzero(new)
        self.length, self.whole, self.place, self.shingles = length[first], whole[first], place[first], shingles[first]
        self.items, self.item_off = item, np.r_[first, len(item)].astype(np.int64)
        self.tokens = {w: np.unique(self.shingles[(self.length >= SHINGLE) == (w > 1)][self.shingles[(self.length >= SHINGLE) == (w > 1)] != 0]) for w in (1, SHINGLE)}

    def choose(self, counts: dict[int, np.ndarray]) -> None:
        """Make the rarest shingle of each window its token; ties go to the smaller hash."""
        self.lookup = {}
        for width in (1, SHINGLE):
            rows = np.flatnonzero((self.length >= SHINGLE) == (width > 1))
            if not len(rows):
                continue
            table, sh = self.tokens[width], self.shingles[rows]
            n = counts[width][np.minimum(np.searchsorted(table, sh), len(table) - 1)].astype(float)
            n[sh == 0] = np.inf
            offset = np.lexsort((sh, n), axis=1)[:, 0]
            token = sh[np.arange(len(rows)), offset]
            order = np.argsort(token, kind="stable")
            unique, first = np.unique(token[order], return_index=True)
            self.lookup[width] = (unique, np.r_[first, len(rows)], rows[order], offset[order])
        del self.shingles, self.tokens

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(window, first word) of every occurrence."""
        h, out = words.hashes(), []
        for width, (unique, bounds, rows, offsets) in self.lookup.items():
            at = np.flatnonzero(words.left() >= width)
            token = B.sorted_find(unique, ngram_or_word(h, width)[at]) if len(at) else at
            at, token = at[token >= 0], token[token >= 0]
            n = bounds[token + 1] - bounds[token]
            post = np.repeat(bounds[token] - np.r_[0, np.cumsum(n)[:-1]][: len(n)], n) + np.arange(n.sum())
            window, start = rows[post], np.repeat(at, n) - offsets[post]
            doc = np.searchsorted(words.off, np.repeat(at, n), "right") - 1
            fits = (start >= words.off[doc]) & (start + self.length[window] <= words.off[doc + 1])
            window, start = window[fits], start[fits]
            for length in np.unique(self.length[window]):
                k = np.flatnonzero(self.length[window] == length)
                k = k[_window_hash(h, start[k], int(length)) == self.whole[window[k]]]
                k = k[same_words(words, start[k], self.words, self.place[window[k]], int(length))]
                out.append((window[k], start[k]))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def ngram_or_word(h: np.ndarray, width: int) -> np.ndarray:
    return ngram_hashes(h, width) if width > 1 else mix(h.copy())


def _count(index):
    def of_batches(batches):
        total = {w: np.zeros(len(t), np.int64) for w, t in index.value.items()}
        for batch in batches:
            for _, _, buf, off in slices(batch.column("text")):
                words = _words(buf, off)
                h, left = words.hashes(), words.left()
                for w, table in index.value.items():
                    if len(table) and len(at := np.flatnonzero(left >= w)):
                        place = B.sorted_find(table, ngram_or_word(h, w)[at])
                        total[w] += np.bincount(place[place >= 0], minlength=len(table))
        for w, n in total.items():
            k = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"width": np.full(len(k), w, np.int32), "token": k.astype(np.int64), "n": n[k]})

    return of_batches


def indexes(docs: DataFrame, benchmark: DataFrame) -> Iterator[Index]:
    """An index for each part of the benchmark in turn, its tokens chosen by their counts over all documents."""
    spark = docs.sparkSession
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // PART_BYTES)
    for k in range(parts):
        index = Index(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).orderBy("item_id").toArrow())
        tokens = spark.sparkContext.broadcast(index.tokens)
        got = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count(tokens), "width int, token long, n long").groupBy("width", "token").agg(F.sum("n").alias("n")).toArrow()
        tokens.destroy()
        counts = {w: np.zeros(len(t), np.int64) for w, t in index.tokens.items()}
        width, token, n = (got[c].to_numpy() for c in ("width", "token", "n"))
        for w in counts:
            counts[w][token[width == w]] = n[width == w]
        index.choose(counts)
        yield index


def _through(out: DataFrame, docs: DataFrame, benchmark: DataFrame, step) -> DataFrame:
    """`out` after a step for each part of the benchmark."""
    held = []
    for index in indexes(docs, benchmark):
        if len(held) == PARTS_AT_ONCE:
            out = B.saved(out)
            while held:
                held.pop().destroy()
        held.append(docs.sparkSession.sparkContext.broadcast(index))
        out = out.mapInArrow(step(held[-1]), out.schema)
    return out


def _joined(index):
    """Adds the hits of one part of the benchmark to those found before: word numbers as bits, item ids."""

    def of_batches(batches):
        x = index.value
        for batch in batches:
            bits, names = [], []
            before = batch.column("hit").to_pylist(), batch.column("items").to_pylist()
            for a, b, buf, off in slices(batch.column("text")):
                words = _words(buf, off)
                window, start = x.hits(words)
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + x.length[window], -1)
                hit = np.cumsum(edge[:-1]) > 0
                doc = np.searchsorted(words.off, start, "right") - 1
                item_of = {}
                for d, w in np.unique(np.stack([doc, window], 1), axis=0).tolist() if len(doc) else []:
                    item_of.setdefault(d, set()).update(x.items[x.item_off[w] : x.item_off[w + 1]].tolist())
                n = words.counts()
                for d in range(b - a):
                    own = hit[words.off[d] : words.off[d + 1]]
                    if before[0][a + d] is not None:
                        own = own | np.unpackbits(np.frombuffer(before[0][a + d], np.uint8), count=int(n[d])).astype(bool)
                    bits.append(np.packbits(own).tobytes() if own.any() else None)
                    names.append(sorted({x.names[i] for i in item_of.get(d, ())} | set(before[1][a + d] or ())))
            out = batch
            for name, values, kind in (("hit", bits, pa.binary()), ("items", names, pa.list_(pa.string()))):
                at = batch.schema.get_field_index(name)
                out = out.set_column(at, pa.field(name, kind), pa.array(values, kind))
            yield out

    return of_batches


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents with two more columns. hit: a bit for each word, set inside an occurrence of a window, null if none is; items: the item_ids that occur, sorted as strings."""
    B.small_batches(docs.sparkSession)
    clash = [c for c in ("hit", "items") if c in docs.columns]
    out = docs.drop(*clash).withColumn("text", F.col("text").cast("string")).withColumn("hit", F.lit(None).cast("binary")).withColumn("items", F.array().cast("array<string>"))
    return _through(out, docs, benchmark, _joined)


def _figures(batches):
    for batch in batches:
        n = np.concatenate([np.zeros(0, np.int64), *[_words(buf, off).counts() for _, _, buf, off in slices(batch.column("text"))]])
        hit = [int(np.unpackbits(np.frombuffer(x, np.uint8)).sum()) if x is not None else 0 for x in batch.column("hit").to_pylist()]
        items = batch.column("items").to_pylist()
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_words": n, "n_hit": pa.array(hit, pa.int64()), "n_items": pa.array([len(x) for x in items], pa.int64()), "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]})


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    found = hits(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark)
    return found.mapInArrow(_figures, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string").withColumn("contaminated", F.col("n_hit") > 0)


def _clean(index):
    def of_batches(batches):
        for batch in batches:
            keep = [np.zeros(0, bool)]
            for a, b, buf, off in slices(batch.column("text")):
                words, dirty = _words(buf, off), np.zeros(b - a, bool)
                dirty[np.searchsorted(words.off, index.value.hits(words)[1], "right") - 1] = True
                keep.append(~dirty)
            yield batch.filter(pa.array(np.concatenate(keep)))

    return of_batches


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a hit, with all their columns."""
    B.small_batches(docs.sparkSession)
    return _through(docs, docs, benchmark, _clean)


def op5_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return report(docs, benchmark)
