"""Substring dedup: a relative Lempel-Ziv parse of every document against the indexed blocks of all documents.

Documents lie in blocks, and every block is indexed: for each window of `window` words, the documents that hold it
and the places where it first stands in each. A document is parsed greedily from left to right: at a window that
stands in a document with a smaller doc_id, the match is extended in each reference, word by word, as long as the
text goes on there, and the longest one becomes a factor (reference document, place in it, length). All factors are
at least as long as a window, so each is a duplicate span. At a factor's boundary the windows that lie across it are
looked up, too, so that the next factor may begin inside the last one: no window with an earlier source is left out.

The index keeps for each window the first `SOURCES` documents that hold it, by doc_id, in whatever block they lie. So a
factor is the longest match along those; which words are removed doesn't depend on that bound, as one earlier
source suffices.

The index is built in two steps, so that only windows that may repeat are exchanged. First each block sends
its anchors, the minimisers of `ANCHOR`-word n-grams: a window holds one for certain, and if the window
stands in two documents so does its anchor. Then only windows over anchors known to two documents are
indexed, by 80 bits of hash.

Nulls: a null text has no words; a null doc_id counts as larger than any other, so such a row is never a
source for others. Rows with the same doc_id are no sources for each other and count as one reference. Texts
without words are returned with zero counts and the hash of the empty text. An empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .textarrays import U64, Words, ngram_hashes, slices, space_split_table, split_by, unpack

ANCHOR = 6
WINDOW = 13
SOURCES = 2
SEND = "bucket int, block int, hash binary, more binary"
INDEX = "bucket int, block int, hash binary, high binary, id binary, place binary"
KNOWN = "block int, hash binary, count binary, id binary, place binary"
FACTORS = "id long, n_words long, starts array<long>, lengths array<long>, references array<long>, places array<long>"
_SECOND = U64(0xC2B2AE3D27D4EB4F)
_TABLE = space_split_table()


def _anchors(h: np.ndarray, window: int) -> np.ndarray:
    """The anchor of the window from each position: its least n-gram hash."""
    a = ngram_hashes(h, ANCHOR)
    span, have = window - ANCHOR + 1, 1
    while have < span:
        step = min(have, span - have)
        a = np.minimum(a[:-step], a[step:]) if len(a) > step else a[:0]
        have += step
    return a


def _windows(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes; positions where a window fits; the anchors of those windows."""
    h = words.hashes()
    a = _anchors(h, window)
    at = np.flatnonzero(words.left() >= window)
    return h, at, a[at]


def _send_anchors(window: int, n: int):
    def of_block(table: pa.Table) -> pa.Table:
        hashes, ids = [], []
        own = table["id"].to_numpy()
        for a, _, buf, off in slices(table["text"]):
            words = Words(buf, off, _TABLE)
            _, at, anchor = _windows(words, window)
            keep = np.ones(len(at), bool)
            keep[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
            hashes.append(anchor[keep])
            ids.append(own[a:][words.doc()[at[keep]]])
        h, i = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((hashes, U64), (ids, np.int64)))
        order = np.lexsort((i, h))
        h, i = h[order], i[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
        last = np.r_[first[1:], len(h)] - 1 if len(h) else first
        more = i[first] != i[last]  # stands in two documents of this block
        h = h[first]
        order, bounds = split_by(B.bucket_of(h, n), n)
        h, more = h[order], more[order]
        full = np.flatnonzero(np.diff(bounds))
        return pa.table({"bucket": full.astype(np.int32), "block": np.full(len(full), table["block"][0].as_py(), np.int32), "hash": [h[bounds[k] : bounds[k + 1]].tobytes() for k in full], "more": [np.packbits(more[bounds[k] : bounds[k + 1]]).tobytes() for k in full]}, schema=pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("hash", pa.binary()), ("more", pa.binary())]))

    return of_block


def _shared_anchors(table: pa.Table) -> pa.Table:
    """Of a bucket: for each block, its anchors that stand in two documents anywhere."""
    each = unpack(table["hash"], U64)
    more = [np.unpackbits(m, count=len(h)).astype(bool) for h, m in zip(each, unpack(table["more"], np.uint8))]
    h = np.concatenate(each)
    order = np.argsort(h, kind="stable")
    s = h[order]
    two = np.concatenate(more)[order]
    same = s[1:] == s[:-1]
    two[1:] |= same
    two[:-1] |= same
    shared = np.unique(s[two])
    out = [x[B.sorted_find(shared, x) >= 0].tobytes() for x in each]
    return pa.table({"block": table["block"], "hash": pa.array(out, pa.binary())})


def _first_documents(h: np.ndarray, high: np.ndarray, ids: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Rows to keep, in the order of windows: of each window the first place in each of the `SOURCES` smallest doc_ids."""
    order = np.lexsort((place, ids, high, h))
    h, high, ids = h[order], high[order], ids[order]
    window = np.r_[True, (h[1:] != h[:-1]) | (high[1:] != high[:-1])][: len(h)]
    document = window | np.r_[True, ids[1:] != ids[:-1]][: len(h)]
    nth = np.cumsum(document)
    nth -= (nth[window] - 1)[np.cumsum(window) - 1] if len(nth) else nth
    return order[document & (nth <= SOURCES)]


def _send_windows(window: int, n: int):
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("hash", pa.binary()), ("high", pa.binary()), ("id", pa.binary()), ("place", pa.binary())])

    def of_block(left: pa.Table, right: pa.Table) -> pa.Table:
        shared = np.sort(np.concatenate([np.zeros(0, U64), *unpack(right["hash"], U64)]))
        if not len(shared) or not len(left):
            return schema.empty_table()
        own, found = left["id"].to_numpy(), []
        for a, _, buf, off in slices(left["text"]):
            words = Words(buf, off, _TABLE)
            h, at, anchor = _windows(words, window)
            at = at[B.sorted_find(shared, anchor) >= 0]
            if len(at):
                doc = words.doc()[at]
                found.append((ngram_hashes(h, window)[at], (ngram_hashes(h, window, _SECOND, 1)[at] >> U64(48)).astype(np.uint16), own[a:][doc], (at - words.off[doc]).astype(np.int32)))
        if not found:
            return schema.empty_table()
        cols = [np.concatenate(x) for x in zip(*found)]
        keep = _first_documents(*cols)
        cols = [x[keep] for x in cols]
        order, bounds = split_by(B.bucket_of(cols[0], n), n)
        full = np.flatnonzero(np.diff(bounds))
        cut = lambda x: [x[order[bounds[k] : bounds[k + 1]]].tobytes() for k in full]
        return pa.table({"bucket": full.astype(np.int32), "block": np.full(len(full), left["block"][0].as_py(), np.int32), **{c: cut(x) for c, x in zip(("hash", "high", "id", "place"), cols)}}, schema=schema)

    return of_block


def _sources(table: pa.Table) -> pa.Table:
    """Of a bucket: for each block, its windows that start in a smaller document, and the documents and places of the first sources."""
    h, high, ids, place = (np.concatenate([np.zeros(0, t), *unpack(table[c], t)]) for c, t in (("hash", U64), ("high", np.uint16), ("id", np.int64), ("place", np.int32)))
    sizes = [len(x.as_buffer()) // 8 for x in table["hash"]]
    keep = _first_documents(h, high, ids, place)
    # a number for each window, and the kept rows of each
    order = np.lexsort((high, h))
    new = np.r_[True, (h[order][1:] != h[order][:-1]) | (high[order][1:] != high[order][:-1])][: len(h)]
    number = np.empty(len(h), np.int64)
    number[order] = np.cumsum(new) - 1
    first = np.searchsorted(number[keep], np.arange(int(new.sum()) + 1))
    ends, out = np.cumsum([0, *sizes]), []
    for a, b in zip(ends, ends[1:]):
        # the windows of this block, and the largest doc_id that it sent for each
        own, at = np.unique(number[a:b][::-1], return_index=True)
        most = ids[b - 1 - at]
        n = first[own + 1] - first[own]
        rows = keep[np.repeat(first[own] - np.r_[0, np.cumsum(n)[:-1]][: len(n)], n) + np.arange(n.sum())]
        # a block that sent as many as are kept may have later documents still
        sent = np.bincount(np.searchsorted(own, number[a:b]), minlength=len(own))
        use = (ids[rows] < np.repeat(most, n)) | np.repeat(sent == SOURCES, n)
        count = np.bincount(np.repeat(np.arange(len(own)), n)[use], minlength=len(own))
        some, rows = count > 0, rows[use]
        out.append((h[b - 1 - at][some].tobytes(), count[some].astype(np.uint8).tobytes(), ids[rows].tobytes(), place[rows].tobytes()))
    return pa.table({"block": table["block"], **{c: pa.array([x[k] for x in out], pa.binary()) for k, c in enumerate(("hash", "count", "id", "place"))}})


class _Known:
    """The windows of a block that have sources, and these."""

    def __init__(self, table: pa.Table):
        h, count, self.id, self.place = (np.concatenate([np.zeros(0, t), *(unpack(table[c], t) if len(table) else [])]) for c, t in (("hash", U64), ("count", np.uint8), ("id", np.int64), ("place", np.int32)))
        order = np.argsort(h, kind="stable")
        self.hash, self.count = h[order], count[order].astype(np.int64)
        self.first = np.r_[0, np.cumsum(count.astype(np.int64))][:-1][order]

    def of(self, words: Words, ids: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, source document, place in it) of all sources of the windows of the texts; ids are the texts' doc_ids."""
        at = np.flatnonzero(words.left() >= window)
        found = B.sorted_find(self.hash, ngram_hashes(words.hashes(), window)[at]) if len(at) else at
        at, found = at[found >= 0], found[found >= 0]
        n = self.count[found]
        rows = np.repeat(self.first[found] - np.r_[0, np.cumsum(n)[:-1]][: len(n)], n) + np.arange(n.sum())
        at = np.repeat(at, n)
        earlier = self.id[rows] < ids[words.doc()[at]]
        return at[earlier], self.id[rows[earlier]], self.place[rows[earlier]].astype(np.int64)


def _greedy_factors(at: np.ndarray, source: np.ndarray, place: np.ndarray, off: np.ndarray, window: int):
    """(document, start, length, reference, place in it) of the factors, in the order of the texts."""
    none = np.zeros(0, np.int64)
    if not len(at):
        return (none,) * 5
    doc = np.searchsorted(off, at, "right") - 1
    # a match goes on as long as the next window stands at the next place of the same reference
    order = np.lexsort((at, place - at, source, doc))
    a, s, d, t = at[order], source[order], (place - at)[order], doc[order]
    ends = np.r_[(a[1:] != a[:-1] + 1) | (s[1:] != s[:-1]) | (d[1:] != d[:-1]) | (t[1:] != t[:-1]), True]
    last = np.empty(len(at), np.int64)
    stops = np.flatnonzero(ends)
    last[order] = a[stops][np.searchsorted(stops, np.arange(len(a)))]
    # of each window the source with the longest match, then the smallest doc_id
    order = np.lexsort((place, source, -last, at))
    best = order[np.r_[True, at[order][1:] != at[order][:-1]]]
    a, e = at[best], last[best]
    chosen, k = [], 0
    after = np.maximum(np.searchsorted(a, e, "right"), np.searchsorted(a, off[doc[best]]))
    after = after.tolist()
    while k < len(a):
        chosen.append(k)
        k = after[k]
    pick = best[chosen]
    return doc[pick], at[pick] - off[doc[pick]], last[pick] - at[pick] + window, source[pick], place[pick]


def _parse(window: int, finish):
    def of_block(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if len(left):
            ids, known = left["id"].to_numpy(), _Known(right)
            for a, b, buf, off in slices(left["text"]):
                words = Words(buf, off, _TABLE)
                parts.append(finish(ids[a:b], words, _greedy_factors(*known.of(words, ids[a:b], window), words.off, window)))
        return pa.concat_tables(parts) if parts else finish(np.zeros(0, np.int64), Words(np.zeros(0, np.uint8), np.zeros(1, np.int64), _TABLE), (np.zeros(0, np.int64),) * 5)

    return of_block


def _as_factors(ids: np.ndarray, words: Words, factors) -> pa.Table:
    doc, *values = factors
    off = np.searchsorted(doc, np.arange(len(ids) + 1)).astype(np.int32)
    lists = [pa.ListArray.from_arrays(off, pa.array(x, pa.int64())) for x in values]
    return pa.table({"id": ids, "n_words": words.counts().astype(np.int64), **dict(zip(("starts", "lengths", "references", "places"), lists))})


def _as_digest(ids: np.ndarray, words: Words, factors) -> pa.Table:
    doc, start, length, *_ = factors
    n = len(words)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, words.off[doc] + start, 1)
    np.add.at(edge, words.off[doc] + start + length, -1)
    kept = np.cumsum(edge[:-1]) == 0
    removed = np.diff(np.r_[0, np.cumsum(~kept)][words.off])
    buf = words.buf
    digest = []
    if n:
        # bytes of kept words, each followed by one space
        size = words.ends - words.starts + 1
        k = np.flatnonzero(kept)
        total = np.r_[0, np.cumsum(size[k])]
        src = np.repeat(words.starts[k] - total[:-1], size[k]) + np.arange(total[-1])
        out = buf[np.minimum(src, len(buf) - 1)] if len(buf) else buf
        out[total[1:] - 1] = 32
        bounds = total[np.searchsorted(k, words.off)]
        view = memoryview(np.ascontiguousarray(out))
        digest = [hashlib.sha256(view[a : max(a, b - 1)]).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    else:
        digest = [hashlib.sha256(b"").hexdigest()] * len(ids)
    return pa.table({"id": pa.array(ids, pa.int64()), "n_words": words.counts().astype(np.int64), "n_removed": removed.astype(np.int64), "kept_sha256": pa.array(digest, pa.string())})


def _run(docs: DataFrame, window: int, finish, schema: str) -> DataFrame:
    spark = docs.sparkSession
    B.small_batches(spark)
    n, p = B.block_count(spark), B.partitions(spark)
    dealt = B.in_blocks(docs)
    sent = dealt.groupBy("block").applyInArrow(_send_anchors(window, n), SEND)
    shared = sent.repartition(p, "bucket").groupBy("bucket").applyInArrow(_shared_anchors, "block int, hash binary")
    index = dealt.groupBy("block").cogroup(shared.repartition(p, "block").groupBy("block")).applyInArrow(_send_windows(window, n), INDEX)
    found = index.repartition(p, "bucket").groupBy("bucket").applyInArrow(_sources, KNOWN)
    return dealt.groupBy("block").cogroup(found.repartition(p, "block").groupBy("block")).applyInArrow(_parse(window, finish), schema)


def _real_id():
    return F.when(F.col("id") != int(B.NO_ID), F.col("id")).alias("doc_id")


def _blank(docs: DataFrame, *columns) -> DataFrame:
    """The documents without a text, which take no part in the exchange."""
    return docs.where("text IS NULL OR text = ''").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_words"), *columns)


def duplicate_factors(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, starts, lengths, references, places): the factors of each document, in words from 0, with the doc_id of each one's reference and its place there."""
    names = ("starts", "lengths", "references", "places")
    found = _run(docs, window, _as_factors, FACTORS).select(_real_id(), "n_words", *names)
    return found.unionByName(_blank(docs, *[F.array().cast("array<long>").alias(c) for c in names]))


def removed_digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): what is left of each document without its duplicate spans."""
    schema = "id long, n_words long, n_removed long, kept_sha256 string"
    found = _run(docs, window, _as_digest, schema).select(_real_id(), "n_words", "n_removed", "kept_sha256")
    return found.unionByName(_blank(docs, F.lit(0).cast("long").alias("n_removed"), F.sha2(F.lit(""), 256).alias("kept_sha256")))


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return removed_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
