"""N-gram Jaccard join: links between documents whose sets of word shingles are alike, and their components.

Exact for Jaccard similarity of `NUM`/`DEN` or more. Shingles are ordered by rarity, then by hash; two such
documents share a shingle among the first |x| - ceil(t|x|) + 1 of each, their prefixes, whatever the order.
What counts as common is measured: a first exchange of prefixes in hash order gives the shingles that stand in
`COMMON` prefixes or more, which go to the end of the order (as bits of a bitmap of fixed size, so that a
chance hit only changes the order). Documents that share a prefix shingle form a tile, cut into bands of sizes
that differ by less than the threshold allows.

First pass: in each band of a tile, all documents are paired with its first one, and the pairs of neighbouring
bands' first ones are added; pairs that met in too few tiles to be likely are left to the second pass, where
the shingles that two prefixes share are counted in full: what lies beyond a prefix is bounded by its length,
so a pair that shares fewer than `shared_need` can't be a link. Identical sets, found by a digest, are linked
outright. Second pass: tiles whose documents are still in two components or more are compared in full, between
components only: hashed bitmap signatures bound a pair's overlap from above by bit counts, and only pairs that
can reach the threshold go on. Large tiles are compared in pieces. Every pair that goes on is decided by the
exact intersection of its sorted shingle arrays. That gives the components.

Links (`linked`, `report`): a link joins two documents of one component, so the components, cut into pieces of
bounded size where they are large, are tiles that hold each pair once. Within them the sizes, then the bitmap
signatures bound the overlap, and what is left is decided by exact intersection. Links are counted where they
are found, so that no row is made for each pair.

Nulls: a null text, like one without words, has an empty set and is linked with nothing; a null doc_id has no
component and is linked with nothing. Rows with the same doc_id are one node of the graph, linked by any of
their sets. An empty table gives no rows. Extra columns are ignored; `keep_first` returns the columns it is given.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import blocks as B
from .graph import components
from .textarrays import _STEP, U64, Words, lower_ascii, mix, ngram_hashes, slices, space_split_table, split_by, unpack

SHINGLE = 5
NUM, DEN = 4, 5
COMMON = 8
COMMON_BITS = 25  # 4 MB
COMMON_SLOTS = 1 << 21  # set in it at most, the most frequent ones
FLUSH = 1 << 20
BROADCAST_IDS = 1_000_000  # ids of documents: 16 MB and their hash table
TILE_PIECE = 2048
LINK_PIECE, LINK_BYTES = 4096, 64 << 20  # rows and bytes of the sets of a piece of a component
DENSE = 32  # from so many sets to compare with one, intersections are taken by bits
BITMAP_LEAST, BITMAP_MOST = 64, 8192
_TABLE = space_split_table()


def shingle_sets(texts, shingle: int = SHINGLE):
    """For slices of texts: first row, the sorted distinct shingle hashes of each text, and their bounds."""
    for a, _, buf, off in slices(texts):
        words = Words(lower_ascii(buf), off, _TABLE)
        h, n, doc = words.hashes(), words.counts(), words.doc()
        at = np.flatnonzero(words.left() >= shingle)
        value, owner = ngram_hashes(h, shingle)[at] if len(at) else np.zeros(0, U64), doc[at]
        for k in range(1, shingle):  # fewer words: the whole sequence
            short = np.flatnonzero(n == k)
            if len(short):
                x = h[words.off[short]] + U64(k)
                for j in range(1, k):
                    x = x * _STEP + h[words.off[short] + j]
                value, owner = np.concatenate([value, mix(x)]), np.concatenate([owner, short])
        order = np.lexsort((value, owner))
        value, owner = value[order], owner[order]
        new = np.r_[True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])][: len(value)]
        value, owner = value[new], owner[new]
        yield a, value, np.searchsorted(owner, np.arange(len(n) + 1))


def digests(value: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each set."""
    out = []
    for salt in (U64(0x51), U64(0xA3)):
        total = np.r_[U64(0), np.cumsum(mix(value + salt))]
        out.append((total[off[1:]] - total[off[:-1]]).view(np.int64))
    return out[0], out[1]


def block_of(ids: np.ndarray, n: int) -> np.ndarray:
    return np.mod(ids, n).astype(np.int32)


def id_blocks(parts: int) -> int:
    """Blocks of ids by remainder: a prime number of them, so that ids with a common step spread, too."""
    n = max(2, parts)
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


BASE = "doc_id long, n long, d1 long, d2 long"


def _base(shingle: int):
    def of_batches(batches):
        for batch in batches:
            for a, value, off in shingle_sets(batch.column("text"), shingle):
                d1, d2 = digests(value, off)
                n = len(off) - 1
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, n), pa.array(np.diff(off).astype(np.int64)), pa.array(d1), pa.array(d2)], names=["doc_id", "n", "d1", "d2"])

    return of_batches


def _common_slots(table: pa.Table) -> pa.Table:
    """Of a bucket: the bitmap slots of the shingles that stand in many prefixes, by the power of two in their count."""
    token = np.sort(np.concatenate(unpack(table["token"], U64)))
    first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    count = np.diff(np.r_[first, len(token)])
    level = np.log2(count).astype(np.int32)
    found = np.unique(level[count >= COMMON]).tolist()
    slots = [np.unique(token[first[(level == k) & (count >= COMMON)]] >> U64(64 - COMMON_BITS)).astype(np.uint32) for k in found]
    return pa.table({"level": pa.array(found, pa.int32()), "n": pa.array([len(x) for x in slots], pa.int64()), "slots": pa.array([x.tobytes() for x in slots], pa.binary())})


def _as_bitmap(batches):
    bits = np.zeros(1 << COMMON_BITS, bool)
    for batch in batches:
        for slots in unpack(batch.column("slots"), np.uint32):
            bits[slots] = True
    yield pa.RecordBatch.from_pydict({"bits": [zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)]}, schema=pa.schema([("bits", pa.binary())]))


def common_shingles(sent: DataFrame, p: int) -> np.ndarray:
    """A bitmap of fixed size over the leading bits of the hashes: set for common ones, the most frequent first, as many as it takes well."""
    slots = B.saved(sent.repartition(p, "bucket").groupBy("bucket").applyInArrow(_common_slots, "level int, n long, slots binary"))
    least, held = 64, 0
    for r in slots.groupBy("level").agg(F.sum("n").alias("n")).orderBy(F.col("level").desc()).collect():  # one row for each power of two
        held += r["n"]
        if held > COMMON_SLOTS:
            break
        least = r["level"]
    parts = slots.where(F.col("level") >= least).repartition(8).mapInArrow(_as_bitmap, "bits binary").collect()
    return np.bitwise_or.reduce([np.zeros(1 << (COMMON_BITS - 3), np.uint8), *[np.frombuffer(zlib.decompress(r["bits"]), np.uint8) for r in parts]])


def is_common(bits: np.ndarray | None, value: np.ndarray) -> np.ndarray:
    if bits is None:
        return np.zeros(len(value), np.uint8)
    slot = value >> U64(64 - COMMON_BITS)
    return (bits[(slot >> U64(3)).astype(np.int64)] >> (slot & U64(7)).astype(np.uint8)) & 1


SENT = "bucket int, token binary, id binary, size binary"
_SENT = pa.schema([("bucket", pa.int32()), ("token", pa.binary()), ("id", pa.binary()), ("size", pa.binary())])


def prefix_length(size: np.ndarray) -> np.ndarray:
    return size - (NUM * size + DEN - 1) // DEN + (size > 0)


def _send_prefixes(shingle: int, n: int, common):
    def flush(held):
        token, ids, size = (np.concatenate(x) for x in zip(*held))
        order, bounds = split_by(B.bucket_of(token, n), n)
        token, ids, size = token[order], ids[order], size[order]
        full = np.flatnonzero(np.diff(bounds))
        cut = lambda x: [x[bounds[k] : bounds[k + 1]].tobytes() for k in full]
        return pa.RecordBatch.from_pydict({"bucket": full.astype(np.int32), "token": cut(token), "id": cut(ids), "size": cut(size)}, schema=_SENT)

    def of_batches(batches):
        held, count, seen = [], 0, set()
        for batch in batches:
            own = batch.column("id").to_numpy()
            for a, value, off in shingle_sets(batch.column("text"), shingle):
                d1, d2 = digests(value, off)
                keep = np.zeros(len(off) - 1, bool)
                for d, key in enumerate(zip(d1.tolist(), d2.tolist())):
                    if key not in seen:  # of identical sets in a task, one stands for all
                        seen.add(key)
                        keep[d] = True
                doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
                last = is_common(common.value, value) if common is not None else is_common(None, value)
                order = np.lexsort((value, last, doc)) if last.any() else np.arange(len(value))
                size = np.diff(off)
                rank = np.arange(len(value)) - off[doc]
                first = (rank < prefix_length(size)[doc]) & keep[doc]
                chosen, owner = order[first], doc[first]
                held.append((value[chosen], own[a:][owner], size[owner].astype(np.int32)))
                count += len(chosen)
                if count > FLUSH:
                    yield flush(held)
                    held, count = [], 0
        if count:
            yield flush(held)

    return of_batches


PAIRED = "kind int, block int, a binary, b binary, c binary, d binary"
_PAIRED = pa.schema([("kind", pa.int32()), ("block", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])


def _band(size: np.ndarray) -> np.ndarray:
    return np.floor(np.log(size) / np.log(DEN / NUM)).astype(np.int64)


def shared_need(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least number of shingles that the prefixes of two sets of these sizes share if the sets are a link.

    Of the prefix that ends first in the order, all common shingles up to its end are in both prefixes; after
    it that set has only |x| less its prefix's length.
    """
    rest = lambda s: (NUM * s + DEN - 1) // DEN - 1
    return -(-NUM * (x + y) // (NUM + DEN)) - np.maximum(rest(x), rest(y))


def _by_block(a: np.ndarray, b: np.ndarray, met: np.ndarray, need: np.ndarray, n: int) -> list[tuple[int, bytes, bytes, bytes, bytes]]:
    """Pairs, in how many tiles they met and how many are needed, packed by the block of the first."""
    order, bounds = split_by(block_of(a, n), n)
    cols = a[order], b[order], met[order].astype(np.int32), need[order].astype(np.int32)
    return [(int(k), *(x[bounds[k] : bounds[k + 1]].tobytes() for x in cols)) for k in np.flatnonzero(np.diff(bounds))]


def _first_pairs(n: int):
    def of_bucket(table: pa.Table) -> pa.Table:
        token, ids, size = (np.concatenate(unpack(table[c], t)) for c, t in (("token", U64), ("id", np.int64), ("size", np.int32)))
        order = np.argsort(token, kind="stable")
        s = token[order]
        two = np.zeros(len(s), bool)
        two[1:] = s[1:] == s[:-1]
        two[:-1] |= two[1:]
        order = order[two]
        if not len(order):
            return _PAIRED.empty_table()
        token, ids, size = token[order], ids[order], size[order]
        band = _band(size)
        order = np.lexsort((ids, band, token))
        token, ids, size, band = token[order], ids[order], size[order], band[order]
        head = np.r_[True, (token[1:] != token[:-1]) | (band[1:] != band[:-1])]
        first = np.flatnonzero(head)
        pivot = first[np.cumsum(head) - 1]
        next_band = first[1:][token[first[1:]] == token[first[:-1]]]
        before = first[:-1][token[first[1:]] == token[first[:-1]]]
        x, y = np.concatenate([pivot, before]), np.concatenate([np.arange(len(ids)), next_band])
        low, high = np.minimum(size[x], size[y]).astype(np.int64), np.maximum(size[x], size[y]).astype(np.int64)
        fit = (DEN * low >= NUM * high) & (ids[x] != ids[y])
        x, y = x[fit], y[fit]
        pairs, first_of, met = np.unique(np.stack([np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])], 1), axis=0, return_index=True, return_counts=True)
        need = shared_need(size[x].astype(np.int64), size[y].astype(np.int64))[first_of] // 2
        rows = [(0, *r) for r in _by_block(pairs[:, 0], pairs[:, 1], met, need, n)]
        # tiles, once for each set of documents
        start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        length = np.diff(np.r_[start, len(token)])
        total = np.r_[U64(0), np.cumsum(mix(ids.view(U64) + U64(0x77)))]
        name = mix(total[start + length] - total[start] + length.astype(U64))
        _, once, times = np.unique(name, return_index=True, return_counts=True)
        if len(once):
            at = np.repeat(start[once] - np.r_[0, np.cumsum(length[once])[:-1]], length[once]) + np.arange(length[once].sum())
            rows.append((1, -1, np.repeat(name[once], length[once]).tobytes(), ids[at].tobytes(), size[at].astype(np.int32).tobytes(), np.repeat(times, length[once]).astype(np.int32).tobytes()))
        return pa.table(dict(zip(_PAIRED.names, map(list, zip(*rows)))) if rows else {c: [] for c in _PAIRED.names}, schema=_PAIRED)

    return of_bucket


def _ids_of_pairs(n: int):
    """The ids that a task's pairs name, once each, packed by block."""

    def of_batches(batches):
        ids = np.zeros(0, np.int64)
        for batch in batches:
            ids = np.unique(np.concatenate([ids, *unpack(batch.column("a"), np.int64), *unpack(batch.column("b"), np.int64)]))
        order, bounds = split_by(block_of(ids, n), n)
        full = np.flatnonzero(np.diff(bounds))
        yield pa.RecordBatch.from_pydict({"block": full.astype(np.int32), "ids": pa.array([ids[order[bounds[k] : bounds[k + 1]]].tobytes() for k in full], pa.binary())})

    return of_batches


def _once(table: pa.Table) -> pa.Table:
    return pa.table({"id": np.unique(np.concatenate(unpack(table["ids"], np.int64)))})


def _tile_rows(batches):
    for batch in batches:
        for cols in zip(unpack(batch.column("a"), np.int64), unpack(batch.column("b"), np.int64), unpack(batch.column("c"), np.int32), unpack(batch.column("d"), np.int32)):
            for k in range(0, len(cols[0]), 50_000):
                yield pa.RecordBatch.from_pydict({c: x[k : k + 50_000] for c, x in zip(("tile", "id", "size", "times"), cols)})


def _sets_in(table: pa.Table, wanted: np.ndarray, shingle: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sets of a block's rows whose ids are wanted."""
    wanted = np.sort(wanted)
    own = table["id"].to_numpy()
    if not len(own) or not len(wanted):
        return np.zeros(0, np.int64), []
    rows = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)] == own)
    sets = [value[off[d] : off[d + 1]] for _, value, off in shingle_sets(table["text"].take(pa.array(rows)), shingle) for d in range(len(off) - 1)]
    return own[rows], sets


SHIPPED = "block int, id binary, n binary, sets binary, a binary, b binary"
_SHIPPED = pa.schema([("block", pa.int32()), ("id", pa.binary()), ("n", pa.binary()), ("sets", pa.binary()), ("a", pa.binary()), ("b", pa.binary())])


def _ship(shingle: int, n: int):
    """Sends the first document's set of each pair to the block of the second, once for all its pairs there."""

    def of_block(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _SHIPPED.empty_table()
        pairs, first, of = np.unique(np.stack([np.concatenate(unpack(right[c], np.int64)) for c in ("a", "b")], 1), axis=0, return_index=True, return_inverse=True)
        met = np.bincount(of.ravel(), np.concatenate(unpack(right["c"], np.int32)), minlength=len(pairs))
        pairs = pairs[met >= np.concatenate(unpack(right["d"], np.int32))[first]]
        ids, sets = _sets_in(left, np.unique(pairs[:, 0]), shingle)
        order, bounds = split_by(block_of(pairs[:, 1], n), n)
        pairs, rows = pairs[order], []
        for k in np.flatnonzero(np.diff(bounds)):
            own = pairs[bounds[k] : bounds[k + 1]]
            need = np.flatnonzero(np.isin(ids, own[:, 0]))
            rows.append((int(k), ids[need].tobytes(), np.array([len(sets[i]) for i in need], np.int64).tobytes(), b"".join(sets[i].tobytes() for i in need), own[:, 0].tobytes(), own[:, 1].tobytes()))
        return pa.table(dict(zip(_SHIPPED.names, map(list, zip(*rows)))), schema=_SHIPPED) if rows else _SHIPPED.empty_table()

    return of_block


def _alike(x: np.ndarray, y: np.ndarray) -> bool:
    """The exact test on sorted arrays."""
    if DEN * min(len(x), len(y)) < NUM * max(len(x), len(y)) or not len(x):
        return False
    both = np.sort(np.concatenate([x, y]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return DEN * common >= NUM * (len(x) + len(y) - common)


def _decide(shingle: int):
    def of_block(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            a, b = (np.concatenate(unpack(right[c], np.int64)) for c in ("a", "b"))
            mine: dict[int, list[np.ndarray]] = {}
            for i, s in zip(*_sets_in(left, np.unique(b), shingle)):
                mine.setdefault(int(i), []).append(s)
            theirs: dict[int, list[np.ndarray]] = {}
            for i, n, s in zip(unpack(right["id"], np.int64), unpack(right["n"], np.int64), unpack(right["sets"], U64)):
                for x, part in zip(i.tolist(), np.split(s, np.cumsum(n)[:-1]) if len(n) else []):
                    theirs.setdefault(x, []).append(part)
            out = [(x, y) for x, y in zip(a.tolist(), b.tolist()) if any(_alike(s, t) for s in theirs.get(x, ()) for t in mine.get(y, ()))]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return of_block


def bitmap(s: np.ndarray) -> np.ndarray:
    """A signature of the set; its width follows the size, so that it is half full at most."""
    width = BITMAP_LEAST
    while width < BITMAP_MOST and 2 * width < 3 * len(s):
        width *= 2
    bits = np.zeros(width, np.uint8)
    bits[(s & U64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(U64)


def _signatures(shingle: int):
    def of_batches(batches):
        for batch in batches:
            for a, value, off in shingle_sets(batch.column("text"), shingle):
                n = len(off) - 1
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, n), pa.array([bitmap(value[off[d] : off[d + 1]]).tobytes() for d in range(n)], pa.binary())], names=["id", "bits"])

    return of_batches


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    return np.bitwise_or.reduce(bits.reshape(-1, width), axis=0) if len(bits) > width else bits


def _tile_pairs(n: int):
    """Pairs of a tile, or of two pieces of one, from different components whose bit counts leave an overlap that suffices. A group holds several tiles."""

    def of_group(table: pa.Table) -> pa.Table:
        size, ids, comp, piece, tile, p, q, times, several = (table[c].to_numpy() for c in ("size", "id", "component", "piece", "tile", "p", "q", "times", "several"))
        size, raw = size.astype(np.int64), unpack(table["bits"], U64)
        order = np.lexsort((size, q, p, tile))
        key = np.stack([tile, p, q], 1)[order]
        bounds = np.r_[np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)]), len(order)]
        a, b, need, met = [], [], [], []
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            own = order[s:e]
            z, c, i, w, loose = size[own], comp[own], ids[own], piece[own], several[own]
            width = min(len(raw[k]) for k in own)
            bits = np.stack([_folded(raw[k], width) for k in own])
            within = p[own[0]] == q[own[0]]
            top = np.where(loose.any(), e - s, np.searchsorted(z, z * DEN // NUM, "right"))
            for k in range(e - s - 1):
                j = np.arange(k + 1, top[k])
                j = j[(c[j] != c[k]) & (i[j] != i[k]) & (within | (w[j] != w[k]))]
                if len(j):
                    out_k = np.bitwise_count(bits[k] & ~bits[j]).sum(1, dtype=np.int64)
                    out_j = np.bitwise_count(bits[j] & ~bits[k]).sum(1, dtype=np.int64)
                    most = np.minimum(z[k] - out_k, z[j] - out_j)
                    free = loose[k] | loose[j]  # with several sets to an id, neither size nor bits bound anything
                    j = j[free | (DEN * most >= NUM * (z[k] + z[j] - most))]
                    a.append(np.full(len(j), i[k]))
                    b.append(i[j])
                    need.append(np.where(loose[k] | loose[j], 0, shared_need(z[k], z[j])))
                    met.append(np.full(len(j), times[own[0]]))
        a, b, need, met = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b, need, met))
        pairs, first, of = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0, return_index=True, return_inverse=True)
        rows = _by_block(pairs[:, 0], pairs[:, 1], np.bincount(of.ravel(), met, minlength=len(pairs)), need[first], n)
        return pa.table({"block": pa.array([r[0] for r in rows], pa.int32()), **{c: pa.array([r[k] for r in rows], pa.binary()) for k, c in enumerate("abcd", 1)}})

    return of_group


def _by_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """A semi or anti join of the documents with saved ids: by broadcast if these are few, else by a shuffle of both."""
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "id", how)


def _decided(docs: DataFrame, pairs: DataFrame, shingle: int, p: int) -> DataFrame:
    """(a, b) of those pairs, packed by the block of a, that are links."""
    n = id_blocks(p)
    named = pairs.select("a", "b").mapInArrow(_ids_of_pairs(n), "block int, ids binary").repartition(p, "block")
    need = B.saved(named.groupBy("block").applyInArrow(_once, "id long"))
    dealt = _by_ids(docs, need, "left_semi").select(F.pmod("id", F.lit(n)).cast("int").alias("block"), "id", "text").repartition(p, "block")
    shipped = dealt.groupBy("block").cogroup(pairs.repartition(p, "block").groupBy("block")).applyInArrow(_ship(shingle, n), SHIPPED)
    return dealt.groupBy("block").cogroup(shipped.repartition(p, "block").groupBy("block")).applyInArrow(_decide(shingle), "a long, b long")


def _open_tiles(tiles: DataFrame) -> DataFrame:
    """The rows of tiles with two components or more, with the number of pieces of each tile."""
    spread = tiles.groupBy("tile").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("m")).where("x <> y")
    spread = B.saved(spread.select("tile", F.ceil(F.col("m") / TILE_PIECE).cast("int").alias("pieces")))
    if spread.count() <= BROADCAST_IDS:
        return tiles.join(F.broadcast(spread), "tile")
    # a large tile is dealt over several tasks
    salts = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("salt")
    sizes = spread.withColumnRenamed("pieces", "_n")
    salted = tiles.join(sizes.where("_n > 1"), "tile", "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("_n", F.lit(1))).cast("int")).drop("_n")
    return salted.join(spread.select("tile", "pieces", salts), ["tile", "salt"]).drop("salt")


def _tile_links(known: DataFrame, tiles: DataFrame, shingle: int, parts: int) -> DataFrame | None:
    """The links between different components within the tiles (tile, id, size, times, component)."""
    rest = B.saved(_open_tiles(tiles))
    if rest.isEmpty():
        return None
    signed = _by_ids(known, B.saved(rest.select("id").distinct()), "left_semi").mapInArrow(_signatures(shingle), "id long, bits binary")
    signed = signed.groupBy("id").agg(F.max("bits").alias("bits"), (F.count("*") > 1).alias("several"))
    piece = F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")
    cut = rest.withColumn("piece", piece).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    cut = cut.withColumn("p", F.least("piece", "other")).withColumn("q", F.greatest("piece", "other")).join(signed, "id")
    group = F.when(F.col("pieces") == 1, F.pmod("tile", F.lit(4 * parts))).otherwise(F.xxhash64("tile", "p", "q"))
    more = cut.withColumn("grp", group).groupBy("grp").applyInArrow(_tile_pairs(id_blocks(parts)), "block int, a binary, b binary, c binary, d binary")
    return B.saved(_decided(known, B.saved(more), shingle, parts))


class Classes:
    """What the join finds. base: (doc_id, n, d1, d2) of every row; held: those of documents with a set, once each; several: (doc_id) of
    documents with more than one set; parts: blocks and buckets that the texts' size asks for; known: (id, text), of the documents with one set the first of each class of copies, and all
    rows of the others; found: (node, component) of the documents that have a link."""

    def __init__(self, docs: DataFrame, shingle: int):
        spark = docs.sparkSession
        B.small_batches(spark)
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        held = Observation()
        self.base = B.saved(rows.observe(held, F.sum(F.octet_length("text")).alias("bytes")).mapInArrow(_base(shingle), BASE))
        self.parts = p = B.blocks_for(spark, held.get["bytes"] or 0)
        self.held = self.base.where("n > 0 AND doc_id IS NOT NULL").distinct()
        self.several = B.saved(self.held.groupBy("doc_id").count().where("count > 1").select("doc_id"))
        copies = self.held.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a <> z")
        equal = B.saved(self.held.join(copies, ["n", "d1", "d2"]).where("doc_id <> a").select("a", F.col("doc_id").alias("b")))
        self.reps = B.saved(self.single().groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
        later = self.single().join(self.reps.where("copies > 1"), ["n", "d1", "d2"]).where("doc_id <> rep").select(F.col("doc_id").alias("id"))
        known = rows.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
        self.known = _by_ids(known, B.saved(later), "left_anti")

        bits = common_shingles(self.known.mapInArrow(_send_prefixes(shingle, p, None), SENT), p)
        sent = self.known.mapInArrow(_send_prefixes(shingle, p, spark.sparkContext.broadcast(bits)), SENT)
        paired = B.saved(sent.repartition(p, "bucket").groupBy("bucket").applyInArrow(_first_pairs(id_blocks(p)), PAIRED))
        links = B.saved(equal.union(_decided(self.known, paired.where("kind = 0").select("block", "a", "b", "c", "d"), shingle, p)))
        self.found = B.saved(components(links))

        tiles = paired.where("kind = 1").select("a", "b", "c", "d").mapInArrow(_tile_rows, "tile long, id long, size int, times int").groupBy("tile", "id").agg(F.max("size").alias("size"), F.sum("times").alias("times"))
        tiles = B.saved(tiles.join(self.found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id")))
        again = _tile_links(self.known, tiles, shingle, p)
        if again is not None and not again.isEmpty():
            self.found = B.saved(components(self.found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(again)))

    def single(self) -> DataFrame:
        """held without the documents that have several sets."""
        return self.held.join(self.several, "doc_id", "left_anti")

    def of_rows(self) -> DataFrame:
        """(doc_id, n_shingles, component_id) of every row."""
        return self.base.join(self.found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _as_sets(shingle: int):
    def of_batches(batches):
        for batch in batches:
            for a, value, off in shingle_sets(batch.column("text"), shingle):
                n = len(off) - 1
                own = [value[off[d] : off[d + 1]].tobytes() for d in range(n)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, n) for c in ("id", "component", "copies")], pa.array(own, pa.binary())], names=["id", "component", "copies", "shingles"])

    return of_batches


def _exact_bits(sets: list[np.ndarray]) -> np.ndarray | None:
    """For each sorted array a row of bits, one bit for each value that stands in two arrays or more: common bits of two rows are their intersection. None if that takes too much memory."""
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    s = every[order]
    new = np.r_[True, s[1:] != s[:-1]]
    size = np.diff(np.r_[np.flatnonzero(new), len(s)])
    rank = np.cumsum(size > 1)[np.cumsum(new) - 1] - 1
    shared = size[np.cumsum(new) - 1] > 1
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[order]
    width = -(-max(1, int((size > 1).sum())) // 64)
    if 8 * width * len(sets) > LINK_BYTES:
        return None
    bits = np.zeros((len(sets), width), U64)
    np.bitwise_or.at(bits, (row[shared], rank[shared] >> 6), U64(1) << (rank[shared] & 63).astype(U64))
    return bits


def _alike_in(sets: list[np.ndarray], first: int | None):
    """(k, numbers of the sets alike with set k), each pair once: among all sets, or from the `first` ones to the rest. Sets come by falling size, in either part."""
    size = np.array([len(x) for x in sets], np.int64)
    width = min(len(bitmap(x)) for x in sets)
    signature = np.stack([_folded(bitmap(x), width) for x in sets])
    exact, room = None, True
    for k in range(len(sets) if first is None else first):
        lo = k + 1 if first is None else first
        a = lo + int(np.searchsorted(-size[lo:], -(size[k] * DEN // NUM), "left"))
        b = lo + int(np.searchsorted(-size[lo:], -size[k] * NUM // DEN, "right"))
        if a >= b:
            continue
        out_k = np.bitwise_count(signature[k] & ~signature[a:b]).sum(1, dtype=np.int64)
        out_j = np.bitwise_count(signature[a:b] & ~signature[k]).sum(1, dtype=np.int64)
        most = np.minimum(size[k] - out_k, size[a:b] - out_j)
        j = a + np.flatnonzero(DEN * most >= NUM * (size[k] + size[a:b] - most))
        if len(j) >= DENSE and exact is None and room:
            exact = _exact_bits(sets)
            room = exact is not None
        if exact is not None:
            common = np.bitwise_count(exact[j] & exact[k]).sum(1, dtype=np.int64)
        else:
            common = np.array([np.intersect1d(sets[k], sets[x], assume_unique=True).size for x in j.tolist()], np.int64)
        j = j[DEN * common >= NUM * (size[k] + size[j] - common)]
        if len(j):
            yield k, j


def _in_component(count: bool):
    """The links within components, or within a pair of pieces of one. A group holds whole components, or one such pair."""

    def of_group(table: pa.Table) -> pa.Table:
        comp, piece, p, q, ids, copies = (table[c].to_numpy() for c in ("component", "piece", "p", "q", "id", "copies"))
        sets = unpack(table["shingles"], U64)
        size = np.array([len(x) for x in sets], np.int64)
        order = np.lexsort((ids, -size, piece, comp))
        bounds = np.r_[np.flatnonzero(np.r_[True, np.diff(comp[order]) != 0]), len(order)]
        total, left, right = {}, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        add = lambda i, m: total.__setitem__(i, total.get(i, 0) + m)
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            own = order[s:e]
            node, w, n, odd = ids[own], copies[own], np.zeros(e - s, np.int64), {}
            _, back, times = np.unique(node, return_inverse=True, return_counts=True)
            many = times[back] > 1  # ids with several sets: linked once with each other id, whichever sets are alike
            for k, j in _alike_in([sets[x] for x in own], int((piece[own] == p[own[0]]).sum()) if p[own[0]] != q[own[0]] else None):
                twice = many[j] | many[k]
                for x in j[twice].tolist():
                    odd[tuple(sorted(((int(node[k]), int(w[k])), (int(node[x]), int(w[x])))))] = True
                j = j[~twice]
                n[k] += w[j].sum()
                n[j] += w[k]
                if not count:
                    left.append(np.full(len(j), node[k]))
                    right.append(node[j])
            for (x, wx), (y, wy) in odd:
                if x != y:
                    add(x, wy)
                    add(y, wx)
                    left.append(np.array([x]))
                    right.append(np.array([y]))
            for i, m in zip(node[n > 0].tolist(), n[n > 0].tolist()):
                add(i, m)
        if count:
            return pa.table({"id": pa.array(list(total), pa.int64()), "n": pa.array(list(total.values()), pa.int64())})
        a, b = np.concatenate(left), np.concatenate(right)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return of_group


def _component_groups(got: Classes, shingle: int) -> DataFrame:
    """The sets of the components with two different ones or more, dealt to groups of bounded size."""
    nodes = got.reps.select(F.col("rep").alias("id"), "copies", "n").unionByName(got.held.join(got.several, "doc_id").groupBy(F.col("doc_id").alias("id")).agg(F.sum("n").alias("n")).withColumn("copies", F.lit(1).cast("long")))
    nodes = B.saved(nodes.join(got.found.withColumnRenamed("node", "id"), "id"))
    whole = nodes.groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("s")).where("m > 1")
    pieces = F.ceil(F.greatest(F.col("m") / LINK_PIECE, F.col("s") * 8 / LINK_BYTES)).cast("int")
    wanted = B.saved(nodes.join(F.broadcast(whole) if whole.count() <= BROADCAST_IDS else whole, "component").select("id", "component", "copies", pieces.alias("pieces")))
    few = wanted.count() <= BROADCAST_IDS
    rows = got.known.join(F.broadcast(wanted.select("id", "component", "copies")) if few else wanted.select("id", "component", "copies"), "id")
    sets = rows.mapInArrow(_as_sets(shingle), "id long, component long, copies long, shingles binary")
    if not got.several.isEmpty() or got.base.where("n > 0 AND doc_id IS NOT NULL").count() != got.held.count():
        sets = sets.distinct()  # repeated rows
    large = wanted.where("pieces > 1").select("component", "pieces").distinct()
    sets = sets.join(F.broadcast(large) if large.count() <= BROADCAST_IDS else large, "component", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    cut = sets.withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    cut = cut.withColumn("p", F.least("piece", "other")).withColumn("q", F.greatest("piece", "other")).drop("other")
    return cut.withColumn("grp", F.when(F.col("pieces") == 1, F.pmod(F.xxhash64("component"), F.lit(4 * got.parts))).otherwise(F.xxhash64("component", "p", "q")))


def linked(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(a, b), a < b: all links between documents with different sets, each once; of documents with the same one set, the least stands for all."""
    return _component_groups(Classes(docs, shingle), shingle).groupBy("grp").applyInArrow(_in_component(False), "a long, b long")


def report(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every document. n_links: how many other doc_ids it is linked with, copies included."""
    got = Classes(docs, shingle)
    near = B.saved(_component_groups(got, shingle).groupBy("grp").applyInArrow(_in_component(True), "id long, n long").groupBy("id").agg(F.sum("n").alias("near")))
    of_single = got.single().join(got.reps, ["n", "d1", "d2"]).select("doc_id", F.col("rep").alias("id"), (F.col("copies") - 1).alias("equal"))
    named = of_single.where("equal > 0 OR doc_id = id").unionByName(got.several.select("doc_id", F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("equal")))
    counted = named.join(near, "id", "left").select("doc_id", (F.col("equal") + F.coalesce("near", F.lit(0))).alias("n_links"))
    return got.of_rows().join(counted, "doc_id", "left").select("doc_id", "n_shingles", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def classes(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    return Classes(docs, shingle).of_rows()


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents without those that have a smaller one in their class, with all their columns. Rows with the same doc_id share their fate."""
    later = Classes(docs, SHINGLE).found.where("node <> component").select(F.col("node").alias("doc_id"))
    return docs.join(later, "doc_id", "left_anti").select(*docs.columns)


def op8_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
