"""Best-fit packing by a grouping genetic algorithm on islands.

Documents are tokenized, closed with id 0 and cut into pieces of at most `CAPACITY` tokens. Pieces are dealt
to groups of about `GROUP_ITEMS`; each group is evolved on several islands. An individual is a set of bins.
It starts as a best fit of the pieces in falling order, shaken a little. Crossover injects whole well-filled
bins of one parent into the other, removes the bins that hold a piece twice by that, and best-fits the
displaced pieces. Fewer bins are fitter; among as many, fuller ones are, which leaves room in one place. Where the
best fit has as few bins as the tokens' sum allows the search is short, else it takes `HARD` times as long. After an
epoch each island sends its elite to the next island of its group; after the last, the group takes the best.
Pieces are dealt by a row number that is written once, so repeated rows spread over the groups.

Nulls: a null or empty text is one piece of one token (id 0); null doc_ids and repeated rows are packed like
all others. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .textarrays import Words, slices, space_split_table, worker_state

CAPACITY = 2048
GROUP_ITEMS = 20_000
ISLANDS, POPULATION, GENERATIONS, EPOCHS = 3, 4, 3, 2
HARD = 8  # times as many generations while a bin more than the bound is in use
TOKENIZER = "word_bpe_49k.json"
END = 0
MARK = b"\x01"
CACHE_WORDS = 3_000_000
_TABLE = space_split_table()
_SPACE = ~_TABLE
_SIGN = np.isin(np.arange(256), np.frombuffer(b"!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~", np.uint8))
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def units(words: Words) -> Words:
    """The words cut, where that is safe, into runs of letters and of signs, in lower case: these recur far more often than words do.

    The tokenizer lower-cases and never joins letters with signs. Words with an apostrophe, a digit, the sign
    that may begin a special token, or a character beyond Latin letters are left whole.
    """
    buf, n = words.buf, len(words.buf)
    if not len(words):
        return words
    low = buf | 0x20
    kind = np.full(n, 3, np.uint8)
    kind[(low >= 97) & (low <= 122) & (buf < 128)] = 1
    kind[_SIGN[buf]] = 2
    kind[_SPACE[buf]] = 0
    lead = np.flatnonzero(buf[:-1] == 0xC3)
    lead = lead[(buf[lead + 1] & 0xC0 == 0x80) & (buf[lead + 1] != 0x97) & (buf[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = 1
    odd = np.r_[0, np.cumsum(kind == 3)]
    simple = odd[words.ends] == odd[words.starts]
    edge = np.zeros(n + 1, np.int8)
    edge[words.starts[simple]] += 1
    edge[words.ends[simple]] -= 1
    inside = np.cumsum(edge[:-1]).astype(bool)
    out = buf.copy()
    out[inside & (kind == 1) & (buf >= 65) & (buf <= 90)] += 32
    upper = lead[(buf[lead + 1] <= 0x9E) & inside[lead]] + 1
    out[upper] += 32
    cut = np.zeros(n, bool)
    cut[1:] = inside[1:] & inside[:-1] & (kind[1:] != kind[:-1])
    cut[words.starts] = False
    at = np.flatnonzero(cut)
    made = object.__new__(Words)
    made.buf, made.doc_off = out, words.doc_off
    made.starts, made.ends = np.sort(np.r_[words.starts, at]), np.sort(np.r_[words.ends, at])
    made.off = np.searchsorted(made.starts, words.doc_off).astype(np.int64)
    return made


class WordTokens:
    """Ids of words, learnt from the tokenizer as they come. It drops white space and works on each word between white space alone, so a text's ids are those of its words in turn."""

    def __init__(self, path: str | None):
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        self.tokenizer = Tokenizer.from_file(path)
        (self.mark,) = self.encode(MARK)
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def coded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and all ids. The words go through the tokenizer as one text with a mark between them, which is one token; words that hold the mark go alone."""
        alone = [k for k, w in enumerate(words) if MARK in w]
        text = b" ".join(x for k, w in enumerate(words) for x in ((w, MARK) if MARK not in w else (MARK,)))
        ids = np.array(self.encode(text), np.uint32)
        end = np.flatnonzero(ids == self.mark)
        n = np.diff(np.r_[-1, end]) - 1
        pool = ids[ids != self.mark]
        if alone:
            own = {k: np.array(self.encode(words[k]), np.uint32) for k in alone}
            parts = np.split(pool, np.cumsum(n)[:-1])
            pool = np.concatenate([own.get(k, part) for k, part in enumerate(parts)])
            n[alone] = [len(own[k]) for k in alone]
        return n.astype(np.int64), pool

    def encode(self, text: bytes) -> list[int]:
        return self.tokenizer.encode_batch_fast([text.decode("utf-8", "replace")], add_special_tokens=False)[0].ids

    def ids(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the bounds of each text in them."""
        words = units(words)
        h = words.hashes()
        unique, first, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) > CACHE_WORDS:
            self.clear()
        new = np.flatnonzero(B.sorted_find(self.known, unique) < 0)
        if len(new):
            n, pool = self.coded([words.place(i) for i in first[new]])
            at = len(self.pool) + np.r_[0, np.cumsum(n)[:-1]]
            self.pool = np.concatenate([self.pool, pool])
            where = np.searchsorted(self.known, unique[new])
            self.known, self.at, self.n = (np.insert(x, where, y) for x, y in ((self.known, unique[new]), (self.at, at), (self.n, n)))
        place = np.searchsorted(self.known, unique)[back] if len(unique) else np.zeros(0, np.int64)
        n = self.n[place]
        ends = np.r_[0, np.cumsum(n)]
        ids = self.pool[np.repeat(self.at[place] - ends[:-1], n) + np.arange(ends[-1])]
        return ids, ends[words.off]


def _pieces(path: str | None):
    def of_batches(batches):
        state = worker_state().__dict__.setdefault("tokens", {})
        if path not in state:
            state[path] = WordTokens(path)
        tokens = state[path]
        for batch in batches:
            for a, b, buf, off in slices(batch.column("text")):
                ids, bounds = tokens.ids(Words(buf, off, _TABLE))
                out = []
                for d in range(b - a):
                    own = np.append(ids[bounds[d] : bounds[d + 1]], np.uint32(END)).astype("<u4")
                    out += [(d, k, s, min(CAPACITY, len(own) - s), zlib.crc32(own[s : s + CAPACITY])) for k, s in enumerate(range(0, len(own), CAPACITY))]
                row, piece, start, length, crc = (np.array(x, np.int64) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a).take(pa.array(row)), *map(pa.array, (piece.astype(np.int32), start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return of_batches


def pieces(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of the pieces of every document. tokenizer: a file's path, the same on all executors."""
    B.small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_pieces(tokenizer), PIECES)


class Bins:
    """Bins that are filled by best fit: the fullest bin that has room, found by a bit mask of the rooms in use."""

    def __init__(self, capacity: int):
        self.capacity, self.items, self.fill = capacity, [], []
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def add_bin(self, items: list[int], fill: int) -> None:
        self._offer(len(self.items), self.capacity - fill)
        self.items.append(items)
        self.fill.append(fill)

    def _offer(self, k: int, room: int) -> None:
        if not self.by_room[room]:
            self.mask |= 1 << room
        self.by_room[room].append(k)

    def put(self, item: int, size: int) -> None:
        fit = self.mask >> size
        if not fit:
            return self.add_bin([item], size)
        room = (fit & -fit).bit_length() - 1 + size
        k = self.by_room[room].pop()
        if not self.by_room[room]:
            self.mask &= ~(1 << room)
        self.items[k].append(item)
        self.fill[k] += size
        self._offer(k, room - size)

    def loosen(self, displaced: list[int]) -> None:
        """Take the bin with most room apart."""
        if self.items:
            k = min(range(len(self.fill)), key=self.fill.__getitem__)
            displaced += self.items[k]
            kept = [(items, fill) for j, (items, fill) in enumerate(zip(self.items, self.fill)) if j != k]
            self.__init__(self.capacity)
            for items, fill in kept:
                self.add_bin(items, fill)

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then fuller ones: the mean square of the fills."""
        return -len(self.items), sum((f / self.capacity) ** 2 for f in self.fill) / max(1, len(self.fill))


def best_fit(size: list[int], order, capacity: int) -> Bins:
    bins = Bins(capacity)
    for i in order:
        bins.put(i, size[i])
    return bins


def crossover(mother: Bins, father: Bins, size: list[int], rng: random.Random) -> Bins:
    """The mother with some of the father's well-filled bins in place of those of hers that share a piece with them."""
    share = rng.random()
    chosen = [father.items[k] for k, f in enumerate(father.fill) if f >= 0.995 * father.capacity and rng.random() < share]
    taken = {i for items in chosen for i in items}
    child, displaced = Bins(mother.capacity), []
    for items in chosen:
        child.add_bin(list(items), sum(size[i] for i in items))
    for items, fill in zip(mother.items, mother.fill):
        if taken.isdisjoint(items):
            child.add_bin(list(items), fill)
        else:
            displaced += [i for i in items if i not in taken]
    # one of the bins with most room goes, too: only so can a child have a bin less
    child.loosen(displaced)
    for i in sorted(displaced, key=lambda i: -size[i]):
        child.put(i, size[i])
    return child


def evolve(size: list[int], capacity: int, seed: int, guests: list[Bins] = []) -> Bins:  # noqa: B006
    """The best individual of one island after an epoch. size: in falling order."""
    least, rng = -(-sum(size) // capacity), random.Random(seed)
    people = list(guests)
    while len(people) < POPULATION:
        # the first is a best fit in falling order; the others come from orders that are shaken more and more
        shake = (0.01 + 0.1 * rng.random()) * capacity * (len(people) > 0)
        people.append(best_fit(size, sorted(range(len(size)), key=lambda i: -size[i] - shake * rng.random()) if shake else range(len(size)), capacity))
    people.sort(key=Bins.fitness, reverse=True)
    for k in range(GENERATIONS * HARD):
        if k >= GENERATIONS and len(people[0].items) <= least:
            break
        mother, father = rng.sample(people, 2)
        people.append(crossover(mother, father, size, rng))
        people.sort(key=Bins.fitness, reverse=True)
        del people[POPULATION:]
    return people[0]


def _coded(best: Bins, n: int) -> bytes:
    out = np.zeros(n, np.int32)
    for k, items in enumerate(best.items):
        out[items] = k
    return out.tobytes()


def _decoded(coded: bytes, size: list[int], capacity: int) -> Bins:
    bins, held = Bins(capacity), {}
    for i, k in enumerate(np.frombuffer(coded, np.int32).tolist()):
        held.setdefault(k, []).append(i)
    for items in held.values():
        bins.add_bin(items, sum(size[i] for i in items))
    return bins


_ORDER = [("length", "descending"), ("row", "ascending")]
ISLAND = "grp int, island int, sizes binary, best binary"
_ISLAND = pa.schema([("grp", pa.int32()), ("island", pa.int32()), ("sizes", pa.binary()), ("best", pa.binary())])


def _settle(table: pa.Table) -> pa.Table:
    size = table.sort_by(_ORDER)["length"].to_numpy().astype(np.uint16).tobytes()
    return pa.table({"grp": [table["grp"][0].as_py()] * ISLANDS, "island": list(range(ISLANDS)), "sizes": [size] * ISLANDS, "best": [None] * ISLANDS}, schema=_ISLAND)


def _epoch(capacity: int, epoch: int):
    def of_island(table: pa.Table) -> pa.Table:
        """One epoch; the elite goes on to this island and to the next."""
        grp, island = table["grp"][0].as_py(), table["island"][0].as_py()
        raw = next(x for x in table["sizes"].to_pylist() if x is not None)
        size = np.frombuffer(raw, np.uint16).tolist()
        guests = [_decoded(x, size, capacity) for x in sorted({x for x in table["best"].to_pylist() if x is not None})]
        best = _coded(evolve(size, capacity, grp * 1009 + island * 31 + epoch, guests), len(size))
        return pa.table({"grp": [grp, grp], "island": [island, (island + 1) % ISLANDS], "sizes": [raw, None], "best": [best, best]}, schema=_ISLAND)

    return of_island


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _place(capacity: int):
    def of_group(left: pa.Table, right: pa.Table) -> pa.Table:
        table = left.sort_by(_ORDER)
        length = table["length"].to_numpy()
        size = length.tolist()
        best = max((_decoded(x, size, capacity) for x in sorted(set(right["best"].to_pylist()))), key=Bins.fitness)
        bin_of, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for k, items in enumerate(best.items):
            at = 0
            for i in items:
                bin_of[i], offset[i] = k, at
                at += size[i]
        table = table.drop_columns(["grp", "row"])
        return table.append_column("sequence_id", pa.array((table_group(left) << 32) + bin_of)).append_column("offset", pa.array(offset))

    return of_group


def table_group(table: pa.Table) -> int:
    return int(table["grp"][0].as_py())


def packed(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset. A piece that fills a sequence has one to itself."""
    columns = items.columns
    items = B.saved(items.withColumn("row", F.monotonically_increasing_id()))
    n = items.where(F.col("length") < capacity).count()
    groups = max(1, round(n / GROUP_ITEMS))
    # groups get one number of pieces or nearly so, full pieces apart: those need no packing
    dealt = items.where(F.col("length") < capacity).withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"))
    # islands are few bytes and much work, so their number of tasks is given: by bytes they would be put into one
    tasks = B.partitions(items.sparkSession)
    dealt = dealt.repartition(min(groups, tasks), "grp")
    islands = dealt.groupBy("grp").applyInArrow(_settle, ISLAND)
    for epoch in range(EPOCHS):
        islands = islands.repartition(min(groups * ISLANDS, tasks), "grp", "island").groupBy("grp", "island").applyInArrow(_epoch(capacity, epoch), ISLAND)
    bests = islands.select("grp", "best").repartition(min(groups, tasks), "grp")
    out = dealt.groupBy("grp").cogroup(bests.groupBy("grp")).applyInArrow(_place(capacity), PACKED)
    full = items.where(F.col("length") >= capacity).select(*columns, (F.col("row") + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return out.unionByName(full)


def pack(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of the documents."""
    return packed(pieces(docs, tokenizer))


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
