"""Postings, corpus statistics, BM25 and TF-IDF (survey D1, D4, E1-E7, G1, C1)."""

from __future__ import annotations

import bisect
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import CONCEPT, CONCEPT_WEIGHT, CONCEPTS, GRAM, HAN_GRAM, HAN_TOKEN, LATIN, STOP_WORDS, WHOLE
from ..functions.vectors import Embedder, Histogram
from ..plans.stored import small, stored
from ..sources.corpus import indexed_text
from .embedding import embedded, text_hash

K1, B = 1.5, 0.75
QUERY_WEIGHT = (0.25, 3.0)
NAMES = ("path", "file_name", "source_location", "extension")
DECLARING = ("class", "interface", "record", "enum", "def", "function")
RUN_BYTES = 4 << 20  # of texts that are split at a time
RUN_POSTINGS = 1 << 19  # that are brought into lists at a time


@dataclass
class Index:
    """Tables of an index. All statistics are over every chunk, whatever a search filters."""

    chunks: DataFrame  # as `prepared` makes them
    terms: DataFrame  # chunk_id, length, terms: array of (token, weight), and the chunk's names
    postings: DataFrame  # token, chunk_id, weight, length
    df: DataFrame  # token, df, most, least: documents, greatest weight, least length
    corpus: DataFrame  # n, avg_length: one row
    vectors: DataFrame  # chunk_id, embedding; none for chunks without text
    by_token: bool = True  # whether the postings are stored; else they are made of the terms


def prepared(chunks: DataFrame) -> DataFrame:
    """The chunks with what every search would have to make of their texts: normal forms of content and names, the names declared and called in it, and the hash of what is embedded."""
    normal = {f"normal_{c}": T.normalise(F.col(c)) for c in ("content", "file_name", "path")}
    rows = chunks.withColumns(normal | {"hash": text_hash(indexed_text())})
    # a name after one of these words may begin anywhere after it, so the pattern takes none of it away; a call stands alone before its bracket
    declared = F.regexp_extract_all("normal_content", F.lit(rf"(?:{'|'.join(DECLARING)}) (?=(\S+))"), 1)
    called = F.regexp_extract_all("normal_content", F.lit(r"(?:^| )([^\s(]+)\("), 1)
    # most texts of prose hold neither: finding one of these words or a bracket is much cheaper than the patterns
    none, some = F.array().cast("array<string>"), F.lit(False)
    for word in DECLARING:
        some = some | F.contains("normal_content", F.lit(f"{word} "))
    declared, called = F.when(some, declared).otherwise(none), F.when(F.contains("normal_content", F.lit("(")), called).otherwise(none)
    return rows.withColumns({"declared": F.array_distinct(declared), "called": F.array_distinct(called)})


def _plain(content: str) -> Column:
    return F.replace(F.lower(content), F.lit("\\"), F.lit("/"))


def folded(chunks: DataFrame) -> DataFrame:
    """Prepared chunks as they are stored: most normal forms are the contents in lower case, and aren't kept beside them."""
    return chunks.withColumn("normal_content", F.when(~F.col("normal_content").eqNullSafe(_plain("content")), F.col("normal_content")))


def unfolded(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("normal_content", F.coalesce("normal_content", _plain("content")))


def terms_of(chunks: DataFrame) -> DataFrame:
    """chunk_id, length, terms, and the names that a search filters by, orders by and returns. A chunk's tokens are added up within its row: no exchange. One without an id has no terms."""
    rows = chunks.select("chunk_id", *NAMES, F.when(F.col("chunk_id").isNotNull(), indexed_text()).otherwise("").alias("text"))
    rows = rows.withColumn("han", T.han_of(F.col("text")))
    names = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("chunk_id", *NAMES))
    return rows.mapInArrow(_added_up, f"length double, terms array<struct<token:string,weight:double>>, {names}").select("chunk_id", "length", "terms", *NAMES)


def _bytes(letters: bytes) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(letters, np.uint8))


_LOWER, _UPPER, _DIGIT, _BLANK = _bytes(b"abcdefghijklmnopqrstuvwxyz"), _bytes(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _bytes(b"0123456789"), _bytes(b" \t\n\x0b\f\r")
_WORD = _LOWER | _DIGIT


def _text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the bounds of each."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, bounds, data = texts.buffers()
    off = np.frombuffer(bounds, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)), off - off[0]


def _normal_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts with their camel-case names split, of normal form and in lower case, as far as tokens depend on it."""
    buf, off = _text_bytes(texts)
    upper = _UPPER[buf]
    split = np.zeros(len(buf) + 1, bool)  # a space comes before
    split[1:-1] = upper[1:] & _WORD[buf[:-1]]
    three = upper[:-2] & upper[1:-1] & _LOWER[buf[2:]]
    three[off[(off >= 2) & (off < len(buf))] - 2] = False  # a name doesn't go on in the next text
    split[1:-2] |= three
    split[off] = False
    at = np.flatnonzero(split)
    buf, off = np.insert(buf, at, 32), off + np.searchsorted(at, off)
    buf = np.where(_UPPER[buf], buf + 32, buf).astype(np.uint8)
    if (buf < 128).all():
        return buf, off
    other = np.diff(np.searchsorted(np.flatnonzero(buf >= 128), off)) > 0
    held = [buf[a:b].tobytes() for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
    for k in np.flatnonzero(other).tolist():
        held[k] = unicodedata.normalize("NFKC", held[k].decode()).lower().encode()
    return np.frombuffer(b"".join(held), np.uint8), np.r_[0, np.cumsum([len(x) for x in held])]


def _words(buf: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The texts' runs of a-z and 0-9, and the text of each."""
    inside = _WORD[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begin, end = off[off < len(buf)], off[off > 0] - 1
    first[begin], last[end] = inside[begin], inside[end]
    first = np.flatnonzero(first)
    bounds = np.r_[0, np.cumsum(np.flatnonzero(last) + 1 - first)].astype(np.int32)
    return pa.StringArray.from_buffers(len(first), pa.py_buffer(bounds), pa.py_buffer(buf[inside])), np.searchsorted(off, first, "right") - 1


def _concepts(buf: np.ndarray, off: np.ndarray) -> tuple[list[str], list[int]]:
    """The concepts of which a phrase stands in a text without its white space, and the text of each. A phrase is looked for in all texts at once."""
    blank = _BLANK[buf]
    solid, bounds = buf[~blank].tobytes(), (off - np.searchsorted(np.flatnonzero(blank), off)).tolist()
    names, rows = [], []
    for name, phrases in CONCEPTS.items():
        found = set()
        for phrase in (p.replace(" ", "").encode() for p in phrases):
            at = solid.find(phrase)
            while at >= 0:
                row = bisect.bisect_right(bounds, at) - 1
                whole = at + len(phrase) <= bounds[row + 1]
                if whole:
                    found.add(row)
                at = solid.find(phrase, bounds[row + 1] if whole else at + 1)
        names += [f"{CONCEPT}{name}"] * len(found)
        rows += sorted(found)
    return names, rows


def _added_up(batches):
    """Each row's tokens with the sums of their weights, as `token_rows` gives them. They stand in order, so that equal texts get equal scores to the last bit wherever they lie."""
    for batch in batches:
        _, off = _text_bytes(batch.column("text"))
        a = 0
        while a < len(off) - 1:
            b = max(a + 1, int(np.searchsorted(off, off[a] + RUN_BYTES, "right")) - 1)
            yield _sums(batch.slice(a, b - a))
            a = b


def _sums(batch: pa.RecordBatch) -> pa.RecordBatch:
    n, (buf, off) = batch.num_rows, _normal_bytes(batch.column("text"))
    words, of_word = _words(buf, off)
    concepts, of_concept = _concepts(buf, off)
    han = batch.column("han").fill_null([])
    of_han = np.repeat(np.arange(n), pa.compute.list_value_length(han).to_numpy())
    row = np.concatenate([of_word, of_han, np.array(of_concept, np.int64)])
    coded = pa.concat_arrays([words, han.flatten().cast(pa.string()), pa.array(concepts, pa.string())]).dictionary_encode()
    form, code = coded.dictionary, coded.indices.to_numpy()
    # what a form means: its token, its weight, and whether it counts
    first = pa.compute.utf8_slice_codeunits(form, 0, 1).to_pylist()
    marked = np.array([c in (WHOLE, GRAM) for c in first], bool)
    plain = pa.compute.if_else(pa.array(marked), pa.compute.utf8_slice_codeunits(form, 1), form)
    distinct = pa.compute.unique(plain)
    distinct = distinct.take(pa.compute.sort_indices(distinct))
    token = pa.compute.index_in(plain, value_set=distinct).to_numpy()
    weight = np.where(np.array([c == WHOLE for c in first], bool), HAN_TOKEN, np.where(marked, HAN_GRAM, LATIN))
    weight = np.where(pa.compute.starts_with(form, CONCEPT).to_numpy(zero_copy_only=False), CONCEPT_WEIGHT, weight)
    counts = (pa.compute.utf8_length(plain).to_numpy() > 1) & ~pa.compute.is_in(plain, value_set=pa.array(STOP_WORDS)).to_numpy(zero_copy_only=False)
    kinds, own = max(1, len(distinct)), counts[code]
    key, at = np.unique(row[own] * kinds + token[code[own]], return_inverse=True)
    total = np.bincount(at, weight[code[own]], minlength=len(key)).astype(float)  # whole numbers if there is none
    row = key // kinds
    bounds = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
    terms = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([distinct.take(pa.array(key % kinds)), pa.array(total)], names=["token", "weight"]))
    length = np.maximum(1.0, np.bincount(row, total, minlength=n))
    return pa.RecordBatch.from_arrays([pa.array(length), terms, *[batch.column(c) for c in ("chunk_id", *NAMES)]], names=["length", "terms", "chunk_id", *NAMES])


def postings_of(terms: DataFrame) -> DataFrame:
    return terms.select("chunk_id", "length", F.explode("terms").alias("t")).select("t.token", "chunk_id", "t.weight", "length")


def _inverted(chunks: int, most: int):
    def of_run(batches, task: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        held = pa.concat_arrays(table["terms"].chunks)
        flat, row = held.flatten(), np.repeat(np.arange(len(held)), pa.compute.list_value_length(held).to_numpy())
        coded = flat.field("token").dictionary_encode()
        code = coded.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        many = np.bincount(code, minlength=len(coded.dictionary))
        at = pa.array(row[order])
        rows = pa.StructArray.from_arrays([pa.concat_arrays(table["chunk_id"].chunks).take(at), flat.field("weight").take(pa.array(order)), pa.concat_arrays(table["length"].chunks).take(at)], names=["chunk_id", "weight", "length"])
        tasks = np.maximum(1, np.ceil(many * (chunks / len(held)) / most)).astype(np.int64)  # by the share of the run's chunks that hold the token
        return pa.RecordBatch.from_arrays([coded.dictionary, pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(many)].astype(np.int32)), rows), pa.array((task % tasks).astype(np.int32))], names=["token", "postings", "apart"])

    def of_batches(batches):
        task, held, count = TaskContext.get().partitionId(), [], 0
        for batch in batches:
            n = pa.compute.sum(pa.compute.list_value_length(batch.column("terms"))).as_py() or 0
            if not n:
                continue
            held.append(batch)
            count += n
            if count >= RUN_POSTINGS:
                yield of_run(held, task)
                task, held, count = task + 1, [], 0
        if held:
            yield of_run(held, task)

    return of_batches


def lists_of(terms: DataFrame, chunks: int = 0, most: int = 1) -> DataFrame:
    """token, postings, apart: a task's postings some at a time as a list for each token, so that far fewer rows than postings are moved and sorted. apart tells the lists of a token apart that may have more than `most` postings among so many chunks: numbers from 0, no more of them than are needed; by an estimate, on which only the deal depends."""
    kind = terms.schema["chunk_id"].dataType.simpleString()
    return terms.select("chunk_id", "length", "terms").mapInArrow(_inverted(chunks, most), f"token string, postings array<struct<chunk_id:{kind},weight:double,length:double>>, apart int")


def statistics(postings: DataFrame) -> DataFrame:
    return postings.groupBy("token").agg(F.count("*").alias("df"), F.max("weight").alias("most"), F.min("length").alias("least"))


def build(chunks: DataFrame, embedder: Embedder = Histogram()) -> Index:
    """The tables of the chunks, each computed once and stored. Chunks are dealt by chunk_id first, so that their texts are split on all cores, then stay dealt so."""
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = stored(prepared(chunks.repartition(parts, "chunk_id")))
    terms = stored(terms_of(chunks.repartition(parts, "chunk_id")))
    postings = stored(postings_of(terms))
    corpus = terms.agg(F.count("*").alias("n"), F.greatest(F.lit(1.0), F.avg("length")).alias("avg_length"))
    vectors = embedded(chunks.select("chunk_id", indexed_text().alias("text")), "chunk_id", embedder)
    return Index(chunks, terms, postings, stored(statistics(postings)), stored(corpus), stored(vectors))


def analysed(queries: DataFrame) -> DataFrame:
    """qid, query, subject, normal, code_intent, location_intent of each query; blank ones are dropped. Stored."""
    subject = T.query_subject(F.col("query"))
    rows = queries.select("qid", "query", subject.alias("subject"), T.code_intent(F.col("query")).alias("code_intent"), T.location_intent(F.col("query")).alias("location_intent")).where(T.strip(F.col("query")) != "")
    return stored(rows.withColumn("normal", T.normalise(F.col("subject"))))


def query_terms(queries: DataFrame) -> DataFrame:
    """qid, token, weight of analysed queries. Stored."""
    return stored(T.token_rows(queries, "qid", F.col("subject"), query=True))


def extension_filter(extension: str | None):
    """A filter for one extension; none for a blank, `all` or `*`."""
    if extension is None or extension.strip() == "" or extension in ("全部", "*") or extension.lower() == "all":
        return F.lit(True)
    return F.lower("extension") == extension.lower()


def weighed(index: Index, terms: DataFrame) -> DataFrame:
    """qid, token, gain, avg_length, ceiling, df of the queries' terms (qid, token, weight) that some chunk holds: a chunk's score for a token is gain times `saturated`, at most ceiling. Stored."""
    clamped = F.least(F.greatest("q", F.lit(QUERY_WEIGHT[0])), F.lit(QUERY_WEIGHT[1]))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # one sided outer joins aren't needed: tokens that no chunk holds score nothing
    rows = index.df.join(small(terms.withColumnRenamed("weight", "q")), "token").crossJoin(F.broadcast(index.corpus))
    rows = rows.withColumn("gain", idf * clamped)
    return stored(rows.select("qid", "token", "gain", "avg_length", (F.col("gain") * saturated("most", "least")).alias("ceiling"), "df"))


def saturated(weight: str, length: str) -> Column:
    """BM25's share of a token's weight in a chunk of a length."""
    return F.col(weight) * (K1 + 1) / (F.col(weight) + K1 * (1 - B + B * F.col(length) / F.col("avg_length")))


def scored(index: Index, weights: DataFrame, extension: str | None) -> DataFrame:
    """qid, chunk_id, bm25 by the given tokens alone. The filter leaves the statistics alone. Postings stay where they lie: the tokens come to them."""
    held = index.postings.join(small(weights.select("qid", "token", "gain", "avg_length")), "token")
    if extension:
        held = held.join(index.chunks.where(extension_filter(extension)).select("chunk_id"), "chunk_id", "left_semi")
    return held.groupBy("qid", "chunk_id").agg(F.sum(F.col("gain") * saturated("weight", "length")).alias("bm25"))


def bm25(index: Index, queries: DataFrame, extension: str | None = None) -> DataFrame:
    """qid, chunk_id, bm25 of all chunks that share a token with a query."""
    return scored(index, weighed(index, query_terms(queries)), extension).where("bm25 > 0")


def top(scores: DataFrame, score: str, k: int, *ties: str) -> DataFrame:
    """The k best rows of each query by the score to six digits, with their rank from 1."""
    order = Window.partitionBy("qid").orderBy(F.round(score, 6).desc(), *ties)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def tfidf(index: Index) -> DataFrame:
    """chunk_id, token, tfidf."""
    weight = (1 + F.log(F.greatest(F.lit(1.0), "weight"))) * F.log(1 + (F.col("n") + 1) / (F.col("df") + 1))
    return index.postings.join(index.df.hint("shuffle_hash"), "token").crossJoin(F.broadcast(index.corpus)).select("chunk_id", "token", weight.alias("tfidf"))


def norms(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("chunk_id").agg(F.sqrt(F.sum(F.col("tfidf") * F.col("tfidf"))).alias("norm"))
