"""A published index (survey A22, C8, D14, E13, E14, J6, J7, J18, J22): built once, brought up to date by what changed, looked up by key.

A revision holds segments: the tables of the chunks that one build added, bucketed by chunk_id (chunks, terms, vectors) and by
token (postings). An update compares the chunks by id and hash, writes a segment of the new ones alone and a list of the
removed ones, and corrects the statistics by what came and went: document frequencies by token, the number of chunks, and
their lengths, which are whole numbers of tenths, so nothing is lost by adding and taking away. Vectors are taken over by
the hash of their text; only unknown texts are embedded. Many segments, or many removed chunks, are rewritten as one
segment. If the index before is of another model, or lacks vectors, all is built anew.

A knowledge base may do without postings: they repeat each chunk's id for each of its tokens, which is many times the texts
where ids are digests, and a search scores chunks by their terms. Its index makes postings of the terms where they are asked
for. A build's shuffle files go when the table that they are for is written, and its tables are compressed by zstd.

chunk_ids must be unique. An empty table of chunks makes an empty index.
"""

from __future__ import annotations

import hashlib
import time
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import Embedder, Histogram
from ..plans.stored import shared_dir, small, stored
from ..sources import corpus as C
from ..sources.corpus import indexed_text
from ..sources.store import Staging, Store
from . import chunking as K
from . import embedding as E
from . import lexical as L

SEGMENTS = 8  # more are rewritten as one
FREQUENT = 20_000  # postings of a token that one task writes
BUCKET_BYTES, BUCKET_POSTINGS = 16 << 20, 1_000_000  # of contents and of postings in a bucket: a task sorts one at a time, so its memory doesn't grow with the table
LITERALS = 256  # keys that are looked up as literals, which prune buckets and row groups; more are joined
TABLES = {"chunks": "chunk_id", "terms": "chunk_id", "vectors": "chunk_id", "postings": "token"}
CHUNKING = 3
LAYOUT = 3  # of the tables; an index of another one is built anew


@dataclass
class Loaded:
    """A revision: its index, and what an update needs of it."""

    manifest: dict
    index: L.Index
    removed: DataFrame  # segment, chunk_id
    every_vector: DataFrame  # hash, embedding, also of removed chunks

    @property
    def model(self) -> str:
        return self.manifest["model"]


class Knowledge:
    """A knowledge base in a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, folder: str, embedder: Embedder = Histogram(), postings: bool = True):
        """postings: whether the index keeps them, for look-ups by token."""
        self.spark, self.store, self.embedder = spark, Store(spark, folder), embedder
        self.tables = {name: key for name, key in TABLES.items() if postings or name != "postings"}

    # reading

    def load(self) -> Loaded | None:
        """The published revision; None if there is none, a segment of it is missing or its tables are of another layout."""
        found = self.store.load()
        if found is None:
            return None
        manifest, own = found
        if manifest.get("layout") != LAYOUT or manifest["postings"] != ("postings" in self.tables):
            return None
        held: dict[str, list[DataFrame]] = {name: [] for name in self.tables}
        vectors = []
        for segment in manifest["segments"]:
            part = self.store.load(segment["revision"])
            if part is None:
                return None
            gone = own["removed"].where(F.col("segment") == segment["revision"]).select("chunk_id")
            for name in self.tables:
                rows = part[1][name]
                held[name].append(rows.join(small(gone), "chunk_id", "left_anti").select(*rows.columns) if segment["removed"] else rows)
            held["chunks"][-1] = held["chunks"][-1].withColumn("segment", F.lit(segment["revision"]).cast("long"))
            vectors.append(part[1]["vectors"].select("hash", "embedding"))
        union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
        tables = {name: union(frames) for name, frames in held.items()}
        corpus = self.spark.range(1).select(F.lit(manifest["n"]).cast("long").alias("n"), F.lit(manifest["average"]).cast("double").alias("avg_length"))
        postings = tables["postings"] if "postings" in tables else L.postings_of(tables["terms"])
        index = L.Index(L.unfolded(tables["chunks"]), tables["terms"], postings, own["df"], corpus, tables["vectors"].select("chunk_id", "embedding"), "postings" in tables)
        return Loaded(manifest, index, own["removed"], union(vectors))

    def lookup(self, ids: list) -> DataFrame:
        """(chunk_id, found, path, source_location, content) of each id: an id that the published revision lacks is stale, not found."""
        loaded = self.load()
        kind = loaded.index.chunks.schema["chunk_id"].dataType.simpleString() if loaded else "string"
        asked = self.spark.createDataFrame([(x,) for x in dict.fromkeys(ids)], f"chunk_id {kind}")
        if loaded is None:
            return asked.select("chunk_id", F.lit(False).alias("found"), *[F.lit(None).cast("string").alias(c) for c in ("path", "source_location", "content")])
        rows = by_key(loaded.index.chunks, "chunk_id", asked).select("chunk_id", F.lit(True).alias("found"), "path", "source_location", "content")
        return asked.join(rows, "chunk_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))

    # writing

    def update(self, chunks: DataFrame, source: str = "") -> dict | None:
        """Bring the published index to the given chunks (chunk_id, path, file_name, extension, start_line, end_line, source_location, content). The report of the build; None if another one is under way or the sources changed meanwhile."""
        revision = self.store.begin()
        if revision is None:
            return None
        try:
            with Staging(self.store, revision) as staging:
                report = self._built(staging, chunks, source)
            return report if self.store.publish(revision) else None
        except BaseException as failure:
            self.store.fail(revision, str(failure))
            raise

    def _built(self, staging: Staging, chunks: DataFrame, source: str) -> dict:
        with _lean(self.spark):
            return self._written(staging, chunks, source)

    def _written(self, staging: Staging, chunks: DataFrame, source: str) -> dict:
        began, clock = time.time(), []

        def timed(name: str) -> None:
            clock.append((name, time.time()))

        before = self.load()
        if before is not None and not (before.model == self.embedder.signature and before.manifest["whole"]):
            before = None
        added, gone = self._compared(chunks, before)
        timed("compare")
        # the segment of the added chunks, each table from the one before
        parts = self._parts(added)
        counts, lengths = Observation(), Observation()
        new = staging.write("chunks", L.folded(L.prepared(added.repartition(parts, "chunk_id"))).observe(counts, F.count("*").alias("n"), F.count_if(F.length(indexed_text()) > 0).alias("texts")), "chunk_id", dealt=True, buckets=parts)
        timed("chunks")
        terms = staging.write("terms", L.terms_of(new).observe(lengths, F.sum(F.round(F.col("length") * 10)).cast("long").alias("tenths"), F.sum(F.size("terms")).alias("postings")), "chunk_id", dealt=True, buckets=parts)
        timed("terms")
        of_tokens = self._parts_of_postings(lengths.get["postings"])
        postings = L.postings_of(terms)
        if "postings" in self.tables:
            postings = staging.write("postings", L.lists_of(terms, counts.get["n"], max(FREQUENT, 2 * counts.get["n"] // of_tokens)), "token", apart="apart", buckets=of_tokens, lists="postings")
        timed("postings")
        vectors, embedded = self._vectors(new, before)
        vectors = staging.write("vectors", vectors, "chunk_id", buckets=parts)
        timed("vectors")
        n, tenths = counts.get["n"], lengths.get["tenths"] or 0
        segments, removed, rows = [], None, L.statistics(postings)
        whole = vectors.count() == counts.get["texts"]
        removed_n = 0
        if before is not None:
            went = before.index.terms.join(small(gone.select("chunk_id")), "chunk_id", "left_semi")
            lost = stored(went.select("chunk_id", "length"))
            of = gone.groupBy("segment").count().collect()  # a row for each segment
            lost_in = {r["segment"]: r["count"] for r in of}
            removed_n = sum(lost_in.values())
            minus = lost.agg(F.sum(F.round(F.col("length") * 10)).cast("long").alias("t")).first()["t"] or 0
            n, tenths = before.manifest["n"] + n - removed_n, before.manifest["tenths"] + tenths - minus
            segments = [{**s, "removed": s["removed"] + lost_in.get(s["revision"], 0)} for s in before.manifest["segments"]]
            removed = before.removed.unionByName(gone.select("segment", "chunk_id"))
            taken = L.postings_of(went).groupBy("token").agg((-F.count("*")).alias("df"), F.lit(None).cast("double").alias("most"), F.lit(None).cast("double").alias("least"))
            rows = before.index.df.unionByName(rows).unionByName(taken).groupBy("token").agg(F.sum("df").alias("df"), F.max("most").alias("most"), F.min("least").alias("least")).where("df > 0")
        staging.write("df", rows, "token", buckets=of_tokens)
        timed("statistics")
        segments.append({"revision": staging.revision, "n": counts.get["n"], "removed": 0})
        if len(segments) > SEGMENTS or sum(s["removed"] for s in segments) > n:
            segments, removed = self._compacted(staging, before, {"chunks": new, "terms": terms, "postings": postings, "vectors": vectors}, gone, n)
        none = self.spark.createDataFrame([], f"segment long, chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}")
        staging.write("removed", none if removed is None else removed)
        timed("publish")
        seconds = {name: round(t - (clock[k - 1][1] if k else began), 3) for k, (name, t) in enumerate(clock)}
        report = {"added": counts.get["n"], "removed": removed_n, "embedded": embedded, "chunks": n, "segments": len(segments), "seconds": seconds}
        staging.commit({"model": self.embedder.signature, "dimension": self.embedder.dimension, "chunking": CHUNKING, "layout": LAYOUT, "source_hash": source, "n": n, "tenths": tenths, "average": max(1.0, tenths / 10 / n if n else 1.0), "postings": "postings" in self.tables, "segments": segments, "uses": [s["revision"] for s in segments], "whole": whole and (before is None or before.manifest["whole"]), "report": report})
        return report

    def _parts(self, chunks: DataFrame) -> int:
        """Buckets of the tables by chunk_id: as many as the session has shuffle partitions, or more, so that each holds `BUCKET_BYTES` of contents at most, by and large."""
        held = chunks.agg(F.sum(F.octet_length("content"))).first()[0] or 0
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-held // BUCKET_BYTES))

    def _parts_of_postings(self, n: int | None) -> int:
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-(n or 0) // BUCKET_POSTINGS))

    def _compared(self, chunks: DataFrame, before: Loaded | None) -> tuple[DataFrame, DataFrame | None]:
        """The chunks that the index before lacks, and its rows (segment, chunk_id) that are there no more."""
        if before is None:
            return chunks, None
        here = chunks.select("chunk_id", E.text_hash(indexed_text()).alias("hash"), F.lit(True).alias("here"))
        there = before.index.chunks.select("chunk_id", "hash", "segment")
        both = stored(here.join(there, ["chunk_id", "hash"], "full_outer").where("here IS NULL OR segment IS NULL"))
        return chunks.join(small(both.where("segment IS NULL").select("chunk_id")), "chunk_id", "left_semi"), both.where("here IS NULL").select("segment", "chunk_id")

    def _vectors(self, new: DataFrame, before: Loaded | None) -> tuple[DataFrame, int]:
        """(chunk_id, hash, embedding) of the new chunks, and how many texts were embedded for them."""
        texts = new.select(F.col("chunk_id").alias("id"), "hash", indexed_text().alias("text"))
        known = before.every_vector if before is not None else self.spark.createDataFrame([], "hash string, embedding array<double>")
        made = stored(E.embedded(E.unknown(texts, known), "hash", self.embedder).dropDuplicates(["hash"]))
        usable = known.join(small(stored(new.select("hash").distinct())), "hash", "left_semi").groupBy("hash").agg(F.any_value("embedding").alias("embedding")) if before is not None else known
        return new.select("chunk_id", "hash").join(usable.unionByName(made), "hash").select("chunk_id", "hash", "embedding"), made.count()

    def _compacted(self, staging: Staging, before: Loaded, new: dict[str, DataFrame], gone: DataFrame, n: int) -> tuple[list[dict], None]:
        """All that is left as one segment in place of the new one: nothing is tokenised or embedded again."""
        out = small(gone.select("chunk_id"))
        old = {"chunks": L.folded(before.index.chunks.drop("segment")), "terms": before.index.terms, "postings": before.index.postings}
        old["vectors"] = before.index.vectors.join(before.index.chunks.select("chunk_id", "hash"), "chunk_id").select("chunk_id", "hash", "embedding")
        parts = {"chunk_id": self._parts(old["chunks"].select("content").unionByName(new["chunks"].select("content"))), "token": self._parts_of_postings(old["postings"].count() + new["postings"].count())}
        for name, key in self.tables.items():
            rows = old[name].join(out, "chunk_id", "left_anti").select(*new[name].columns).unionByName(new[name])
            staging.replace(name, rows, key, parts[key])
        return [{"revision": staging.revision, "n": n, "removed": 0}], None


@contextmanager
def _bucket_by_bucket(spark: SparkSession):
    """Within it a task that reads a bucketed table reads one bucket. Else Spark may hand a task many files at once where no join or group needs the buckets, and the more the larger the table is."""
    name = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def by_key(table: DataFrame, key: str, asked: DataFrame) -> DataFrame:
    """The rows of a table with one of the keys asked for: few keys as literals, so that only their buckets and row groups are read; more by a join."""
    few = asked.select(key).where(F.col(key).isNotNull()).distinct().limit(LITERALS + 1).collect()
    if len(few) <= LITERALS:
        return table.where(F.col(key).isin(*[r[0] for r in few])) if few else table.limit(0)
    return table.join(small(stored(asked.select(key).distinct())), key, "left_semi")


def signature_of(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of a table's files."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files, found = fs.listFiles(at, True), []
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath().getName()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


@contextmanager
def _lean(spark: SparkSession):
    """Within it tasks read bucket by bucket, the files of a job's shuffles go when it has ended, and tables are compressed well."""
    lean = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}
    before = {name: spark.conf.get(name) for name in lean}
    for name, value in lean.items():
        spark.conf.set(name, value)
    try:
        with _bucket_by_bucket(spark):
            yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _kept(spark: SparkSession, sf_dir: str, kind: str, chunks, postings: bool = True) -> Knowledge:
    """The knowledge base of a table of documents, brought up to date if the table isn't the one it was built from."""
    source, app = signature_of(spark, f"{sf_dir}/documents.parquet"), spark.sparkContext.applicationId
    kb = Knowledge(spark, f"{shared_dir(spark)}/{kind}-{hashlib.sha256(f'{app} {sf_dir}'.encode()).hexdigest()[:16]}", postings=postings)
    found = kb.store.load()
    if found is None or found[0]["source_hash"] != source:
        if kb.update(chunks(C.whole_documents(spark, sf_dir)), source) is None:
            raise RuntimeError("another build of this knowledge base is under way")
    return kb


def of_documents(spark: SparkSession, sf_dir: str) -> Knowledge:
    """Each document a chunk."""
    return _kept(spark, sf_dir, "documents", lambda docs: docs)


def of_chunks(spark: SparkSession, sf_dir: str) -> Knowledge:
    """The documents' prose chunks. No query looks their postings up by token."""
    return _kept(spark, sf_dir, "chunks", K.chunks, postings=False)
