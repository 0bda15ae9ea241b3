"""Incremental builds of an index (survey D6, J6, J7): what can be reused is, the rest is read and chunked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.stored import stored
from ..sources import readers as R
from . import chunking as K
from . import planner as P

CHUNKING = 3


def hashed(documents: DataFrame, before: DataFrame | None = None, verify: bool = False) -> DataFrame:
    """The documents with content_hash; one known from before is taken over where size and time are the same, unless all are to be verified. Only the others are read."""
    if before is not None and not verify:
        known = before.select(*P.KEY, F.col("size").alias("_s"), F.col("modified_at").alias("_t"), "content_hash")
        rows = documents.join(known, P.KEY, "left").withColumn("content_hash", F.when((F.col("_s") == F.col("size")) & (F.col("_t") == F.col("modified_at")), F.col("content_hash"))).drop("_s", "_t")
    else:
        rows = documents.withColumn("content_hash", F.lit(None).cast("string"))
    return stored(rows.mapInArrow(_hash, rows.schema))


def _hash(batches):
    import hashlib

    import pyarrow as pa

    for batch in batches:
        out = []
        for path, known in zip(batch.column("path").to_pylist(), batch.column("content_hash").to_pylist()):
            if known is None:
                digest = hashlib.sha256()
                with open(path, "rb") as f:
                    while block := f.read(1 << 20):
                        digest.update(block)
                known = digest.hexdigest()
            out.append(known)
        at = batch.schema.get_field_index("content_hash")
        yield batch.set_column(at, batch.schema.field(at), pa.array(out, pa.string()))


def chunked(units: DataFrame) -> DataFrame:
    """Chunks of read units. A section is a document to the chunker; its lines are those of its units, so locations count units."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "text"))), lambda u: u["text"]), "\n")  # a file's size is bounded by its reader
    rows = units.where("error IS NULL").groupBy("root", "path", "relative_path", "section").agg(F.max("label").alias("label"), text.alias("content"))
    named = rows.select(F.struct("root", "relative_path", "section", "label").alias("chunk_id"), "path", F.regexp_extract("path", "([^/]+)$", 1).alias("file_name"), T.extension(F.col("path")).alias("extension"), "content")
    made = K.chunks(named).select("doc_id.root", "doc_id.relative_path", "path", "file_name", "extension", "start_line", "end_line", F.concat(F.when(F.col("doc_id.label") != "", F.concat("doc_id.label", F.lit(" · "))).otherwise(F.lit("")), "source_location").alias("source_location"), "content", F.col("doc_id.section").alias("section"))
    return made.withColumn("id", F.sha1(F.concat_ws(":", "path", F.col("section").cast("string"), "source_location", "content"))).drop("section")


def build(documents: DataFrame, before: dict[str, DataFrame] | None = None, verify: bool = False, readers: dict = R.READERS) -> dict[str, DataFrame]:
    """chunks, entries, plan and warnings of the documents of a scan, given the chunks and entries of the revision before. All are stored."""
    old = before and before["entries"]
    files = hashed(documents, old, verify)
    if old is None:
        plan = files.select(*P.KEY, F.lit("added").alias("action"))
    else:
        plan = P.plan(old.withColumn("chunking_version", F.col("chunking_version")), files, CHUNKING)
        # an entry whose chunks aren't all there is read again
        whole = P.reusable(old, before["chunks"]).where("whole")
        plan = plan.join(whole.select(*P.KEY, "whole"), P.KEY, "left").withColumn("action", F.when((F.col("action") == "reused") & F.col("whole").isNull(), "modified").otherwise(F.col("action"))).drop("whole")
    plan = stored(plan)
    units = stored(R.read(files.join(plan.where("action IN ('added', 'modified')"), P.KEY, "left_semi"), readers))
    chunks = chunked(units)
    if old is not None:
        chunks = chunks.unionByName(before["chunks"].join(plan.where("action = 'reused'"), P.KEY, "left_semi"))
    chunks = stored(chunks)
    ids = chunks.groupBy(*P.KEY).agg(F.array_sort(F.collect_set("id")).alias("chunk_ids"))
    entries = files.join(ids, P.KEY, "left").select(*P.KEY, "size", "modified_at", "content_hash", "reader_id", "reader_version", F.lit(CHUNKING).alias("chunking_version"), F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"))
    warnings = units.where("error IS NOT NULL").select("path", "reader_id", F.col("error").alias("message"), F.lit(True).alias("skipped"))
    return {"chunks": chunks, "entries": stored(entries), "plan": plan, "warnings": warnings}


def indexable(built: dict[str, DataFrame]) -> DataFrame:
    """The chunks of a build as `published.Knowledge.update` takes them: it embeds and indexes those alone that it hasn't got yet."""
    return built["chunks"].select(F.col("id").alias("chunk_id"), "path", "file_name", "extension", "start_line", "end_line", "source_location", "content")
