"""Hybrid retrieval (survey J8): branches, reciprocal-rank fusion, features, rerank, cap for each document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import Embedder, Histogram
from ..plans.stored import small, stored
from . import bounded as U
from . import dense as D
from . import inplace as Z
from . import lexical as L
from .embedding import embedded

BRANCH, RRF_K, POOL, PER_DOCUMENT = 50, 60, 20, 3
STRATEGIES = ("BM25", "DENSE", "RRF", "RRF_RERANK")
TIES = ("file_name", "source_location", "chunk_id")


def sparse_branch(index: L.Index, queries: DataFrame, k: int, extension: str | None = None) -> DataFrame:
    """qid, chunk_id, bm25, rank, and the chunk's names. Chunks are scored where their terms lie."""
    return stored(L.top(Z.best(index, queries, k, extension), "bm25", k, *TIES))


def bounded_branch(index: L.Index, queries: DataFrame, k: int, extension: str | None = None) -> DataFrame:
    """The same rows by ceilings of tokens: for indexes whose frequent tokens have more postings than a search should read."""
    return _named_top(index, U.best(index, queries, k, extension), k)


def _named_top(index: L.Index, scores: DataFrame, k: int) -> DataFrame:
    return stored(L.top(with_chunks(scores, index, "path", "file_name", "source_location"), "bm25", k, *TIES))


def with_chunks(found: DataFrame, index: L.Index, *columns: str) -> DataFrame:
    """What was found (chunk_id, ...) with columns of its chunks. What is found comes to the chunks, so that these are neither sorted nor moved for a few rows."""
    return small(stored(found)).join(index.chunks.select("chunk_id", *columns), "chunk_id")


def embedded_queries(queries: DataFrame, embedder: Embedder = Histogram()) -> DataFrame:
    """qid, embedding of analysed queries."""
    return embedded(queries.select("qid", F.col("subject").alias("text")), "qid", embedder)


def dense_branch(index: L.Index, queries: DataFrame, k: int, extension: str | None = None, asked: DataFrame | None = None) -> DataFrame:
    """qid, chunk_id, dense, rank by the index's vectors. asked: the queries' vectors, of the index's model; the default embedder's if not given."""
    vectors = index.vectors
    if extension:
        vectors = vectors.join(index.chunks.where(L.extension_filter(extension)).select("chunk_id"), "chunk_id", "left_semi")
    return stored(D.nearest(vectors, embedded_queries(queries) if asked is None else asked, k))


def branches(index: L.Index, queries: DataFrame, k: int, extension: str | None = None, asked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Both branches of analysed queries, stored: several strategies may share them."""
    return sparse_branch(index, queries, k, extension), dense_branch(index, queries, k, extension, asked)


def fuse(sparse: DataFrame, dense: DataFrame) -> DataFrame:
    """qid, chunk_id, bm25, dense, rrf, seq: the sum of 1/(60 + rank) over the branches; seq is the order of first sight."""
    both = sparse.select("qid", "chunk_id", "bm25", F.lit(0.0).alias("dense"), "rank", F.col("rank").alias("seq")).unionByName(
        dense.select("qid", "chunk_id", F.lit(0.0).alias("bm25"), "dense", "rank", (F.col("rank") + 1_000_000).alias("seq"))
    )
    return both.groupBy("qid", "chunk_id").agg(F.max("bm25").alias("bm25"), F.max("dense").alias("dense"), F.sum(1 / (RRF_K + F.col("rank"))).alias("rrf"), F.min("seq").alias("seq"))


def normalised(fused: DataFrame) -> DataFrame:
    """bm25 and rrf by their greatest value in the query, held to [0, 1]; fusion is the normalised rrf."""
    over = Window.partitionBy("qid")
    part = lambda c: F.when(F.max(c).over(over) > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c) / F.max(c).over(over)))).otherwise(F.lit(0.0))
    return fused.withColumns({"bm25": part("bm25"), "fusion": part("rrf"), "dense": F.least(F.lit(1.0), F.greatest(F.lit(0.0), "dense"))})


def features(index: L.Index, queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """qid, chunk_id, cosine, exact, name_matches, path_matches, concept_matches, declarations, code_file, feature of the candidates (qid, chunk_id)."""
    ids = small(stored(candidates.select("chunk_id").distinct()))
    terms = L.query_terms(queries)
    n = F.broadcast(index.corpus.select("n"))
    idf = F.log(1 + (F.col("n") + 1) / (F.coalesce("df", F.lit(0)) + 1))
    tf = 1 + F.log(F.greatest(F.lit(1.0), "weight"))
    # the pool's chunks bring their terms with them: postings aren't looked at
    doc = L.postings_of(index.terms.join(ids, "chunk_id", "left_semi")).join(index.df, "token").crossJoin(n).select("chunk_id", "token", (tf * idf).alias("d"))
    held = stored(doc)
    query = stored(terms.join(index.df, "token", "left").crossJoin(n).select("qid", "token", (tf * idf).alias("q")))
    norm = lambda df, key, c: df.groupBy(key).agg(F.sqrt(F.sum(F.col(c) * F.col(c))).alias(f"{c}_norm"))
    pairs = candidates.select("qid", "chunk_id")
    dots = pairs.join(small(query), "qid").join(held, ["chunk_id", "token"]).groupBy("qid", "chunk_id").agg(F.sum(F.col("q") * F.col("d")).alias("dot"), F.count(F.when(F.col("token").startswith("concept:"), 1)).alias("concept_matches"))
    words = terms.where("NOT startswith(token, 'concept:')").groupBy("qid").agg(F.collect_set("token").alias("words"))
    asked = queries.select("qid", "normal", "code_intent", "location_intent").join(words, "qid", "left").join(norm(query, "qid", "q"), "qid", "left")
    chunks = index.chunks.join(ids, "chunk_id", "left_semi").select("chunk_id", "extension", "normal_content", "normal_file_name", "normal_path", "declared", "called")
    rows = pairs.join(chunks, "chunk_id").join(small(stored(asked)), "qid").join(norm(held, "chunk_id", "d"), "chunk_id", "left").join(dots, ["qid", "chunk_id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    size = F.col("q_norm") * F.col("d_norm")
    cosine = F.when(zero(size) == 0, F.lit(0.0)).otherwise(zero("dot") / size)
    count = lambda test: F.greatest(F.lit(0), zero(F.size(F.filter("words", test))))
    declared = lambda w: (F.length(w) >= 3) & (F.array_contains("called", w) | F.exists("declared", lambda d: F.startswith(d, w)))
    rows = rows.select(
        "qid", "chunk_id", "code_intent", "location_intent", cosine.alias("cosine"),
        F.contains("normal_content", "normal").alias("exact"),
        count(lambda w: F.contains("normal_file_name", w)).alias("name_matches"),
        count(lambda w: F.contains("normal_path", w)).alias("path_matches"),
        zero("concept_matches").alias("concept_matches"),
        count(declared).alias("declarations"),
        (F.col("code_intent") & F.lower("extension").isin(*T.SCORED_CODE_EXTENSIONS)).alias("code_file"),
    )
    focused = F.col("code_intent") | F.col("location_intent")
    value = (
        F.col("cosine") * 0.74
        + F.when(F.col("exact"), 0.24).otherwise(0.0)
        + F.col("name_matches") * F.when(focused, 0.09).otherwise(0.035)
        + F.least(F.lit(0.18), F.col("path_matches") * F.when(F.col("location_intent"), 0.055).otherwise(0.02))
        + F.least(F.lit(0.30), F.col("concept_matches") * 0.10)
        + F.when(F.col("code_file"), 0.09).otherwise(0.0)
        + F.least(F.lit(0.32), F.col("declarations") * 0.16)
    )
    return rows.withColumn("feature", value).withColumn("focused", focused)


def reranked(candidates: DataFrame) -> DataFrame:
    """Adds final, from fusion, bm25, dense and the saturated feature."""
    f = F.when(F.col("feature") <= 0, F.lit(0.0)).otherwise(1 - F.exp(-F.col("feature")))
    score = lambda a, b, c, d: F.col("fusion") * a + F.col("bm25") * b + F.col("dense") * c + f * d
    final = F.when(F.col("focused"), score(0.35, 0.20, 0.10, 0.35)).otherwise(score(0.40, 0.20, 0.25, 0.15))
    return candidates.withColumn("final", F.least(F.lit(1.0), F.greatest(F.lit(0.0), final)))


def capped(ranked: DataFrame, score: str, limit: int, *ties: str) -> DataFrame:
    """At most 3 chunks of a document, in order of rank, then at most `limit` for the query; rank counts what is left."""
    order = (F.round(score, 6).desc(), *ties)
    of_path = F.row_number().over(Window.partitionBy("qid", "path").orderBy(*order))
    rows = ranked.withColumn("of_path", of_path).where(F.col("of_path") <= PER_DOCUMENT).drop("of_path")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("rank") <= limit)


def search(index: L.Index, queries: DataFrame, strategy: str = "RRF_RERANK", limit: int = 10, extension: str | None = None, asked: DataFrame | None = None, explain: bool = True, found_by: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """qid, rank, chunk_id, path, file_name, score, reason for each query (qid, query). asked: the queries' vectors, see `dense_branch`. explain: whether BM25's reasons tell of declarations and names that match, which costs the features of what is found. found_by: the `branches` of at least max(4 limit, `BRANCH`) rows, if they are there already."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    queries = L.analysed(queries) if "subject" not in queries.columns else queries
    k = max(4 * limit, BRANCH)
    if strategy == "BM25":
        found = found_by[0] if found_by else sparse_branch(index, queries, k, extension)
        best = F.max("bm25").over(Window.partitionBy("qid"))
        found = found.withColumn("score", F.col("bm25") / best).where(F.col("rank") <= limit)
        if explain:
            found = stored(found)
            matches = features(index, queries, found).select("qid", "chunk_id", "declarations", (F.col("name_matches") + F.col("path_matches")).alias("names"))
            reason = F.when(F.col("declarations") > 0, "BM25, declaration").when(F.col("names") > 0, "BM25, name of the file").otherwise("BM25")
            found = found.join(matches, ["qid", "chunk_id"], "left").withColumn("reason", reason)
        else:
            found = found.withColumn("reason", F.lit("BM25"))
        return found.select("qid", "rank", "chunk_id", "path", "file_name", "score", "reason")
    if strategy == "DENSE":
        found = found_by[1] if found_by else dense_branch(index, queries, k, extension, asked)
        found = with_chunks(found.where(F.col("rank") <= limit), index, "path", "file_name")
        return found.select("qid", "rank", "chunk_id", "path", "file_name", F.col("dense").alias("score"), F.lit("dense").alias("reason"))
    fused = stored(normalised(fuse(*(found_by or branches(index, queries, k, extension, asked)))))
    names = index.chunks.select("chunk_id", "path", "file_name", "source_location")
    named = names.join(small(stored(fused.select("chunk_id").distinct())), "chunk_id", "left_semi")
    pool = stored(L.top(fused.join(small(stored(named)), "chunk_id"), "fusion", max(4 * limit, POOL), "file_name", "seq"))
    if strategy == "RRF":
        return capped(pool.withColumn("score", F.col("fusion")), "score", limit, "file_name", "seq").select("qid", "rank", "chunk_id", "path", "file_name", "score", F.lit("RRF").alias("reason"))
    scored = reranked(pool.drop("rank").join(features(index, queries, pool).select("qid", "chunk_id", "feature", "focused"), ["qid", "chunk_id"]))
    return capped(scored.withColumn("score", F.col("final")), "score", limit, *TIES).select("qid", "rank", "chunk_id", "path", "file_name", "score", F.lit("RRF + local-feature-reranker-v1").alias("reason"))
