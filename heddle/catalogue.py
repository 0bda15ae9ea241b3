"""The registered queries of the retrieval operators, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import oracle as O
from .functions import text as T
from .operators import dense as D
from .operators import lexical as L
from .operators import published as P
from .operators import retrieval as R
from .plans.stored import stored
from .sources import corpus as C

FLAGSHIP = "hybrid_search"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def _index(spark, sf_dir):
    """The published index of the documents."""
    return P.of_documents(spark, sf_dir).load().index


# lexical statistics


@query(f"WITH {O.POSTINGS} SELECT token, df, round(sum(weight), 6) AS total_weight FROM post JOIN df USING (token) GROUP BY token, df")
def token_df(spark, sf_dir):
    """Document frequency and total weight of every token."""
    return _index(spark, sf_dir).postings.groupBy("token").agg(F.count("*").alias("df"), F.round(F.sum("weight"), 6).alias("total_weight"))


@query(f"WITH {O.POSTINGS} SELECT n, round(avg_length, 6) AS avg_length, (SELECT count(*) FROM df) AS vocabulary FROM corpus")
def corpus_stats(spark, sf_dir):
    """Chunks, average length, vocabulary."""
    index = _index(spark, sf_dir)
    return index.corpus.select("n", F.round("avg_length", 6).alias("avg_length")).crossJoin(F.broadcast(index.df.agg(F.count("*").alias("vocabulary"))))


@query(f"""WITH {O.POSTINGS} SELECT chunk_id, round(sqrt(sum(x * x)), 6) AS norm FROM (
  SELECT chunk_id, (1 + ln(greatest(1.0, weight))) * ln(1 + (n + 1) / (df + 1)) AS x FROM post JOIN df USING (token) CROSS JOIN corpus) GROUP BY chunk_id""")
def tfidf_norm(spark, sf_dir):
    """Length of each chunk's TF-IDF vector."""
    return L.norms(L.tfidf(_index(spark, sf_dir))).select("chunk_id", F.round("norm", 6).alias("norm"))


@query(f"WITH {O.DOCS} SELECT chunk_id, concept FROM (SELECT chunk_id, unnest({O.concept_list(O.NORMAL.format(x='content'))}) AS concept FROM docs)")
def concept_tags(spark, sf_dir):
    """Concepts of each document."""
    compact = C.whole_documents(spark, sf_dir).select("chunk_id", F.regexp_replace(T.normalise(F.col("content")), r"\s+", "").alias("compact"))
    return compact.select("chunk_id", F.explode_outer(T.concepts(F.col("compact"))).alias("concept")).where("concept IS NOT NULL")


# search branches


def _bm25(spark, sf_dir, extension=None):
    found = R.sparse_branch(_index(spark, sf_dir), L.analysed(C.benchmark_queries(spark, sf_dir)), R.BRANCH, extension)
    return found.where("rank <= 10").select("qid", F.col("rank").cast("int").alias("rank"), "chunk_id", F.round("bm25", 6).alias("score"))


_BM25_OUT = "SELECT qid, CAST(rank AS INTEGER) AS rank, chunk_id, round(bm25, 6) AS score FROM sparse WHERE rank <= 10"


@query(f"WITH {O.POSTINGS}, {O.QUERIES}, {O.bm25()} {_BM25_OUT}")
def bm25_topk(spark, sf_dir):
    """The ten best documents for each benchmark item."""
    return _bm25(spark, sf_dir)


@query(f"WITH {O.POSTINGS}, {O.QUERIES}, {O.bm25('en')} {_BM25_OUT}")
def bm25_topk_ext_filter(spark, sf_dir):
    """The same among one extension; the statistics stay those of all documents."""
    return _bm25(spark, sf_dir, "en")


@query(f"WITH {O.POSTINGS}, {O.QUERIES}, {O.bm25()} {_BM25_OUT}")
def bm25_bounded_topk(spark, sf_dir):
    """The ten best documents by ceilings of tokens, without the postings of frequent ones."""
    found = R.bounded_branch(_index(spark, sf_dir), L.analysed(C.benchmark_queries(spark, sf_dir)), 10)
    return found.select("qid", F.col("rank").cast("int").alias("rank"), "chunk_id", F.round("bm25", 6).alias("score"))


_STORED = """q AS (SELECT vec_id AS qid, embedding AS q FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT qid, vec_id AS chunk_id, greatest(0.0, list_dot_product(CAST(q AS DOUBLE[]), CAST(embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(q AS DOUBLE[]), CAST(q AS DOUBLE[])) * list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS dense FROM q CROSS JOIN embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(dense, 6) DESC, chunk_id) AS rank FROM s WHERE dense >= {threshold})"""


def _stored(spark, sf_dir, k, threshold):
    vectors = C.table(spark, sf_dir, "embeddings")
    found = D.nearest(vectors.select(F.col("vec_id").alias("chunk_id"), "embedding"), vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding"), k, threshold)
    return found.select("qid", F.col("rank").cast("int").alias("rank"), "chunk_id", F.round("dense", 6).alias("score"))


@query(f"WITH {_STORED.format(threshold=0.0)} SELECT qid, CAST(rank AS INTEGER) AS rank, chunk_id, round(dense, 6) AS score FROM r WHERE rank <= 10")
def dense_topk(spark, sf_dir):
    """The ten nearest stored vectors of every twentieth one."""
    return _stored(spark, sf_dir, 10, 0.0)


@query(f"WITH {_STORED.format(threshold=0.15)} SELECT qid, CAST(rank AS INTEGER) AS rank, chunk_id, round(dense, 6) AS score FROM r WHERE rank <= 50")
def dense_threshold_topk(spark, sf_dir):
    """A dense branch: at most 50 with a cosine of 0.15 or more."""
    return _stored(spark, sf_dir, R.BRANCH, 0.15)


@query("SELECT label, count(*) AS n, bool_and(coalesce(len(embedding) = 64, false)) AS compatible FROM embeddings GROUP BY label")
def vector_compatibility(spark, sf_dir):
    """Whether all vectors have the index's dimension, for each label."""
    from .functions.vectors import compatible

    return C.table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), compatible(F.col("embedding"), 64).alias("compatible"))


@query(f"WITH {O.DOCS}, {O.QUERIES}, {O.DENSE} SELECT qid, CAST(rank AS INTEGER) AS rank, chunk_id, round(dense, 6) AS score FROM dense WHERE rank <= 10")
def embedded_topk(spark, sf_dir):
    """Dense search with the histogram embedder."""
    found = R.dense_branch(_index(spark, sf_dir), L.analysed(C.benchmark_queries(spark, sf_dir)), R.BRANCH)
    return found.where("rank <= 10").select("qid", F.col("rank").cast("int").alias("rank"), "chunk_id", F.round("dense", 6).alias("score"))


# fusion and ranking

_HYBRID = f"WITH {O.POSTINGS}, {O.QUERIES}, {O.bm25()}, {O.DENSE}, {O.FUSED}"


def _branches(spark, sf_dir):
    index, asked = _index(spark, sf_dir), L.analysed(C.benchmark_queries(spark, sf_dir))
    return index, asked, R.normalised(R.fuse(*R.branches(index, asked, R.BRANCH)))


@query(f"{_HYBRID} SELECT qid, chunk_id, round(bm25, 6) AS bm25, round(dense, 6) AS dense, round(rrf, 6) AS rrf, round(fusion, 6) AS fusion FROM norm")
def rrf_fusion(spark, sf_dir):
    """Both branches fused by reciprocal rank and normalised."""
    return _branches(spark, sf_dir)[2].select("qid", "chunk_id", *[F.round(c, 6).alias(c) for c in ("bm25", "dense", "rrf", "fusion")])


@query(f"""{_HYBRID}, {O.pool(10)}, {O.FEATURES} SELECT qid, chunk_id, round(cosine, 6) AS cosine, exact, CAST(name_matches AS INTEGER) AS name_matches, CAST(path_matches AS INTEGER) AS path_matches,
  concept_matches, CAST(declarations AS INTEGER) AS declarations, code_file, round(feature, 6) AS feature FROM feat""")
def lexical_features(spark, sf_dir):
    """Lexical features of the fused pool."""
    index, asked, fused = _branches(spark, sf_dir)
    pool = stored(L.top(R.with_chunks(fused, index, "path", "file_name", "source_location"), "fusion", 40, "file_name", "seq"))
    found = R.features(index, asked, pool)
    ints = [F.col(c).cast("int").alias(c) for c in ("name_matches", "path_matches", "declarations")]
    return found.select("qid", "chunk_id", F.round("cosine", 6).alias("cosine"), "exact", *ints, F.col("concept_matches").cast("long").alias("concept_matches"), "code_file", F.round("feature", 6).alias("feature"))


_RESULT = "SELECT qid, CAST(rnk AS INTEGER) AS rank, chunk_id, path, round(score, 6) AS score, {reason} AS reason FROM res WHERE rnk <= 10"


def _search(spark, sf_dir, strategy):
    found = R.search(_index(spark, sf_dir), C.benchmark_queries(spark, sf_dir), strategy)
    return found.select("qid", F.col("rank").cast("int").alias("rank"), "chunk_id", "path", F.round("score", 6).alias("score"), "reason")


@query(f"""WITH {O.POSTINGS}, {O.QUERIES}, {O.bm25()}, best AS (SELECT *, bm25 / max(bm25) OVER (PARTITION BY qid) AS score FROM sparse), pool AS (SELECT * FROM best WHERE rank <= 10), {O.FEATURES}
  SELECT qid, CAST(rank AS INTEGER) AS rank, chunk_id, path, round(score, 6) AS score, CASE WHEN declarations > 0 THEN 'BM25, declaration' WHEN name_matches + path_matches > 0 THEN 'BM25, name of the file' ELSE 'BM25' END AS reason FROM pool JOIN feat USING (qid, chunk_id)""")
def bm25_search(spark, sf_dir):
    """BM25 alone, with the reason for each result: a declaration, the file's name or path, or the words."""
    return _search(spark, sf_dir, "BM25")


@query(f"{_HYBRID}, {O.pool(10)}, f2 AS (SELECT *, fusion AS score FROM pool), {O.capped('f2', 'score', 10, 'file_name, seq')} {_RESULT.format(reason=O.quote('RRF'))}")
def rrf_search(spark, sf_dir):
    """Fusion alone, at most three results of a document."""
    return _search(spark, sf_dir, "RRF")


@query(f"{_HYBRID}, {O.pool(10)}, {O.FEATURES}, {O.RERANKED}, {O.capped('fin', 'score', 10, 'file_name, source_location, chunk_id')} {_RESULT.format(reason=O.quote('RRF + local-feature-reranker-v1'))}")
def hybrid_search(spark, sf_dir):
    """The whole pipeline: branches, fusion, features, rerank, cap."""
    return _search(spark, sf_dir, "RRF_RERANK")


# query analysis

_USER = "SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations WHERE role = 'user'"


@query(f"SELECT conv_id, turn, {O.subject('t')} AS subject, regexp_matches(t, {O.quote(T.CODE_INTENT)}) AS code_intent, regexp_matches(t, {O.quote(T.LOCATION_INTENT)}) AS location_intent FROM ({_USER})")
def query_analysis(spark, sf_dir):
    """Every user turn as a query: its subject and its intents."""
    turns = C.table(spark, sf_dir, "conversations").where("role = 'user'")
    return turns.select("conv_id", "turn", T.query_subject(F.col("text")).alias("subject"), T.code_intent(F.col("text")).alias("code_intent"), T.location_intent(F.col("text")).alias("location_intent"))


from . import catalogue_more  # noqa: E402, F401  (registers further queries)
