"""BM25's best chunks without the postings of frequent tokens (survey E6, G1).

A token gives a chunk at most its ceiling, from the token's greatest weight and its least length. Each query's strongest
tokens, by ceiling, are scored from their postings; the k-th best sum is a bound that the k best chunks reach in any case.
The weakest tokens whose ceilings together stay below that bound can't bring a chunk among the best by themselves, so
their postings aren't read: they are looked up in the terms of those chunks alone that they may still lift to the bound.
The result holds the k best chunks of each query, ties by rounded score included, with the scores that exhaustive scoring
gives. Updates of a published index may leave ceilings too high, never too low, so bounds hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stored import small, stored
from . import lexical as L

STRONG = 0.25  # of a query's postings are scored at first, but its strongest token in any case
MARGIN = 1e-5  # scores are ranked by six digits, so a chunk just below the bound may tie


def _bound(partial: DataFrame, k: int) -> DataFrame:
    """(qid, bound): the k-th best score of each query that has k rows. Each task keeps its k best before rows are exchanged."""
    order = Window.partitionBy("qid").orderBy(F.desc("bm25"))
    return partial.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).groupBy("qid").agg(F.min("bm25").alias("bound"), F.count("*").alias("n")).where(F.col("n") == k).select("qid", "bound")


def plan(weights: DataFrame, share: float = STRONG) -> DataFrame:
    """The queries' tokens (`lexical.weighed`) with strong: scored at first."""
    by_ceiling = Window.partitionBy("qid").orderBy(F.desc("ceiling"), "token")
    read = F.sum("df").over(by_ceiling.rowsBetween(Window.unboundedPreceding, 0))
    return weights.withColumn("strong", (F.row_number().over(by_ceiling) == 1) | (read <= share * F.sum("df").over(Window.partitionBy("qid"))))


def spared(tokens: DataFrame, bounds: DataFrame) -> DataFrame:
    """The tokens with spared: weak ones, from the weakest on, whose ceilings together stay below the query's bound."""
    weakest = Window.partitionBy("qid", "strong").orderBy("ceiling", "token").rowsBetween(Window.unboundedPreceding, 0)
    together = F.sum("ceiling").over(weakest)
    return tokens.join(small(stored(bounds)), "qid", "left").withColumn("spared", ~F.col("strong") & (together < F.coalesce("bound", F.lit(0.0)) - MARGIN))


def candidates(index: L.Index, queries: DataFrame, k: int, extension: str | None = None, share: float = STRONG) -> tuple[DataFrame, DataFrame]:
    """(qid, chunk_id, bm25) by the tokens that were scored, of the chunks that may be among the k best; and the tokens with strong and spared. Both stored."""
    tokens = stored(plan(L.weighed(index, L.query_terms(queries)), share))
    first = stored(L.scored(index, tokens.where("strong"), extension))
    tokens = stored(spared(tokens, _bound(first, k)))
    more = L.scored(index, tokens.where("NOT strong AND NOT spared"), extension)
    partial = stored(first.unionByName(more).groupBy("qid", "chunk_id").agg(F.sum("bm25").alias("bm25")))
    rest = tokens.where("spared").groupBy("qid").agg(F.sum("ceiling").alias("rest"))
    limits = stored(_bound(partial, k).join(rest, "qid", "left").select("qid", (F.col("bound") - F.coalesce("rest", F.lit(0.0)) - MARGIN).alias("least")))
    reach = partial.join(small(limits), "qid", "left").where(F.col("bm25") >= F.coalesce("least", F.lit(0.0)))
    return stored(reach.select("qid", "chunk_id", "bm25")), tokens


def best(index: L.Index, queries: DataFrame, k: int, extension: str | None = None, share: float = STRONG) -> DataFrame:
    """(qid, chunk_id, bm25) of the k best chunks of each analysed query at least, and of others that came near."""
    found, tokens = candidates(index, queries, k, extension, share)
    left = tokens.where("spared").select("qid", "token", "gain", "avg_length")
    terms = index.terms.join(small(stored(found.select("chunk_id").distinct())), "chunk_id", "left_semi")
    held = terms.select("chunk_id", "length", F.explode("terms").alias("t")).select("chunk_id", "length", "t.token", "t.weight").join(small(stored(left)), "token")
    added = held.join(small(found.select("qid", "chunk_id")), ["qid", "chunk_id"]).groupBy("qid", "chunk_id").agg(F.sum(F.col("gain") * L.saturated("weight", "length")).alias("bm25"))
    return found.unionByName(added).groupBy("qid", "chunk_id").agg(F.sum("bm25").alias("bm25")).where("bm25 > 0")
