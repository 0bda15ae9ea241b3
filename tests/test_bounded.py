"""Top k by ceilings beside exhaustive scoring: equal rows, fewer postings."""

import random

import pytest
from pyspark.sql import functions as F
from test_published import frame

from heddle.operators import bounded, lexical, published, retrieval

QUERIES = [(1, "common often rare3"), (2, "common often usual"), (3, "rare1 rare2 rare3 rare4"), (4, "usual common rare9 rare9"), (5, "nowhere"), (6, "   ")]


def texts(n, seed):
    r = random.Random(seed)
    return {k: " ".join(["common"] * r.randint(0, 2) + ["often"] * r.randint(0, 1) + ["usual"] * (r.random() < 0.5) + r.choices([f"rare{j}" for j in range(40)], k=r.randint(0, 9)) + r.choices(["a1", "b2", "c3"], k=r.randint(0, 12))) for k in range(n)}


def best(found, k):
    return sorted((r["qid"], r["chunk_id"], round(r["bm25"], 9)) for r in lexical.top(found, "bm25", k, "chunk_id").collect())


@pytest.fixture(scope="module")
def index(spark):
    return lexical.build(frame(spark, texts(400, 1)).withColumn("extension", F.when(F.col("chunk_id") < "c2", "en").otherwise("md")))


@pytest.fixture(scope="module")
def queries(spark):
    return lexical.analysed(spark.createDataFrame(QUERIES, "qid long, query string"))


@pytest.mark.parametrize("k,share,extension", [(1, 0.25, None), (5, 0.25, None), (5, 0.0, "en"), (10, 0.6, None), (1000, 0.25, None)])
def test_equals_exhaustive(index, queries, k, share, extension):
    want = best(lexical.bm25(index, queries, extension), k)
    assert want and best(bounded.best(index, queries, k, extension, share), k) == want


def test_spares_postings(index, queries):
    found, tokens = bounded.candidates(index, queries, 3)
    assert tokens.where("spared").count() > 0
    read = tokens.where("NOT spared").agg(F.sum("df")).first()[0]
    assert read < 0.8 * tokens.agg(F.sum("df")).first()[0]
    assert found.count() < lexical.bm25(index, queries).count() / 2
    assert not tokens.where("strong AND spared").count()


def test_ceilings_hold(index, queries):
    weights = lexical.weighed(index, lexical.query_terms(queries))
    each = index.postings.join(weights, "token").select("ceiling", (F.col("gain") * lexical.saturated("weight", "length")).alias("score"))
    assert each.count() > 0 and each.where(F.col("score") > F.col("ceiling") + 1e-12).isEmpty()


def test_after_updates_and_without_chunks(spark, queries, tmp_path):
    kb, rows = published.Knowledge(spark, str(tmp_path / "kb")), texts(120, 2)
    kb.update(frame(spark, rows))
    rows = {k: t for k, t in rows.items() if k % 3} | {500 + k: t for k, t in texts(30, 3).items()}
    kb.update(frame(spark, rows))
    index = kb.load().index
    assert best(bounded.best(index, queries, 4), 4) == best(lexical.bm25(index, queries), 4)
    names = ("qid", "rank", "chunk_id")
    plain = lambda df: sorted(tuple(r) for r in df.select(*names).collect())
    assert plain(retrieval.bounded_branch(index, queries, 4)) == plain(retrieval.sparse_branch(index, queries, 4))
    empty = lexical.build(frame(spark, {0: "x"}).limit(0))
    assert bounded.best(empty, queries, 4).isEmpty()
