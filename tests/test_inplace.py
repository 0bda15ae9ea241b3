"""Scoring where the terms lie beside exhaustive scoring; no pairs are shuffled, texts stay where they are."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F
from test_bounded import QUERIES, best, texts
from test_published import frame, plan

from heddle.functions import text as T
from heddle.operators import context, inplace, lexical, published, retrieval
from heddle.sources.corpus import indexed_text


@pytest.fixture(scope="module")
def index(spark):
    rows = texts(300, 4) | {1000 + k: "usual common rare9" for k in range(60)}  # copies tie
    rows = frame(spark, rows).withColumn("extension", F.when(F.col("chunk_id") < "c2", "en").otherwise("md"))
    return lexical.build(rows.withColumn("file_name", F.when(~F.col("chunk_id").isin("c1001", "c7"), F.col("file_name"))))


@pytest.fixture(scope="module")
def queries(spark):
    return lexical.analysed(spark.createDataFrame(QUERIES, "qid long, query string"))


@pytest.mark.parametrize("k,extension,cells", [(1, None, 1 << 18), (7, None, 40), (20, "en", 300), (1000, None, 1 << 18)])
def test_equals_exhaustive(index, queries, k, extension, cells, monkeypatch):
    monkeypatch.setattr(inplace, "CELLS", cells)
    row = lambda r: (r["qid"], r["rank"], r["chunk_id"], r["path"], round(r["bm25"], 9))
    names = index.chunks.select("chunk_id", "path", "file_name", "source_location")
    want = lexical.top(lexical.bm25(index, queries, extension).join(names, "chunk_id"), "bm25", k, *retrieval.TIES)
    assert want.count() > 0
    assert sorted(map(row, retrieval.sparse_branch(index, queries, k, extension).collect())) == sorted(map(row, want.collect()))


def test_no_pairs_are_shuffled(index, queries, monkeypatch):
    found = inplace.best(index, queries, 3)
    assert "Exchange" not in plan(found) and found.count() < lexical.bm25(index, queries).count() / 2
    monkeypatch.setattr(inplace, "WEIGHTS", 2)  # queries of very many tokens: the postings are joined
    top = lambda rows: sorted((r["qid"], r["rank"], r["chunk_id"]) for r in lexical.top(rows, "bm25", 3, *retrieval.TIES).collect())
    assert top(inplace.best(index, queries, 3)) == top(found)


def test_terms_are_added_up_within_a_row(spark):
    rows = frame(spark, {1: "数据库连接 数据库 getUserName login a the x", 2: "", 3: "ﬁle FILE file 重试", 4: None, 5: "of the a"})
    terms = lexical.terms_of(rows)
    assert "Exchange" not in plan(terms).replace("Exchange RoundRobin", "")
    got = terms.select("chunk_id", F.explode("terms").alias("t")).select("chunk_id", "t.token", F.round("t.weight", 9))
    want = T.token_rows(rows, "chunk_id", indexed_text()).select("chunk_id", "token", F.round("weight", 9))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {r["chunk_id"] for r in terms.where("length >= 1").collect()} == {f"c{k}" for k in range(1, 6)}


def test_terms_of_texts_side_by_side(spark, monkeypatch):
    """Texts are split many at once: names, words and phrases end where a text ends, whatever its letters."""
    odd = ["", "aB", "Cd", "ABc", "XMLHttp", "HTTPServer2Go", "wordA", "Bc", "A", "Bc", "aA", "ca", "che ca che", "connection", "pool", "İstanbul K ﬁleName Ｆｕｌｌ", "é1É2Él", "数据库", "连接池连 接数据", "²x ①２", "\\tcp\\Ip", "a\x0bb\x0cc\xa0d", "UPPER lower MiXed", "", "x" * 50]
    want = None
    for size in (4 << 20, 1, 60):  # of what is split at a time
        monkeypatch.setattr(lexical, "RUN_BYTES", size)
        rows = frame(spark, dict(enumerate(odd))).coalesce(1)
        rows = rows.withColumns({c: F.lit(None).cast("string") for c in ("file_name", "source_location")})
        got = lexical.terms_of(rows).select("chunk_id", F.explode("terms").alias("t")).select("chunk_id", "t.token", F.round("t.weight", 9))
        want = want or sorted(map(tuple, T.token_rows(rows, "chunk_id", indexed_text()).select("chunk_id", "token", F.round("weight", 9)).collect()))
        assert sorted(map(tuple, got.collect())) == want


def test_letters_that_normalisation_keeps_stay_in_the_jvm(spark):
    rows = spark.createDataFrame([("é",), ("Straße – “naïve” €",), ("plain",), ("e\u0301",), ("ﬁ",), ("…",), ("½",)], "t string")
    assert [r[0] for r in rows.select(F.col("t").rlike(T.CHANGING)).collect()] == [False, False, False, True, True, True, True]
    kept = [chr(c) for c in range(0x80, 0x3000) if unicodedata.is_normalized("NFKC", chr(c)) and not unicodedata.combining(chr(c))]
    every = spark.createDataFrame([(c,) for c in map(chr, range(0x80, 0x3000))], "t string")
    left = {r[0] for r in every.where(~F.col("t").rlike(T.CHANGING)).collect()}
    assert left <= set(kept) and len(left) > 150


def test_prepared_names_beside_the_patterns(spark):
    texts = ["class A", "my subclass b", "def f(x) g(y) (z)", "no names here", "", "record", "function (", "a( enum e(", "klass A"]
    rows = lexical.prepared(frame(spark, dict(enumerate(texts))))
    declared, called = r"(?:class|interface|record|enum|def|function) (?=(\S+))", r"(?:^| )([^\s(]+)\("
    for r in rows.collect():
        assert (r["declared"], r["called"]) == tuple(list(dict.fromkeys(re.findall(p, r["normal_content"]))) for p in (declared, called))


def test_buckets_grow_with_the_table(spark, queries, tmp_path, monkeypatch):
    """A task that writes or reads a bucket holds a bounded part of the table, whatever the shuffle partitions."""
    rows = texts(200, 6)
    few = published.Knowledge(spark, str(tmp_path / "few"))
    few.update(frame(spark, rows))
    monkeypatch.setattr(published, "BUCKET_BYTES", sum(map(len, rows.values())) // 9)
    monkeypatch.setattr(published, "BUCKET_POSTINGS", few.load().index.postings.count() // 11)
    many = published.Knowledge(spark, str(tmp_path / "many"))
    many.update(frame(spark, rows))
    buckets = lambda kb: {name: x["buckets"] for name, x in kb.store._manifest(kb.load().manifest["revision"])["bucketed"].items()}
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert set(buckets(few).values()) == {least}
    assert all(n >= (11 if name in ("postings", "df") else 9) > least for name, n in buckets(many).items())
    row = lambda df: sorted(map(tuple, df.collect()))
    one, other = few.load().index, many.load().index
    assert row(one.postings) == row(other.postings) and row(one.vectors) == row(other.vectors) and row(one.df) == row(other.df)
    assert best(lexical.bm25(other, queries), 5) == best(lexical.bm25(one, queries), 5)
    assert other.terms.select(F.spark_partition_id()).count() == len(rows)
    with published._bucket_by_bucket(spark):
        assert other.terms.rdd.getNumPartitions() >= 9
    assert spark.conf.get("spark.sql.sources.bucketing.autoBucketedScan.enabled") == "true"


def test_postings_are_moved_in_lists(spark, tmp_path, monkeypatch):
    """Far fewer rows than postings are moved and sorted, however many runs of postings a task has; none is lost."""
    rows = texts(300, 8)
    kb = published.Knowledge(spark, str(tmp_path / "kb"))
    kb.update(frame(spark, rows))
    index = kb.load().index
    row = lambda df: sorted(map(tuple, df.select("token", "chunk_id", "weight", "length").collect()))
    want = row(lexical.postings_of(index.terms))
    assert row(index.postings) == want
    lists = lexical.lists_of(index.terms.coalesce(2), len(rows), 10**6)
    common = lists.where("token IN ('common', 'often', 'usual')").select(F.size("postings").alias("n"), "apart").collect()
    assert len(common) == 6 and sum(r["n"] for r in common) > 300 and not any(r["apart"] for r in common)
    monkeypatch.setattr(lexical, "RUN_POSTINGS", 100)
    lists = lexical.lists_of(index.terms, len(rows), 40)
    assert row(lists.select("token", F.inline("postings"))) == want
    apart = lists.groupBy("token").agg(F.max("apart").alias("most"), F.sum(F.size("postings")).alias("n")).collect()
    assert all(r["most"] == 0 for r in apart if r["n"] < 5) and any(r["most"] > 0 for r in apart if r["token"] == "common")


def test_frequent_tokens_are_written_by_several_tasks(spark, queries, tmp_path, monkeypatch):
    rows = texts(200, 5)
    whole = published.Knowledge(spark, str(tmp_path / "whole"))
    whole.update(frame(spark, rows))
    monkeypatch.setattr(published, "FREQUENT", 10)
    kb = published.Knowledge(spark, str(tmp_path / "kb"))
    kb.update(frame(spark, rows))
    row = lambda df: sorted(map(tuple, df.collect()))
    one, other = whole.load().index, kb.load().index
    assert row(one.postings) == row(other.postings) and row(one.df) == row(other.df)
    files = lambda index: index.postings.where("token = 'common'").select(F.input_file_name()).distinct().count()
    assert files(one) == 1 < files(other)
    found = published.by_key(other.postings, "token", spark.createDataFrame([("common",)], "token string"))
    assert found.count() == one.postings.where("token = 'common'").count() > 0
    assert best(lexical.bm25(other, queries), 5) == best(lexical.bm25(one, queries), 5)


def test_neighbours_move_no_texts(spark):
    rows = frame(spark, {k: f"text {k}" for k in range(12)})
    moved = [x for x in plan(context.neighbours(rows)).splitlines() if "Exchange hashpartitioning" in x]
    below = plan(context.neighbours(rows)).split("Exchange hashpartitioning")[1].splitlines()[1]
    assert len(moved) == 1 and "content" not in below.split("AS size")[-1] and "length(content" in below


def test_equal_texts_score_alike_wherever_they_lie(spark, queries):
    rows = {k: "rare2 rare9 common often usual rare4" for k in range(12, 99, 3)} | {k: f"usual often own{k} rare4 rare9 rare2" for k in range(13, 99, 3)}
    found = inplace.best(lexical.build(frame(spark, rows).repartition(7)), queries, 100).join(frame(spark, rows).select("chunk_id", "content"), "chunk_id").where("content LIKE 'rare2%'")
    assert found.groupBy("qid").agg(F.count_distinct("bm25").alias("n"), F.count("*").alias("m")).where("n <> 1 OR m <> 29").isEmpty() and found.count() > 0


def test_batches_to_python_are_bounded(spark):
    from heddle.plans import stored

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    stored.small_batches(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"


def test_dense_search_sends_no_pairs_to_python(spark):
    from heddle.operators import dense

    rows = spark.createDataFrame([(k, [float(k % 7), 1.0, k / 5]) for k in range(50)], "chunk_id long, embedding array<double>")
    found = dense.nearest(rows, rows.where("chunk_id < 9").withColumnRenamed("chunk_id", "qid"), 3)
    assert found.count() == 27 and "CartesianProduct" not in plan(found) and "HashJoin" not in plan(found)  # vectors and blocks meet in the task


def test_an_index_without_postings_gives_the_same(spark, queries, tmp_path, monkeypatch):
    """Postings repeat a chunk's id for each of its tokens: an index that isn't looked up by token keeps none of them."""
    monkeypatch.setattr(published, "SEGMENTS", 2)
    rows = texts(150, 5)
    whole, lean = published.Knowledge(spark, str(tmp_path / "whole")), published.Knowledge(spark, str(tmp_path / "lean"), postings=False)
    row = lambda df: sorted(map(tuple, df.collect()))
    top = lambda index: sorted((r["qid"], r["rank"], r["chunk_id"], round(r["bm25"], 9)) for r in retrieval.sparse_branch(index, queries, 3).collect())
    for step in range(3):  # the third is rewritten as one segment
        held = {k: t for k, t in rows.items() if not step or k % 4 != step} | {1000 + step: "common often another word"}
        assert [kb.update(frame(spark, held))["segments"] for kb in (whole, lean)] == [(1, 2, 1)[step]] * 2
        one, other = whole.load().index, lean.load().index
        for table in ("df", "vectors", "corpus"):
            assert row(getattr(one, table)) == row(getattr(other, table)), (step, table)
        assert row(one.postings.select("token", "chunk_id", "weight", "length")) == row(other.postings.select("token", "chunk_id", "weight", "length"))
        assert "postings" in whole.store.load()[0]["tables"] and "postings" not in lean.store.load()[0]["tables"]
    want = top(one)
    assert want and top(other) == want
    monkeypatch.setattr(inplace, "WEIGHTS", 2)  # queries of very many tokens: some at a time
    assert top(other) == want and "Join" not in plan(inplace.best(other, queries, 3))
    assert published.Knowledge(spark, str(tmp_path / "whole"), postings=False).load() is None


def test_normal_forms_are_kept_where_they_tell_more(spark, tmp_path):
    held = {1: "Plain Text", 2: "Ｆｕｌｌ width", 3: "C:\\Dir", 4: "", 5: "Été ﬁn", 6: "İ"}
    kb = published.Knowledge(spark, str(tmp_path / "kb"))
    kb.update(frame(spark, held))
    row = lambda df: sorted(map(tuple, df.select("chunk_id", "normal_content", "declared").collect()))
    assert row(kb.load().index.chunks) == row(lexical.prepared(frame(spark, held)))
    assert {r["chunk_id"] for r in kb.store.load()[1]["chunks"].where("normal_content IS NOT NULL").collect()} == {"c2", "c5"}


def test_a_build_leaves_no_shuffle_files(spark, tmp_path):
    held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {str(n) for n in held.getAllFiles().mkString("\n").split("\n") if "shuffle_" in n}
    before = files()
    published.Knowledge(spark, str(tmp_path / "kb"), postings=False).update(frame(spark, texts(100, 7)))
    assert not files() - before
    assert spark.conf.get("spark.sql.parquet.compression.codec") == "snappy"


def test_the_queries_chunks_need_no_postings(spark):
    index = published.of_chunks(spark, "/root/testdata/sf0.001")
    assert "postings" not in index.store.load()[0]["tables"] and index.load().index.terms.count() > 0
