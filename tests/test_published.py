"""A published index: updates equal full builds, look-ups are pruned, models and states are checked."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.functions.vectors import Histogram
from heddle.operators import builder, lexical, published, retrieval
from heddle.sources import files
from heddle.sources.store import LEGAL, STATUSES, Store

CHUNKS = "chunk_id string, path string, file_name string, extension string, start_line int, end_line int, source_location string, content string"


def named(name):
    class Named(Histogram):
        """The histogram under another name; defined here, so that it travels to the tasks by value."""

        signature = name

        def __init__(self):
            pass

        def embed(self, texts):
            if name == "away":
                raise OSError("the model is away")
            return super().embed(texts)

    return Named()


def chunk(k, text):
    return (f"c{k}", f"/p/{k % 5}.md", f"{k % 5}.md", "md", 1, 2, f"L{k}-{k}", text)


def frame(spark, rows):
    return spark.createDataFrame([chunk(k, t) for k, t in rows.items()], CHUNKS).repartition(3)


def state_of(kb, queries):
    index = kb.load().index
    found = lexical.bm25(index, lexical.analysed(queries))
    return (
        sorted((r["token"], r["df"]) for r in index.df.collect()),
        tuple(index.corpus.first()),
        sorted((r["qid"], r["chunk_id"], round(r["bm25"], 9)) for r in found.collect()),
        sorted((r["chunk_id"], tuple(r["embedding"])) for r in index.vectors.collect()),
        sorted((r["token"], r["chunk_id"], r["weight"], r["length"]) for r in index.postings.collect()),
    )


def test_updates_equal_full_builds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(published, "SEGMENTS", 3)
    rng = random.Random(3)
    words = [f"word{k}" for k in range(30)] + ["数据库连接", "login", "getUserName"]
    text = lambda: " ".join(rng.choices(words, k=rng.randint(1, 12)))
    queries = spark.createDataFrame([(1, "word1 word2 login"), (2, "数据库"), (3, "word7 word7")], "qid long, query string")
    kb, rows, seen = published.Knowledge(spark, str(tmp_path / "kb")), {k: text() for k in range(20)}, set()
    dropped = {}
    for step in range(4):
        held = {(k, t) for k, t in rows.items()} if step else set()
        if step:
            again = dropped
            dropped = {k: rows.pop(k) for k in rng.sample(sorted(rows), 3)}
            for k in rng.sample(sorted(rows), 2):
                rows[k] = text()
            if step == 3:
                rows |= again  # what was removed is back: its vectors are still known
            rows |= {100 + 10 * step + j: text() for j in range(3)}
        report = kb.update(frame(spark, rows))
        new = {(k, t) for k, t in rows.items()} - held
        assert report["added"] == len(new) and report["chunks"] == len(rows)
        assert report["removed"] == len(held - {(k, t) for k, t in rows.items()})
        assert report["embedded"] <= len(new - seen) and (step != 3 or report["embedded"] < len(new))
        seen |= new
        own = kb.store.load()[1]["postings"]  # this revision's segment alone
        if report["segments"] > 1:
            assert {r["chunk_id"] for r in own.select("chunk_id").distinct().collect()} == {f"c{k}" for k, _ in new}
        if step > 1:
            full = published.Knowledge(spark, str(tmp_path / f"full{step}"))
            full.update(frame(spark, rows))
            assert state_of(kb, queries) == state_of(full, queries), step
    assert report["segments"] <= 3
    assert kb.update(frame(spark, rows))["embedded"] == 0
    used = {f"revision={k}" for k in kb.store.load()[0]["uses"]}
    kb.store.clean()
    assert {n for n in kb.store._names(kb.store.folder) if n.startswith("revision=")} >= used and kb.load() is not None
    kb.update(frame(spark, {}).limit(0))
    assert kb.load().index.corpus.first()["n"] == 0 and kb.load().index.df.count() == 0


def test_another_model_builds_anew(spark, tmp_path):
    rows = {k: f"text number {k}" for k in range(8)}
    kb = published.Knowledge(spark, str(tmp_path / "kb"), named("one"))
    assert kb.update(frame(spark, rows))["embedded"] == 8 and kb.update(frame(spark, rows))["embedded"] == 0
    other = published.Knowledge(spark, str(tmp_path / "kb"), named("two"))
    assert other.update(frame(spark, rows))["embedded"] == 8 and other.load().model == "two"


def test_failed_build_publishes_nothing(spark, tmp_path):
    kb = published.Knowledge(spark, str(tmp_path / "kb"), named("away"))
    with pytest.raises(Exception, match="the model is away"):
        kb.update(frame(spark, {1: "a text"}))
    assert kb.load() is None and kb.store.state()["status"] == "FAILED"
    assert not [n for n in kb.store._names(kb.store.folder) if n.startswith(("staging", "revision"))]
    kb.embedder = Histogram()
    assert kb.update(frame(spark, {1: "a text"}))["added"] == 1 and kb.store.state()["status"] == "READY"


def plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_lookups_are_pruned(spark, tmp_path):
    kb = published.Knowledge(spark, str(tmp_path / "kb"))
    rows = {k: f"text number {k} of many" for k in range(40)}
    kb.update(frame(spark, rows))
    got = {r["chunk_id"]: (r["found"], r["content"]) for r in kb.lookup(["c3", "gone", "c7", "c3"]).collect()}
    assert got == {"c3": (True, rows[3]), "c7": (True, rows[7]), "gone": (False, None)}
    index = kb.load().index
    for table, key, value in ((index.chunks, "chunk_id", "c3"), (index.postings, "token", "number")):
        found = published.by_key(table.select(key), key, spark.createDataFrame([(value,)], f"{key} string"))
        n = len(found.collect())
        read = found._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()
        assert n <= read < table.count() * 0.6, (key, read)  # of four buckets, one
    many = spark.createDataFrame([(f"c{k}",) for k in range(500)], "chunk_id string")
    assert published.by_key(index.chunks, "chunk_id", many).count() == 40
    # chunks are removed without being rewritten, and are stale then
    del rows[3]
    kb.update(frame(spark, rows))
    assert not kb.lookup(["c3"]).first()["found"] and published.Knowledge(spark, str(tmp_path / "none")).lookup(["c3"]).first()["found"] is False


def test_search_reads_the_published_tables_alone(spark, tmp_path):
    kb = published.Knowledge(spark, str(tmp_path / "kb"))
    kb.update(frame(spark, {k: f"text number {k} of many" for k in range(40)}))
    index = kb.load().index
    shown = plan(lexical.bm25(index, lexical.analysed(spark.createDataFrame([(1, "number many")], "qid long, query string"))))
    # the tokens come to the postings: the one exchange is that of the sums, and no document is read
    exchanges = [x for x in shown.splitlines() if "Exchange hashpartitioning" in x]
    assert len(exchanges) == 1 and "hashpartitioning(qid" in exchanges[0] and "Bucketed: true" in shown and "documents" not in shown


def test_every_illegal_transition_is_refused(spark, tmp_path):
    for old in STATUSES:
        for new in STATUSES:
            store = Store(spark, str(tmp_path / f"{old}-{new}"))
            state = {**store.state(), "status": old, "published": 1}
            if (old, new) in LEGAL:
                assert store._change(state, status=new)["status"] == new
            else:
                with pytest.raises(ValueError, match="can't become"):
                    store._change(state, status=new)
    store = Store(spark, str(tmp_path / "unpublished"))
    with pytest.raises(ValueError, match="READY needs"):
        store._change({**store.state(), "status": "BUILDING"}, status="READY")


def test_log_is_cleared_and_old_writers_lose(spark, tmp_path, monkeypatch):
    from heddle.sources import store as S

    monkeypatch.setattr(S, "KEPT_STATES", 3)
    store = Store(spark, str(tmp_path / "kb"))
    first = store.state()
    assert store._change(first, status="BUILDING")
    for _ in range(6):
        assert store.fail(1, "x") and store.begin() == 1
    assert len(store._versions()) == 3 and store.state()["version"] == 13
    assert store._change(first, status="BUILDING") is None  # number 1 is free again, but the log is at 13
    assert store.state()["version"] == 13
    assert store._create(f"{store.folder}/state/claim-14", {}) and store.fail(1, "y") is False  # another writer has claimed it
    assert [x["folder"] for x in S.listed([Store(spark, str(tmp_path / "new")), store])] == [store.folder, str(tmp_path / "new")]


def test_files_to_published_index(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    for name in ("a", "b", "c"):
        (src / f"{name}.md").write_text(f"the text of file {name} " * 30)
    kb = published.Knowledge(spark, str(tmp_path / "kb"))
    first = builder.build(files.scan(spark, [str(src)]).documents)
    n = first["chunks"].count()
    assert kb.update(builder.indexable(first))["embedded"] == n
    (src / "d.md").write_text("quite another text " * 30)
    (src / "a.md").unlink()
    second = builder.build(files.scan(spark, [str(src)]).documents, first)
    report = kb.update(builder.indexable(second))
    assert report["embedded"] == report["added"] == second["chunks"].where("path LIKE '%d.md'").count() and report["removed"] == first["chunks"].where("path LIKE '%a.md'").count()
    found = retrieval.search(kb.load().index, spark.createDataFrame([(1, "quite another")], "qid long, query string"))
    assert found.orderBy("rank").first()["file_name"] == "d.md"
