"""Dense search, normalisation, contexts, citations and highlights on literal rows, beside plain versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from heddle.functions import text as T
from heddle.operators import context, dense, highlight, iterate, lexical, retrieval
from heddle.plans import stored


def test_nearest_of_each_width(spark):
    rng = np.random.default_rng(1)
    vectors = [(k, rng.integers(-3, 4, 2 + k % 2).astype(float).tolist()) for k in range(60)] + [(100, None), (101, []), (102, [0.0, 0.0])]
    queries = [(k, rng.integers(-3, 4, 2 + k % 2).astype(float).tolist()) for k in range(7)] + [(50, None)]
    got = dense.nearest(spark.createDataFrame(vectors, "chunk_id long, embedding array<double>").repartition(3), spark.createDataFrame(queries, "qid long, embedding array<double>"), 4, 0.15)
    want = set()
    for q, a in queries:
        scored = []
        for c, b in vectors:
            if a and b and len(a) == len(b):
                n = np.linalg.norm(a) * np.linalg.norm(b)
                s = max(0.0, float(np.dot(a, b) / n)) if n else 0.0
                scored += [(-round(s, 6), c)] * (s >= 0.15)
        want |= {(q, c, k) for k, (_, c) in enumerate(sorted(scored)[:4], 1)}
    assert {(r["qid"], r["chunk_id"], r["rank"]) for r in got.collect()} == want and len(want) > 20


def test_nearest_of_texts_as_ids(spark):
    vectors = spark.createDataFrame([(f"c{k:02d}" + "x" * (k % 3), [float(k % 5), 1.0]) for k in range(40)], "chunk_id string, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([(1, [0.0, 1.0])], "qid long, embedding array<double>")
    assert [r["chunk_id"][:3] for r in dense.nearest(vectors, queries, 4).orderBy("rank").collect()] == ["c00", "c05", "c10", "c15"]


def test_nearest_with_many_blocks(spark, monkeypatch):
    vectors = spark.createDataFrame([(k, [float(k % 5), 1.0]) for k in range(40)], "chunk_id long, embedding array<double>")
    queries = vectors.select(F.col("chunk_id").alias("qid"), "embedding")
    want = sorted(map(tuple, dense.nearest(vectors, queries, 3).collect()))
    monkeypatch.setattr(dense, "QUERY_BLOCK", 3)
    monkeypatch.setattr(dense, "BROADCAST_BLOCKS", 0)
    monkeypatch.setattr(dense, "PAIRS_AT_ONCE", 8)
    assert sorted(map(tuple, dense.nearest(vectors, queries, 3).collect())) == want and len(want) == 120


def test_compatibility_characters_and_han(spark):
    rows = spark.createDataFrame([(1, "Ｆｕｌｌ ﬁnd C:\\Dir getUserName"), (2, "数据库连接测试"), (3, None), (4, "plain text")], "id long, t string")
    got = {i: {} for i in range(1, 5)}
    for r in T.token_rows(rows, "id", F.col("t")).collect():
        got[r["id"]][r["token"]] = round(r["weight"], 6)
    assert {"full": 1.0, "find": 1.0, "dir": 1.0, "get": 1.0, "user": 1.0, "name": 1.0} == got[1]
    assert got[2]["数据"] == 0.9 and got[2]["数据库"] == 0.9 and got[2]["concept:database-connection"] == 2.8 and "数据库连接测试" not in got[2]
    assert got[3] == {} and got[4] == {"plain": 1.0, "text": 1.0}


def test_han_search_meets_concepts(spark):
    chunks = spark.createDataFrame([(1, "/a.md", "a.md", "md", "L1-1", "mysql connection pool"), (2, "/b.md", "b.md", "md", "L1-1", "nothing of that kind")], "chunk_id long, path string, file_name string, extension string, source_location string, content string")
    found = lexical.bm25(lexical.build(chunks), lexical.analysed(spark.createDataFrame([(1, "数据库连接"), (2, "  ")], "qid long, query string")))
    assert [(r["qid"], r["chunk_id"]) for r in found.collect()] == [(1, 1)]


def test_reasons_of_lexical_results(spark):
    texts = [("/x/parser.py", "def parser(text):\n    return text"), ("/x/parser.md", "notes on the parser of texts"), ("/parser/notes.md", "parser once more"), ("/x/other.md", "a parser is mentioned")]
    chunks = spark.createDataFrame([(k, p, p.rsplit("/", 1)[1], p.rsplit(".", 1)[1], "L1-1", t) for k, (p, t) in enumerate(texts)], "chunk_id long, path string, file_name string, extension string, source_location string, content string")
    index, asked = lexical.build(chunks), spark.createDataFrame([(1, "parser"), (2, "nowhere")], "qid long, query string")
    found = retrieval.search(index, asked, "BM25").collect()
    assert {(r["qid"], r["chunk_id"], r["reason"]) for r in found} == {(1, 0, "BM25, declaration"), (1, 1, "BM25, name of the file"), (1, 2, "BM25, name of the file"), (1, 3, "BM25")}
    plain = retrieval.search(index, asked, "BM25", explain=False).collect()
    assert {r["reason"] for r in plain} == {"BM25"}
    assert sorted((r["chunk_id"], r["rank"], r["score"]) for r in plain) == sorted((r["chunk_id"], r["rank"], r["score"]) for r in found)


def test_expansion_takes_neighbours_once(spark):
    chunks = spark.createDataFrame([(f"c{k}", "/p", 10 * k + 1, 10 * k + 9, f"L{10 * k + 1}-{10 * k + 9}", f"text {k}") for k in range(5)] + [("far", "/q", 1, 5, "L1-5", "alone")], "chunk_id string, path string, start_line int, end_line int, source_location string, content string")
    picks = spark.createDataFrame([(1, 1, "c1", "/p", 0.9), (1, 2, "c2", "/p", 0.8), (1, 3, "c4", "/p", 0.7), (1, 4, "far", "/q", 0.6)], "qid long, pick int, chunk_id string, path string, score double")
    got = [tuple(r) for r in context.expanded(picks, chunks).orderBy("pick").collect()]
    assert [(r[1], r[2], r[4], r[5], r[7]) for r in got] == [(1, "c1:context", 1, 29, "text 0\n\ntext 1\n\ntext 2"), (2, "c4:context", 31, 49, "text 3\n\ntext 4"), (3, "far", 1, 5, "alone")]


def result(search, rank, chunk, path="/p", a=1, b=10, score=1.0):
    return (1, search, rank, chunk, path, f"L{a}-{b}", a, b, score)


def test_citations_are_bounded(spark):
    schema = f"qid long, search int, rank int, {iterate.PLACE}"
    made = lambda rows: spark.createDataFrame(rows, schema).repartition(3)
    names = lambda df: [(r["number"], r["chunk_id"]) for r in df.orderBy("number").collect()]
    found = made([result(0, 1, "a"), result(0, 2, "b", a=5, b=12), result(0, 3, "c", a=11, b=20), result(0, 4, "d", a=21, b=30), result(0, 5, "e", a=31, b=40), result(0, 6, "f", path="/q"), result(0, 7, "f", path="/q")])
    got = iterate.cited(spark.createDataFrame([], iterate.CITED), found, 6).cache()
    assert names(got) == [(1, "a"), (2, "c"), (3, "d"), (4, "f")]  # b overlaps, e is the fourth of its path, f stands twice
    more = made([result(0, k, f"x{k}", path=f"/x{k}") for k in range(5)] + [result(1, k, f"y{k}", path=f"/y{k}") for k in range(9)])
    assert [c for _, c in names(iterate.cited(got, more, 3))] == ["a", "c", "d", "f", "x0", "x1", "x2", "y0", "y1", "y2"]
    full = iterate.cited(iterate.cited(got, more, 3), made([result(0, k, f"z{k}", path=f"/z{k}") for k in range(9)]), 6)
    assert len(names(full)) == iterate.TOTAL and names(iterate.cited(got, more.limit(0), 3)) == names(got)


def test_iteration_stops(spark):
    questions = spark.createDataFrame([(1, "First  question"), (2, "other")], "qid long, query string")
    asked = []

    def search(due):
        asked.append(sorted((r["qid"], r["query"]) for r in due.collect()))
        return due.select("qid", "search", F.lit(1).alias("rank"), F.concat("query", F.lit("!")).alias("chunk_id"), F.concat(F.lit("/"), "query").alias("path"), F.lit("L1-2").alias("source_location"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), F.lit(0.5).alias("score"))

    def plan(held, attempts):
        replies = {1: '{"action":"search","queries":["first question","new one","NEW  ONE","second"]}', 2: '{"action":"answer"}'}
        rows = spark.createDataFrame(list(replies.items()), "qid long, reply string")
        return rows.select("qid", iterate.decision(F.col("reply")).alias("d")).select("qid", "d.*")

    got = iterate.collect(questions, search, plan)
    assert asked == [[(1, "First  question"), (2, "other")], [(1, "new one"), (1, "second")]]
    assert sorted((r["qid"], r["number"]) for r in got.collect()) == [(1, 1), (1, 2), (1, 3), (2, 1)]

    def away(held, attempts):
        raise OSError

    assert iterate.collect(questions, search, away).count() == 2

    @F.pandas_udf("string")
    def remote(x: pd.Series) -> pd.Series:
        raise OSError("the planner is away")

    def away_in_a_task(held, attempts):
        return attempts.select("qid", remote("query").alias("action"), F.array("query").alias("queries"))

    assert iterate.collect(questions, search, away_in_a_task).count() == 2
    assert iterate.collect(questions, search).count() == 2  # a single search without a planner


def test_only_a_planner_that_is_away_leaves_the_citations_as_they_are(spark, monkeypatch):
    questions = spark.createDataFrame([(1, "one"), (2, "two")], "qid long, query string")

    def search(due):
        return due.select("qid", "search", F.lit(1).alias("rank"), F.col("query").alias("chunk_id"), F.col("query").alias("path"), F.lit("L1-2").alias("source_location"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), F.lit(0.5).alias("score"))

    def called(failure):
        def plan(held, attempts):
            raise failure

        return plan

    def in_a_task(failure):
        @F.pandas_udf("string")
        def remote(x: pd.Series) -> pd.Series:
            raise failure

        return lambda held, attempts: attempts.select("qid", remote("query").alias("action"), F.array("query").alias("queries"))

    def broken_job(held, attempts):
        return attempts.select("qid", F.raise_error(F.lit("OSError: not the planner's")).cast("string").alias("action"), F.array("query").alias("queries"))

    def full_disk(held, attempts):  # what the planner says can't be stored
        monkeypatch.setattr(stored, "shared_dir", lambda _: "/dev/null/full")
        return attempts.select("qid", F.lit("ANSWER").alias("action"), F.array("query").alias("queries"))

    told = lambda got: sorted((r["qid"], r["planner_unavailable"]) for r in got.collect())
    with pytest.raises(Exception, match="/dev/null"):
        iterate.collect(questions, search, full_disk)
    monkeypatch.undo()
    full, fault = OSError(28, "No space left on device"), ValueError("OSError: a fault of the planner")
    for plan in (called(full), in_a_task(full), in_a_task(fault)):
        with pytest.raises(Exception, match="No space|fault"):
            iterate.collect(questions, search, plan)
    for plan in (called(OSError("away")), in_a_task(TimeoutError("late\nsecond line")), in_a_task(ConnectionResetError(104, "reset"))):
        assert told(iterate.collect(questions, search, plan)) == [(1, True), (2, True)]
    with pytest.raises(Exception, match="not the planner's"):
        iterate.collect(questions, search, broken_job)
    # a decision that can't be used is told for its question alone
    some = lambda held, attempts: spark.createDataFrame([(1, "ANSWER", ["x"]), (2, "UNAVAILABLE", [])], "qid long, action string, queries array<string>")
    assert told(iterate.collect(questions, search, some)) == [(1, False), (2, True)] and told(iterate.collect(questions, search)) == [(1, False), (2, False)]


def plain_spans(text):
    """All candidate places of a text whose spans are few, by plain scans."""
    import re

    places, lines = set(), [(m.start(), m.end()) for m in re.finditer(r"[^\n]*\S[^\n]*", text)]
    ends = re.compile(r"""(?<=[.!?])["')\]]*(?=\s)|(?<=[。！？])(?![。！？])""")
    for m in re.finditer(r"\S(?:(?!\n\s*\n).)*", text, re.DOTALL):
        cuts = [0, *(e.end() for e in ends.finditer(m[0])), len(m[0])]
        places |= {m.span()} | {(m.start() + a, m.start() + b) for a, b in zip(cuts, cuts[1:])}
    places |= set(lines) | {(lines[k][0], lines[min(k + 3, len(lines) - 1)][1]) for k in range(0, len(lines) - 1, 2)}
    trimmed = {(a + len(text[a:b]) - len(text[a:b].lstrip()), b - len(text[a:b]) + len(text[a:b].rstrip())) for a, b in places}
    return {(a, b) for a, b in trimmed if 8 <= b - a <= 700}


TEXTS = [
    "First sentence here. Second sentence there!\n\nAnother paragraph of some length.\nshort\nand one more line of words",
    "  one line alone, with no end  ",
    "tiny",
    "漢字の文がここにあります。次の文もここにあります！！終わり",
    'He said "stop it now." Then (he left.) \n \n\nlast paragraph\nwith lines\nof text\nfour of them\nfive of them',
    " \n\t ",
]


def test_candidate_spans(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)) + [(50, None), (51, "")], "chunk_id long, content string")
    got = highlight.candidates(rows).collect()
    places = {(r["chunk_id"], r["start"], r["end"]) for r in got}
    assert len(places) == len(got) and places == {(k, a, b) for k, t in enumerate(TEXTS) for a, b in plain_spans(t)}
    many = "\n\n".join(f"Sentence number {k} stands here. And another {k} follows it." for k in range(200))
    long = highlight.candidates(spark.createDataFrame([(1, many), (2, "\n".join(f"line number {k}" for k in range(300)))], "chunk_id long, content string")).toPandas()
    kinds = long["turn"].map(lambda t: t["kind"])
    assert [int(((long["chunk_id"] == 1) & (kinds == k)).sum()) for k in range(3)] == [81, 93, 0]  # 27 paragraphs of 3 spans, then lines that aren't among them
    assert [int(((long["chunk_id"] == 2) & (kinds == k)).sum()) for k in range(3)] == [0, 120, 0]


def test_highlights_are_the_best_that_do_not_overlap(spark):
    queries = ["Second sentence there!", "four of them", "次の文もここに", "LINE a words", "", None]
    rows = [(q, k, query, t) for q, query in enumerate(queries) for k, t in enumerate([*TEXTS, None])]
    got = {(r["qid"], r["chunk_id"]): r for r in highlight.highlights(spark.createDataFrame(rows, "qid long, chunk_id long, query string, content string")).collect()}
    assert len(got) == len(rows)
    embed = highlight.Histogram().embed
    for q, k, query, text in rows:
        found, best = [(s["start"], s["end"]) for s in got[q, k]["spans"]], []
        if (query or "").strip() and text:
            vector = embed([query.strip()])[0]
            scored = sorted((min(0.055, 0.018 * np.log1p((b - a) / 90)) - (s := max(0.0, float(embed([text[a:b]])[0] @ vector))), s, a, b) for a, b in plain_spans(text))
            for _, s, a, b in scored:
                if s >= 0.18 and len(best) < 3 and all(b <= x or y <= a for x, y in best):
                    best.append((a, b))
        assert found == sorted(best), (q, k)
    assert [tuple(t) for t in got[3, 0]["terms"]] == [(TEXTS[0].index("line"), TEXTS[0].index("line") + 4), (TEXTS[0].index("words"), TEXTS[0].index("words") + 5)]
    crowded = spark.createDataFrame([(1, 1, "aa b", "aaaaa b aa " * 60)], "qid long, chunk_id long, query string, content string")
    assert len(highlight.word_places(crowded).first()["terms"]) == highlight.PLACES
