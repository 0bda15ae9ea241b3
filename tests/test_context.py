"""Picks of a context by the stated rule, term by term; sections of web pages; texts of other charsets."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from heddle.operators import context as X
from heddle.sources import files, html, readers


def plain_picks(rows, limit):
    """Of the rows (path, score, content) the one with the greatest worth, again and again."""
    words = [{w for w in "".join(c if c.isalnum() or c == "_" else " " for c in text.lower()).split() if len(w) > 1} for *_, text in rows]
    out = []

    def worth(k):
        likes = [0.0]
        for j in out:
            both = len(words[k] | words[j])
            likes.append(max(len(words[k] & words[j]) / both if both else 0.0, X.SAME_PATH_FLOOR if rows[j][0] == rows[k][0] else 0.0))
        again = any(rows[j][0] == rows[k][0] for j in out)
        return X.RELEVANCE * rows[k][1] - X.SIMILARITY * max(likes) - (X.SAME_DOCUMENT if again else 0)

    while len(out) < limit:
        free = [k for k in range(len(rows)) if k not in out and sum(rows[j][0] == rows[k][0] for j in out) < X.PER_DOCUMENT]
        if not free:
            break
        out.append(max(free, key=lambda k: (worth(k), -k)))
    return out


@pytest.mark.parametrize("seed", range(20))
def test_picks_by_the_rule(seed):
    r = random.Random(seed)
    vocabulary = ["index", "token", "query", "a", "Été", "数据库", "x_1", "end"]
    rows = [(r.choice(["p", "q", "r", "s"]), r.choice([0.5, 0.9, round(r.random(), 3)]), " ".join(r.choices(vocabulary, k=r.randint(0, 8)))) for _ in range(r.randint(0, 14))]
    pool = pd.DataFrame(rows, columns=["path", "score", "content"])
    for limit in (0, 1, 4, 99):
        assert X.diverse(pool, limit) == plain_picks(rows, limit)


def test_select_takes_two_of_a_document(spark):
    rows = [(q, k + 1, f"c{q}{k}", "same" if k < 4 else f"p{k}", 1.0 - k / 10, None if k == 5 else f"text {k}") for q in (1, 2) for k in range(6)]
    found = X.select(spark.createDataFrame(rows, "qid long, rank int, chunk_id string, path string, score double, content string"), 5)
    got = sorted(tuple(r) for r in found.select("qid", "pick", "chunk_id").collect())
    assert [(q, p) for q, p, _ in got] == [(q, p) for q in (1, 2) for p in range(1, 5)]
    assert found.where("path = 'same'").groupBy("qid").count().where("count != 2").isEmpty() and got[0][2] == "c10"


PAGES = {
    "main content alone": ("<body><p>before</p><main><h1>Title</h1><p>one <b>bold</b><br>two</p><ul><li>item <p>inner</p></li></ul></main><p>after</p></body>", [(1, "Title", 1, "Title"), (1, "Title", 2, "one bold two"), (1, "Title", 3, "item inner")]),
    "role": ("<div role=main><p>in</p></div><p>out</p>", [(0, "", 1, "in")]),
    "no main content": ("<h2>A</h2><p>x</p><h3>B</h3><p>y</p>", [(1, "A", 1, "A"), (1, "A", 2, "x"), (2, "B", 3, "B"), (2, "B", 4, "y")]),
    "what is dropped": ("<nav><p>menu</p></nav><p>kept<script>var x = '<p>';</script></p><footer><p>foot</p></footer><form><p>field</p></form>", [(0, "", 1, "kept")]),
    "unclosed": ("<p>first <li>second", [(0, "", 1, "first second")]),
    "entities and spaces": ("<p>  a &amp;\n\t b&nbsp;c </p><p> </p>", [(0, "", 1, "a & b c")]),
    "table cells": ("<table><tr><th>k</th><td>v</td></tr></table>", [(0, "", 1, "k"), (0, "", 2, "v")]),
    "stray ends": ("</p></main><p>x</div></p>", [(0, "", 1, "x")]),
    "empty": ("", []),
    "null": (None, []),
}


def test_sections_of_pages(spark):
    pages = spark.createDataFrame([(k, f"http://x/{k}", page) for k, (page, _) in enumerate(PAGES.values())], "page_id long, url string, html string")
    got = {}
    for r in html.sections(pages).collect():
        got.setdefault(r["page_id"], []).append((r["section"], r["title"], r["number"], r["text"]))
    for k, (name, (_, want)) in enumerate(PAGES.items()):
        assert got.get(k, []) == want, name
    assert html.sections(pages.limit(0)).isEmpty()


def test_charset_of_older_texts(spark, tmp_path):
    (tmp_path / "old.txt").write_bytes("检索 引擎".encode("gb18030"))
    (tmp_path / "new.txt").write_bytes("检索 é".encode())
    (tmp_path / "mark.txt").write_bytes(b"\xff\xfe" + "检索".encode("utf-16-le"))
    (tmp_path / "old.html").write_bytes("<p>引擎</p>".encode("gb18030"))
    documents = files.scan(spark, [str(tmp_path)]).documents
    texts = lambda table: {r["relative_path"]: r["text"] for r in table.where(F.col("error").isNull()).collect()}
    assert texts(readers.read(documents, readers.of_charset("gb18030"))) == {"old.txt": "检索 引擎", "new.txt": "检索 é", "mark.txt": "检索", "old.html": "引擎"}
    usual = texts(readers.read(documents))
    assert usual["new.txt"] == "检索 é" and "�" in usual["old.txt"]
    with pytest.raises(LookupError):
        readers.of_charset("no such charset")
