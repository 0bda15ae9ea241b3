"""Incremental builds and revisions over files that the tests write; chunks of literal code."""

import os

from heddle.operators import builder, chunking
from heddle.sources import files
from heddle.sources.store import Store, validated


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_incremental_build_equals_full(spark, tmp_path):
    for name, text in (("keep.md", "kept words here " * 30), ("edit.md", "before the edit " * 30), ("gone.md", "soon to be gone " * 30)):
        (tmp_path / name).write_text(text)
    first = builder.build(files.scan(spark, [str(tmp_path)]).documents)
    assert rows(first["plan"], "relative_path", "action") == [("edit.md", "added"), ("gone.md", "added"), ("keep.md", "added")]
    (tmp_path / "gone.md").unlink()
    (tmp_path / "new.py").write_text("def added():\n    return 'a new file'\n")
    stat = (tmp_path / "edit.md").stat()
    (tmp_path / "edit.md").write_text("after the change " * 30)
    os.utime(tmp_path / "edit.md", ns=(stat.st_atime_ns, stat.st_mtime_ns + 5_000_000_000))
    now = files.scan(spark, [str(tmp_path)]).documents
    second = builder.build(now, first)
    assert rows(second["plan"], "relative_path", "action") == [("edit.md", "modified"), ("gone.md", "deleted"), ("keep.md", "reused"), ("new.py", "added")]
    full = builder.build(now)
    assert rows(second["chunks"], "id", "path", "source_location", "content") == rows(full["chunks"], "id", "path", "source_location", "content")
    assert rows(second["entries"], "relative_path", "content_hash", "chunk_ids") == rows(full["entries"], "relative_path", "content_hash", "chunk_ids")
    lost = {**second, "chunks": second["chunks"].where("path NOT LIKE '%keep.md'")}
    assert ("keep.md", "modified") in rows(builder.build(now, lost)["plan"], "relative_path", "action")


def test_same_size_and_time_is_modified_when_verified(spark, tmp_path):
    (tmp_path / "a.md").write_text("one text that is long enough")
    first = builder.build(files.scan(spark, [str(tmp_path)]).documents)
    stat = (tmp_path / "a.md").stat()
    (tmp_path / "a.md").write_text("two text that is long enough")
    os.utime(tmp_path / "a.md", ns=(stat.st_atime_ns, stat.st_mtime_ns))
    now = files.scan(spark, [str(tmp_path)]).documents
    assert rows(builder.build(now, first)["plan"], "action") == [("reused",)]
    assert rows(builder.build(now, first, verify=True)["plan"], "action") == [("modified",)]


def test_store_publishes_conditionally(spark, tmp_path):
    store = Store(spark, str(tmp_path / "kb"))
    assert store.load() is None and store.state()["status"] == "EMPTY"
    assert store.begin() == 1 and store.begin() is None
    table = spark.range(3)
    store.save(1, {"chunks": table}, {"kb": "k", "source_hash": "h", "chunking": 3, "model": "m"})
    assert store.publish(1) and store.state()["status"] == "READY"
    manifest, tables = store.load()
    assert tables["chunks"].count() == 3 and validated(manifest, store.state(), "h", 3, "m") == "READY"
    assert validated(manifest, store.state(), "other", 3, "m") == "DIRTY" and validated(manifest, store.state(), "h", 4, "m") == "INCOMPATIBLE" and validated(None, store.state(), "h", 3, "m") == "INCOMPATIBLE"
    # the sources change during a build: it can't be published
    assert store.begin() == 2
    store.save(2, {"chunks": spark.range(5)}, {"kb": "k"})
    assert store.mark_dirty(2) and not store.mark_dirty(2)
    assert not store.publish(2) and store.load(2) is None and store.load()[1]["chunks"].count() == 3
    # two writers from one state: one wins
    old = store.state()
    assert store._change(old, status="DIRTY") and store._change(old, status="FAILED") is None
    # a restart in the middle of a build
    assert store.begin() == 3
    store.save(3, {"chunks": table}, {})
    assert store.clean() == ["revision=3"] and store.state()["status"] == "FAILED" and store.load() is not None
    (tmp_path / "kb" / "revision=1" / "manifest.json").write_text("broken")
    assert store.load() is None


def test_code_chunks():
    code = ["import os", "", "@cached", "def first(a):", "    return a", "", "// a class", "public class Second {", "  if (x) {", "  }", "}", "const third = (a) => a", "fun fourth() {", "}"]
    found = chunking.code_ranges(code, [1] * len(code))
    assert found == [(0, 0, "header"), (1, 4, "first"), (5, 10, "Second"), (11, 11, "third"), (12, 13, "fourth")]
    assert chunking.code_ranges(["x = 1"] * 900, [1] * 900) == [(0, 419, ""), (356, 775, ""), (712, 899, "")]
    made = chunking.of_document("p.kt", "KT", "\n".join(code))
    assert [m[2] for m in made] == ["first · L3-5", "Second · L7-11", "third · L12-12", "fourth · L13-14"]
    assert chunking.unit_tokens("漢字かな한글abcde") == 8 and chunking.unit_tokens("") == 1
