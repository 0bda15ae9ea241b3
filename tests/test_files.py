"""Scans and readers over files that the tests write."""

import io
import os
import zipfile

import pytest

from heddle.sources import files, readers


def tree(root):
    for path, data in {
        "a.md": b"# One\n\ntext", "b.xyz": b"?", "c.xyz": b"?", "noext": b"?", "Makefile": b"all:", "big.txt": b"x" * (2 << 20) + b"y",
        ".env": b"KEY=1", ".env.local": b"KEY=2", "server.PEM": b"k", ".ssh/id": b"k", "node_modules/m.js": b"1", "sub/deep/d.py": b"print(1)", "Target/t.txt": b"no",
    }.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    os.symlink(root / "a.md", root / "link.md")
    return root


def test_scan_policies(spark, tmp_path):
    root = tree(tmp_path / "kb")
    got = files.scan(spark, [str(root), str(root / "sub"), str(root), str(tmp_path / "missing")])
    assert got.roots == [str(root)]
    assert {(r["relative_path"], r["reader_id"]) for r in got.documents.collect()} == {("a.md", "plain-text"), ("Makefile", "plain-text"), ("sub/deep/d.py", "plain-text")}
    warned = {(os.path.relpath(r["path"], root), r["reader_id"], r["skipped"]) for r in got.warnings.collect()}
    assert warned == {(".env", "sensitive-file", True), (".env.local", "sensitive-file", True), ("server.PEM", "sensitive-file", True), (".ssh", "sensitive-file", True), ("big.txt", "plain-text", True), (".", "unsupported-format", False), (".", "symbolic-link", False)}
    assert any("3 files" in r["message"] and "xyz 2, none 1" in r["message"] for r in got.warnings.collect())
    free = files.scan(spark, [str(root)], policy=False)
    assert not free.warnings.where("reader_id = 'sensitive-file'").collect()
    assert files.scan(spark, [str(tmp_path / "missing")]).documents.count() == 0


def test_scan_budget(spark, tmp_path):
    for k in range(6):
        (tmp_path / f"f{k}.txt").write_text("x" * 10)
    (tmp_path / "d1" / "d2").mkdir(parents=True)
    (tmp_path / "d1" / "d2" / "deep.txt").write_text("deep")
    (tmp_path / "d1" / "near.txt").write_text("near")
    by_files = files.scan(spark, [str(tmp_path)], budget=files.Budget(files=3))
    assert sorted(r["relative_path"] for r in by_files.documents.collect()) == ["d1/d2/deep.txt", "d1/near.txt", "f0.txt"]
    assert [r["skipped"] for r in by_files.warnings.where("reader_id = 'scan-budget'").collect()] == [True]
    by_bytes = files.scan(spark, [str(tmp_path)], budget=files.Budget(total_bytes=30))
    assert by_bytes.documents.count() == 4
    assert [by.warnings.where("reader_id = 'scan-budget'").first()["message"] for by in (by_files, by_bytes)] == ["more than 3 files", "more than 30 bytes"]
    both = files.scan(spark, [str(tmp_path)], budget=files.Budget(files=5, total_bytes=30))
    assert both.documents.count() == 4 and both.warnings.where("reader_id = 'scan-budget'").first()["message"] == "more than 30 bytes"
    shallow = files.scan(spark, [str(tmp_path)], budget=files.Budget(depth=2))
    assert shallow.documents.count() == 7 and "1 folders" in shallow.warnings.first()["message"]


def test_folders_beyond_the_budget_are_not_entered(spark, tmp_path):
    for folder in ("a", "b", "c"):
        for k in range(3):
            (tmp_path / "kb" / folder / "in").mkdir(parents=True, exist_ok=True)
            (tmp_path / "kb" / folder / f"{k}.txt").write_text("x")
            (tmp_path / "kb" / folder / "in" / f"{k}.txt").write_text("y")
            (tmp_path / "kb" / folder / "in" / f"{k}.pem").write_text("z")
    root = str(tmp_path / "kb")
    all_of_them = files.scan(spark, [root])
    order = sorted(r["relative_path"] for r in all_of_them.documents.collect())
    assert len(order) == 18 and all_of_them.warnings.where("reader_id = 'sensitive-file'").count() == 9
    for n in (2, 6, 17):
        got = files.scan(spark, [root], budget=files.Budget(files=n))
        assert sorted(r["relative_path"] for r in got.documents.collect()) == order[:n]
    # a/in is entered for its first file; b/in and c/in come after b/1.txt, which is beyond the budget
    few = files.scan(spark, [root], budget=files.Budget(files=4))
    assert {r["path"][len(root) + 1] for r in few.warnings.where("reader_id = 'sensitive-file'").collect()} == {"a"}


def test_readers_and_budgets_are_checked():
    one = readers.READERS["plain-text"]
    with pytest.raises(ValueError, match="md"):
        files.dispatch({"a": one, "b": readers.Reader("other", 1, (" MD ",), (), 10, one.read)})
    assert len(files.dispatch(readers.READERS)) == len({x[:2] for x in files.dispatch(readers.READERS)})
    for wrong in ({"files": 0}, {"total_bytes": -1}, {"depth": 0}):
        with pytest.raises(ValueError):
            files.Budget(**wrong)


@pytest.mark.parametrize("data,want", [(b"\xef\xbb\xbfa", "a"), ("é\n".encode("utf-16"), "é\n"), (b"\xfe\xff\x00a", "a"), (b"plain", "plain")])
def test_byte_order_marks(data, want):
    assert readers.decoded(data) == want


def test_binary_sniff():
    assert readers.looks_binary("a\0b") and readers.looks_binary("\x01\x02abc") and not readers.looks_binary("tab\tand\nline " * 10)
    assert readers.plain_text(b" \n ") is None


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_office_readers_and_failures(spark, tmp_path):
    w = 'xmlns:w="http://w"'
    docx = zipped({"word/document.xml": f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Body </w:t></w:r><w:r><w:t>text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
    pptx = zipped({f"ppt/slides/slide{k}.xml": f'<s xmlns:a="http://a"><a:txBody><a:p><a:r><a:t>slide {k}</a:t></a:r></a:p></a:txBody><a:txBody><a:p><a:r><a:t>slide {k}</a:t></a:r></a:p></a:txBody></s>' for k in (1, 2, 10)})
    xlsx = zipped({"xl/workbook.xml": '<w><sheets><sheet name="First"/></sheets></w>', "xl/sharedStrings.xml": "<sst><si><t>hello</t></si></sst>", "xl/worksheets/sheet1.xml": '<w><sheetData><row r="1"><c t="s"><v>0</v></c><c><v>7</v></c></row><row r="2"><c/></row><row r="3"><c t="inlineStr"><is><t>in</t></is></c></row></sheetData></w>'})
    bomb = zipped({"word/document.xml": "<a>" + " " * 5_000_000 + "</a>"})
    for name, data in (("d.docx", docx), ("p.pptx", pptx), ("x.xlsx", xlsx), ("bomb.docx", bomb), ("broken.docx", b"no zip"), ("t.txt", b"one\r\ntwo  \n"), ("bin.txt", b"\0\1"), ("h.html", b"<nav>no</nav><h1>T</h1><p>yes</p>")):
        (tmp_path / name).write_bytes(data)
    rows = readers.read(files.scan(spark, [str(tmp_path)]).documents).collect()
    units = {n: [(r["title"], r["number"], r["text"]) for r in sorted((r for r in rows if r["relative_path"] == n and not r["error"]), key=lambda r: (r["section"], r["number"]))] for n in {r["relative_path"] for r in rows}}
    assert units["d.docx"] == [("Title", 1, "Title"), ("Title", 2, "Body text"), ("Title", 3, "x | y")]
    assert [t for _, _, t in units["p.pptx"]] == ["slide 1", "slide 2", "slide 10"]
    assert units["x.xlsx"] == [("First", 1, "hello | 7"), ("First", 3, "in")]
    assert [t for _, _, t in units["t.txt"]] == ["one", "two", ""] and units["h.html"] == [("T", 1, "T"), ("T", 2, "yes")]
    failed = {r["relative_path"]: r["error"] for r in rows if r["error"]}
    assert set(failed) == {"bomb.docx", "broken.docx", "bin.txt"} and "too much" in failed["bomb.docx"]
