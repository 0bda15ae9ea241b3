"""Readers of files (survey A12, A13, A16-A19, A21): bytes to sections of numbered units, in tasks, with failures as rows.

A reader is a small function from bytes to sections (title, label, [(number, text), ...]). A document that a reader
fails on becomes a row with the error; the others go on.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import partial
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

Section = tuple[str, str, list[tuple[int, str]]]


@dataclass(frozen=True)
class Reader:
    id: str
    version: int
    extensions: tuple[str, ...]
    names: tuple[str, ...]
    most_bytes: int
    read: Callable[[bytes], list[Section] | None]


def decoded(data: bytes, charset: str = "utf-8") -> str:
    """Text by its byte-order mark, else as UTF-8, else by the charset of the sources; bytes that aren't of it are replaced."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode(charset, "replace")


def looks_binary(text: str) -> bool:
    """A NUL, or more than a twentieth of control characters, among the first 2048."""
    sample = text[:2048]
    return "\0" in sample or sum(c < "\t" or "\r" < c < " " for c in sample) > len(sample) // 20


def line_units(text: str) -> list[tuple[int, str]]:
    return [(k, line.rstrip()) for k, line in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").split("\n"), 1)]


def plain_text(data: bytes, charset: str = "utf-8") -> list[Section] | None:
    text = decoded(data, charset)
    return None if not text.strip() or looks_binary(text) else [("", "", line_units(text))]


ENTRY_BYTES, XML_BYTES, LEAST_RATIO = 64 << 20, 16 << 20, 0.01


def _parts(data: bytes) -> zipfile.ZipFile:
    """The archive, if none of its entries unpacks to too much."""
    archive = zipfile.ZipFile(io.BytesIO(data))
    for e in archive.infolist():
        if e.file_size > ENTRY_BYTES or (e.file_size and e.compress_size / e.file_size < LEAST_RATIO):
            raise ValueError(f"entry unpacks to too much: {e.filename}")
        if e.filename.endswith((".xml", ".rels")) and e.file_size > XML_BYTES:
            raise ValueError(f"entry holds too much text: {e.filename}")
    return archive


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(archive.read(name))


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _text(e: ElementTree.Element, leaf: str = "t") -> str:
    return "".join((x.text or "") if _tag(x) == leaf else "\n" if _tag(x) in ("br", "tab") else "" for x in e.iter())


def _numbered(archive: zipfile.ZipFile, folder: str, stem: str) -> list[str]:
    """Names such as folder/stem12.xml, in the order of their numbers."""
    found = [n for n in archive.namelist() if n.startswith(f"{folder}/{stem}") and n.endswith(".xml") and n[len(folder) + len(stem) + 1 : -4].isdigit()]
    return sorted(found, key=lambda n: int(n[len(folder) + len(stem) + 1 : -4]))


def docx(data: bytes) -> list[Section] | None:
    """Paragraphs and table rows in the order of the body; a heading opens a section."""
    out: list[Section] = [("", "", [])]
    number = 0
    for e in _xml(_parts(data), "word/document.xml").iter():
        if _tag(e) != "body":
            continue
        for block in e:
            if _tag(block) == "p":
                style = next((v for x in block.iter() if _tag(x) == "pStyle" for k, v in x.attrib.items() if k.endswith("val")), "")
                lines = [_text(block).strip()]
                if style.lower().startswith(("heading", "title")) and lines[0]:
                    out.append((lines[0], lines[0], []))
            else:
                lines = [" | ".join(_text(c).strip() for c in row if _tag(c) == "tc") for row in block.iter() if _tag(row) == "tr"]
            for line in lines:
                if line.strip(" |"):
                    number += 1
                    out[-1][2].append((number, line))
    return [s for s in out if s[2]] or None


def pptx(data: bytes) -> list[Section] | None:
    """A section for each slide, with the distinct texts of its shapes."""
    archive, out = _parts(data), []
    for k, name in enumerate(_numbered(archive, "ppt/slides", "slide"), 1):
        shapes = ["\n".join(_text(p) for p in s.iter() if _tag(p) == "p") for s in _xml(archive, name).iter() if _tag(s) == "txBody"]
        lines = [x.strip() for s in dict.fromkeys(shapes) for x in s.split("\n") if x.strip()]
        if lines:
            out.append((lines[0], f"slide {k}", list(enumerate(lines, 1))))
    return out or None


def xlsx(data: bytes) -> list[Section] | None:
    """A section for each sheet, a unit for each row with a value."""
    archive = _parts(data)
    shared = [_text(s) for s in _xml(archive, "xl/sharedStrings.xml") if _tag(s) == "si"] if "xl/sharedStrings.xml" in archive.namelist() else []
    titles = [e.attrib.get("name", "") for e in _xml(archive, "xl/workbook.xml").iter() if _tag(e) == "sheet"]
    out = []
    for k, name in enumerate(_numbered(archive, "xl/worksheets", "sheet")):
        rows = []
        for _, row in ElementTree.iterparse(io.BytesIO(archive.read(name))):
            if _tag(row) == "row":
                cells = [_cell(c, shared) for c in row if _tag(c) == "c"]
                if any(cells):
                    rows.append((int(row.attrib.get("r", len(rows) + 1)), " | ".join(cells)))
                row.clear()
        title = titles[k] if k < len(titles) else f"sheet {k + 1}"
        if rows:
            out.append((title, title, rows))
    return out or None


def _cell(c: ElementTree.Element, shared: list[str]) -> str:
    if c.attrib.get("t") == "inlineStr":
        return _text(c).strip()
    value = next((x.text or "" for x in c if _tag(x) == "v"), "")
    return shared[int(value)].strip() if c.attrib.get("t") == "s" and value else value.strip()


# What the plain-text reader takes.
TEXT_EXTENSIONS = (
    "md", "markdown", "txt", "rst", "adoc", "java", "kt", "kts", "py", "js", "jsx",
    "ts", "tsx", "go", "rs", "c", "h", "cpp", "hpp", "cs", "php", "rb", "swift",
    "scala", "sql", "sh", "bash", "ps1", "bat", "cmd", "css", "scss", "less", "xml",
    "json", "jsonl", "yaml", "yml", "toml", "ini", "properties", "conf", "vue", "svelte",
    "gradle", "dockerfile", "csv", "tsv", "proto", "graphql", "gql", "tf", "tfvars", "hcl",
    "lua", "r", "pl", "pm", "ex", "exs", "erl", "dart", "groovy",
)
TEXT_NAMES = ("dockerfile", "makefile", "readme", "license", "gemfile", "rakefile", "procfile", "vagrantfile", "justfile", "taskfile")


def html(data: bytes, charset: str = "utf-8") -> list[Section] | None:
    from .html import page_units

    found: dict[int, Section] = {}
    for u in page_units(decoded(data, charset)):
        found.setdefault(u["section"], (u["title"], u["title"], []))[2].append((u["number"], u["text"]))
    return list(found.values()) or None


READERS = {
    r.id: r
    for r in (
        Reader("plain-text", 2, TEXT_EXTENSIONS, TEXT_NAMES, 2 << 20, plain_text),
        Reader("html", 1, ("html", "htm", "xhtml"), (), 8 << 20, html),
        Reader("docx", 1, ("docx",), (), 8 << 20, docx),
        Reader("pptx", 1, ("pptx",), (), 8 << 20, pptx),
        Reader("xlsx", 1, ("xlsx",), (), 8 << 20, xlsx),
    )
}


def of_charset(charset: str) -> dict[str, Reader]:
    """The readers for sources whose texts may be of an older charset, such as gb18030, where they aren't UTF-8."""
    "".encode(charset)  # an unknown one fails here, not in every document
    return READERS | {k: replace(READERS[k], read=partial(READERS[k].read, charset=charset)) for k in ("plain-text", "html")}


UNITS = "root string, path string, relative_path string, reader_id string, section int, title string, label string, number int, text string, error string"


def _read(readers: dict[str, Reader]):
    def rows(root, path, relative, reader_id) -> Iterator[tuple]:
        own = (root, path, relative, reader_id)
        try:
            with open(path, "rb") as f:
                sections = readers[reader_id].read(f.read())
            if sections is None:
                yield *own, None, None, None, None, None, "no text"
            for k, (title, label, units) in enumerate(sections or ()):
                for number, text in units:
                    yield *own, k, title, label, number, text, None
        except Exception as failure:  # one document's failure is a row, and the scan goes on
            yield *own, None, None, None, None, None, f"{type(failure).__name__}: {failure}"

    def of_batches(batches):
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
        for batch in batches:
            for own in zip(*(batch.column(c).to_pylist() for c in ("root", "path", "relative_path", "reader_id"))):
                cols = list(zip(*rows(*own))) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in UNITS.split(", ")])

    return of_batches


def read(documents: DataFrame, readers: dict[str, Reader] = READERS) -> DataFrame:
    """One row for each unit of each document (root, path, relative_path, reader_id): section, title, label, number, text; or one row with its error."""
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return documents.select("root", "path", "relative_path", "reader_id").repartition(parts, "path").mapInArrow(_read(readers), UNITS)
