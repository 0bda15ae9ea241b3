"""Chunks of documents (survey J1-J4, I18, A20): ranges of lines by estimated tokens.

The ranges are a fold over a document's lines. It runs in Arrow batches, together with what depends on it (lines,
contents, ids), and is linear in the text. Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import CHUNKED_CODE_EXTENSIONS

TARGET, OVERLAP, PARAGRAPH, LEAST = 320, 40, 80, 12
CODE_TARGET, CODE_OVERLAP, CODE_BACK = 420, 64, 4
SPACE = " \t\n\x0b\f\r"
CHUNKS = "doc_id {kind}, path string, file_name string, extension string, start_line int, end_line int, source_location string, content string, chunk_id string"
_WIDE = re.compile(r"[\u1100-\u11ff\u2e80-\u2fd5\u3005\u3007\u3021-\u3029\u3038-\u303b\u3041-\u3096\u309d-\u309f\u30a1-\u30fa\u30fd-\u30ff\u3131-\u318e\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua960-\ua97c\uac00-\ud7fb\uf900-\ufad9\uff66-\uff9d\uffa0-\uffdc\U00020000-\U000323af]")

# Modifiers and kinds of declarations in source code.
_MODIFIERS = "public|protected|private|static|final|abstract|synchronized|override|open|internal|async"
_KINDS = "class|interface|record|enum|struct|trait|object|def|function|fun|fn|func|type"
_NAME = r"([A-Za-z_$][\w$]*)"
_DECLARED = (
    re.compile(rf"^\s*(?:(?:{_MODIFIERS}|native|export|default)\s+)*(?:{_KINDS})\s+{_NAME}", re.IGNORECASE),
    re.compile(rf"^\s*(?:export\s+)?(?:const|let|var)\s+{_NAME}\s*=.*=>"),
    re.compile(rf"^\s*(?:(?:{_MODIFIERS})\s+)*(?:[A-Za-z_$][\w$<>?,.\[\] ]+\s+)?{_NAME}\s*\([^;]*\)\s*(?:\{{|throws\b.*|:)?\s*$"),
)
_NO_METHODS = {"if", "for", "while", "switch", "catch", "return", "new"}
_LEADING = re.compile(r"^\s*(?:@|#|//|/\*|\*|\"|$)")


def prose_ranges(tokens: list[int], blank: list[bool]) -> list[tuple[int, int]]:
    """First and last unit of each chunk: full at `TARGET` tokens, with an overlap, or at a blank unit from `PARAGRAPH` on, without one."""
    out, start, held = [], 0, 0
    for i, n in enumerate(tokens):
        held += n
        if held >= TARGET:
            out.append((start, i))
            s, back = i, tokens[i]
            while s > start and back < OVERLAP:
                s -= 1
                back += tokens[s]
            start, held = s, back
        elif blank[i] and held >= PARAGRAPH:
            out.append((start, i))
            start, held = i + 1, 0
    if start < len(tokens) and (start, len(tokens) - 1) not in out[-1:]:
        out.append((start, len(tokens) - 1))
    return out


def window_ranges(tokens: list[int], a: int, b: int, target: int = CODE_TARGET, overlap: int = CODE_OVERLAP) -> list[tuple[int, int]]:
    """Windows over units a to b of at least `target` tokens; each steps back by about `overlap`, and always goes on."""
    out, start = [], a
    while start <= b:
        end, held = start, tokens[start]
        while end < b and held < target:
            end += 1
            held += tokens[end]
        out.append((start, end))
        if end == b:
            break
        s, back = end + 1, 0
        while s > start + 1 and back < overlap:
            s -= 1
            back += tokens[s]
        start = s
    return out


def code_ranges(lines: list[str], tokens: list[int]) -> list[tuple[int, int, str]]:
    """Ranges between declarations, each with the annotations and comments before it and the declared name; what comes first is `header`."""
    starts = []
    for i, line in enumerate(lines):
        m = next((m for p in _DECLARED if (m := p.match(line)) and (p is not _DECLARED[2] or m[1] not in _NO_METHODS)), None)
        if m:
            s = i
            while s > 0 and i - s < CODE_BACK and _LEADING.match(lines[s - 1]) and (not starts or s - 1 > starts[-1][0]):
                s -= 1
            starts.append((s, m[1]))
    if not starts:
        return [(a, b, "") for a, b in window_ranges(tokens, 0, len(lines) - 1)]
    parts = [(0, "header"), *starts] if starts[0][0] > 0 else starts
    ends = [s - 1 for s, _ in parts[1:]] + [len(lines) - 1]
    return [(a, b, label) for (s, label), e in zip(parts, ends) for a, b in window_ranges(tokens, s, e)]


def unit_tokens(line: str) -> int:
    """Estimated tokens of a line: wide characters, and a quarter of the others, rounded up; one at least."""
    wide = 0 if line.isascii() else len(_WIDE.findall(line))
    return max(1, wide + -(-(len(line) - wide) // 4))


def units(text: str) -> list[str]:
    """Lines without their trailing white space."""
    return [x.rstrip(SPACE) for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n")]


def of_document(path: str, extension: str, text: str) -> list[tuple[int, int, str, str, str]]:
    """(start_line, end_line, source_location, content, chunk_id) of the chunks of a document."""
    lines = units(text)
    tokens, blank = [unit_tokens(x) for x in lines], [not x for x in lines]
    code = (extension or "").lower() in CHUNKED_CODE_EXTENSIONS
    out = []
    for a, b, label in code_ranges(lines, tokens) if code else [(a, b, "") for a, b in prose_ranges(tokens, blank)]:
        while a <= b and blank[a]:
            a += 1
        while b >= a and blank[b]:
            b -= 1
        content = "\n".join(lines[a : b + 1]).strip(SPACE)
        if len(content) >= LEAST:
            where = f"L{a + 1}-{b + 1}"
            location = f"{label} · {where}" if label else where
            out.append((a + 1, b + 1, location, content, hashlib.sha1(f"{path}:{location}:{content}".encode()).hexdigest()))
    return out


def _chunked(batches):
    for batch in batches:
        found = [of_document(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("path", "extension", "content")))]
        rows = pa.array([k for k, x in enumerate(found) for _ in x], pa.int64())
        cols = list(zip(*[c for x in found for c in x])) or [()] * 5
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([*[batch.column(c).take(rows) for c in ("doc_id", "path", "file_name", "extension")], *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["doc_id", "path", "file_name", "extension", "start_line", "end_line", "source_location", "content", "chunk_id"])


def chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, path, file_name, extension, start_line, end_line, source_location, content, chunk_id) of documents (chunk_id, path, file_name, extension, content)."""
    rows = docs.select(F.col("chunk_id").alias("doc_id"), "path", "file_name", "extension", F.coalesce("content", F.lit("")).alias("content"))
    return rows.mapInArrow(_chunked, CHUNKS.format(kind=rows.schema["doc_id"].dataType.simpleString()))
