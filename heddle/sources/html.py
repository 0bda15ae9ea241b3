"""Main text of web pages (survey A14, A21): sections by headings, blocks of text."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

DROPPED = {"script", "style", "noscript", "svg", "canvas", "nav", "footer", "aside", "form"}
BLOCKS = {"p", "li", "pre", "blockquote", "dt", "dd", "th", "td"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
UNITS = ArrayType(StructType().add("section", "integer").add("title", "string").add("number", "integer").add("text", "string"))
_SPACE = re.compile(r"\s+")


class _Page(HTMLParser):
    """Collects (kind, text, inside main content) of headings and outermost blocks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.found, self.held, self.kind, self.depth, self.main = [], [], [], None, 0, 0

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if self.kind and tag == "br":
                self.held.append(" ")
            return
        main = tag in ("main", "article") or dict(attrs).get("role") == "main"
        self.open.append((tag, main))
        self.main += main
        if not self.kind and (tag in BLOCKS or tag in HEADINGS) and not any(t in DROPPED for t, _ in self.open):
            self.kind, self.depth, self.held = tag, len(self.open), []

    def handle_endtag(self, tag):
        if not any(t == tag for t, _ in self.open):
            return
        while self.open:
            if self.kind and len(self.open) == self.depth:
                self.flush()
            t, main = self.open.pop()
            self.main -= main
            if t == tag:
                break

    def flush(self):
        text = _SPACE.sub(" ", "".join(self.held)).strip()
        if text:
            self.found.append((self.kind, text, self.main > 0))
        self.kind = None

    def handle_data(self, data):
        if self.kind and not any(t in DROPPED for t, _ in self.open):
            self.held.append(data)


def page_units(html: str | None) -> list[dict]:
    """Blocks of the main content, or of the whole page if it marks none."""
    page = _Page()
    page.feed(html or "")
    page.close()
    if page.kind:
        page.flush()
    inside = any(m for *_, m in page.found)
    out, section, title, number = [], 0, "", 0
    for kind, text, main in page.found:
        if inside and not main:
            continue
        number += 1
        if kind in HEADINGS:
            section, title = section + 1, text
        out.append({"section": section, "title": title, "number": number, "text": text})
    return out


@F.pandas_udf(UNITS)
def _units(html: pd.Series) -> pd.Series:
    return pd.Series([page_units(x) for x in html])


def sections(pages: DataFrame) -> DataFrame:
    """(page_id, url, section, title, number, text) of pages (page_id, url, html)."""
    return pages.select("page_id", "url", F.explode(_units("html")).alias("u")).select("page_id", "url", "u.*")
