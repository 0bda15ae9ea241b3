"""WARC derivatives: metadata and plain-text conversion records made from response records.

A page becomes a response record; from each response come a metadata record (application/warc-fields) and a
conversion record (text/plain). Both name the response in refers_to, keep its target URI and carry its HTTP
headers and payload digest along with their own block digest. Record ids are derived from the response, so a
repeated build names the same records.

Only DataFrame functions are used: a page is read once and nothing is shuffled. Nulls: a null url or html is
empty text, a null page_id an empty part of the id. Repeated pages give repeated records. Empty pages give
records with an empty text. An empty table gives no records; pages are taken whole, however long.
Extra columns are ignored. Where a tag or comment is never closed, its text stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DROPPED = ("script", "style", "noscript", "svg", "canvas", "template")
BREAKS = "p|div|br|h[1-6]|li|ul|ol|dl|dt|dd|table|tr|article|section|main|header|footer|nav|aside|blockquote|pre|title|body|head|html"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))
#: Each in turn is replaced everywhere; the patterns mean the same to Java and to RE2.
STEPS = (
    (r"(?s)<!--.*?-->", ""),
    *((rf"(?is)<{t}(\s[^>]*)?>.*?</{t}\s*>", "") for t in DROPPED),
    (rf"(?i)</?({BREAKS})(\s[^>]*)?/?>", "\n"),
    (r"<[^>]*>", ""),
)
TIDY = ((r"[ \t\r\f]+", " "), (r" ?\n[ \n]*", "\n"), (r"^[ \n]+|[ \n]+$", ""))
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
TITLE = r"(?is)<title[^>]*>([^<]*)"
LANG = r"(?i)<html[^>]*\slang=\"?([A-Za-z-]+)"
LINK = r"(?i)<a\s[^>]*href="
WARC_DATE = "1970-01-01T00:00:00Z"  # pages carry no date


def _urn(*parts) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-" if a < 21 else ">"))])


def plain_text(html: Column) -> Column:
    """Text of a page: without comments, scripts and tags; a line for each block."""
    for pattern, to in STEPS:
        html = F.regexp_replace(html, pattern, to)
    for name, to in ENTITIES:
        html = F.replace(html, F.lit(name), F.lit(to))
    for pattern, to in TIDY:
        html = F.regexp_replace(html, pattern, to)
    return html


def responses(pages: DataFrame) -> DataFrame:
    """(page_id, record_id, target_uri, http_header, payload_digest, html) of each page."""
    html, url = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("html", "url"))
    return pages.select(
        "page_id",
        _urn(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), url).alias("record_id"),
        url.alias("target_uri"),
        F.concat(F.lit(HTTP), F.octet_length(html).cast("string")).alias("http_header"),
        F.concat(F.lit("sha256:"), F.sha2(html, 256)).alias("payload_digest"),
        html.alias("html"),
    )


def derivatives(source: DataFrame) -> DataFrame:
    """Two records for each response: (page_id, record_type, record_id, refers_to, target_uri, content_type, content_length, block_digest, source_header, source_digest, block)."""
    fields = source.select(
        "page_id",
        "record_id",
        "target_uri",
        "http_header",
        "payload_digest",
        plain_text(F.col("html")).alias("plain"),
        F.concat(
            F.lit("title: "), F.trim(F.regexp_replace(F.regexp_extract("html", TITLE, 1), r"[ \t\r\n]+", " ")),
            F.lit("\r\nlanguage: "), F.lower(F.regexp_extract("html", LANG, 1)),
            F.lit("\r\noutlinks: "), F.regexp_count("html", F.lit(LINK)).cast("string"),
            F.lit("\r\nsource-length: "), F.octet_length("html").cast("string"), F.lit("\r\n"),
        ).alias("fields"),
    )

    def record(kind: str, content_type: str, block: str) -> Column:
        return F.struct(
            F.lit(kind).alias("record_type"),
            _urn(F.lit(kind), F.col("record_id")).alias("record_id"),
            F.lit(content_type).alias("content_type"),
            F.octet_length(block).cast("long").alias("content_length"),
            F.concat(F.lit("sha256:"), F.sha2(F.col(block), 256)).alias("block_digest"),
            F.col(block).alias("block"),
        )

    both = F.array(record("metadata", "application/warc-fields", "fields"), record("conversion", "text/plain; charset=utf-8", "plain"))
    out = fields.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "http_header", "payload_digest", F.explode(both).alias("r"))
    return out.select("page_id", "r.record_type", "r.record_id", "refers_to", "target_uri", "r.content_type", "r.content_length", "r.block_digest", F.col("http_header").alias("source_header"), F.col("payload_digest").alias("source_digest"), "r.block")


def serialized(records: DataFrame) -> DataFrame:
    """One column, record: a whole WARC/1.1 record without its closing blank lines."""
    head = [("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Payload-Digest", "source_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length")]
    lines = [F.concat(F.lit(f"{name}: "), F.col(c).cast("string")) for name, c in head]
    return records.select(F.concat_ws("\r\n", F.lit("WARC/1.1"), F.lit(f"WARC-Date: {WARC_DATE}"), *lines, F.lit(""), F.col("block")).alias("record"))


def write_warc(records: DataFrame, path: str) -> None:
    """Gzipped WARC files, one for each partition: records end in two line breaks."""
    serialized(records).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def op9_warc(spark, sf_dir: str) -> DataFrame:
    return derivatives(responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def _duck() -> str:
    q = lambda s: "'" + s.replace("'", "''").replace("\r", "' || chr(13) || '").replace("\n", "' || chr(10) || '") + "'"
    text = "html"
    for pattern, to in STEPS:
        text = f"regexp_replace({text}, {q(pattern)}, {q(to)}, 'g')"
    for name, to in ENTITIES:
        text = f"replace({text}, {q(name)}, {q(to)})"
    for pattern, to in TIDY:
        text = f"regexp_replace({text}, {q(pattern)}, {q(to)}, 'g')"
    urn = lambda h: f"'<urn:uuid:' || substr({h},1,8) || '-' || substr({h},9,4) || '-' || substr({h},13,4) || '-' || substr({h},17,4) || '-' || substr({h},21,12) || '>'"
    return f"""
WITH s AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS html FROM pages),
r AS (SELECT *, md5('response|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || target_uri) AS h FROM s),
f AS (SELECT page_id, target_uri, {urn('h')} AS refers_to, {q(HTTP)} || CAST(strlen(html) AS VARCHAR) AS source_header,
  'sha256:' || sha256(html) AS source_digest, {text} AS plain,
  'title: ' || trim(regexp_replace(regexp_extract(html, {q(TITLE)}, 1), {q(r'[ \t\r\n]+')}, ' ', 'g'))
  || {q(chr(13) + chr(10) + 'language: ')} || lower(regexp_extract(html, {q(LANG)}, 1))
  || {q(chr(13) + chr(10) + 'outlinks: ')} || CAST(len(regexp_extract_all(html, {q(LINK)})) AS VARCHAR)
  || {q(chr(13) + chr(10) + 'source-length: ')} || CAST(strlen(html) AS VARCHAR) || {q(chr(13) + chr(10))} AS fields FROM r),
b AS (SELECT page_id, 'metadata' AS record_type, refers_to, target_uri, 'application/warc-fields' AS content_type, source_header, source_digest, fields AS block FROM f
  UNION ALL SELECT page_id, 'conversion', refers_to, target_uri, 'text/plain; charset=utf-8', source_header, source_digest, plain FROM f),
h AS (SELECT *, md5(record_type || '|' || refers_to) AS h FROM b)
SELECT page_id, record_type, {urn('h')} AS record_id, refers_to, target_uri, content_type, CAST(strlen(block) AS BIGINT) AS content_length,
  'sha256:' || sha256(block) AS block_digest, source_header, source_digest, block FROM h"""


ORACLE_SQL = _duck()
