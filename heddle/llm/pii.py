"""PII: patterns propose spans, checksums confirm them, context words nearby adjust the score.

Base kinds: email, ip (parts of 255 at most), card (Luhn), phone (9 to 15 digits). A base span that passes its
check always stays. Further kinds are proposed by pattern, confirmed by a checksum where one exists (IBAN:
mod 97) and stay if their score is `ACCEPT` or more: iban, ssn and secret. A score is the kind's own plus a
bonus if one of its context words stands within `CONTEXT` characters before or after the span. Positions are
code points, the end exclusive. Each kind is scanned in time proportional to the text.

Nulls: a null text is empty and has no spans; a null doc_id stays null. Repeated rows are judged each for itself. Of
spans of one kind the leftmost counts, so there are no ties. Texts are scanned whole, however long. An empty table
gives no rows. Extra columns are ignored; `redact` returns the columns it is given.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .textarrays import string_buffer

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = KINDS[:4]
CONTEXT = 40
ACCEPT = 0.5
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4, "secret": 0.6}
BONUS = 0.35
WORDS = {
    "email": ("mail", "contact", "write to"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank"),
    "ssn": ("ssn", "social security"),
    "secret": ("key", "secret", "token", "password", "credential"),
}
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?:password|passwd|secret|token|api_key)\x20?[=:]\x20?\"?[A-Za-z0-9_/+-]{12,128}\"?)")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    double = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in double)) % 10 == 0


def mod97(code: str) -> bool:
    code = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(t: str):
    p, done = t.find("@"), 0
    while p >= 0:
        local = _LOCAL.match(t[done:p][::-1]).end()
        m = _DOMAIN.match(t, p + 1) if local else None
        if m:
            yield p - local, m.end()
        done = m.end() if m else p + 1
        p = t.find("@", done)


def _ips(t: str):
    for m in _IP.finditer(t):
        if all(len(x) <= 3 and int(x) <= 255 for x in (y.lstrip("0") or "0" for y in m[0].split("."))):
            yield m.span()


def _cards(t: str):
    for m in _CARD.finditer(t):
        d = _NOT_DIGIT.sub("", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            yield m.span()


def _phones(t: str):
    for m in _PHONE.finditer(t):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            yield m.span()


def _score(kind: str, t: str, a: int, b: int) -> float:
    near = t[max(0, a - CONTEXT) : a].lower() + " " + t[b : b + CONTEXT].lower()
    return min(1.0, SCORE[kind] + BONUS * any(w in near for w in WORDS[kind]))


def spans(t: str | None) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score), by start and then by kind as listed."""
    if not t:
        return []
    found = [(a, b, kind) for kind, of in (("email", _emails), ("ip", _ips), ("card", _cards), ("phone", _phones)) for a, b in of(t)]
    found += [(*m.span(), "iban") for m in _IBAN.finditer(t) if mod97(m[0])]
    found += [(*m.span(), kind) for kind, of in (("ssn", _SSN), ("secret", _SECRET)) for m in of.finditer(t)]
    scored = [(a, b, k, _score(k, t, a, b)) for a, b, k in found]
    return sorted((s for s in scored if s[2] in BASE or s[3] >= ACCEPT), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


_MARK = np.isin(np.arange(256), np.frombuffer(b"0123456789@+", np.uint8))
_MARK_WORD = (b"AKIA", b"password", b"passwd", b"secret", b"token", b"api_key")  # every alternative of _SECRET begins with one


def _may_hold(texts: pa.Array) -> np.ndarray:
    """Texts without a digit, an at sign, a plus or a secret's name hold nothing that the patterns can propose."""
    buf, off = string_buffer(texts)
    seen = np.r_[0, np.cumsum(_MARK[buf], dtype=np.int64)]
    may = seen[off[1:]] > seen[off[:-1]]
    raw = buf.tobytes()
    for word in _MARK_WORD:
        at = raw.find(word)
        while at >= 0:
            may[np.searchsorted(off, at, "right") - 1] = True
            at = raw.find(word, at + 1)
    return may


def _each(batch, name: str = "text"):
    """The spans of each text of a batch."""
    texts = batch.column(name)
    may = _may_hold(texts)
    return [spans(texts[i].as_py()) if m else [] for i, m in enumerate(may.tolist())]


SPANS = "array<struct<start:int,end:int,kind:string,score:double>>"


def _found(batches):
    for batch in batches:
        rows = [[dict(zip(("start", "end", "kind", "score"), s)) for s in x] for x in _each(batch)]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"])


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of every document."""
    B.small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_found, f"doc_id long, spans {SPANS}")


def blanked(t: str, found) -> str:
    """The text with its spans replaced by their kind in angle brackets; of overlapping spans the first names the whole."""
    out, at = [], 0
    for a, b, kind, _ in found:
        if a >= at:
            out += [t[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, t[at:]])


def _blank(batches):
    for batch in batches:
        texts = batch.column("text")
        hit = {i: blanked(texts[i].as_py(), x) for i, x in enumerate(_each(batch)) if x}
        if hit:
            at = batch.schema.get_field_index("text")
            mask = np.zeros(len(texts), bool)
            mask[list(hit)] = True
            texts = pa.compute.replace_with_mask(texts, pa.array(mask), pa.array(list(hit.values()), texts.type))
            batch = batch.set_column(at, batch.schema.field(at), texts)
        yield batch


def redact(docs: DataFrame) -> DataFrame:
    """The documents with personal data blanked out of their texts, and n_chars counted anew if they have it."""
    B.small_batches(docs.sparkSession)
    out = docs.mapInArrow(_blank, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op10_pii(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    of_kind = lambda k: lambda x: x["kind"] == k
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *[F.size(F.filter("spans", of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda x: F.format_number(x["score"], 2)), ",").alias("scores"),
    )
