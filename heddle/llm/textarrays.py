"""Texts of an Arrow batch as flat arrays: words, word hashes, n-gram hashes.

A batch is handled in slices of a few megabytes, so that a task's memory depends on the slice and on the
longest single text, not on the batch. All hashes are 64-bit and depend on bytes alone, so every task and
every pass over the data gives the same value for the same words.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 2 << 20
_RADIX = 0x9E3779B97F4A7C15
_STEP = U64(0xD6E8FEB86659FD93)


def space_split_table() -> np.ndarray:
    """True for bytes of words `[^\\x20\\x09-\\x0D]+`."""
    t = np.ones(256, bool)
    t[[0x20, 9, 10, 11, 12, 13]] = False
    return t


def alnum_table() -> np.ndarray:
    """True for bytes of words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, after lower-casing A-Z."""
    t = np.zeros(256, bool)
    t[0x30:0x3A] = t[0x61:0x7B] = t[0x80:] = True
    return t


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    out = buf.copy()
    upper = (buf >= 65) & (buf <= 90)
    out[upper] += 32
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (in place)."""
    h ^= h >> U64(32)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(29)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(32)
    return h


def worker_state() -> types.ModuleType:
    """What a process keeps from task to task. It is no global of this package, as those travel with every function."""
    return sys.modules.setdefault("heddle_worker_state", types.ModuleType("heddle_worker_state"))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    held = worker_state().__dict__
    if "powers" not in held or len(held["powers"][0]) < n:
        size = max(n, SLICE_BYTES + 4096)
        made = []
        for base in (_RADIX, pow(_RADIX, -1, 1 << 64)):
            x = np.full(size, base, U64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        held["powers"] = tuple(made)
    return held["powers"]


def string_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n+1 offsets; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    n, at = len(texts), texts.offset
    _, offsets, data = texts.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64)[at : at + n + 1]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def slices(texts, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about `limit` bytes, one row at least."""
    buf, off = string_buffer(texts)
    n, a = len(off) - 1, 0
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1))
        yield a, b, buf[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


class Words:
    """Words of some texts. starts, ends: byte positions; off: the n+1 word offsets of the texts."""

    __slots__ = ("buf", "starts", "ends", "off", "doc_off")

    def __init__(self, buf: np.ndarray, doc_off: np.ndarray, table: np.ndarray):
        self.buf, self.doc_off = buf, doc_off
        m = table[buf]
        n = len(buf)
        if not n:
            self.starts = self.ends = np.zeros(0, np.int64)
            self.off = np.zeros(len(doc_off), np.int64)
            return
        first = m.copy()
        first[1:] &= ~m[:-1]
        inner = doc_off[(doc_off < n)]
        first[inner] = m[inner]
        last = m.copy()
        last[:-1] &= ~m[1:]
        ends = doc_off[(doc_off > 0)] - 1
        last[ends] = m[ends]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.off = np.searchsorted(self.starts, doc_off).astype(np.int64)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.off)

    def doc(self) -> np.ndarray:
        """The text's number for each word."""
        return np.repeat(np.arange(len(self.off) - 1), self.counts())

    def left(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        return np.repeat(self.off[1:], self.counts()) - np.arange(len(self))

    def hashes(self) -> np.ndarray:
        return span_hashes(self.buf, self.starts, self.ends)

    def place(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.ends[i]].tobytes()


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span, the same wherever the span stands."""
    n = len(buf)
    up, down = _powers(n + 1)
    total = np.empty(n + 1, U64)
    total[0] = 0
    np.cumsum((buf.astype(U64) + U64(1)) * up[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def ngram_hashes(h: np.ndarray, n: int, step: np.uint64 = _STEP, salt: int = 0) -> np.ndarray:
    """Hash of the n words from each position; the last n-1 are of no use. Positions aren't held to one text."""
    size = len(h) - n + 1
    if size <= 0:
        return np.zeros(0, U64)
    out = h[:size] + U64(salt)
    for k in range(1, n):
        out *= step
        out += h[k : k + size]
    return mix(out)


def pack(*arrays: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(a).tobytes() for a in arrays]


def unpack(values, dtype) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), dtype) if v.is_valid else np.zeros(0, dtype) for v in values]


def split_by(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that groups rows by key 0..n-1 (stable), and the n+1 bounds of the groups."""
    order = np.argsort(keys, kind="stable")
    return order, np.searchsorted(keys[order], np.arange(n + 1))
