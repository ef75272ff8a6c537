"""Vectorised word splitting and hashing over Arrow string columns.

Every function works on a bounded slice of a record batch (about 2 MB of text, or one document if that is longer), so a
task's memory does not grow with the table. Hashes are 64-bit values that depend on the bytes alone and are the same in
every process.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICE_BYTES = 2 << 20
_MASK = (1 << 64) - 1
_rng = np.random.default_rng(20240501)
_MULT = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _table(lower: bool, alnum: bool) -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    if lower:
        t[65:91] += 32
    if alnum:
        keep = np.zeros(256, bool)
        keep[48:58] = keep[97:123] = keep[128:] = True
        t[~keep[t]] = 32
    t[9:14] = 32
    return t


#: Byte tables by (lower-case A-Z, letters and digits only): separators become a space.
TABLES = {(lo, al): _table(lo, al) for lo in (False, True) for al in (False, True)}
#: The table of lower-cased words of letters alone.
LETTERS = TABLES[(True, True)].copy()
LETTERS[48:58] = 32


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser; other salts give independent functions."""
    x = x ^ np.uint64((int(salt) * 0xD1B54A32D192ED03 + 0x8CB92BA72F3D8DD7) & _MASK)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Words of more bytes are hashed one by one.
LONG_WORD = 512


def range_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of bytes: its length, then lane after lane of eight bytes, each mixed before the next."""
    size = end - start
    if not len(size):
        return np.empty(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    short = np.minimum(size, LONG_WORD)
    out = mix(size.astype(np.uint64), 31)
    rows, j = np.flatnonzero(short > 0), 0
    while len(rows):
        left = np.minimum(short[rows] - 8 * j, 8).astype(np.uint64)
        lane = lanes[start[rows] + 8 * j] << (np.uint64(8) * (np.uint64(8) - left))
        out[rows] = mix(out[rows] * np.uint64(0x9E3779B97F4A7C15) + lane, 32)
        j += 1
        rows = rows[short[rows] > 8 * j]
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


@dataclass
class Words:
    """The words of some documents: byte ranges in data, document index and hash of each word."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    n_docs: int

    def bounds(self) -> np.ndarray:
        """Where each document's words begin; one entry more than documents."""
        return np.searchsorted(self.doc, np.arange(self.n_docs + 1))

    def head(self, n: int) -> np.ndarray:
        """Hash of each word's first n bytes (all of a shorter word)."""
        return range_hash(self.data, self.start, np.minimum(self.end, self.start + n))


def short_batches(df: DataFrame, rows: int = 2000) -> DataFrame:
    """df, after limiting the rows of an Arrow batch in its session, so that a batch of long texts fits a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, str(rows))
    return df


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as an empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Pieces of the batches of at most limit bytes of text each (or one row), with that text's bytes and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, off = text_buffer(batch.column(batch.schema.get_field_index(column)))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
            yield batch.slice(lo, hi - lo), data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            lo = hi


def words(data: np.ndarray, off: np.ndarray, lower: bool = False, alnum: bool = False, letters: bool = False) -> Words:
    """Words of the texts: runs of bytes other than space and 09-0D, or (alnum) of 0-9, a-z and bytes over 7F, or (letters)
    of a-z and bytes over 7F.

    UTF-8 bytes of characters beyond ASCII are never separators, so this equals splitting by code points.
    """
    n = len(data)
    mapped = (LETTERS if letters else TABLES[(lower, alnum)])[data]
    is_word = mapped != 32
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0] = after[-1] = True
        before[1:] = ~is_word[:-1]
        after[:-1] = ~is_word[1:]
        first = off[:-1][off[:-1] < n]
        before[first] = True
        after[first[first > 0] - 1] = True
    start = np.flatnonzero(is_word & before)
    end = np.flatnonzero(is_word & after) + 1
    doc = np.searchsorted(off, start, "right") - 1
    return Words(mapped, start, end, doc, range_hash(mapped, start, end), len(off) - 1)


def word_column(w: Words) -> pa.LargeStringArray:
    """The words as an Arrow column."""
    size = w.end - w.start
    off = np.concatenate([[0], np.cumsum(size)])
    data = w.data[np.repeat(w.start - off[:-1], size) + np.arange(off[-1])]
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data))


def text_names(w: Words, off: np.ndarray) -> np.ndarray:
    """Two 64-bit numbers for each text, a cryptographic hash of its words in their order."""
    keep = w.data != 32
    keep[1:] |= keep[:-1].copy()
    cut = np.concatenate([[0], np.cumsum(keep)])[off]
    raw = w.data[keep].tobytes()
    names = b"".join(hashlib.blake2b(raw[a:b].strip(b" "), digest_size=16).digest() for a, b in zip(cut[:-1], cut[1:], strict=True))
    return np.frombuffer(names, "<u8").reshape(-1, 2)


def same_words(a: Words, at_a: np.ndarray, b: Words, at_b: np.ndarray, k: int) -> np.ndarray:
    """Whether the k words from each place on are the same in both."""
    words_a, words_b = ((at[:, None] + np.arange(k)).ravel() for at in (at_a, at_b))
    size = a.end[words_a] - a.start[words_a]
    same = size == b.end[words_b] - b.start[words_b]
    size = np.where(same, size, 0)
    off = np.cumsum(size) - size
    byte = np.arange(size.sum())
    differs = a.data[np.repeat(a.start[words_a] - off, size) + byte] != b.data[np.repeat(b.start[words_b] - off, size) + byte]
    upto = np.concatenate([[0], np.cumsum(differs)])
    return (same & (upto[off + size] == upto[off])).reshape(-1, k).all(1)


def runs(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within a document, and the index of each run's first word."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    total = h[:n] * _MULT[0]
    for j in range(1, k):
        total += h[j : j + n] * _MULT[j]
    return mix(total[at], k), at


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document in ascending order, and the documents' bounds.

    A document of fewer than k words, but not none, has its whole sequence as one shingle.
    """
    h, at = runs(w.hash, w.doc, k)
    owner = w.doc[at]
    count = np.bincount(w.doc, minlength=w.n_docs)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        first = np.searchsorted(w.doc, short)
        extra = np.array([mix(np.sum(w.hash[a : a + c] * _MULT[:c], dtype=np.uint64, keepdims=True), c)[0] for a, c in zip(first, count[short], strict=True)], np.uint64)
        place = np.searchsorted(owner, short)
        h, owner = np.insert(h, place, extra), np.insert(owner, place, short)
    cut = np.searchsorted(owner, np.arange(w.n_docs + 1))
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        h[a:b].sort()
    if len(h):
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        h, owner = h[keep], owner[keep]
    return h, np.searchsorted(owner, np.arange(w.n_docs + 1))
