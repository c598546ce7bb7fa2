"""Vectorised kernels over the bytes of UTF-8 texts.

A block of texts is one ``uint8`` buffer and the offsets of its documents. Words are found with byte tables (every
class the operators use is closed under UTF-8: bytes from 0x80 belong to code points from U+0080), hashed with a
polynomial over random byte values, and n-grams of words are hashed from the word hashes. All arithmetic wraps at 64 bit.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 20
#: Words of more bytes are hashed one by one.
LONG = 64
_GOLDEN = 0x9E3779B97F4A7C15


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * np.uint64(_GOLDEN)) | np.uint64(1)


_BYTE = constants(256, 1)
_BASE = int(constants(1, 2)[0])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW = _powers(_BASE, SEGMENT + 1)
_INV = _powers(pow(_BASE, -1, 1 << 64), SEGMENT + 1)

#: Words of anything but ASCII white space: [^\x20\x09-\x0D]+
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words of digits, ASCII letters in lower case and everything beyond ASCII, after lower-casing A-Z.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def release() -> None:
    """Give freed memory back to the system: workers live on between tasks, and an executor counts what they hold."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def buffer_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not (pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.string())
    column = pc.fill_null(column, b"" if "binary" in str(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, at - at[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``most`` bytes of text, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cut = (np.cumsum(lengths) - lengths) // most
        edges = [0, *(np.flatnonzero(np.diff(cut)) + 1), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            yield batch.slice(a, b - a)
        del batch, lengths, cut
        release()


def words(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word of every document (n + 1 numbers)."""
    if not buf.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = table[buf]
    edge = np.zeros(buf.size + 1, bool)  # documents touch in the buffer, words must not
    edge[offsets] = True
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before &= ~edge[:-1]
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after &= ~edge[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes, for features, not for identity; segment by segment, so that memory does not follow the buffer."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, a + SEGMENT, "right")))
        n = int(ends[j - 1] - a)
        power, inverse = (_POW, _INV) if n <= SEGMENT else (_powers(_BASE, n + 1), _INV)  # one word beyond a segment starts at 0
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[buf[a : a + n]] * power[:n], dtype=np.uint64, out=total[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64)
        i = j
    return mix64(out)


def word_keys(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash that may stand for a word: its blocks of 8 bytes go one by one through a keyed bijection, and words
    above LONG bytes through BLAKE2. (Sums of powers, as in word_hashes, collide for whole families of regular words.)"""
    lengths = (ends - starts).astype(np.int64)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray(max(0, len(padded) - 7), "<u8", padded.data, 0, (1,))
    out = mix64(lengths.astype(np.uint64) + np.uint64(_GOLDEN))
    at = np.arange(len(starts))
    for i, c in enumerate(constants(LONG // 8, 41)):
        if i:
            at = at[lengths[at] > 8 * i]
        if not len(at):
            break
        block, left = eight[starts[at] + 8 * i], lengths[at] - 8 * i
        cut = left < 8
        block[cut] &= (np.uint64(1) << (8 * left[cut]).astype(np.uint64)) - np.uint64(1)
        out[at] = mix64((out[at] ^ block) + c)
    for i in np.flatnonzero(lengths > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def ngrams(hashes: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """Hash of the k words from each position on; the last k - 1 positions have none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i, c in enumerate(constants(k, seed)):
        out += hashes[i : i + n] * c
    return mix64(out)


def owners(first: np.ndarray) -> np.ndarray:
    """The document of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def whole(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """Whether the k words from each of the n n-gram positions on are of one document."""
    ok = np.ones(max(n, 0) + k, bool)
    for i in range(1, k):
        ends = first[1:-1] - i
        ok[ends[ends >= 0]] = False
    return ok[: max(n, 0)]


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each document, A-Z lower-cased: hashes ordered by document and hash, and the n + 1
    bounds. A document of fewer words has its whole sequence as its one shingle; one without words has none."""
    buf = LOWER[buf]
    starts, ends, first = words(buf, offsets, SPACED)
    h = word_keys(buf, starts, ends)
    grams = ngrams(h, k, 11)
    ok = whole(first, k, len(grams))
    doc, grams = owners(first)[: len(grams)][ok], grams[ok]
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        parts, c = np.zeros(len(short), np.uint64), constants(k, 13)
        for i in range(k - 1):
            has = counts[short] > i
            parts[has] += h[first[short[has]] + i] * c[i]
        parts = mix64(parts + counts[short].astype(np.uint64))
        doc, grams = np.concatenate([doc, short]), np.concatenate([grams, parts])
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    if len(doc):
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
        doc, grams = doc[new], grams[new]
    return grams, np.searchsorted(doc, np.arange(len(offsets)))
