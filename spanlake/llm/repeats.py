"""Substring deduplication over fixed-block anchors.

Every document's words are cut into blocks of ANCHOR words, which do not overlap; these are the index. All rolling
windows of ANCHOR words probe it. A repeat of WINDOW >= 2 * ANCHOR - 1 words holds a whole block wherever the cut falls,
so every repeat has an anchor that both of its sides find. Around the hits, the WINDOW-word sequences are compared by
96-bit hashes, and where one also starts in a document of smaller id its words go; overlapping ones join to the maximal
exact repeat. Blocks are met by hashes of so many bits that about one probe in a thousand hits by chance; that costs a
comparison, not a result.

The texts are first written once, in compressed chunks of about CHUNK bytes, to the shared folder. All shuffles then move
packed, sorted arrays with one entry for each distinct window of a chunk, dealt by hash; a passage in a third of all
documents is one entry a chunk. Parts are as many as the words need, so that a task's arrays stay within memory.

Defined cases: null and empty texts have no words; a document shorter than the window loses nothing; a null doc_id is
neither smaller nor larger than another, so its row loses nothing and takes nothing; rows of equal doc_id take nothing
from each other.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as X
from .common import discard, documents, stash, tidy

WINDOW, ANCHOR = 13, 7
CHUNK = 2 << 20
#: Words whose probes make one part.
PART_WORDS = 1_000_000
_CHUNK = "chunk bigint, ids binary, void binary, bounds binary, n_words bigint, body binary"


def chunks(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """One row for each chunk of documents: ids, byte bounds and the compressed texts."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, base = zstandard.ZstdCompressor(level=9), TaskContext.get().partitionId() << 32
        for k, block in enumerate(X.blocks(batches, most=size)):
            buf, offsets = X.buffer_of(block.column("text"))
            ids, void = block.column("doc_id").fill_null(0).to_numpy(), block.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            n = len(X.words(buf, offsets, X.SPACED)[0])
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([base + k], pa.int64()), "ids": pa.array([ids.tobytes()], pa.binary()), "void": pa.array([void.tobytes()], pa.binary()), "bounds": pa.array([offsets.tobytes()], pa.binary()), "n_words": pa.array([n], pa.int64()), "body": pa.array([press.compress(buf.tobytes())], pa.binary())})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pack, _CHUNK)


class Chunk:
    def __init__(self, row: dict):
        self.id = row["chunk"]
        self.ids, self.void = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["void"], bool)
        self.offsets = np.frombuffer(row["bounds"], np.int64)
        self.buf = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["body"], max_output_size=max(1, int(self.offsets[-1]))), np.uint8)
        self.starts, self.ends, self.first = X.words(self.buf, self.offsets, X.SPACED)
        self.hashes = X.word_keys(self.buf, self.starts, self.ends)
        self.doc = X.owners(self.first)

    def windows(self, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-word windows and whether each lies within one document that has an id."""
        h = X.ngrams(self.hashes, k, seed)
        ok = X.whole(self.first, k, len(h))
        return h, ok & ~self.void[self.doc[: len(h)]]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]
            X.release()


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _cuts(part: np.ndarray) -> list[tuple[int, int, int]]:
    """Each value of a sorted array, and where it begins and ends; as many as there are, whatever their range."""
    edges = [*np.flatnonzero(np.r_[True, part[1:] != part[:-1]]).tolist(), len(part)] if len(part) else [0]
    return [(int(part[a]), a, b) for a, b in zip(edges, edges[1:], strict=False)]


def _encode(values: np.ndarray, flags: np.ndarray) -> bytes:
    """Sorted values with 2 flag bits each, as the first value and differences of 3 bytes, or 4 where those are too wide. A
    longer difference is bridged by values without a flag, which match nothing but a block that is then found to be no
    repeat."""
    gaps = np.diff(values, prepend=values[:1])
    room = 22 if len(gaps) and float(np.mean(gaps)) < 1 << 20 else 30
    step = np.uint64((1 << room) - 1)
    if len(gaps) and gaps.max() > step:
        extra = ((gaps - np.minimum(gaps, np.uint64(1))) // step).astype(np.int64)
        at = np.repeat(np.arange(len(gaps)), extra)
        gaps = gaps - extra.astype(np.uint64) * step
        gaps, flags = np.insert(gaps, at, step), np.insert(flags, at, 0)
    packed = (gaps.astype(np.uint32) << np.uint32(2)) | flags.astype(np.uint32)
    body = packed.tobytes() if room == 30 else packed.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    return bytes([room]) + values[:1].astype(np.uint64).tobytes() + body


def _decode(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    base = np.frombuffer(blob, np.uint64, 1, 1)
    if blob[0] == 30:
        raw = np.frombuffer(blob, np.uint32, offset=9)
    else:
        three = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, 3).astype(np.uint32)
        raw = three[:, 0] | three[:, 1] << np.uint32(8) | three[:, 2] << np.uint32(16)
    return np.cumsum(raw >> np.uint32(2), dtype=np.uint64) + base, (raw & np.uint32(3)).astype(np.uint8)


def _arrow(kind: str, **columns: list) -> pa.RecordBatch:
    types = {"l": pa.int64(), "i": pa.int32(), "b": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(v, types[t]) for v, t in zip(columns.values(), kind, strict=True)], names=list(columns))


def anchors(held: DataFrame, parts: int, bits: int, anchor: int) -> DataFrame:
    """(chunk, blob): the sorted window hashes of a chunk that are an indexed block and occur in two documents or more."""
    shift = np.uint64(64 - bits)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            c = Chunk(row)
            h, ok = c.windows(anchor, 29)
            if not len(h):
                continue
            doc = c.doc[: len(h)]
            block = (np.arange(len(h)) - c.first[doc]) % anchor == 0
            h, ids, block = h[ok] >> shift, c.ids[doc[ok]], block[ok]
            order = np.argsort(h)
            h, ids, block = h[order], ids[order], block[order]
            if not len(h):
                continue
            at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            several = np.minimum.reduceat(ids, at) != np.maximum.reduceat(ids, at)
            flags = np.logical_or.reduceat(block, at) + 2 * several
            h = h[at]
            cuts = _cuts(_part(h << shift, parts))
            yield _arrow("ilb", part=[p for p, _, _ in cuts], chunk=[c.id] * len(cuts), blob=[_encode(h[a:b], flags[a:b]) for _, a, b in cuts])

    def meet(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        X.release()
        ids, got = [], []
        for batch in batches:
            ids += batch.column("chunk").to_pylist()
            for b in batch.column("blob"):
                value, flags = _decode(b.as_py())
                got.append(value << np.uint64(2) | flags.astype(np.uint64))  # bits <= 60
        lengths = [len(v) for v in got]
        keyed = np.concatenate(got)
        del got
        order = np.argsort(keyed, kind="stable")
        owner = np.repeat(np.arange(len(ids), dtype=np.int32), lengths)[order]
        keyed = keyed[order]
        del order
        value, flags = keyed >> np.uint64(2), (keyed & np.uint64(3)).astype(np.uint8)
        del keyed
        at = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
        n = np.diff(np.r_[at, len(value)])
        both = np.bitwise_or.reduceat(flags, at)
        live = np.repeat(((both & 1) > 0) & ((n > 1) | (both > 1)), n)
        value, owner = value[live], owner[live]
        order = np.argsort(owner, kind="stable")
        value, owner = value[order], owner[order]
        cuts = _cuts(owner)
        yield _arrow("lb", chunk=[ids[i] for i, _, _ in cuts], blob=[_encode(value[a:b], np.zeros(b - a, np.uint8)) for _, a, b in cuts])

    sent = held.mapInArrow(scatter, "part int, chunk bigint, blob binary")
    return sent.groupBy("part").applyInArrow(meet, "chunk bigint, blob binary")


def _with(held: DataFrame, found: DataFrame) -> DataFrame:
    """Chunks and the lists of what was found for them; as many lists as there are parts, at most."""
    lists = found.groupBy("chunk").agg(F.collect_list("blob").alias("found"))
    return held.join(lists, "chunk", "left")


_SENT = np.dtype([("h", "<u8"), ("x", "<u4"), ("low", "<i8"), ("high", "<i8")])


def sources(held: DataFrame, found: DataFrame, parts: int, bits: int, window: int, anchor: int) -> DataFrame:
    """(chunk, blob): candidate windows of a chunk that start in a document of smaller id than one of its own, each with
    the smallest id."""
    shift = np.uint64(64 - bits)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            if not row["found"]:
                continue
            c = Chunk(row)
            known = np.sort(np.concatenate([_decode(b)[0] for b in row["found"]]))
            h7, ok7 = c.windows(anchor, 29)
            h7 = h7 >> shift
            live = ok7 & (known[np.minimum(np.searchsorted(known, h7), len(known) - 1)] == h7)
            h, ok = c.windows(window, 31)
            if not len(h):
                continue
            run = np.r_[0, np.cumsum(live)]
            reach = window - anchor + 1
            ok &= run[np.arange(len(h)) + reach] > run[: len(h)]
            h, x, ids = h[ok], (X.ngrams(c.hashes, window, 37)[ok] >> np.uint64(32)).astype(np.uint32), c.ids[c.doc[: len(ok)][ok]]
            if not len(h):
                continue
            order = np.lexsort((x, h))
            h, x, ids = h[order], x[order], ids[order]
            at = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (x[1:] != x[:-1])])
            sent = np.empty(len(at), _SENT)
            sent["h"], sent["x"], sent["low"], sent["high"] = h[at], x[at], np.minimum.reduceat(ids, at), np.maximum.reduceat(ids, at)
            cuts, press = _cuts(_part(sent["h"], parts)), zstandard.ZstdCompressor(level=1)
            packed = [press.compress(b"".join(np.ascontiguousarray(sent[n][a:b]).tobytes() for n in _SENT.names)) for _, a, b in cuts]
            yield _arrow("ilb", part=[p for p, _, _ in cuts], chunk=[c.id] * len(cuts), blob=packed)

    def meet(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        X.release()
        ids, got = [], []
        for batch in batches:
            ids += batch.column("chunk").to_pylist()
            for b in batch.column("blob"):
                raw = zstandard.ZstdDecompressor().decompress(b.as_py())
                n, one, a = len(raw) // _SENT.itemsize, np.empty(len(raw) // _SENT.itemsize, _SENT), 0
                for name in _SENT.names:
                    size = _SENT[name].itemsize * n
                    one[name] = np.frombuffer(raw[a : a + size], _SENT[name])
                    a += size
                got.append(one)
        rows, owner = np.concatenate(got), np.repeat(np.arange(len(got)), [len(g) for g in got])
        order = np.lexsort((rows["x"], rows["h"]))
        rows, owner = rows[order], owner[order]
        at = np.flatnonzero(np.r_[True, (rows["h"][1:] != rows["h"][:-1]) | (rows["x"][1:] != rows["x"][:-1])])
        n = np.diff(np.r_[at, len(rows)])
        least = np.repeat(np.minimum.reduceat(rows["low"], at), n)
        live = least < rows["high"]
        rows, owner, least = rows[live], owner[live], least[live]
        order = np.argsort(owner, kind="stable")
        h, least, owner = rows["h"][order], least[order], owner[order]
        cuts, press = _cuts(owner), zstandard.ZstdCompressor(level=3)
        yield _arrow("lb", chunk=[ids[i] for i, _, _ in cuts], blob=[press.compress(h[a:b].tobytes() + least[a:b].tobytes()) for _, a, b in cuts])

    sent = _with(held, found).mapInArrow(scatter, "part int, chunk bigint, blob binary")
    return sent.groupBy("part").applyInArrow(meet, "chunk bigint, blob binary")


def removals(held: DataFrame, found: DataFrame, window: int, with_text: bool = False) -> DataFrame:
    """Per document: word counts, the hash of what is kept, and with_text the kept words themselves."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            c = Chunk(row)
            gone = np.zeros(len(c.starts) + 1, np.int64)
            if row["found"]:
                raw = [zstandard.ZstdDecompressor().decompress(b) for b in row["found"]]
                known = np.concatenate([np.frombuffer(b, np.uint64, len(b) // 16) for b in raw])
                low = np.concatenate([np.frombuffer(b, np.int64, offset=len(b) // 2) for b in raw])
                order = np.argsort(known)
                known, low = known[order], low[order]
                h, ok = c.windows(window, 31)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                own = c.ids[c.doc[: len(h)]]
                hit = np.flatnonzero(ok & (known[at] == h) & (low[at] < own))
                np.add.at(gone, hit, 1)
                np.add.at(gone, hit + window, -1)
            gone = np.cumsum(gone[:-1]) > 0
            n = np.diff(c.first)
            lost = np.add.reduceat(np.r_[gone, False].astype(np.int64), c.first[:-1]) if len(n) else n
            lost[n == 0] = 0
            texts = []
            for d, k in enumerate(lost.tolist()):
                raw = c.buf[c.offsets[d] : c.offsets[d + 1]]
                if k:
                    a, b = c.first[d], c.first[d + 1]
                    keep = np.flatnonzero(~gone[a:b]) + a
                    whole = c.buf.data
                    texts.append(b" ".join([bytes(whole[s:e]) for s, e in zip(c.starts[keep].tolist(), c.ends[keep].tolist(), strict=True)]))
                else:
                    texts.append(b" ".join(raw.tobytes().split()))
            ids = pa.array(c.ids, mask=c.void)
            columns = [ids, pa.array(n.astype(np.int64)), pa.array(lost), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns, names = [*columns, pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return _with(held, found).mapInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * with_text)


def dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = False) -> DataFrame:
    """Remove exact repeats of ``window`` words or more that start in a document of smaller id."""
    if 2 * anchor - 1 > window:
        raise ValueError("a window must hold a whole block: window >= 2 * anchor - 1")
    spark = docs.sparkSession
    held = stash(chunks(docs), "chunks")
    n = held.agg(F.sum("n_words")).first()[0] or 0
    parts, bits = max(1, math.ceil(n / PART_WORDS)), min(60, max(32, 8 + math.ceil(math.log2(n + 1))))
    parts = max(parts, min(24, n // 100_000))
    one = stash(anchors(held, parts, bits, anchor), "anchors")
    tidy(spark)
    two = stash(sources(held, one, parts, bits, window, anchor), "sources")
    discard(one)
    return removals(held, two, window, with_text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
m AS (SELECT gram, min(doc_id) AS low FROM g GROUP BY gram),
h AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM g JOIN m USING (gram) WHERE low < doc_id),
r AS (SELECT doc_id, list(j) AS js, count(*) AS n FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce((SELECT string_agg(w[k], ' ' ORDER BY k) FROM (SELECT unnest(range(1, len(w) + 1)) AS k) WHERE js IS NULL OR NOT list_contains(js, k)), '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
