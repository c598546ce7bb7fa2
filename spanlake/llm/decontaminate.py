"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton is built over word ids of the items. Documents are streamed through it: a vectorised pass finds runs of
words that the items know, and only runs long enough to hold a window walk the automaton, which tracks the longest
suffix that also occurs in an item. Where that length reaches the window, those words are hit. An item shorter than the
window is a window by itself; its end state marks it.

Items are collected in shards of a bounded number of bytes. Each shard is one automaton, which is built of dictionaries and
kept as arrays (some 40 bytes a word); PASS of them go through the texts together. Where there are more, each pass is a job
that writes what it finds, so memory on the driver and the executors is bounded however large the benchmark is.

Defined cases: a null or empty text has no words, is not contaminated and keeps its row; null items and items without
words match nothing; repeated rows each get their result; items of equal id count once.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import batched, chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X
from .common import documents, stash, table

WINDOW = 10
#: A shard takes some 70 bytes a byte while it is built, and about 6 after that.
SHARD_BYTES, PASS = 2 << 20, 8


class Automaton:
    """Suffix automaton of several word-id sequences, as arrays: the words that lead on from state v and where they lead
    are ``word`` and ``to`` from ptr[v] to ptr[v + 1]. top[v] is the state of the last ``window`` words of the strings of v;
    the items that hold them are in ``items`` from item_ptr[top] on. ``short`` are the states that end whole short items."""

    def __init__(self, sequences: list[list[int]], window: int):
        self.window = window
        self._go: list[dict[int, int]] = [{}]
        self._link, self._length = [-1], [0]
        for seq in sequences:
            last = 0
            for w in seq:
                last = self._extend(last, w)
        self.ptr = np.zeros(len(self._go) + 1, np.int32)
        np.cumsum([len(g) for g in self._go], out=self.ptr[1:])
        self.word, self.to = np.zeros(self.ptr[-1], np.int32), np.zeros(self.ptr[-1], np.int32)
        for v, g in enumerate(self._go):
            for k, w in enumerate(sorted(g), int(self.ptr[v])):
                self.word[k], self.to[k] = w, g[w]
            self._go[v] = None
        self.link, self.length = np.array(self._link, np.int32), np.array(self._length, np.int32)
        del self._go, self._link, self._length
        self.top = np.arange(len(self.link), dtype=np.int32)
        for v in np.argsort(self.length, kind="stable")[1:].tolist():
            up = self.link[v]
            if self.length[up] >= window:
                self.top[v] = self.top[up]
        held, short = set(), set()
        step = self._stepper()
        for i, seq in enumerate(sequences):  # states are final now: mark what each prefix ends with, and whole short items
            v = 0
            for n, w in enumerate(seq, 1):
                v = step(v, w)
                if n >= window:
                    held.add((int(self.top[v]), i))
            if 0 < len(seq) < window:
                short.add((v, i))
        self.item_ptr, self.items = self._listed(held)
        self.short_ptr, self.short = self._listed(short)
        self.least = min(window, min((len(s) for s in sequences if s), default=1))

    def _listed(self, pairs: set[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Items by state, and where each state's begin."""
        x = np.array(sorted(pairs), np.int32).reshape(-1, 2)
        return np.searchsorted(x[:, 0], np.arange(len(self.link) + 1)).astype(np.int32), x[:, 1].copy()

    def _stepper(self) -> Callable[[int, int], int]:
        """A function of a state and a word: the next state, or -1."""
        ptr, word, to = memoryview(self.ptr), memoryview(self.word), memoryview(self.to)

        def step(v: int, w: int) -> int:
            end = ptr[v + 1]
            k = bisect_left(word, w, ptr[v], end)
            return to[k] if k < end and word[k] == w else -1

        return step

    def _extend(self, last: int, w: int) -> int:
        go, link, length = self._go, self._link, self._length
        if w in go[last]:
            q = go[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        cur = len(go)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in go[p]:
            go[p][w] = cur
            p = link[p]
        if p >= 0:
            q = go[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return cur

    def _split(self, p: int, w: int, q: int) -> int:
        """A state of its own for the shorter strings of q."""
        new = len(self._go)
        self._go.append(dict(self._go[q]))
        self._link.append(self._link[q])
        self._length.append(self._length[p] + 1)
        self._link[q] = new
        while p >= 0 and self._go[p].get(w) == q:
            self._go[p][w] = new
            p = self._link[p]
        return new

    def walk(self, ids: list[int], hit: np.ndarray, at: int) -> set[int]:
        """Mark the words of ids that lie in an occurrence of a window, from hit[at] on; the items that occur."""
        step, link, length, top, window = self._stepper(), memoryview(self.link), memoryview(self.length), memoryview(self.top), self.window
        states, shorts, found = set(), set(), set()
        v = n = upto = 0
        for i, w in enumerate(ids):
            to = step(v, w)
            while to < 0 and v:
                v = link[v]
                n = length[v]
                to = step(v, w)
            if to >= 0:
                v, n = to, n + 1
            if n >= window:
                hit[at + max(upto, i + 1 - n) : at + i + 1] = True
                upto = i + 1
                states.add(top[v])
            if len(self.short):
                u, most = v, n
                while u > 0:
                    if length[u] <= most and self.short_ptr[u] < self.short_ptr[u + 1]:
                        hit[at + i + 1 - length[u] : at + i + 1] = True
                        shorts.add(u)
                    u = link[u]
        for u in states:
            found.update(self.items[self.item_ptr[u] : self.item_ptr[u + 1]].tolist())
        for u in shorts:
            found.update(self.short[self.short_ptr[u] : self.short_ptr[u + 1]].tolist())
        return found


class Matcher:
    """Vocabulary, pairs of neighbouring words and automaton of one shard of items."""

    def __init__(self, rows: list[tuple[str, str]], window: int = WINDOW):
        self.names = [name for name, _ in rows]
        texts = pa.array([t for _, t in rows], pa.string())
        buf, offsets = X.buffer_of(texts)
        buf = X.LOWER[buf]
        starts, ends, first = X.words(buf, offsets, X.ALNUM)
        h = X.word_keys(buf, starts, ends)
        self.vocabulary, ids = np.unique(h, return_inverse=True)
        inside = X.whole(first, 2, len(ids) - 1)
        self.pairs = np.unique((ids[:-1] * len(self.vocabulary) + ids[1:])[inside]) if len(ids) > 1 else np.zeros(0, np.int64)
        self.automaton = Automaton([ids[a:b].tolist() for a, b in zip(first, first[1:], strict=False)], window)

    def find(self, h: np.ndarray, first: np.ndarray, hit: np.ndarray) -> dict[int, set[str]]:
        """Mark hit words of a block of documents; the items that occur, by document. Only runs of words whose neighbours
        are neighbours in an item too walk the automaton."""
        out: dict[int, set[str]] = {}
        if not len(self.vocabulary) or not len(h):
            return out
        ids = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        known = self.vocabulary[ids] == h
        joined = np.zeros(len(h) + 1, bool)  # joined[i]: word i goes with the one before it
        both = np.flatnonzero(known[:-1] & known[1:] & X.whole(first, 2, len(h) - 1)) if len(h) > 1 else np.zeros(0, np.int64)
        if len(both) and len(self.pairs):
            pair = ids[both] * len(self.vocabulary) + ids[both + 1]
            joined[both + 1] = self.pairs[np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)] == pair
        a, b = np.flatnonzero(known & ~joined[:-1]), np.flatnonzero(known & ~joined[1:]) + 1
        long = b - a >= self.automaton.least
        doc = np.searchsorted(first, a[long], "right") - 1
        for d, x, y in zip(doc.tolist(), a[long].tolist(), b[long].tolist(), strict=True):
            if found := self.automaton.walk(ids[x:y].tolist(), hit, x):
                out.setdefault(d, set()).update(self.names[i] for i in found)
        return out


def shards(benchmark: DataFrame, most: int = SHARD_BYTES) -> Iterator[list[tuple[str, str]]]:
    """The items, each id and text once, in lists of about ``most`` bytes."""
    rows, size = [], 0
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    for r in items.toLocalIterator():
        rows.append((r.item_id, r.text))
        size += len(r.text)
        if size >= most:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def _scanned(rows: DataFrame, held: Broadcast[tuple]) -> DataFrame:
    """Rows with ``spans`` and ``items`` of what the matchers find in their text; the other column is the first."""
    name = rows.columns[0]
    schema = T.StructType([rows.schema[0], T.StructField("text", T.StringType()), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in X.blocks(batches):
            buf, offsets = X.buffer_of(block.column("text"))
            buf = X.LOWER[buf]
            starts, ends, first = X.words(buf, offsets, X.ALNUM)
            hit = np.zeros(len(starts), bool)
            h, found = X.word_keys(buf, starts, ends), {}
            for matcher in held.value:
                for d, names in matcher.find(h, first, hit).items():
                    found.setdefault(d, set()).update(names)
            spans, items = [[]] * block.num_rows, [[]] * block.num_rows
            for d, names in found.items():
                edges = np.flatnonzero(np.diff(np.r_[False, hit[first[d] : first[d + 1]], False].astype(np.int8)))
                spans[d], items[d] = edges.tolist(), sorted(names)
            yield pa.RecordBatch.from_arrays([block.column(name), block.column("text"), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names=[name, "text", "spans", "items"])

    return rows.select(name, "text").mapInArrow(scan, schema)


def _joined_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One list of maximal runs and one of items, from those of several passes."""
    for batch in batches:
        spans, items = [], []
        for lists, names in zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True):
            runs: list[int] = []
            for a, b in sorted(x for one in lists for x in zip(one[::2], one[1::2], strict=True)):
                if runs and a <= runs[-1]:
                    runs[-1] = max(runs[-1], b)
                else:
                    runs += [a, b]
            spans.append(runs)
            items.append(sorted({x for one in names for x in one}))
        yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names=["_row", "spans", "items"])


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, keep: Column | None = None) -> DataFrame:
    """Documents with ``spans`` (first word, end word, ... of maximal hit runs) and ``items`` (ids that occur); the first
    column is doc_id, or ``keep``. A benchmark of more than one pass is scanned pass by pass: what one finds is written, its
    automata go, and the findings of all are put together by row."""
    spark = docs.sparkSession
    keep = F.col("doc_id").cast("bigint").alias("doc_id") if keep is None else keep
    rows = docs.select(keep, F.col("text").cast("string").alias("text"))
    passes = batched((Matcher(rows, window) for rows in shards(benchmark, shard_bytes)), PASS)
    first, second = next(passes, ()), next(passes, None)
    if second is None:
        return _scanned(rows, spark.sparkContext.broadcast(first))
    base, found = stash(rows.withColumn("_row", F.monotonically_increasing_id()), "texts"), []
    for together in chain((first, second), passes):
        held = spark.sparkContext.broadcast(together)
        found.append(stash(_scanned(base.select("_row", "text"), held).where("size(spans) > 0").drop("text"), "hits"))
        held.destroy()
        del together
    lists = reduce(DataFrame.unionByName, found).groupBy("_row").agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))  # a list a pass
    merged = lists.mapInArrow(_joined_runs, "_row bigint, spans array<bigint>, items array<string>")
    none = [F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("spans", "array<bigint>"), ("items", "array<string>"))]
    return base.join(merged, "_row", "left").select(rows.columns[0], "text", *none)


def report(found: DataFrame) -> DataFrame:
    """Word counts, hit words and items of each document of occurrences()."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in X.blocks(batches):
            buf, offsets = X.buffer_of(block.column("text"))
            _, _, first = X.words(buf, offsets, X.ALNUM)
            n_hit = [sum(s[1::2]) - sum(s[::2]) for s in block.column("spans").to_pylist()]
            items = block.column("items").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array(np.diff(first)), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]), pa.array([n > 0 for n in n_hit])],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return found.mapInArrow(digest, "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean")


def cut(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_covered: float = 0.5, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Remove hit spans from the texts, and whole documents of which more than ``most_covered`` is hit.

    Spans and coverage are of the text as it came, over all shards of the items. Returns the columns of ``docs``; texts
    without a hit stay as they are, byte for byte. n_chars, where there is such a column, follows the new text."""
    names = docs.columns
    whole = F.struct(*[F.col(c) for c in names]).alias("row")
    found = occurrences(docs, benchmark, window, shard_bytes, keep=whole)
    schema = T.StructType([found.schema["row"], T.StructField("text", T.StringType())])

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in X.blocks(batches):
            buf, offsets = X.buffer_of(block.column("text"))
            spans = block.column("spans").to_pylist()
            texts, gone = block.column("text"), np.zeros(block.num_rows, bool)
            if any(spans):
                starts, ends, first = X.words(X.LOWER[buf], offsets, X.ALNUM)
                texts = texts.to_pylist()
                for d in [d for d, s in enumerate(spans) if s]:
                    a, b, raw, edges = first[d], first[d + 1], buf[offsets[d] : offsets[d + 1]], spans[d]
                    gone[d] = sum(edges[1::2]) - sum(edges[::2]) > most_covered * (b - a)
                    kept = np.ones(len(raw), bool)
                    for x, y in zip(edges[::2], edges[1::2], strict=True):
                        kept[starts[a + x] - offsets[d] : ends[a + y - 1] - offsets[d]] = False
                    texts[d] = raw[kept].tobytes().decode("utf-8", "replace")
                texts = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([block.column("row"), texts], names=["row", "text"]).filter(pa.array(~gone))

    found = found.mapInArrow(strip, schema)
    changed = ~F.col("text").eqNullSafe(F.col("row.text"))
    back = {c: F.col(f"row.`{c}`") for c in names}
    back["text"] = F.col("text")
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        back["n_chars"] = F.when(changed, F.length("text").cast(kind)).otherwise(F.col("row.n_chars"))
    return found.select(*[back[c].alias(c) for c in names])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(occurrences(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
      FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM g),
p AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS gram
      FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT p.doc_id, p.i, p.k, g.item FROM p JOIN g ON p.k = g.k AND p.gram = g.gram),
h AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.w), 0) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.s, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
