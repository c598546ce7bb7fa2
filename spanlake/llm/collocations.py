"""Phrase collocation mining, level by level, with hashed counts that prune the next level.

Pass k goes over all texts and counts phrases of k words exactly, and phrases of k + 1 words by hash bucket. Only phrases
of which both parts of one word less are frequent (Apriori) and whose bucket is frequent enough are counted exactly; a
bucket of the next length is only fed by phrases whose both parts got that far. Both tests are bitmaps of BUCKETS bits,
which is what is broadcast whatever the input. A bitmap can only let too much through, so counts are exact at any size:
where buckets fill up (about 100 * BUCKETS occurrences) the parts alone prune, and more is counted.

Counts of buckets are capped at the least frequency in each task (a task that reaches it decides), and travel as sparse
slices of the bucket range. Exact counts are of strings: a task sums up what it has seen, word by word compared, and Spark
sums by language and phrase.

Scores are exact: products are decimals of 38 digits, enough for 3e17 words a language.

Defined cases: a null text is empty, a null language ``und``; a null or repeated doc_id does not matter, each row counts;
a word may be of any length and hold anything but the separators; ties go by phrase; other columns are ignored; a table
without a frequent phrase, or empty, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import text as X
from .common import discard, documents, stash

LONGEST, LEAST, TOP, PERCENT = 5, 100, 2000, 100
#: A bitmap of 2^BITS buckets has 16 MB; it is summed up in slices of 2^SLICE.
BITS, SLICE = 27, 16
#: Bytes of text that are looked at together, and bucket counts that a task holds.
BLOCK, HELD = 8 << 20, 1 << 23
#: Languages whose totals may be broadcast; groups in which a language's best phrases are first looked for.
MOST_BROADCAST, GROUPS = 10_000, 256
_RAW = "lang string, phrase string, n bigint, slice int, places binary, counts binary"

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?\x0a\x0b\x0c\x0d"]] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False


class Words(NamedTuple):
    """The words of a block: number of each in ``names``, language number, and whether the next word is in the same piece."""

    ids: np.ndarray
    names: pa.Array
    lang: np.ndarray
    joined: np.ndarray


def words_of(texts: pa.Array, langs: np.ndarray) -> Words:
    buf, offsets = X.buffer_of(texts)
    buf = X.LOWER[buf]
    starts, ends, first = X.words(buf, offsets, _WORD)
    n = len(starts)
    piece = np.cumsum(_BREAK[buf], dtype=np.int32)[starts] if n else np.zeros(0, np.int32)
    joined = np.zeros(n, bool)
    joined[:-1] = piece[1:] == piece[:-1]
    last = first[1:] - 1
    joined[last[last >= 0]] = False
    edges = np.zeros(n + 1, np.int64)
    np.cumsum(ends - starts, out=edges[1:])
    all_ = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(buf[_WORD[buf]]))])
    coded = all_.dictionary_encode()
    return Words(coded.indices.to_numpy(), coded.dictionary, np.repeat(langs, np.diff(first)), joined)


def _hashes(names: pa.Array) -> np.ndarray:
    buf, at = X.buffer_of(names)
    return X.word_keys(buf, at[:-1], at[1:])


def _buckets(h: np.ndarray, lang: np.ndarray, k: int, at: np.ndarray, bits: int) -> np.ndarray:
    """Buckets of the k words from each of ``at`` on; h and lang are hashes of words and of their languages."""
    total = lang[at] + np.uint64(k)
    for i, c in enumerate(X.constants(LONGEST, 43)[:k]):
        total += h[at + i] * c
    return (X.mix64(total) >> np.uint64(64 - bits)).astype(np.uint32)


def _has(bitmap: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    return (bitmap[buckets >> 3] >> (buckets & 7).astype(np.uint8) & 1).astype(bool)


class Counts:
    """Capped counts of buckets, as rows of slices."""

    def __init__(self, cap: int) -> None:
        self.cap, self.held, self.size = cap, [], 0
        self.kind = np.min_scalar_type(cap)

    def add(self, buckets: np.ndarray) -> None:
        u, c = np.unique(buckets, return_counts=True)
        self.held.append((u, np.minimum(c, self.cap).astype(self.kind)))
        self.size += len(u)

    def rows(self) -> pa.RecordBatch | None:
        if not self.size:
            return None
        u, c = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.size = [], 0
        order = np.argsort(u, kind="stable")
        u, c = u[order], c[order]
        at = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
        u, c = u[at], np.minimum(np.add.reduceat(c.astype(np.int64), at), self.cap).astype(self.kind)
        part = u >> SLICE
        at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        edges = np.r_[at, len(u)]
        packed = lambda x: pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((edges * x.itemsize).astype(np.int32)), pa.py_buffer(x)])
        return _raw(slice=pa.array(part[at].astype(np.int32)), places=packed((u & ((1 << SLICE) - 1)).astype(np.uint16)), counts=packed(c))


def _raw(**columns: pa.Array) -> pa.RecordBatch:
    kinds = {"lang": pa.string(), "phrase": pa.string(), "n": pa.int64(), "slice": pa.int32(), "places": pa.binary(), "counts": pa.binary()}
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[c].cast(t) if c in columns else pa.nulls(n, t) for c, t in kinds.items()], names=list(kinds))


def _phrases(w: Words, langs: pa.Array, at: np.ndarray, k: int, h: np.ndarray) -> pa.RecordBatch:
    """Phrases of k words from each of ``at`` on, with their numbers; equal ones are found by hash and told apart by words."""
    order = np.argsort(h)
    order, h = at[order], h[order]
    new = np.r_[True, h[1:] != h[:-1]] | np.r_[True, w.lang[order[1:]] != w.lang[order[:-1]]]
    for i in range(k):
        word = w.ids[order + i]
        new[1:] |= word[1:] != word[:-1]
    start = np.flatnonzero(new)
    place = order[start]
    parts = [w.names.take(pa.array(w.ids[place + i])) for i in range(k)]
    phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if k > 1 else parts[0]
    return _raw(lang=langs.take(pa.array(w.lang[place])), phrase=phrase, n=pa.array(np.diff(np.r_[start, len(order)])))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    size = 0
    for block in X.blocks(batches, most=BLOCK):
        held.append(block)
        size += block.nbytes
        if size >= BLOCK:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def counted(docs: DataFrame, k: int, least: int, maps: Broadcast | None, longest: int, bits: int = BITS) -> DataFrame:
    """Raw rows of pass k: phrases of k words that the bitmaps (bucket, known) let through, and bucket counts of k + 1 words."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, known = maps.value if maps else (None, None)
        sums = Counts(least)
        for block in _merged(batches):
            coded = pc.fill_null(block.column("lang").combine_chunks(), "und").dictionary_encode()
            w = words_of(block.column("text").combine_chunks(), coded.indices.to_numpy())
            if not len(w.ids):
                continue
            h, lang = _hashes(w.names)[w.ids], _hashes(coded.dictionary)[w.lang]
            at = np.arange(len(w.ids))
            for i in range(k - 1):
                at = at[w.joined[at + i]]
            if k > 1:
                for i in (0, 1):
                    at = at[_has(known, _buckets(h, lang, k - 1, at + i, bits))]
                b = _buckets(h, lang, k, at, bits)
                fits = _has(bucket, b)
                at, b = at[fits], b[fits]
            else:
                b = _buckets(h, lang, 1, at, bits)
            if len(at):
                yield _phrases(w, coded.dictionary, at, k, b)
            if k < longest:
                alive = np.zeros(len(w.ids) + 1, bool)
                alive[at] = True
                at = at[alive[at + 1] & w.joined[at + k - 1]]
                sums.add(_buckets(h, lang, k + 1, at, bits))
            if sums.size > HELD and (rows := sums.rows()):
                yield rows
            X.release()
        if rows := sums.rows():
            yield rows

    return docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(look, _RAW)


def bitmap(raw: DataFrame, least: int, bits: int = BITS) -> np.ndarray:
    """Bits of the buckets whose counts reach ``least``."""
    kind = np.min_scalar_type(least)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, places, counts in zip(*(batch.column(c).to_pylist() for c in ("slice", "places", "counts")), strict=True):
                if part not in sums:
                    sums[part] = np.zeros(1 << SLICE, np.uint32)
                s, at = sums[part], np.frombuffer(places, np.uint16)
                s[at] = np.minimum(s[at] + np.frombuffer(counts, kind), least)
        packed = [np.packbits(s >= least, bitorder="little").tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(packed, pa.binary())], names=["slice", "bits"])

    tasks = min(1 << bits - SLICE, max(64, int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    found = raw.where("slice is not null").select("slice", "places", "counts").repartition(tasks, "slice").mapInArrow(add, "slice int, bits binary").toArrow()
    out = np.zeros((1 << bits - SLICE, (1 << SLICE) // 8), np.uint8)
    for part, packed in zip(found.column("slice").to_pylist(), found.column("bits").to_pylist(), strict=True):
        out[part] = np.frombuffer(packed, np.uint8)
    return out.ravel()


def known(frequent: DataFrame, k: int, least: int, bits: int = BITS) -> DataFrame:
    """Raw rows that set the buckets of frequent phrases."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Counts(least)
        for batch in batches:
            words = pc.split_pattern(batch.column("phrase").cast(pa.large_string()), " ").flatten()
            h, lang = _hashes(words), np.repeat(_hashes(batch.column("lang").cast(pa.large_string())), k)
            sums.add(np.repeat(_buckets(h, lang, k, np.arange(0, len(h), k), bits), least))
        if rows := sums.rows():
            yield rows

    return frequent.select("lang", "phrase").mapInArrow(mark, _RAW)


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, k, n of every phrase of up to ``longest`` words that occurs ``least`` times; lang, n of all words."""
    spark, levels, maps, totals = docs.sparkSession, [], None, None
    for k in range(1, longest + 1):
        raw = stash(counted(docs, k, least, maps, longest, bits), f"phrases-{k}")
        if maps:
            maps.destroy()
        sums = raw.where("phrase is not null").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        if k == 1:
            totals = stash(raw.where("phrase is not null").groupBy("lang").agg(F.sum("n").alias("n")), "totals")
        level = stash(sums.where(F.col("n") >= least).withColumn("k", F.lit(k)), f"frequent-{k}")
        levels.append(level)
        if k < longest and not level.isEmpty():
            maps = spark.sparkContext.broadcast((bitmap(raw, least, bits), bitmap(known(level, k, least, bits), least, bits)))
            discard(raw)
        else:
            discard(raw)
            break
    return reduce(DataFrame.unionByName, levels), totals


def _first(words: Column, k: Column) -> Column:
    return F.array_join(F.slice(words, F.lit(1), k), " ")


def _rest(words: Column, k: Column) -> Column:
    return F.array_join(F.slice(words, k + 1, F.size(words)), " ")


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, percent: int = PERCENT, bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best ``top`` phrases."""
    all_, totals = frequent(docs, least, longest, bits)
    words = F.split("phrase", " ")
    candidates = all_.where("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"))
    # a longer phrase with enough occurrences has one word more, as those between have as many at least
    part = F.explode(F.array(_first(words, F.col("k") - 1), _rest(words, F.lit(1))))
    longer = candidates.where("k > 2").select("lang", part.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = candidates.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a")))
    cuts = kept.select("lang", "phrase", "a", words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", _first(F.col("w"), F.col("cut")).alias("first"), _rest(F.col("w"), F.col("cut")).alias("rest"))
    of = lambda name, n: all_.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    totals = F.broadcast(totals) if totals.count() <= MOST_BROADCAST else totals
    facts = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    facts = facts.withColumn("over", F.lit(1000).cast("decimal(4,0)") * whole("a") * whole("n")).withColumn("under", whole("l") * whole("r"))
    lowest = F.min(F.struct(F.expr("over div under").alias("score"), "cut", "l", "r")).alias("x")
    scored = facts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), lowest).select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    scored = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(GROUPS)))
    for keys in (["lang", "part"], ["lang"]):
        scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return scored.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(documents(spark, sf_dir))


SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 6) AS t(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(n) AS HUGEINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND n >= 100),
s AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c x WHERE x.lang = c.lang AND x.k > c.k AND 100 * x.n >= 100 * c.n AND contains(' ' || x.phrase || ' ', ' ' || c.phrase || ' '))),
u AS (SELECT lang, phrase, n AS a, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS cut FROM s),
v AS (SELECT u.lang, u.phrase, u.a, u.cut, l.n AS l, r.n AS r, t.n AS n, CAST(CAST(1000 AS HUGEINT) * u.a * t.n // (CAST(l.n AS HUGEINT) * r.n) AS BIGINT) AS score
  FROM u JOIN f l ON l.lang = u.lang AND l.phrase = array_to_string(ws[1:cut], ' ') JOIN f r ON r.lang = u.lang AND r.phrase = array_to_string(ws[cut + 1:], ' ') JOIN totals t ON t.lang = u.lang),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM b
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
