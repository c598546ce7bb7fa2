"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the whole text (shares of byte classes, repetition of words and lines, lengths) are cut into bins at sample
quantiles. Training goes round the features cyclically; each turn fits a shallow tree on one feature's bins to the
gradient and adds a small step to that feature's lookup table. The strongest pairs, by the gain of a four-leaf tree on
the residuals, then get tables of their own in the same way. A score is the sum of table entries, so scoring is bin
lookups and additions over whole batches.

Labels come from at most about SAMPLE labelled rows, chosen by hash; scoring covers all rows. Defined cases: a null or
empty text has features of 0 and is scored like any other; without labels of both classes every score is the mean label,
or 0.5; rows of equal id are scored each; null labels are not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X
from .common import documents, remainder, table

SAMPLE = 20_000
BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 32, 8, 120, 60, 6, 0.15

_CLASS = np.full(256, 4, np.uint8)  # 0 lower and beyond ASCII, 1 upper, 2 digit, 3 white space, 4 symbol, 5 stop, 6 bar, 7 bang
_CLASS[0x61:0x7B] = 0
_CLASS[0x80:] = 0
_CLASS[0x41:0x5B] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[[0x20, *range(0x09, 0x0E)]] = 3
_CLASS[[ord(c) for c in ".,;:'\"()-?"]] = 5
_CLASS[ord("|")] = 6
_CLASS[ord("!")] = 7
_LINE = np.ones(256, bool)
_LINE[[0x0A, 0x0D]] = False

FEATURES = ["bytes", "words", "upper", "digits", "symbols", "stops", "bars", "bangs", "letters", "distinct", "top", "again", "length", "spread", "lines", "same_lines", "line_words", "symbol_words"]


def _per(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values of each document."""
    total = np.r_[0.0, np.cumsum(values, dtype=np.float64)]
    return total[first[1:]] - total[first[:-1]]


def _repeats(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the count of the most frequent one, of each document."""
    doc = X.owners(first)
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    n = len(first) - 1
    if not len(h):
        return np.zeros(n), np.zeros(n)
    at = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
    runs, top = np.diff(np.r_[at, len(h)]), np.zeros(n)
    np.maximum.at(top, d[at], runs)
    return np.bincount(d[at], minlength=n).astype(float), top


def features(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row for each document; see FEATURES."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    kinds = _CLASS[buf]
    counts = np.stack([_per(kinds == c, offsets) for c in range(8)])
    starts, ends, first = X.words(buf, offsets, X.SPACED)
    words = np.diff(first).astype(float)
    lengths = (ends - starts).astype(float)
    h = X.word_hashes(buf, starts, ends)
    distinct, top = _repeats(h, first)
    doc = X.owners(first)
    again = np.zeros(len(h))
    if len(h) > 1:
        again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    last = kinds[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    ls, le, lf = X.words(buf, offsets, _LINE)
    lines = np.diff(lf).astype(float)
    line_distinct, _ = _repeats(X.word_hashes(buf, ls, le), lf)
    per_byte, per_word, per_line = 1 / np.maximum(size, 1), 1 / np.maximum(words, 1), 1 / np.maximum(lines, 1)
    mean = _per(lengths, first) * per_word
    spread = np.sqrt(np.maximum(_per(lengths**2, first) * per_word - mean**2, 0))
    letters = counts[0] + counts[1]
    out = [np.log1p(size), np.log1p(words), counts[1] / np.maximum(letters, 1), counts[2] * per_byte, counts[4] * per_byte, counts[5] * per_byte, counts[6] * per_byte, counts[7] * per_byte, letters * per_byte,
           distinct * per_word, top * per_word, _per(again, first) * per_word, mean, spread, np.log1p(lines), 1 - line_distinct * per_line, words * per_line, _per((last == 4) | (last == 7), first) * per_word]
    return np.stack(out, axis=1) if n else np.zeros((0, len(FEATURES)))


def _split(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of up to three leaves over ordered bins: its value for each bin."""
    def best(a: int, b: int) -> tuple[float, int]:
        gl, hl = np.cumsum(g[a : b - 1]), np.cumsum(h[a : b - 1])
        if not len(gl):
            return 0.0, a
        gt, ht = g[a:b].sum(), h[a:b].sum()
        gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
        i = int(np.argmax(gain))
        return float(gain[i]), a + i + 1

    n = len(g)
    _, m = best(0, n)
    (x, i), (y, j) = best(0, m), best(m, n)
    edges = sorted({0, m, n, i if x >= y else j})
    out = np.zeros(n)
    for a, b in zip(edges, edges[1:], strict=False):
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def _quarters(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a plane of bins into four; its gain and values."""
    def corner(m: np.ndarray) -> list[np.ndarray]:
        c = m.cumsum(0).cumsum(1)
        low, left, top, all_ = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return [low, left - low, top - low, all_ - left - top + low]

    gs, hs = corner(g), corner(h)
    gain = sum(a**2 / (b + 1) for a, b in zip(gs, hs, strict=True))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out, v = np.zeros_like(g), [-a[i, j] / (b[i, j] + 1) for a, b in zip(gs, hs, strict=True)]
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(gain[i, j]), out


@dataclass
class Gam:
    """Cuts and lookup tables."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]
    coarse: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (cut, values) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += values[np.searchsorted(cut, x[:, j], "right")]
        for i, j, values in self.pairs:
            total += values[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Train on features and 0/1 labels; classes weigh by their counts as they are."""
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(mean / (1 - mean)))
    if len(np.unique(y)) < 2:
        return Gam(base if len(y) else 0.0, [], [], [], [])
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    coarse = [np.unique(np.quantile(c, np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) for c in x.T]
    bins = [np.searchsorted(c, v, "right") for c, v in zip(cuts, x.T, strict=True)]
    wide = [np.searchsorted(c, v, "right") for c, v in zip(coarse, x.T, strict=True)]
    tables, total = [np.zeros(len(c) + 1) for c in cuts], np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for j, b in enumerate(bins):
            g, h = slopes()
            step = RATE * _split(np.bincount(b, g, len(tables[j])), np.bincount(b, h, len(tables[j])))
            tables[j] += step
            total += step[b]

    def plane(i: int, j: int, v: np.ndarray) -> np.ndarray:
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        return np.bincount(wide[i] * shape[1] + wide[j], v, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    usable = [j for j in range(len(coarse)) if len(coarse[j])]
    ranked = sorted(((_quarters(plane(i, j, g), plane(i, j, h))[0], i, j) for n, i in enumerate(usable) for j in usable[n + 1 :]), reverse=True)[:PAIRS]
    pairs = [(i, j, np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for _, i, j in ranked]
    for _ in range(PAIR_ROUNDS):
        for i, j, values in pairs:
            g, h = slopes()
            step = RATE * _quarters(plane(i, j, g), plane(i, j, h))[1]
            values += step
            total += step[wide[i], wide[j]]
    return Gam(base, cuts, tables, pairs, coarse)


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int = SAMPLE) -> DataFrame:
    """text and y (0/1) of at most about ``most`` labelled rows, by hash of the id; the ids are joined as a small table. An id
    that several rows or labels have counts once: its least text, its highest label."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & learn).groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    n = known.count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64("_id", F.lit(41)), F.lit(1 << 30)) < int((1 << 30) * most / n))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), F.col("doc_id") == F.col("_id"))
    return rows.groupBy("_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, sample: int = SAMPLE) -> Gam:
    """Fit on the labelled rows for which ``learn`` holds; only features leave the executors."""
    rows = labelled(docs, labels, "quality", F.lit(True) if learn is None else learn, sample)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in X.blocks(batches):
            x = features(*X.buffer_of(block.column("text")))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([block.column("_id"), block.column("y"), flat], names=["_id", "y", "x"])

    got = rows.mapInArrow(extract, "_id bigint, y int, x array<double>").toArrow().sort_by("_id")
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(x, got.column("y").to_numpy().astype(float))


def score(docs: DataFrame, model: Gam, keep: list[str]) -> DataFrame:
    """The columns of ``keep`` and _score of each row."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("_row"), F.col("text").cast("string").alias("text"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in X.blocks(batches):
            s = held.value.score(features(*X.buffer_of(block.column("text"))))
            yield pa.RecordBatch.from_arrays([block.column("_row"), pa.array(s)], names=["_row", "_score"])

    out = rows.mapInArrow(add, T.StructType([T.StructField("_row", rows.schema["_row"].dataType), T.StructField("_score", T.DoubleType())]))
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in keep], "_score")


def accepted(docs: DataFrame, labels: DataFrame, at: float = 0.5) -> DataFrame:
    """The rows of docs that score at least ``at``."""
    return score(docs, train(docs, labels), docs.columns).where(F.col("_score") >= at).drop("_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 3) != 1)
    return score(docs, model, ["doc_id"]).select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
