"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word (a run of letters, lower-cased) enters as the sum of a word vector, from a vocabulary of telling words, and of the
vectors of all its characters, each with its neighbours: a byte, the one before and the one after it, hashed. Two gated recurrent layers read a window forwards and
backwards; attention weighs the steps; one output scores the window. All windows of SPAN words, STRIDE apart, of the whole
text are scored, and the largest decides. Labels are of documents, so training alternates: the network picks the windows
of a document that look most toxic, and learns from those. A last logistic fit on document scores sets the threshold.

The fit uses a bounded sample: at most about POSITIVE and NEGATIVE labelled documents and BYTES of text, chosen by hash. Defined cases: a
null text, or one without letters, gets the score of an empty window; without both classes every score is the mean label,
or 0; rows of equal id are scored each; null labels are not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X
from .common import documents, remainder, table

POSITIVE, NEGATIVE = 2500, 3500
#: Bytes of their texts that the driver holds.
BYTES = 48 << 20
VOCABULARY, BUCKETS = 4096, 4096
WIDTH, HIDDEN, SPAN, STRIDE = 12, 8, 48, 32
EPOCHS, ROUNDS, BATCH, STEP = 4, 2, 512, 0.01

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z and the Latin-1 capitals in lower case."""
    out = X.LOWER[buf]
    if len(out) > 1:
        capital = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
        out[1:][capital] += 32
    return out


@dataclass
class Words:
    """The words of a block of documents: hashes, the buckets of their characters (those of word i from chars_of[i] on), and
    the first word of each document."""

    hashes: np.ndarray
    chars: np.ndarray
    chars_of: np.ndarray
    first: np.ndarray

    def ragged(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The character buckets of some words, one after the other, and how many each has."""
        n = self.chars_of[at + 1] - self.chars_of[at]
        ends = np.cumsum(n)
        return self.chars[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.chars_of[at] - (ends - n), n)], n


def words_of(buf: np.ndarray, offsets: np.ndarray) -> Words:
    buf = lowered(buf)
    starts, ends, first = X.words(buf, offsets, _LETTER)
    inside = np.zeros(len(buf) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    place = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    size = ends - starts
    at = np.r_[0, np.cumsum(size)]
    own = buf[place].astype(np.uint32)
    before, after = np.r_[np.uint32(0), own[:-1]], np.r_[own[1:], np.uint32(0)]
    before[at[:-1]] = 0
    after[at[1:] - 1] = 0
    mixed = (before << np.uint32(16) | own << np.uint32(8) | after) * np.uint32(0x9E3779B1)
    return Words(X.word_hashes(buf, starts, ends), (mixed >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.uint16), at, first)


def all_words(texts: pa.Array | pa.ChunkedArray) -> Words:
    """The words of all texts, found block by block, as finding them takes many times the memory of the words."""
    parts = [words_of(*X.buffer_of(block.column("text"))) for block in X.blocks(iter(pa.table({"text": texts}).to_batches()))]
    if not parts:
        return words_of(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    after = lambda ends: np.cumsum([0, *ends[:-1]])
    chars_of, first = after([p.chars_of[-1] for p in parts]), after([p.first[-1] for p in parts])
    return Words(np.concatenate([p.hashes for p in parts]), np.concatenate([p.chars for p in parts]), np.concatenate([np.zeros(1, np.int64), *[p.chars_of[1:] + n for p, n in zip(parts, chars_of, strict=True)]]), np.concatenate([np.zeros(1, np.int64), *[p.first[1:] + n for p, n in zip(parts, first, strict=True)]]))


def summed(table: np.ndarray, chars: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The sum of the vectors of each word's characters, over the root of their number."""
    if not len(n):
        return np.zeros((0, table.shape[1]), np.float32)
    return np.add.reduceat(table[chars], np.cumsum(n) - n) / np.sqrt(n, dtype=np.float32)[:, None]


def spans(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first and end word of all windows; each document has one at least."""
    n = np.diff(first)
    count = np.maximum(1, -(-(n - SPAN) // STRIDE) + 1)
    doc = np.repeat(np.arange(len(n)), count)
    a = first[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    return doc, a, np.minimum(a + SPAN, first[1:][doc])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Network:
    """Parameters by name, the vocabulary's sorted hashes, and the last logistic fit."""

    vocabulary: np.ndarray
    p: dict[str, np.ndarray] = field(default_factory=dict)
    slope: float = 1.0
    shift: float = 0.0
    prior: float | None = None

    def start(self, telling: np.ndarray) -> None:
        rng = np.random.default_rng(5)
        draw = lambda *s, by=0.3: (rng.normal(size=s) * by).astype(np.float32)
        p = self.p
        p["word"], p["char"] = draw(len(self.vocabulary) + 1, WIDTH, by=0.05), draw(BUCKETS, WIDTH, by=0.02)
        p["word"][0] = 0
        p["word"][1:, 0] = np.clip(telling, -2, 2)
        for d in "fb":
            p[f"w{d}"], p[f"u{d}"], p[f"c{d}"] = draw(WIDTH, 3 * HIDDEN), draw(HIDDEN, 3 * HIDDEN), np.zeros(3 * HIDDEN, np.float32)
            p[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1
        p["a"], p["v"], p["o"], p["e"] = draw(2 * HIDDEN, 8), draw(8), draw(2 * HIDDEN), np.zeros(1, np.float32)

    def ids(self, w: Words) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(w.hashes), np.int32)
        at = np.minimum(np.searchsorted(self.vocabulary, w.hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == w.hashes, at + 1, 0).astype(np.int32)

    def layer(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States of one direction; x: (steps, windows, 3 * HIDDEN) projected inputs."""
        u, n = self.p[f"u{d}"], HIDDEN
        h, out = np.zeros((x.shape[1], n), np.float32), np.empty((*x.shape[:2], n), np.float32)
        for t in range(x.shape[0]) if d == "f" else range(x.shape[0] - 1, -1, -1):
            hu = h @ u
            rz = _sigmoid(x[t, :, : 2 * n] + hu[:, : 2 * n])
            new = np.tanh(x[t, :, 2 * n :] + rz[:, :n] * hu[:, 2 * n :])
            z = rz[:, n:]
            to = np.where(mask[t][:, None], new + z * (h - new), h)
            if keep is not None:
                keep.append((t, h, rz, new, hu[:, 2 * n :]))
            h = to
            out[t] = h
        return out

    def pool(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
        q = np.tanh(states @ self.p["a"])
        s = np.where(mask, q @ self.p["v"], -30.0)
        s = np.exp(s - s.max(0))
        weight = (s / s.sum(0)).astype(np.float32)
        context = np.einsum("tn,tnh->nh", weight, states)
        return q, weight, context, context @ self.p["o"] + self.p["e"][0]

    def inputs(self, ids: np.ndarray, chars: np.ndarray, n_chars: np.ndarray) -> np.ndarray:
        """(steps, windows, WIDTH) from word ids and the characters of the words in the same order."""
        return self.p["word"][ids] + summed(self.p["char"], chars, n_chars).reshape(*ids.shape, WIDTH)

    def _loss(self, ids: np.ndarray, chars: np.ndarray, n_chars: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean logistic loss over a batch; ids: (steps, windows), with the characters of each word."""
        p, n = self.p, HIDDEN
        x = self.inputs(ids, chars, n_chars)
        kept: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self.layer(x @ p[f"w{d}"] + p[f"c{d}"], mask, d, kept[d]) for d in "fb"], axis=2)
        q, weight, context, logit = self.pool(states, mask)
        g: dict[str, np.ndarray] = {}
        dl = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
        g["o"], g["e"] = context.T @ dl, dl.sum(keepdims=True)
        dc = dl[:, None] * p["o"]
        ds = np.einsum("nh,tnh->tn", dc, states)
        ds = weight * (ds - (weight * ds).sum(0))
        dq = ds[..., None] * p["v"] * (1 - q * q)
        g["v"] = np.einsum("tn,tnk->k", ds, q)
        g["a"] = np.einsum("tnh,tnk->hk", states, dq)
        dstates = weight[..., None] * dc + dq @ p["a"].T
        dx = np.zeros_like(x)
        for i, d in enumerate("fb"):
            u, w = p[f"u{d}"], p[f"w{d}"]
            dp, du, dh = np.zeros((*x.shape[:2], 3 * n), np.float32), np.zeros_like(u), np.zeros((x.shape[1], n), np.float32)
            for t, h, rz, new, hn in reversed(kept[d]):
                dh = dh + dstates[t, :, i * n : (i + 1) * n]
                m = mask[t][:, None]
                r, z = rz[:, :n], rz[:, n:]
                live = np.where(m, dh, 0)
                dn = live * (1 - z) * (1 - new * new)
                dz = live * (h - new) * z * (1 - z)
                dr = dn * hn * r * (1 - r)
                dhu = np.concatenate([dr, dz, dn * r], axis=1)
                dp[t, :, :n], dp[t, :, n : 2 * n], dp[t, :, 2 * n :] = dr, dz, dn
                du += h.T @ dhu
                dh = np.where(m, live * z + dhu @ u.T, dh)
            g[f"u{d}"], g[f"c{d}"] = du, dp.sum((0, 1))
            g[f"w{d}"] = np.einsum("tni,tnj->ij", x, dp)
            dx += dp @ w.T
        flat = np.where(mask[..., None], dx, 0).reshape(-1, WIDTH)
        spread = np.repeat(flat / np.sqrt(n_chars)[:, None], n_chars, axis=0)
        for name, i, d in (("word", ids.ravel(), flat), ("char", chars, spread)):
            g[name] = np.stack([np.bincount(i, d[:, c], len(p[name])) for c in range(WIDTH)], axis=1).astype(np.float32)
        g["word"][0] = 0
        return g

    def learn(self, w: Words, a: np.ndarray, b: np.ndarray, y: np.ndarray, epochs: int, seed: int) -> None:
        """Adam over the given windows."""
        rng, ids, size = np.random.default_rng(seed), self.ids(w), int(np.clip(len(a) // 20, 32, BATCH))
        state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        steps = 0
        for epoch in range(epochs):
            order = rng.permutation(len(a))
            for i in range(0, len(order), size):
                some = order[i : i + size]
                at = a[some] + np.arange(SPAN)[:, None]
                mask = at < b[some]
                at = np.minimum(at, len(ids) - 1)
                g = self._loss(ids[at], *w.ragged(at.ravel()), mask, y[some])
                steps += 1
                for k, d in g.items():
                    m, v = state[k]
                    m += 0.1 * (d - m)
                    v += 0.01 * (d * d - v)
                    rate = STEP * (1 - epoch / (epochs + 1)) * (0.3 if k == "char" else 1)
                    self.p[k] -= rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.99**steps)) + 1e-6)

    def windows(self, w: Words, a: np.ndarray, b: np.ndarray, most: int = 2048) -> np.ndarray:
        """Logits of the given windows. Inputs are projected once a word, not once a window."""
        p, ids, out = self.p, self.ids(w), np.empty(len(a), np.float32)
        both = np.concatenate([p["wf"], p["wb"]], axis=1)
        of_word = p["word"] @ both + np.concatenate([p["cf"], p["cb"]])
        for i in range(0, len(a), most):
            low, high = int(a[i]), max(int(a[i]) + 1, int(b[i : i + most].max()))  # windows are in order of their words
            x = np.zeros((high - low, both.shape[1]), np.float32)
            if len(ids[low:high]):
                x += of_word[ids[low:high]]
                bounds = w.chars_of[low : high + 1]
                x += summed(p["char"], w.chars[bounds[0] : bounds[-1]], np.diff(bounds)) @ both
            at = a[i : i + most] + np.arange(SPAN)[:, None]
            mask = at < b[i : i + most]
            steps = max(1, int(mask.any(1).sum()))
            at, mask = np.minimum(at[:steps] - low, len(x) - 1), mask[:steps]
            states = np.concatenate([self.layer(x[:, : 3 * HIDDEN][at], mask, "f"), self.layer(x[:, 3 * HIDDEN :][at], mask, "b")], axis=2)
            out[i : i + most] = self.pool(states, mask)[3]
        return out

    def logits(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The largest window logit of each document."""
        w = words_of(buf, offsets)
        doc, a, b = spans(w.first)
        return np.maximum.reduceat(self.windows(w, a, b), np.searchsorted(doc, np.arange(len(offsets) - 1))) if len(doc) else np.zeros(0, np.float32)

    def score(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(offsets) - 1, self.prior)
        return _sigmoid(np.clip(self.slope * self.logits(buf, offsets).astype(np.float64) + self.shift, -30, 30))


def _telling(w: Words, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words whose presence tells most about the label, as sorted hashes, and their log odds."""
    doc = X.owners(w.first)
    order = np.lexsort((doc, w.hashes))
    h, d = w.hashes[order], doc[order]
    once = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])]
    h, d = h[once], d[once]
    at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    ones, n = np.add.reduceat(y[d], at), np.diff(np.r_[at, len(h)])
    all1, all0 = y.sum(), (1 - y).sum()
    odds = np.log((ones + 0.3) / (all1 + 0.6)) - np.log((n - ones + 0.3) / (all0 + 0.6))
    worth = np.where(n >= 2, np.abs(odds) * np.sqrt(n), 0)
    best = np.sort(np.argsort(-worth, kind="stable")[:VOCABULARY])
    best = best[worth[best] > 0]
    return h[at][best], odds[best]


def train(texts: pa.Array | pa.ChunkedArray, y: np.ndarray, weight: np.ndarray) -> Network:
    """Fit on documents and 0/1 labels; weight: how many labelled documents each one stands for."""
    if len(np.unique(y)) < 2:
        return Network(np.zeros(0, np.uint64), prior=float(y.mean()) if len(y) else 0.0)
    w = all_words(texts)
    if not len(w.hashes):
        return Network(np.zeros(0, np.uint64), prior=float(np.average(y, weights=weight)))
    vocabulary, odds = _telling(w, y)
    net = Network(vocabulary)
    net.start(odds)
    doc, a, b = spans(w.first)
    ids = net.ids(w)
    run = np.r_[0, np.cumsum(np.where(ids > 0, np.maximum(np.r_[0, odds][ids] - 1, 0), 0))]
    look = run[np.minimum(b, len(ids))] - run[np.minimum(a, len(ids))]
    for turn in range(ROUNDS):
        if turn:
            look = net.windows(w, a, b)
        order = np.lexsort((-look, doc))
        place = np.arange(len(doc)) - np.searchsorted(doc, doc)  # rank within the document, as order sorts by it
        top = order[place < np.where(y[doc] > 0, 1, 2)]
        other = np.random.default_rng(turn).permutation(np.flatnonzero(y[doc] == 0))[: len(top) // 4]
        chosen = np.concatenate([top, other])
        net.learn(w, a[chosen], b[chosen], y[doc[chosen]].astype(np.float32), EPOCHS, turn)
    best = np.maximum.reduceat(net.windows(w, a, b), np.searchsorted(doc, np.arange(len(y)))).astype(np.float64)
    scale = best.std() + 1e-9
    x, beta = np.stack([best / scale, np.ones_like(best)], 1), np.zeros(2)
    for _ in range(50):  # Newton steps of a weighted, slightly damped logistic fit
        q = _sigmoid(np.clip(x @ beta, -30, 30))
        grad, curve = x.T @ (weight * (q - y)) + 1e-2 * beta, (x.T * (weight * q * (1 - q))) @ x + 1e-2 * np.eye(2)
        beta -= np.clip(np.linalg.solve(curve, grad), -2, 2)
    net.slope, net.shift = float(beta[0] / scale), float(beta[1])
    return net


def sample(docs: DataFrame, labels: DataFrame, learn: Column, budget: int = BYTES) -> tuple[pa.ChunkedArray, np.ndarray, np.ndarray]:
    """Texts, labels and weights of the documents to fit on. An id that several rows or labels have counts once: its least
    text, its highest label. Of the documents chosen those of the least hashes are fetched whose texts together have at most
    ``budget`` bytes; a weight says how many labelled ids one stands for."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & learn)
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("y"))
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = {k: min(1.0, m / max(1, counts.get(k, 0))) for k, m in ((0, NEGATIVE), (1, POSITIVE))}
    part = F.when(F.col("y") == 1, int(share[1] * (1 << 30))).otherwise(int(share[0] * (1 << 30)))
    hashed = F.pmod(F.xxhash64("_id", F.lit(53)), F.lit(1 << 30))
    chosen = known.where(hashed <= part)
    text = F.col("text").cast("string").alias("text")
    joined = lambda ids: docs.select("doc_id", text).join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
    sizes = joined(chosen).groupBy("_id").agg(F.max(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes")).join(chosen, "_id").orderBy(hashed / part, "_id")
    taken, held = [], 0
    for r in sizes.collect():  # a row a chosen document, without its text
        held += r.bytes
        if held > budget and taken:
            break
        taken.append((r["_id"],))
    few = docs.sparkSession.createDataFrame(taken, T.StructType([known.schema["_id"]]))
    fetched = chosen.join(F.broadcast(few), "_id")
    rows = joined(fetched).groupBy("_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).toArrow().sort_by("_id")
    y = rows.column("y").to_numpy().astype(np.float64)
    return rows.column("text"), y, np.where(y > 0, 1 / share[1], 1 / share[0])


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id and score of each row."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in X.blocks(batches, most=1 << 20):
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(held.value.score(*X.buffer_of(block.column("text"))))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    net = train(*sample(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0))
    return score(docs, net).select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
