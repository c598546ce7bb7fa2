"""Exact top-k search by distributed histogram selection.

Every query meets every candidate. No score is stored: a pass over the candidates scores a block of queries in matrix
products and counts scores into BINS bins of each query's interval. The summed histogram says which bin holds the kth
score, that bin is the next interval, and passes go on until a bin is one value wide or at most STOP times k candidates
reach it. A last pass keeps what reaches the kth score; ties are broken by id.

A task reports no bin below the one that holds its own kth score: the kth score of all candidates is not lower. So it
sends some k counts a query, not BINS, and scores below that bin are passed over by one comparison.

Vectors become integers, so products are exact in any order of summation: in 32-bit floats while norms keep sums below
2^24, in 64-bit ones below 2^53, else in Python's integers.

Queries are dealt to blocks by a hash; a block's matrix is bounded by BLOCK rows and BLOCK_BYTES, and is what is
broadcast. The number of passes follows the number of queries, as the work of an exact search does.

Defined cases: vectors that are null or hold null or non-finite components take no part; a missing component of a shorter
vector is 0; a component or score beyond 64 bits is the nearest 64-bit number; rows of equal id and vector are counted, each
meets its copies and is answered; a null id is never a query, and comes last among equal scores; fewer than k candidates
are all returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, shared_dir, stash, table

K, EVERY, SCALE = 20, 20, 64
BINS, STOP = 256, 8
BLOCK, BLOCK_BYTES = 8192, 32 << 20
#: Scores that are in memory at once, in a task.
SCORES = 1 << 21
#: A query's rows of the last pass come in so many groups before they are one.
GROUPS = 64
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def integers(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v, n: floor(scale * component) of every vector that takes part, and the number of equal rows; written, with a
    number of its own (``own``) for each."""
    x = F.col("embedding").cast("array<double>")
    whole = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(math.inf)))
    top = F.lit(float(1 << 63))
    number = lambda c: F.when(c >= top, F.lit(_HIGH)).when(c < -top, F.lit(_LOW)).otherwise(F.floor(c))
    rows = df.where(whole).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(x, lambda c: number(c * F.lit(float(scale)))).alias("v"))
    sums = rows.groupBy("vec_id", "v").agg(F.count("*").alias("n"))
    return stash(sums.withColumn("own", F.monotonically_increasing_id()), "vectors")


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column; shorter ones are filled with 0, longer ones cut at ``width``, which leaves products as they are."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    width = int(lengths.max(initial=0)) if width is None else width
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row[at < width], at[at < width]] = flat[at < width]
    return out


def _norm(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)


class Block:
    """Queries in the order of their own number, and each one's interval [low, high] of bins of 2^shift."""

    def __init__(self, rows: pa.Table, reach: float) -> None:
        rows = rows.sort_by("own").combine_chunks()
        self.own = rows.column("own").to_numpy()
        self.ids, self.copies = rows.column("vec_id").to_numpy(), rows.column("n").to_numpy()
        self.m = _matrix(rows.column("v").chunk(0)) if rows.num_rows else np.zeros((0, 0), np.int64)
        self.norm = _norm(self.m)
        ends = [min(math.ceil(x * reach) + 1, _HIGH) for x in self.norm.tolist()]
        self.shift = np.array([max(0, (2 * e // (BINS - 1)).bit_length()) for e in ends], np.int64)
        self.low = np.array([max(-e, _LOW) for e in ends], np.int64) >> self.shift << self.shift
        self.high = np.array(ends, np.int64)
        self.above = np.zeros(len(self.own), np.int64)  # candidates beyond the interval
        self.open = np.ones(len(self.own), bool)

    def scores(self, v: np.ndarray) -> np.ndarray:
        """queries x candidates."""
        most = float(self.norm.max(initial=0)) * float(_norm(v).max(initial=0))
        if most < 1 << 53:
            kind = np.float32 if most < 1 << 24 else np.float64
            return self.m.astype(kind) @ v.T.astype(kind)
        return np.clip(self.m.astype(object) @ v.T.astype(object), _LOW, _HIGH).astype(np.int64)

    def narrow(self, found: pa.Table, k: int) -> None:
        """The bin of the kth score becomes the interval. ``found``: q, bin, ahead (candidates in higher bins), n."""
        q, at = found.column("q").to_numpy(), found.column("bin").to_numpy().astype(np.int64)
        low = self.low.copy()
        self.low[q] = low[q] + (at << self.shift[q])
        self.high[q] = np.minimum(self.high[q], self.low[q] + ((np.int64(1) << self.shift[q]) - 1))
        self.above[q] += found.column("ahead").to_numpy()
        few = np.zeros(len(self.own), bool)
        few[q] = self.above[q] + found.column("n").to_numpy() <= STOP * k
        reached = np.zeros(len(self.own), bool)
        reached[q] = True
        self.open &= reached & ~few & (self.shift > 0)  # without a kth score all candidates are taken
        self.shift = np.where(self.open, np.maximum(self.shift - (BINS.bit_length() - 1), 0), self.shift)


def _met(block: Block, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.RecordBatch, np.ndarray]]:
    """Scores of each piece of the candidates, the piece in the order of its ids, and whether a pair is a row with itself."""
    step = max(1, SCORES // max(1, len(block.own)))
    for batch in batches:
        for a in range(0, batch.num_rows, step):
            part = batch.slice(a, step)
            own = part.column("own").to_numpy()
            at = np.minimum(np.searchsorted(block.own, own), len(block.own) - 1)
            yield block.scores(_matrix(part.column("v"), block.m.shape[1])), part, np.where(block.own[at] == own, at, -1)


def histogram(vectors: DataFrame, held: Broadcast[Block], k: int) -> DataFrame:
    """q, bin, ahead, n: the bin of each open query's kth score, the candidates in higher bins of its interval and in it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = held.value
        counts = np.zeros((len(b.own), BINS), np.int64)
        floor = np.where(b.open, b.low, _HIGH)
        need = k - b.above
        for s, part, own in _met(b, batches):
            n = part.column("n").to_numpy()
            q, c = np.nonzero((s >= floor.astype(s.dtype)[:, None]) & (s <= b.high.astype(s.dtype)[:, None]))
            score = s[q, c].astype(np.int64)
            ok = b.open[q] & (score >= floor[q]) & (score <= b.high[q])  # floats of far bounds are rounded
            q, c, score = q[ok], c[ok], score[ok]
            weight = n[c] - (own[c] == q)
            np.add.at(counts.reshape(-1), q * BINS + ((score >> b.shift[q]) - (b.low[q] >> b.shift[q])), weight)
            if len(q) < SCORES // 64:
                continue
            more = np.cumsum(counts[:, ::-1], 1)[:, ::-1] >= need[:, None]
            best = BINS - 1 - np.argmax(more[:, ::-1], 1)  # this task's own kth score is in this bin
            floor = np.where(more.any(1) & b.open, b.low + (best << b.shift), floor)
        q, at = np.nonzero(counts)
        ok = b.low[q] + (at << b.shift[q]) >= floor[q]
        yield pa.RecordBatch.from_arrays([pa.array(q[ok].astype(np.int32)), pa.array(at[ok].astype(np.int32)), pa.array(counts[q, at][ok]), pa.array(need[q][ok])], names=["q", "bin", "n", "need"])

    parts = vectors.select("v", "n", "own").mapInArrow(count, "q int, bin int, n bigint, need bigint")
    sums = parts.groupBy("q", "bin").agg(F.sum("n").alias("n"), F.max("need").alias("need"))
    down = Window.partitionBy("q").orderBy(F.desc("bin"))  # BINS rows at most
    ahead = F.coalesce(F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sums.withColumn("ahead", ahead).where((F.col("ahead") < F.col("need")) & (F.col("ahead") + F.col("n") >= F.col("need")))


def best(vectors: DataFrame, held: Broadcast[Block], k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the block's queries: what reaches the kth score, ranked."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, group = held.value, TaskContext.get().partitionId() % GROUPS
        kept = [np.zeros(0, np.int64)] * 5  # q, score, id, whether there is none, n
        for s, part, own in _met(b, batches):
            ids, void = part.column("vec_id").fill_null(0).to_numpy(), part.column("vec_id").is_null().to_numpy(zero_copy_only=False)
            q, c = np.nonzero(s >= b.low.astype(s.dtype)[:, None])
            score = s[q, c].astype(np.int64)
            n = part.column("n").to_numpy()[c] - (own[c] == q)
            ok = (score >= b.low[q]) & (n > 0)
            new = [x[ok] for x in (q, score, ids[c], void[c].astype(np.int64), n)]
            kept = [np.concatenate(x) for x in zip(kept, new, strict=True)]
            order = np.lexsort((kept[2], kept[3], -1 - kept[1], kept[0]))
            kept = [x[order] for x in kept]
            first = np.searchsorted(kept[0], kept[0])
            kept = [x[np.arange(len(first)) - first < k] for x in kept]
        q, score, ids, void, n = kept
        columns = [b.ids[q], b.copies[q], b.own[q], score, pa.array(ids, mask=void.astype(bool)), n, np.full(len(q), group, np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["query_id", "copies", "own", "score", "vec_id", "n", "part"])

    rows = vectors.mapInArrow(take, "query_id bigint, copies bigint, own bigint, score bigint, vec_id bigint, n bigint, part int")
    order = [F.desc("score"), F.asc_nulls_last("vec_id")]
    for keys in (["own", "part"], ["own"]):
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("ahead", F.coalesce(F.sum("n").over(w), F.lit(0))).where(F.col("ahead") < k)
    ranks = F.sequence(F.col("ahead") + 1, F.least(F.col("ahead") + F.col("n"), F.lit(k)))
    rows = rows.select("query_id", "copies", F.explode(ranks.cast("array<int>")).alias("rank"), "vec_id", "score")
    return rows.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, asks: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each row of ``vectors`` (vec_id, embedding) for which ``asks``
    holds, a condition on vec_id."""
    spark = vectors.sparkSession
    all_, out = integers(vectors, scale), f"{shared_dir(spark)}/best-{uuid.uuid4().hex}"
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    asked = all_.where(asks & F.col("vec_id").isNotNull())
    reach = all_.agg(F.max(norm)).first()[0] or 0.0
    n, width = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = math.ceil(n / min(BLOCK, max(1, BLOCK_BYTES // (8 * max(1, width or 1)))))
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not blocks:
        discard(all_)
        return spark.createDataFrame([], schema)
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("own"), F.lit(blocks)))
    dealt = stash(dealt.repartitionByRange(min(blocks, 1000), "block").sortWithinPartitions("block"), "queries")
    for i in range(blocks):
        block = Block(dealt.where(F.col("block") == i).drop("block").toArrow(), reach * (1 + 1e-9))
        if not len(block.own):
            continue
        while block.open.any():
            held = spark.sparkContext.broadcast(block)
            found = histogram(all_, held, k).toArrow()
            held.destroy()
            block.narrow(found, k)
        held = spark.sparkContext.broadcast(block)
        best(all_, held, k).write.mode("append").parquet(out)
        held.destroy()
    discard(dealt)
    discard(all_)
    return spark.read.schema(schema).parquet(out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id AS query_id, unnest(v) AS a, unnest(range(len(v))) AS i FROM e WHERE vec_id % 20 = 0),
c AS (SELECT vec_id, unnest(v) AS b, unnest(range(len(v))) AS i FROM e),
s AS (SELECT query_id, vec_id, CAST(sum(a * b) AS BIGINT) AS score FROM q JOIN c USING (i) WHERE query_id <> vec_id GROUP BY ALL)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
