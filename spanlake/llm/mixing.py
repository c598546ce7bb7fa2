"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a row of slots of BLOCK words. Slot i has the van der Corput point of i in base 2; the point falls into the
interval of one source on the line of cumulative targets. The rank of a slot among those of its source is the number of
earlier points in that interval, which has a closed form over the binary digits of i, so slots are ranked where they are
made, without a sort or a shuffle. Each source's documents are put in a seeded random order, laid on a line of words,
twice for two passes, and cut into blocks of equal words; block r of a source fills its slot of rank r. The schedule has
a few slots more or fewer than a source's target: each source gives its rounded target in words, its last block is cut, and
blocks without a slot follow at the end. The mix lists documents in the order of their first slots.

Positions on a source's line are two-level sums (within hash buckets, then over bucket totals), so a source that holds
most rows is still dealt over all tasks.

Defined cases: a null text has size 0; a null source is a source of its own, the last; documents of size 0 take 0 words;
an empty table gives an empty mix; rows of equal id are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import documents, stash

WEIGHTS = (5, 2, 1)
PASSES = 2
#: Words in a slot are at most BLOCK, and fewer while the mix has fewer than SLOTS of them.
BLOCK, SLOTS = 1024, 1 << 18
#: Weights are a setting of the driver's; more sources than this are refused.
MOST_SOURCES = 1_000_000
BITS = 48
SEED = "mix-1"
_WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(_WORD)), F.lit(0)).cast("bigint")
    return docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), _print().alias("print"))


def _print() -> Column:
    """Tells rows of equal id apart, so that a window never holds all of a frequent id."""
    return F.coalesce(F.md5(F.col("text").cast("string").cast("binary")), F.lit("null"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: int = PASSES) -> DataFrame:
    """One row for each source: rank by code point, weight, size and target. The shares above the cap are spread over the
    others by weight: with sources ordered by cap over weight, a source is capped if it would be above its cap when all
    before it are, which is where repeated spreading ends."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = by.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", weight.cast("bigint")).withColumn("cap", F.col("source_size") * cap)
    everything, line = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    by = by.withColumns({"total": F.sum("source_size").over(everything) * F.lit(share), "w": F.sum("weight").over(everything)})
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumns({"left": F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)), "lw": F.col("w") - F.coalesce(F.sum("weight").over(before), F.lit(0))})
    by = by.withColumn("capped", F.col("left") * F.col("weight") > F.col("cap") * F.col("lw"))
    rest = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0))
    open_weight = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    return by.select("source", "rank", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(rest * F.col("weight") / open_weight).alias("target"))


def _earlier(i: np.ndarray, u: np.ndarray) -> np.ndarray:
    """How many of the first i van der Corput points are below u / 2**BITS: the points of each binary digit's run of
    indices are an even grid, shifted by the reversed digits above."""
    out, shift = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    for k in range(int(i.max(initial=0)).bit_length() - 1, -1, -1):
        has, step = (i >> k) & 1 == 1, 1 << (BITS - k)
        n = np.clip(-((shift - u) // step), 0, 1 << k)
        out += np.where(has, n, 0)
        shift += np.where(has, 1 << (BITS - 1 - k), 0)
    return out


def _reverse(i: np.ndarray) -> np.ndarray:
    out, rest = np.zeros(len(i), np.int64), i.copy()
    for _ in range(BITS):
        out = (out << 1) | (rest & 1)
        rest >>= 1
    return out


def _bounds(shares: list[float]) -> np.ndarray:
    """Where the interval of each source ends, in units of 2**-BITS."""
    line = np.cumsum(np.asarray(shares, np.float64))
    bounds = np.floor(line / (line[-1] or 1.0) * float(1 << BITS)).astype(np.int64) if len(line) else np.zeros(0, np.int64)
    if len(bounds):
        bounds[-1] = 1 << BITS
    return bounds


def words_due(shares: list[float], slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Words that each source gives to the mix, its target rounded, and its slots in the schedule."""
    bounds = _bounds(shares)
    ends = np.full(len(bounds), slots, np.int64)
    has = _earlier(ends, bounds) - _earlier(ends, np.r_[0, bounds[:-1]]) if len(bounds) else ends
    return np.rint(np.asarray(shares, np.float64)).astype(np.int64), has


def schedule(spark: SparkSession, shares: list[float], slots: int) -> DataFrame:
    """(slot, source rank, block): the source and the block of each slot."""
    bounds = _bounds(shares)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.r_[0, bounds[:-1]]
        for batch in batches:
            i = batch.column("id").to_numpy()
            owner = np.searchsorted(bounds, _reverse(i), "right")
            block = _earlier(i, bounds[owner]) - _earlier(i, low[owner])
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(owner.astype(np.int32)), pa.array(block)], names=["slot", "rank", "block"])

    return spark.range(slots).mapInArrow(fill, "slot bigint, rank int, block bigint")


def _ordered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The word at which each document begins on its source's line, in the seeded order."""
    rows = rows.withColumn("key", F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), "print").cast("binary")))
    rows = rows.withColumn("bucket", F.substring("key", 1, 3))
    within = Window.partitionBy("rank", "bucket").orderBy("key", *keys).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    totals = rows.groupBy("rank", "bucket").agg(F.sum("size").alias("n"))
    ahead = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("rank", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    return rows.join(totals, ["rank", "bucket"]).withColumn("start", F.col("ahead") + F.col("inside")).drop("key", "bucket", "inside", "ahead")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, slot (the first that it fills), ``passes``, the words taken of
    each pass, and ``slots``, the first slot of each; print goes with doc_id."""
    spark = docs.sparkSession
    sizes = stash(sized(docs), "sizes")
    planned = targets(sizes, weights, share).orderBy("rank").limit(MOST_SOURCES + 1).collect()
    if len(planned) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    total = sum(r.target for r in planned)
    block = max(1, min(BLOCK, int(total) // SLOTS))
    shares, n_slots = [r.target for r in planned], int(round(total / block))
    due, has = words_due(shares, n_slots)
    slots = schedule(spark, shares, n_slots)
    # blocks for which the schedule has no slot come after it; slots it has too many stay empty
    more = [(i, int(has[i]), int(-(-due[i] // block)) - 1) for i in np.flatnonzero(due > has * block).tolist()]
    extra = spark.createDataFrame(more, "rank int, a bigint, b bigint").select("rank", F.explode(F.sequence("a", "b")).alias("block"))
    slots = slots.unionByName(extra.select((F.lit(n_slots) + F.col("block")).cast("bigint").alias("slot"), "rank", "block"))
    kind = T.StructType([T.StructField("source", T.StringType()), T.StructField("rank", T.IntegerType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("due", T.LongType())])
    known = F.broadcast(spark.createDataFrame([(r.source, r["rank"], r.source_size, r.target, n) for r, n in zip(planned, due.tolist(), strict=True)], kind).withColumnRenamed("source", "of"))
    rows = sizes.join(known, F.col("source").eqNullSafe(F.col("of"))).drop("of", "source")
    rows = stash(_ordered(rows, ["doc_id", "size"]).withColumn("row", F.monotonically_increasing_id()), "lines")
    passes = rows.where("size > 0").select("row", "rank", "size", "due", F.explode(F.array([F.lit(p) for p in range(PASSES)])).alias("pass"), (F.col("start") + F.col("pass") * F.col("source_size")).alias("a"))
    passes = passes.where("a < due")
    pieces = passes.select("row", "rank", "pass", "a", F.least(F.col("a") + F.col("size"), "due").alias("b"), F.explode(F.expr(f"sequence(a div {block}, (least(a + size, due) - 1) div {block})")).alias("block"))
    words = F.least(F.col("b"), (F.col("block") + 1) * block) - F.greatest(F.col("a"), F.col("block") * block)
    pieces = pieces.select("row", "rank", "block", "pass", words.alias("words"))
    of = lambda p, c: F.when(F.col("pass") == p, F.col(c))
    sums = [F.coalesce(F.sum(of(p, "words")), F.lit(0)).alias(f"p{p}") for p in range(PASSES)] + [F.min(of(p, "slot")).alias(f"s{p}") for p in range(PASSES)]
    taken = pieces.join(slots, ["rank", "block"]).groupBy("row").agg(F.sum("words").alias("taken"), F.min("slot").alias("slot"), *sums)
    zero = F.lit(0).cast("bigint")
    out = rows.join(taken, "row", "left")
    lists = [F.array(*[F.coalesce(f"p{p}", zero) for p in range(PASSES)]).alias("passes"), F.array(*[F.col(f"s{p}") for p in range(PASSES)]).alias("slots")]
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", zero).alias("taken"), "slot", *lists, "print")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, ordered: bool = True) -> DataFrame:
    """The mix as documents, ``ordered`` by the schedule, which sorts them all: a document is there once for each pass of which it fills at least
    half its words, at the first slot of that pass; pieces of a document go with its larger part."""
    filled = F.filter(F.arrays_zip("passes", "slots"), lambda p: p["passes"] * 2 >= F.col("size"))
    plan = mix(docs, weights, share).where("size > 0").select(F.col("doc_id").alias("_of"), F.col("print").alias("_like"), F.transform(filled, lambda p: p["slots"]).alias("_slots"))
    # rows of equal id and text are alike to the plan: their slots are dealt out among them
    plan = plan.groupBy("_of", "_like").agg(F.sort_array(F.flatten(F.collect_list("_slots"))).alias("_slots"), F.count("*").alias("_rows")).where("size(_slots) > 0")
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"), _print().alias("_print"))
    rows = rows.join(plan, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_print") == F.col("_like")))
    turn = F.row_number().over(Window.partitionBy("_id", "_print").orderBy(F.xxhash64("_row"))) - 1
    single = rows.where("_rows = 1").select("_row", F.explode("_slots").alias("_slot"))
    several = rows.where("_rows > 1").withColumn("_turn", turn)
    several = several.select("_row", F.explode(F.filter("_slots", lambda x, i: i % F.col("_rows") == F.col("_turn"))).alias("_slot"))
    rows = single.unionByName(several)
    rows = rows.orderBy("_slot") if ordered else rows
    return rows.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "slot")


SQL = r"""
WITH s AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, coalesce(md5(text), 'null') AS print FROM documents),
o AS (SELECT source, sum(size) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM s GROUP BY source),
w AS (SELECT *, CASE r % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 2 * n AS cap, sum(n) OVER () * 1.5 AS total FROM o),
l AS (SELECT *, total - coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
      sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lw FROM w),
c AS (SELECT *, rest * w > cap * lw AS capped FROM l),
t AS (SELECT source, r, CAST(n AS BIGINT) AS n, CAST(CASE WHEN capped THEN cap ELSE (total - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0)) * w / sum(CASE WHEN NOT capped THEN w END) OVER () END AS DOUBLE) AS target FROM c),
k AS (SELECT sum(target) AS total, CAST(greatest(1, least(1024, CAST(floor(sum(target)) AS BIGINT) // 262144)) AS BIGINT) AS b FROM t),
u AS (SELECT r, source, n, target, floor(sum(target) OVER (ORDER BY r) / k.total * 281474976710656) AS hi FROM t, k),
x AS (SELECT i, CAST('0b' || reverse(lpad(bin(i), 48, '0')) AS BIGINT) AS p FROM (SELECT unnest(range(0, CAST(round_even(total / b, 0) AS BIGINT))) AS i FROM k)),
y AS (SELECT i, coalesce(u.r, (SELECT max(r) FROM u)) AS r FROM x ASOF LEFT JOIN u ON x.p < u.hi),
z AS (SELECT r, i, row_number() OVER (PARTITION BY r ORDER BY i) - 1 AS block FROM y),
d AS (SELECT s.doc_id, s.size, t.r, t.n, t.target, row_number() OVER () AS id,
      coalesce(sum(s.size) OVER (PARTITION BY t.r ORDER BY md5('mix-1:' || coalesce(CAST(s.doc_id AS VARCHAR), 'null') || ':' || print), s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
e0 AS (SELECT id, r, a + p * n AS a, a + p * n + size AS z, b, CAST(round_even(target, 0) AS BIGINT) AS due FROM d, k, (SELECT unnest([0, 1]) AS p) WHERE size > 0),
e AS (SELECT id, r, a, least(z, due) AS z, b FROM e0 WHERE a < due), slots AS (SELECT count(*) AS n FROM x),
f AS (SELECT id, r, a, z, b, unnest(range(CAST(a // b AS BIGINT), CAST((z - 1) // b + 1 AS BIGINT))) AS block FROM e),
g AS (SELECT id, sum(least(f.z, (f.block + 1) * b) - greatest(a, f.block * b)) AS taken, min(coalesce(z.i, slots.n + f.block)) AS slot FROM f CROSS JOIN slots LEFT JOIN z ON f.r = z.r AND f.block = z.block GROUP BY id)
SELECT doc_id, size, n AS source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, slot FROM d LEFT JOIN g USING (id)
"""
