"""Interaction audit of text filters by incidence matrices.

Five filters judge every whole text. What a document is to the audit is its part (the source), its mask (bit i: it fails
filter i) and its labels, so each part is three histograms over 32 masks: all rows, rows of good quality, toxic rows. Any
order of the filters is a fixed map from masks to outcomes. For 120 orders of 5 steps, integer matrices of 32 x 600 say
which masks are kept after a step, removed in it, redundant to it or failed by its filter alone; stacked histograms times
these matrices are the counts, whatever the number of documents.

Copies: a row fails E where an equal text has a smaller doc_id. Features are first summed up by (text, id, part), so equal
rows are one; the least id of each text is found by its SHA-256 and joined to these sums, never to texts.

Defined cases: a null text is empty, a null source the part ''; a null doc_id is smaller or larger than nothing and has no
labels; rows of equal id and text fail E only by a smaller id, and each is counted; an id with several label rows is good
or toxic if any of them says so; other columns are ignored; an empty table has no parts and gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, table

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MASKS = 1 << len(FILTERS)
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
_SPACE = r"[\x20\x09-\x0D]+"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_OUT = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def incidence() -> dict[str, np.ndarray]:
    """MASKS x (orders x steps) matrices of 0 and 1, by outcome; ``shapley`` has in each column the number of orders in
    which the step's filter removes the mask."""
    shape = (MASKS, len(ORDERS), len(FILTERS))
    kept, removed, redundant, unique = (np.zeros(shape, np.int64) for _ in range(4))
    fails = (np.arange(MASKS)[:, None] >> np.arange(len(FILTERS)) & 1).astype(bool)
    for o, order in enumerate(ORDERS):
        gone = np.zeros(MASKS, bool)
        for s, letter in enumerate(order):
            bit = FILTERS.index(letter)
            removed[:, o, s] = fails[:, bit] & ~gone
            redundant[:, o, s] = fails[:, bit] & gone
            unique[:, o, s] = np.arange(MASKS) == 1 << bit
            gone |= fails[:, bit]
            kept[:, o, s] = ~gone
    letters = np.array([[FILTERS.index(c) for c in order] for order in ORDERS])
    by_filter = np.stack([(removed * (letters == i)).sum((1, 2)) for i in range(len(FILTERS))], 1)
    flat = {"kept": kept, "removed": removed, "redundant": redundant, "unique_fails": unique, "shapley": by_filter[:, letters]}
    return {k: v.reshape(MASKS, -1) for k, v in flat.items()}


def judged(text: Column) -> Column:
    """The mask of filters A to D of a text that is not null."""
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    capitals = F.octet_length(text) - F.octet_length(F.translate(text, _CAPITALS, ""))
    facts = F.struct(F.size(words).cast("bigint").alias("words"), F.size(F.array_distinct(words)).cast("bigint").alias("distinct"), capitals.cast("bigint").alias("capitals"), F.char_length(text).cast("bigint").alias("points"))
    bit = lambda i, fails: F.when(fails, 1 << i).otherwise(0)
    mask = lambda f: bit(0, f["words"] < LEAST_WORDS) + bit(1, 100 * f["distinct"] < DISTINCT_PERCENT * f["words"]) + bit(2, 100 * f["capitals"] > CAPITAL_PERCENT * f["points"])
    return F.transform(F.array(facts), mask)[0] + bit(3, text.rlike("[#$%&*|]"))


def histograms(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good and toxic: rows of each part by mask, in all and by label."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.sha2(text.cast("binary"), 256).alias("print"), judged(text).alias("mask"))
    sums = rows.groupBy("id", "part", "print", "mask").agg(F.count("*").alias("n"))
    says = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    none = F.lit(0).cast("int")
    known = sums.where("id is not null").join(told, "id", "left").fillna(0, ["good", "toxic"])
    known = known.unionByName(sums.where("id is null").withColumns({"good": none, "toxic": none}))
    # equal texts of one part and label are one row: how many there are, and how many of these have their least id
    kinds = known.groupBy("print", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("loose"))
    least = kinds.groupBy("print").agg(F.min("first.id").alias("least"))
    copies = kinds.join(least, "print").withColumn("clear", F.col("loose") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0))
    split = F.explode(F.array(F.struct(F.col("mask").alias("m"), F.col("clear").alias("k")), F.struct((F.col("mask") + (1 << 4)).alias("m"), (F.col("n") - F.col("clear")).alias("k"))))
    split = copies.select("part", "good", "toxic", split.alias("x"))
    return split.groupBy("part", F.col("x.m").alias("mask")).agg(F.sum("x.k").alias("n"), F.sum(F.col("x.k") * F.col("good")).alias("good"), F.sum(F.col("x.k") * F.col("toxic")).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step with the counts of that step."""
    counts = F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic"))))  # MASKS entries at most
    lists = histograms(docs, labels).groupBy("part").agg(counts.alias("h"))
    masks = F.array(*map(F.lit, range(MASKS)))
    row = lambda f: F.transform(masks, lambda m: F.coalesce(F.try_element_at("h", m)[f], F.lit(0)).cast("bigint")).alias(f)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrices = incidence()
        orders = pa.array(np.repeat(ORDERS, len(FILTERS)).tolist())
        steps = pa.array(np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS)))
        for batch in batches:
            parts = batch.column("part").to_pylist()
            n, good, toxic = (batch.column(c).flatten().to_numpy().reshape(-1, MASKS) for c in ("n", "good", "toxic"))
            for i, part in enumerate(parts):
                rows = np.stack([n[i], good[i], toxic[i]])
                by = {k: rows[0] @ m for k, m in matrices.items()}
                _, good_lost, toxic_lost = rows @ matrices["removed"]
                columns = [by["kept"], by["removed"], by["redundant"], by["unique_fails"], good_lost, toxic_lost, by["shapley"]]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(steps), pa.string()), orders, steps, *map(pa.array, columns)], names=[c.split()[0] for c in _OUT.split(", ")])

    return lists.select("part", row("n"), row("good"), row("toxic")).mapInArrow(multiply, _OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  (CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 4 ELSE 0 END)
  + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN min(w.doc_id) OVER (PARTITION BY t) < w.doc_id THEN 16 ELSE 0 END) AS mask
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
h AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT i, 'ABCDE'[i + 1] AS c FROM range(5) AS t(i)),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.i NOT IN (b.i, c.i, d.i, e.i) AND b.i NOT IN (c.i, d.i, e.i) AND c.i NOT IN (d.i, e.i) AND d.i <> e.i),
s AS (SELECT filter_order, k AS step, CAST(1 << bits[k] AS BIGINT) AS bit, CAST(list_sum(list_transform(bits[1:k - 1], lambda b: 1 << b)) AS BIGINT) AS before FROM o, range(1, 6) AS t(k)),
r AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, bit,
  CAST(sum(CASE WHEN mask & (bit | coalesce(before, 0)) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN mask & bit > 0 AND mask & coalesce(before, 0) = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN mask & bit > 0 AND mask & coalesce(before, 0) > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN mask & bit > 0 AND mask & coalesce(before, 0) = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN mask & bit > 0 AND mask & coalesce(before, 0) = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM h, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""
