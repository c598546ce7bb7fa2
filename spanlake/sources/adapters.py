"""Deterministic span, genotype and mask tables from the driver's tables, so that every operator has a checkable input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contig_id, seq, span, a1, b1, nb1 from ``events``; seq orders a contig."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type")
    a1 = F.expr("CASE event_type WHEN 'error' THEN -1 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 0 END")
    e = e.select(F.col("user_id").alias("contig_id"), F.col("event_id").alias("seq"), (1 + F.col("event_id") % 37).cast("int").alias("span"), a1.alias("a1"), F.expr("CASE WHEN event_id % 11 = 0 THEN 0 ELSE 4 END").alias("nb1"))
    return e.select("contig_id", "seq", "span", "a1", F.expr("CAST(CASE WHEN a1 <= 0 THEN 0 ELSE seq % (nb1 + 1) END AS INT)").alias("b1"), "nb1")


def genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contig, pos, sid, h0, h1 from ``lineitem``; a null allele is missing."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    keys = [F.expr("concat('chr', CAST(l_partkey % 4 AS STRING))").alias("contig"), (F.col("l_partkey") + 1).alias("pos"), F.col("l_linenumber").alias("sid")]
    return rows.groupBy(*keys).agg(F.min(F.expr("CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 END")).alias("h0"), F.min(F.expr("CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END")).alias("h1"))


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contig, m_start, m_end (half open) from ``supplier``."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return rows.select(F.expr("concat('chr', CAST(s_suppkey % 4 AS STRING))").alias("contig"), (F.col("s_suppkey") * 20).alias("m_start"), (F.col("s_suppkey") * 20 + 1 + F.col("s_suppkey") % 7).alias("m_end"))


SPANS_SQL = """t0 AS (SELECT user_id AS contig_id, event_id AS seq, CAST(1 + event_id % 37 AS INT) AS span,
  CASE event_type WHEN 'error' THEN -1 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 0 END AS a1, CASE WHEN event_id % 11 = 0 THEN 0 ELSE 4 END AS nb1 FROM events),
spans AS (SELECT contig_id, seq, span, a1, CAST(CASE WHEN a1 <= 0 THEN 0 ELSE seq % (nb1 + 1) END AS INT) AS b1, nb1 FROM t0),
pos AS (SELECT *, sum(span) OVER (PARTITION BY contig_id ORDER BY seq) AS e FROM spans),
placed AS (SELECT contig_id, seq, span, a1, b1, nb1, CAST(e - span AS BIGINT) AS start, CAST(e AS BIGINT) AS stop FROM pos)"""
GENO_SQL = """geno AS (SELECT concat('chr', CAST(l_partkey % 4 AS VARCHAR)) AS contig, l_partkey + 1 AS pos, l_linenumber AS sid,
  min(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 END) AS h0, min(CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END) AS h1 FROM lineitem GROUP BY 1, 2, 3)"""
MASK_SQL = "mask AS (SELECT concat('chr', CAST(s_suppkey % 4 AS VARCHAR)) AS contig, s_suppkey * 20 AS m_start, s_suppkey * 20 + 1 + s_suppkey % 7 AS m_end FROM supplier)"
