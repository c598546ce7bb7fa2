"""Spectra, folds, bootstrap draws and set algebra of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def alleles(calls: DataFrame) -> DataFrame:
    """contig, pos, sid, hap, allele: one row for each haplotype."""
    return calls.select("contig", "pos", "sid", F.posexplode(F.array("h0", "h1")).alias("hap", "allele"))


def site_counts(calls: DataFrame) -> DataFrame:
    """Derived and called alleles of each site."""
    d, n = F.coalesce("h0", F.lit(0)) + F.coalesce("h1", F.lit(0)), F.col("h0").isNotNull().cast("int") + F.col("h1").isNotNull().cast("int")
    return calls.groupBy("contig", "pos").agg(F.sum(d).alias("d"), F.sum(n).alias("n"))


def spectrum(calls: DataFrame, fold: bool = False) -> DataFrame:
    """Sites by derived count and sample size; folded counts are of the rarer allele."""
    k = F.least(F.col("d"), F.col("n") - F.col("d")) if fold else F.col("d")
    return site_counts(calls).groupBy("n", k.alias("k")).agg(F.count("*").alias("sites"))


def segregating(calls: DataFrame) -> DataFrame:
    return site_counts(calls).where("d > 0 and d < n").select("contig", "pos")


def by_frequency(calls: DataFrame, low: float, high: float) -> DataFrame:
    return site_counts(calls).where((F.col("n") > 0) & (F.col("d") / F.col("n")).between(low, high)).select("contig", "pos", "d", "n")


def marginal_spectrum(df: DataFrame, fold: bool = False, na: int = 2) -> DataFrame:
    """Bases of span rows by derived alleles of pair and sample together; rows with a missing pair have none."""
    k = F.col("a1") + F.col("b1")
    k = F.least(k, na + F.col("nb1") - k) if fold else k
    return df.where("a1 >= 0").groupBy(F.col("nb1"), k.alias("k")).agg(F.sum("span").alias("bases"))


def missingness(calls: DataFrame) -> DataFrame:
    return calls.groupBy("sid").agg(F.avg(F.when(F.col("h0").isNull(), 1.0).otherwise(0.0)).alias("missing"))


def folds(ids: DataFrame, k: int, key: str = "contig_id") -> DataFrame:
    """Fold of each id in order; the first ones are one larger. Ids are a dimension table."""
    return ids.select(key, (F.ntile(k).over(Window.orderBy(key)) - 1).alias("fold"))


def bootstrap(chunks: DataFrame, n: int, seed: int, key: str = "contig_id") -> DataFrame:
    """n draws with replacement: draw i takes the chunk whose row number a seeded hash of i names."""
    spark = chunks.sparkSession
    total = chunks.count()
    numbered = chunks.select(key, (F.row_number().over(Window.orderBy(key)) - 1).alias("at"))
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary")), 1, 12), 16, 10).cast("bigint")
    draws = spark.range(n).select(F.col("id").alias("draw"), (bits % max(1, total)).cast("int").alias("at"))
    return draws.join(numbered, "at").select("draw", key)


def subpanel(calls: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n called haplotypes of each site, without replacement."""
    rows = alleles(calls).where("allele is not null")
    w = Window.partitionBy("contig", "pos").orderBy(F.xxhash64(F.lit(seed), "contig", "pos", "sid", "hap"))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
