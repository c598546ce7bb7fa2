"""Haplotype panels: rows to spans, spectra under a condition, injected errors, per-base tables, unique positions.

A panel is contig, pos (from 1), sid, h0, h1, as genotypes are; draws are hashes of a seed and the row, so they repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import ingest, spans

_SPACE = float(1 << 48)


def uniform(seed: int, *names: str) -> Column:
    """A number in (0, 1) from 48 bits of a hash of the seed and the columns."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(n).cast("string") for n in names])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / _SPACE


def unique_positions(sites: DataFrame) -> DataFrame:
    """The first of neighbours of equal position; rows are in order of ``line``."""
    before = F.lag("pos").over(Window.partitionBy("contig").orderBy("line"))
    return sites.withColumn("_p", before).where("_p is null or _p <> pos").drop("_p")


def to_spans(panel: DataFrame, roles: DataFrame, lengths: DataFrame) -> DataFrame:
    """Span rows of a panel: its segregating sites, and quiet gaps of all undistinguished lineages between and around them.
    lengths: contig, length, n1."""
    alleles = panel.select("contig", "pos", F.explode(F.array("h0", "h1")).alias("x"))
    varied = alleles.groupBy("contig", "pos").agg(F.max(F.coalesce(F.col("x") != 0, F.lit(True))).alias("one"), F.max(F.coalesce(F.col("x") != 1, F.lit(True))).alias("zero")).where("one and zero")
    sites = ingest.project_roles(panel.join(varied.select("contig", "pos"), ["contig", "pos"], "left_semi"), roles)
    return ingest.gap_fill(ingest.events(sites), lengths)


def distinguished_spectrum(sites: DataFrame, draws: DataFrame, low: float, high: float) -> DataFrame:
    """Mean number of sites a draw by derived alleles of pair and sample, over the draws whose pair meets between low and
    high; a draw without a site counts as one with none derived. sites: draw, a1, b1; draws: draw, t."""
    kept = draws.where((F.col("t") > low) & (F.col("t") < high)).select("draw")
    n = kept.agg(F.count("*").alias("n"))
    seen = kept.join(sites, "draw", "left").select(F.coalesce("a1", F.lit(0)).alias("a1"), F.coalesce("b1", F.lit(0)).alias("b1"))
    return seen.groupBy("a1", "b1").agg(F.count("*").alias("c")).join(F.broadcast(n)).select("a1", "b1", (F.col("c") / F.col("n")).alias("mean"))  # one row


def perturbed(calls: DataFrame, error: float, missing: float, seed: int) -> DataFrame:
    """Alleles flipped with the probability ``error`` and lost with ``missing``, each by a draw of its own."""
    out = {}
    for h in ("h0", "h1"):
        flip, lose = (uniform(seed + i + 10 * int(h[1]), "contig", "pos", "sid") for i in (0, 1))
        out[h] = F.when(lose < missing, F.lit(None)).when(flip < error, 1 - F.col(h)).otherwise(F.col(h)).cast("int")
    return calls.withColumns(out)


def per_base(bases: DataFrame, variants: DataFrame, default: int = 0) -> DataFrame:
    """Every base with the genotype of its variant, or the default where there is none; a masked base is missing.
    bases: contig, pos, called; variants: contig, pos, gt."""
    found = bases.join(variants, ["contig", "pos"], "left")
    return found.select("contig", "pos", F.when(F.col("called"), F.coalesce("gt", F.lit(default))).otherwise(-1).alias("gt"))


def zipped(streams: list[DataFrame]) -> DataFrame:
    """Per-base streams (contig, pos, v) side by side, as v0, v1, ...; a base must be in all of them."""
    out = streams[0].withColumnRenamed("v", "v0")
    for i, s in enumerate(streams[1:], 1):
        out = out.join(s.withColumnRenamed("v", f"v{i}"), ["contig", "pos"])
    return out


def break_merged(df: DataFrame, cutoff: int) -> DataFrame:
    """Runs longer than the cutoff cut a contig and go, the last run excepted; each piece that is not empty begins with a row
    of one base. piece counts the cuts before it."""
    runs, names = spans.compress(df), spans.observation(df)
    last = F.lead("seq").over(spans.ordered()).isNull()
    rows = runs.withColumn("long", ((F.col("span") > cutoff) & ~last).cast("int"))
    rows = rows.withColumn("piece", F.sum("long").over(spans.ordered().rowsBetween(Window.unboundedPreceding, 0))).where("long = 0")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("contig_id", "piece").orderBy("seq")))
    cut = F.when((F.col("_n") == 1) & (F.col("span") > 1), F.array(F.lit(1).cast("bigint"), F.col("span") - 1)).otherwise(F.array("span"))
    return rows.select("contig_id", "piece", "seq", F.posexplode(cut).alias("part", "span"), *names)
