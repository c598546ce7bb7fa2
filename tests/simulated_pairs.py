"""A fixture: simulated data of the distinguished pair, from the sequentially Markov coalescent under a step model."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.operators.demography import Steps


def segments(model: Steps, length: int, rho: float, rng: np.random.Generator) -> Iterator[tuple[int, int, float]]:
    """Start, end and meeting time of the pieces of a sequence; a break comes at the rate rho t a base. It cuts a lineage at a
    time even between now and the meeting. The cut one floats: it may meet either lineage, and its own leaves all as it was;
    above the old meeting only one is left."""
    at, t = 0, model.inverse(rng.exponential())
    while at < length:
        end = int(min(length, at + max(1, math.ceil(rng.exponential() / max(rho * t, 1e-12)))))
        yield at, end, t
        at = end
        s = model.inverse(model.hazard(rng.uniform(0, t)) + rng.exponential() / 2)
        if s >= t:
            t = model.inverse(model.hazard(t) + rng.exponential())
        elif rng.random() < 0.5:
            t = s


def pairs(spark: SparkSession, model: Steps, contigs: int, length: int, theta: float, rho: float, seed: int = 0) -> DataFrame:
    """contig_id, pos (from 1), t: heterozygous sites of diploids, a contig each, drawn from the contig's own seed. a pair that meets
    at time t differs at a base at the rate 2 theta t."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for c in batch["id"].tolist():
                rng, out = np.random.default_rng([seed, c]), []
                for a, b, t in segments(model, length, rho, rng):
                    sites = np.flatnonzero(rng.random(b - a) < -np.expm1(-2 * theta * t)) if b - a < 1 << 20 else np.unique(rng.integers(0, b - a, rng.poisson(2 * theta * t * (b - a))))
                    out += [(c, a + int(i) + 1, t) for i in sites]
                yield pd.DataFrame(out, columns=["contig_id", "pos", "t"])

    return spark.range(contigs).repartition(contigs, "id").mapInPandas(draw, "contig_id bigint, pos bigint, t double")


def genotypes(sites: DataFrame) -> DataFrame:
    """The sites as calls of one diploid sample: contig, pos, sid, h0, h1."""
    return sites.select(F.concat(F.lit("c"), F.col("contig_id").cast("string")).alias("contig"), "pos", F.lit("s").alias("sid"), F.lit(0).alias("h0"), F.lit(1).alias("h1"))
