"""Measures of spectra, decodings and fits: divergence, error, choice of a penalty, exact sums, checks and small parsers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import models
from .panels import uniform


def divergence(p: DataFrame, q: DataFrame, keys: list[str]) -> DataFrame:
    """Kullback-Leibler divergence of two spectra (keys, mass); classes without mass in p add nothing."""
    both = p.where("mass <> 0").join(q.withColumnRenamed("mass", "other"), keys, "left")
    return both.agg(F.sum(F.col("mass") * (F.log("mass") - F.log(F.coalesce("other", F.lit(0.0))))).alias("kl"))


def exact_sum(column: str, digits: int = 15) -> Column:
    """A sum of decimals, which does not depend on the order of the rows."""
    return F.sum(F.col(column).cast(f"decimal(38,{digits})")).cast("double")


def decoded(posterior: DataFrame) -> DataFrame:
    """The likeliest state of each run (the first of equals) and the mean time; posterior: contig_id, seq, span, m, time, p."""
    best = F.max_by("m", F.struct(F.col("p"), -F.col("m")))
    return posterior.groupBy("contig_id", "seq", "span").agg(best.alias("best"), (F.sum(F.col("time") * F.col("p")) / F.sum("p")).alias("mean"))


def decoding_error(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Mean square error of the mean time over all bases, by contig; truth: contig_id, seq, t."""
    both = found.join(truth, ["contig_id", "seq"])
    return both.groupBy("contig_id").agg((F.sum(F.col("span") * (F.col("mean") - F.col("t")) ** 2) / F.sum("span")).alias("mse"))


def best_penalty(scores: DataFrame) -> DataFrame:
    """The penalty of each fold with the largest log likelihood of what was left out; the smaller of equals."""
    return scores.groupBy("fold").agg(F.max_by("penalty", F.struct(F.col("loglik"), -F.col("penalty"))).alias("penalty"), F.max("loglik").alias("loglik"))


def not_ascending(states: DataFrame) -> DataFrame:
    """Hidden states (model_id, m, t) that are not above the one before."""
    before = F.lag("t").over(Window.partitionBy("model_id").orderBy("m"))
    return states.withColumn("before", before).where("t <= before")


def random_times(pieces: DataFrame, low: float, high: float, n: int, seed: int) -> DataFrame:
    """n meeting times a model between low and high, by the inverse of the distribution function."""
    spark = pieces.sparkSession
    ends = spark.createDataFrame([(low, high)], "a double, b double")
    ids = pieces.select("model_id").distinct()
    at = lambda c, name: models.hazard_at(ids.join(F.broadcast(ends)).select("model_id", F.col(c).alias("t")), pieces).select("model_id", F.col("r").alias(name))
    draws = spark.range(n).select(F.col("id").alias("draw")).withColumn("u", uniform(seed, "draw"))
    rows = at("a", "ra").join(at("b", "rb"), "model_id").join(F.broadcast(draws)) if n <= 1000 else draws.join(F.broadcast(at("a", "ra").join(at("b", "rb"), "model_id")))
    y = F.col("ra") - F.log(1 - F.col("u") * (1 - F.exp(F.col("ra") - F.col("rb"))))
    return models.time_of(rows.select("model_id", "draw", y.alias("y")), pieces).select("model_id", "draw", "t")


def with_knots(pieces: DataFrame, times: list[float]) -> DataFrame:
    """The same model with pieces cut at more times."""
    cuts = F.array(*[F.lit(float(t)) for t in sorted(times)])
    inside = F.filter(cuts, lambda t: (t > F.col("t0")) & (F.col("t1").isNull() | (t < F.col("t1"))))
    rows = pieces.select("model_id", F.explode(F.concat(F.array("t0"), inside)).alias("t0"), "size")
    return models._renumbered(rows)


def offset(pieces: DataFrame, offsets: DataFrame, fill: float = 0.0) -> DataFrame:
    """Models and offsets (number, offset) by their numbers, all of either; a missing offset is ``fill``. Times move by it."""
    named = pieces.select("model_id").distinct().select("model_id", (F.dense_rank().over(Window.orderBy("model_id")) - 1).alias("number"))
    both = named.join(offsets, "number", "full").select("number", "model_id", F.coalesce("offset", F.lit(fill)).alias("offset"))
    return both.join(pieces, "model_id", "left").select("number", "model_id", "offset", (F.col("t0") + F.col("offset")).alias("x"), "size")


def pieces_of(text: str) -> list[int]:
    """``4*2+10``: four pieces of 2 intervals and one of 10."""
    parts = [p.partition("*") for p in text.split("+")]
    return [int(span) for count, star, size in parts for span in [size if star else count] for _ in range(int(count) if star else 1)]


def time_points(first: float, last: float, pieces: list[int], offset: float) -> list[float]:
    """The first time and the lengths of pieces that join intervals, which are even on the scale of logarithms."""
    edges = np.geomspace(offset + first, last, sum(pieces) + 1)
    at = np.cumsum([0, *pieces])
    return [first, *(edges[at[1:]] - edges[at[:-1]]).tolist()]


def from_meeting(times: list[float], p: list[float]) -> tuple[list[float], list[float]]:
    """Start times and sizes of the steps with which a pair meets in [times[i], times[i + 1]) with the probability p[i]; the
    last interval, whose share follows from the others, has size 1."""
    left = 1 - np.r_[0, np.cumsum(p[:-1])]
    hazard = -np.log(left)
    sizes = np.diff(times[: len(p)]) / np.diff(hazard)
    return list(times[: len(p)]), [*sizes.tolist(), 1.0]


def first_meeting(t: np.ndarray, a: np.ndarray, n: int, q: float) -> float:
    """The time by which the first of n lineages have met with the probability q under steps of start t and size a."""
    from .demography import Steps

    return Steps(t, a).inverse(-np.log1p(-q) / (n * (n - 1) / 2))


def mixture(x: np.ndarray, k: int, rounds: int = 200, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and deviations of a mixture of k normal distributions, by expectation and maximisation."""
    m = np.quantile(x, (np.arange(k) + 0.5) / k) + np.random.default_rng(seed).normal(size=k) * x.std() * 1e-3
    w, s = np.full(k, 1 / k), np.full(k, max(x.std() / k, 1e-6))
    for _ in range(rounds):
        logs = np.log(w) - np.log(s) - 0.5 * ((x[:, None] - m) / s) ** 2
        r = np.exp(logs - logs.max(1, keepdims=True))
        r /= r.sum(1, keepdims=True)
        n = r.sum(0) + 1e-12
        w, m = n / n.sum(), (r * x[:, None]).sum(0) / n
        s = np.sqrt((r * (x[:, None] - m) ** 2).sum(0) / n + 1e-6)
    return w, m, s


def meeting_quantiles(rates: DataFrame, k: int, theta: float, w: int, draws: int = 100_000, bins: int = 4096, seed: int = 0) -> np.ndarray:
    """Quantiles, even on the scale of logarithms between 1 and 99 %, of the meeting time of the pair, from the rates of
    windows: a mixture of k normal distributions is fitted and drawn from, and draws above 0 count. The rates come to the
    driver as counts of ``bins`` equal bins, whatever the table's size."""
    low, high = rates.agg(F.min("rate"), F.max("rate")).first()
    if low is None or low == high:
        raise ValueError("rates do not differ")
    width = (high - low) / bins
    counted = rates.groupBy(F.least(F.floor((F.col("rate") - low) / width), F.lit(bins - 1)).alias("b")).agg(F.count("*").alias("n"), F.avg("rate").alias("x")).collect()
    n = np.array([r.n for r in counted], float)
    share = np.maximum(1, np.round(n * min(1.0, 50_000 / n.sum()))).astype(int)
    weight, mean, deviation = mixture(np.repeat([r.x for r in counted], share), k, seed=seed)
    rng = np.random.default_rng(seed)
    which = rng.choice(k, draws, p=weight / weight.sum())
    y = rng.normal(mean[which], deviation[which])
    return np.quantile(y[y > 0], np.geomspace(0.01, 0.99, k)) / (2 * theta * w)
