"""Density of values between 0 and 1 by beta kernels, which do not leak over the ends: at a point y the kernel is the beta
distribution of 1 + y / h and 1 + (1 - y) / h, averaged over the values.

Values are counted first; each task sums the kernels of its values at all points, so what is shuffled is a row a point."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values whose kernels are in memory at once.
SOME = 1 << 10


def _log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    return lgamma(a) + lgamma(b) - lgamma(a + b)


def _log_kernel(x: np.ndarray, y: np.ndarray, h: float) -> np.ndarray:
    """Logarithm of the kernel, up to what does not depend on x: -inf where a value at an end weighs nothing."""
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(y > 0, y / h * np.log(x), 0.0)
        right = np.where(y < 1, (1 - y) / h * np.log1p(-x), 0.0)
    return left + right


def density(values: DataFrame, column: str, points: list[float], h: float) -> DataFrame:
    """y and density at each point. Null values do not count; values outside 0 to 1 are refused."""
    at = np.array(points, float)
    counts = values.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("x")).agg(F.count("*").alias("n"))
    counts = counts.withColumn("x", F.when(F.col("x").between(0, 1), F.col("x")).otherwise(F.raise_error(F.lit("values must lie between 0 and 1")).cast("double")))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, total, beta = np.zeros(len(at)), 0, _log_beta(1 + at / h, 1 + (1 - at) / h)
        for pdf in batches:
            total += int(pdf["n"].sum())
            for i in range(0, len(pdf), SOME):
                x, n = (pdf[c].to_numpy()[i : i + SOME] for c in ("x", "n"))
                sums += np.exp(_log_kernel(x[:, None], at[None, :], h) - beta).T @ n
        yield pd.DataFrame({"i": np.arange(len(at)), "sum": sums, "n": total})

    parts = counts.mapInPandas(add, "i int, sum double, n long").groupBy("i").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n"))
    y = F.element_at(F.array(*[F.lit(float(p)) for p in points]), F.col("i") + 1)
    return parts.where("n > 0").select(y.alias("y"), (F.col("sum") / F.col("n")).alias("density"))


def quantiles(values: DataFrame, column: str, probabilities: list[float], h: float, points: int = 1000) -> list[float]:
    """Where the distribution of the density reaches each probability: areas between points, then halving between two."""
    at = np.linspace(0, 1, points + 1)
    found = {r.y: r.density for r in density(values, column, at.tolist(), h).collect()}  # a row a point
    if not found:
        raise ValueError("no values")
    f = np.array([found[y] for y in at.tolist()])
    area = np.r_[0, np.cumsum((f[1:] + f[:-1]) / 2)]
    area /= area[-1]
    out = []
    for p in probabilities:
        low, high = 0.0, 1.0
        while high - low > 1e-9:
            middle = (low + high) / 2
            low, high = (middle, high) if np.interp(middle, at, area) < p else (low, middle)
        out.append((low + high) / 2)
    return out


def _uniform(seed: int, ids: np.ndarray, turn: int) -> np.ndarray:
    """A number above 0 and below 1 for each id and turn, the same wherever it is made."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 1_000_003 + turn + 1) * np.uint64(0xD1B54A32D192ED03)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)


def _edge(f, inside: np.ndarray, outside: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Between a point where f is at least the level and an end: the last such point, by halving."""
    low, high = inside.copy(), np.where(f(outside) >= level, outside, inside)
    far = outside.copy()
    done = high == outside
    for _ in range(50):
        middle = (low + far) / 2
        up = f(middle) >= level
        low, far = np.where(up, middle, low), np.where(up, far, middle)
    return np.where(done, outside, low)


def sample(values: DataFrame, column: str, key: str, mean: float, h: float, seed: int = 0) -> DataFrame:
    """key, draw, y: for each value a Poisson number of draws of the points whose kernels could have given it, by slice
    sampling: a level below the present height, then a uniform point of the slice. A value at an end is its own draw. The
    draws follow from seed and key alone."""

    def draws(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, ids = pdf["x"].to_numpy(float), pdf["id"].to_numpy()
            many = np.zeros(len(x), int)
            u, k, term = _uniform(seed, ids, 0), 0, math.exp(-mean)
            cdf = term
            while (u > cdf).any() and k < 10 * mean + 100:  # Poisson numbers by their distribution
                k += 1
                many[u > cdf] = k
                term *= mean / k
                cdf += term
            inner = (x > 0) & (x < 1)
            xs = np.clip(x, 1e-300, 1 - 1e-16)
            f = lambda y: _log_kernel(xs, y, h) - _log_beta(1 + y / h, 1 + (1 - y) / h)  # noqa: E731, B023
            grid = np.linspace(0, 1, 65)
            peak = grid[np.argmax(np.stack([f(np.full(len(xs), g)) for g in grid]), 0)] if len(xs) else xs
            now, out = peak.copy(), []
            for turn in range(int(many.max(initial=0))):
                level = f(now) + np.log(_uniform(seed, ids, 2 * turn + 1))
                top = np.where(f(peak) >= level, peak, now)
                a, b = _edge(f, top, np.zeros(len(xs)), level), _edge(f, top, np.ones(len(xs)), level)
                now = a + (b - a) * _uniform(seed, ids, 2 * turn + 2)
                here = many > turn
                out.append(pd.DataFrame({key: ids[here], "draw": turn, "y": np.where(inner, now, x)[here]}))
            if out:
                yield pd.concat(out)

    rows = values.where(F.col(column).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(column).cast("double").alias("x"))
    return rows.mapInPandas(draws, f"{key} long, draw int, y double")
