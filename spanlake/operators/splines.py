"""Splines through knots as Hermite pieces: a kind is a rule for the slopes at the knots. Outside the knots they are flat.

Coefficients are small and made on the driver; ``pieces`` turns them into a table that points meet by an as-of pass."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import models


def clamped(h: np.ndarray, delta: np.ndarray) -> np.ndarray:
    """Slopes of the twice differentiable cubic whose end slopes are 0."""
    n = len(h) + 1
    system, right = np.eye(n), np.zeros(n)
    for i in range(1, n - 1):
        system[i, i - 1 : i + 2] = 1 / h[i - 1], 2 / h[i - 1] + 2 / h[i], 1 / h[i]
        right[i] = 3 * (delta[i - 1] / h[i - 1] + delta[i] / h[i])
    return np.linalg.solve(system, right)


def monotone(h: np.ndarray, delta: np.ndarray) -> np.ndarray:
    """The rule of Fritsch and Butland: inside, the harmonic mean of the neighbouring secants, weighted by the intervals, and
    0 where they differ in sign; at the ends, the slope of the parabola through the next three points, kept between 0 and
    three times the first secant."""
    if len(h) == 1:
        return np.repeat(delta, 2)

    def outer(i: int, j: int) -> float:
        bounds = sorted((0.0, 3 * delta[i]))
        return float(np.clip(delta[i] - h[i] * (delta[j] - delta[i]) / (h[i] + h[j]), *bounds))

    slopes = [outer(0, 1)]
    for i in range(1, len(h)):
        a, b = delta[i - 1], delta[i]
        w = (h[i - 1] + 2 * h[i]) / (3 * (h[i - 1] + h[i]))  # weight of the secant before
        slopes.append(a * b / (w * b + (1 - w) * a) if a * b > 0 else 0.0)
    return np.array([*slopes, outer(-1, -2)])


def local(h: np.ndarray, delta: np.ndarray) -> np.ndarray:
    """Akima's rule of 1970: a knot's slope is the mean of its two secants, each weighted by how much the secants on the
    other side change, and their plain mean where neither side changes. Beyond the ends secants go on in equal steps."""
    if len(h) == 1:
        return np.repeat(delta, 2)
    steps = np.array([1, 2])
    m = np.r_[(delta[0] + steps * (delta[0] - delta[1]))[::-1], delta, delta[-1] + steps * (delta[-1] - delta[-2])]

    def slope(a: float, b: float, c: float, d: float) -> float:
        left, right = abs(d - c), abs(b - a)
        return (b + c) / 2 if left == right == 0 else (left * b + right * c) / (left + right)

    return np.array([slope(*m[i : i + 4]) for i in range(len(h) + 1)])


KINDS = {"cubic": clamped, "pchip": monotone, "akima": local}


@dataclass
class Spline:
    """Knots x and coefficients c, one row a knot, lowest power first; the last row is the flat piece behind."""

    x: np.ndarray
    c: np.ndarray

    def __call__(self, at: np.ndarray) -> np.ndarray:
        at = np.maximum(np.asarray(at, float), self.x[0])
        k = np.searchsorted(self.x, at, "right") - 1
        u = at - self.x[k]
        return ((self.c[k, 3] * u + self.c[k, 2]) * u + self.c[k, 1]) * u + self.c[k, 0]

    def roughness(self) -> float:
        """Integral of the squared second derivative."""
        h = np.diff(self.x)
        p = 2 * self.c[:-1, 2]
        q = p + 6 * self.c[:-1, 3] * h
        return float(np.sum((p * p + p * q + q * q) * h / 3))


def fit(kind: str, x: list[float], y: list[float]) -> Spline:
    """A spline of KINDS, or ``piecewise``: constant from each knot on."""
    xs, ys = np.asarray(x, float), np.asarray(y, float)
    c = np.zeros((len(xs), 4))
    c[:, 0] = ys
    if kind == "piecewise" or len(xs) == 1:
        return Spline(xs, c)
    h = np.diff(xs)
    delta = np.diff(ys) / h
    s = KINDS[kind](h, delta)
    c[:-1, 1] = s[:-1]
    c[:-1, 2] = (3 * delta - 2 * s[:-1] - s[1:]) / h
    c[:-1, 3] = (s[:-1] + s[1:] - 2 * delta) / h**2
    return Spline(xs, c)


def basis(x: list[float], y: list[float]) -> Spline:
    """The cubic of control points y over knots x, two more than there are: in each interval the values of the four basis
    functions at four places, by the triangle of de Boor, give the cubic through them."""
    xs = np.asarray(x, float)
    t = np.r_[[xs[0]] * 3, xs, [xs[-1]] * 3]
    if len(y) != len(xs) + 2:
        raise ValueError("two control points more than knots are needed")
    c = np.zeros((len(xs), 4))
    for k in range(len(xs) - 1):
        width, d = xs[k + 1] - xs[k], np.empty(4)
        for i, u in enumerate(np.arange(4) / 3):
            at, p = xs[k] + u * width, [float(v) for v in y[k : k + 4]]
            for level in range(1, 4):
                for j in range(3, level - 1, -1):
                    low, high = t[k + j], t[k + j + 4 - level]
                    share = (at - low) / (high - low)
                    p[j] = (1 - share) * p[j - 1] + share * p[j]
            d[i] = p[3]
        c[k] = np.linalg.solve(np.vander(np.arange(4) / 3 * width, 4, increasing=True), d)
    c[-1, 0] = y[-1]
    return Spline(xs, c)


def control_roughness(y: list[float]) -> float:
    """Sum of the squared second differences of control points."""
    return float(np.sum(np.diff(y, 2) ** 2))


def aligned(a: Spline, b: Spline) -> tuple[Spline, Spline]:
    """The same two curves with the knots of both."""
    x = np.union1d(a.x, b.x)

    def moved(s: Spline) -> Spline:
        k = np.clip(np.searchsorted(s.x, x, "right") - 1, 0, None)
        u, c = x - s.x[k], s.c[k]
        taylor = [np.polynomial.polynomial.polyval(u, np.polynomial.polynomial.polyder(c.T, i), tensor=False) / math.factorial(i) for i in range(4)]
        return Spline(x, np.stack(taylor, axis=1))

    return moved(a), moved(b)


def pieces(spark: SparkSession, splines: dict[str, Spline]) -> DataFrame:
    """model_id, t0, c0 to c3; a flat piece leads."""
    rows = [(m, -1e300, float(s.c[0, 0]), 0.0, 0.0, 0.0) for m, s in splines.items()]
    rows += [(m, float(t), *map(float, c)) for m, s in splines.items() for t, c in zip(s.x, s.c, strict=True)]
    return spark.createDataFrame(rows, "model_id string, t0 double, c0 double, c1 double, c2 double, c3 double")


def values(points: DataFrame, table: DataFrame) -> DataFrame:
    """Points (model_id, t, ...) with y, the value of their model's spline."""
    found = models.as_of(points, table).withColumn("_u", F.col("t") - F.col("t0"))
    y = ((F.col("c3") * F.col("_u") + F.col("c2")) * F.col("_u") + F.col("c1")) * F.col("_u") + F.col("c0")
    return found.withColumn("y", F.when(F.col("t0") < -1e299, F.col("c0")).otherwise(y)).select(*points.columns, "y")


def steps(spline: Spline, times: list[float]) -> tuple[list[float], list[float]]:
    """A step model from a spline of log sizes, by its value in the middle of each interval."""
    middle = [(a + b) / 2 for a, b in zip(times, [*times[1:], times[-1]], strict=True)]
    return list(times), np.exp(spline(np.array(middle))).tolist()
