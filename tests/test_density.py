"""Densities by beta kernels."""

import math

import numpy as np
import pytest

from spanlake.operators import density


def plain(xs, y, h):
    a, b = 1 + y / h, 1 + (1 - y) / h
    c = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    one = lambda x: math.exp(c) * (x ** (a - 1)) * ((1 - x) ** (b - 1))
    return sum(map(one, xs)) / len(xs)


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(1)
    xs = [0.0, 1.0, 1.0, *rng.beta(2, 5, 800).tolist()]
    return xs, spark.createDataFrame([(i, x) for i, x in enumerate(xs)] + [(-1, None)], "id long, x double").repartition(5)


def test_density_against_loops(values):
    xs, df = values
    at = [0.0, 0.01, 0.2, 0.5, 0.93, 1.0]
    got = {r.y: r.density for r in density.density(df, "x", at, 0.05).collect()}
    np.testing.assert_allclose([got[y] for y in at], [plain(xs, y, 0.05) for y in at], rtol=1e-9)


def test_it_integrates_to_one_and_quantiles_are_near_those_of_the_sample(values):
    xs, df = values
    at = np.linspace(0, 1, 2001)
    got = {r.y: r.density for r in density.density(df, "x", at.tolist(), 0.01).collect()}
    f = np.array([got[y] for y in at.tolist()])
    assert abs(np.sum((f[1:] + f[:-1]) / 2) / 2000 - 1) < 0.02
    q = density.quantiles(df, "x", [0.05, 0.25, 0.5, 0.75, 0.95], 0.005)
    assert all(a < b for a, b in zip(q, q[1:]))
    np.testing.assert_allclose(q, np.quantile(xs, [0.05, 0.25, 0.5, 0.75, 0.95]), atol=0.03)


def test_slice_samples(spark):
    h, mean = 0.1, 4.0
    df = spark.createDataFrame([(i, 0.3) for i in range(3000)] + [(9001, 0.0), (9002, 1.0)], "id long, x double")
    rows = density.sample(df.repartition(4), "x", "id", mean, h, 7).collect()
    again = density.sample(df.repartition(3), "x", "id", mean, h, 7).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    assert abs(len(rows) / 3002 - mean) < 0.15
    assert {r.y for r in rows if r.id == 9001} <= {0.0} and {r.y for r in rows if r.id == 9002} <= {1.0}
    ys = np.array([r.y for r in rows if r.id < 9000])
    at = np.linspace(0, 1, 2001)
    f = np.array([plain([0.3], y, h) for y in at])
    want = [np.sum(at**k * f) / np.sum(f) for k in (1, 2)]
    np.testing.assert_allclose([np.mean(ys), np.mean(ys**2)], want, rtol=0.03)


def test_values_outside_are_refused_and_none_are_none(spark):
    df = spark.createDataFrame([(1.5,)], "x double")
    with pytest.raises(Exception, match="between 0 and 1"):
        density.density(df, "x", [0.5], 0.1).collect()
    assert density.density(df.where("false"), "x", [0.5], 0.1).collect() == []
    with pytest.raises(ValueError):
        density.quantiles(df.where("false"), "x", [0.5], 0.1)
