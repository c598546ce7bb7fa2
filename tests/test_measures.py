"""Moran rates, small measures, the optimiser, and a fit of simulated data from calls to model."""

import json
import math

import numpy as np
import pytest
import simulated_pairs
from pyspark.sql import functions as F

from spanlake.__main__ import main
from spanlake.operators import demography, measures, moran, panels, splines
from spanlake.sources import text


def test_moran_eigensystems():
    for n, pair in ((5, None), (5, 0), (8, 1), (4, 2)):
        d, u, inverse = moran.eigensystem(n, pair)
        m = np.array(moran.rates(n, pair), float)
        assert len(d) == n + 1 and np.allclose((u * d) @ inverse, m, atol=1e-4) and np.allclose(m.sum(1), 0)
        p = moran.after(n, 0.7, pair)
        assert np.allclose(p.sum(1), 1) and np.allclose(moran.after(n, 0.3, pair) @ moran.after(n, 0.4, pair), p)
    assert moran.rates(6)[0][1] == moran.rates(6)[6][5] == 0  # without a pair, fixed is fixed


def test_pieces_and_models_of_probabilities():
    assert measures.pieces_of("4*2+10") == [2, 2, 2, 2, 10] and measures.pieces_of("3") == [3]
    points = measures.time_points(0.0, 1.0, [1, 2], 0.1)
    assert points[0] == 0 and sum(points) == pytest.approx(0.9) and points[1] == pytest.approx(0.1 * (10 ** (1 / 3) - 1))
    times, p = [0.0, 0.5, 1.0, math.inf], [0.3, 0.2, 0.5]
    steps = demography.Steps(*map(np.array, measures.from_meeting(times, p)))
    assert np.allclose(demography.initial(steps, times), p)
    t = measures.first_meeting(np.zeros(1), np.ones(1), 5, 0.25)
    assert 1 - math.exp(-10 * t) == pytest.approx(0.25)


def test_minimum_between_bounds():
    valley = lambda x: (1 - x[0]) ** 2 + 100 * (x[1] - x[0] ** 2) ** 2
    x = demography.minimise(valley, np.array([-1.0, 1.0]), np.full(2, -2.0), np.full(2, 2.0), rounds=200)
    assert np.allclose(x, 1, atol=1e-2)
    held = demography.minimise(lambda x: float(((x - np.array([3.0, 0.5])) ** 2).sum()), np.zeros(2), np.full(2, -1.0), np.full(2, 1.0))
    assert np.allclose(held, [1, 0.5], atol=1e-3)


def test_matched_curves():
    knots = [0.0, 0.5, 1.0, 2.0]
    target = demography.Steps(np.linspace(0, 2, 80), np.exp(np.sin(np.linspace(0, 2, 80))))
    y = demography.matched(lambda v: splines.fit("cubic", knots, v), 4, target, 2.0)
    assert np.abs(splines.fit("cubic", knots, y)(np.linspace(0.1, 1.9, 50)) - np.sin(np.linspace(0.1, 1.9, 50))).max() < 0.1


def test_breaks_against_a_loop(spark):
    rng = np.random.default_rng(8)
    rows = [(int(rng.choice([1, 3, 9, 12])), int(rng.integers(0, 2)), 0, 4) for _ in range(60)]
    runs = []
    for s, *o in rows:
        if runs and runs[-1][1:] == o:
            runs[-1][0] += s
        else:
            runs.append([s, *o])
    pieces, n = [[]], len(runs)
    for i, r in enumerate(runs):
        if r[0] > 10 and i < n - 1:
            pieces.append([])
        else:
            pieces[-1].append(tuple(r))
    want = [(k, [(1, *p[0][1:]), (p[0][0] - 1, *p[0][1:]), *p[1:]] if p[0][0] > 1 else p) for k, p in enumerate(pieces) if p]
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "contig_id bigint, seq bigint, span int, a1 int, b1 int, nb1 int")
    got = {}
    for r in panels.break_merged(df, 10).orderBy("seq", "part").collect():
        got.setdefault(r.piece, []).append((r.span, r.a1, r.b1, r.nb1))
    assert sorted(got.items()) == want


def test_simulated_pairs_have_the_expected_differences(spark):
    model = demography.Steps(np.array([0.0]), np.array([1.0]))
    sites = simulated_pairs.pairs(spark, model, 4, 200_000, 2e-3, 2e-3, seed=3)
    n = sites.groupBy("contig_id").count().collect()
    assert len(n) == 4 and sum(r["count"] for r in n) / 800_000 == pytest.approx(4e-3, rel=0.1)
    assert sites.collect() == simulated_pairs.pairs(spark, model, 4, 200_000, 2e-3, 2e-3, seed=3).collect()


def test_constant_size_comes_back(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    sites = simulated_pairs.pairs(spark, demography.Steps(np.array([0.0]), np.array([1.0])), 6, 300_000, 1e-3, 1e-3, 1)
    lengths = spark.range(6).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("contig"), F.lit(300_000).cast("bigint").alias("length"))
    text.write_vcf(simulated_pairs.genotypes(sites), at("v"), ["s"], lengths)
    main(["convert", at("v"), at("s"), "p:s"], spark)
    assert spark.read.parquet(at("s")).agg(F.sum("span")).first()[0] == 1_800_000
    fit = ["--mu", "1e-8", "--knots", "3", "--penalty", "10"]
    main(["estimate", at("s"), at("m"), *fit, "--em-iterations", "4"], spark)
    got = json.loads(spark.read.text(at("m")).first()["value"])
    model = demography.Steps(np.array(got["model"]["knots"]), np.exp(got["model"]["y"]))
    assert model.survival(0.0, math.inf) == pytest.approx(10, rel=0.15)  # the mean meeting time, in units of theta 1e-4
    assert 5e-5 < got["rho"] < 2e-4  # six short contigs tell it to a factor of 2
    rounds = [json.loads(r.value) for r in spark.read.text(at("m") + "-rounds").collect()]
    assert max(r["round"] for r in rounds) == len(got["loglik"]) and sum(r["done"] for r in rounds) == 1
    # a run that was ended goes on from its last round
    half = sorted((r for r in rounds if not r["done"]), key=lambda r: r["round"])[:2]
    spark.createDataFrame([(json.dumps(r),) for r in half], "value string").write.text(at("n-rounds"))
    main(["estimate", at("s"), at("n"), *fit, "--em-iterations", "3"], spark)
    again = json.loads(spark.read.text(at("n")).first()["value"])
    assert again["loglik"][:2] == got["loglik"][:2] and again["loglik"][2] == pytest.approx(got["loglik"][2])
