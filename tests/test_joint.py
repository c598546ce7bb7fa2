"""Joint spectra of two populations: margins, limits and a simulation."""

import math

import numpy as np
import pytest

from spanlake.operators import conditioned as cs
from spanlake.operators import demography as dm
from spanlake.operators import joint

cs_chain = cs._Chain
FLAT = dm.Steps(np.array([0.0]), np.array([1.0]))
BENT = dm.Steps(np.array([0.0, 0.3, 1.2]), np.array([1.0, 0.2, 3.0]))
GROWN = dm.Steps(np.array([0.0, 0.5]), np.array([2.0, 0.4]))
STATES = [0.0, 0.2, 0.6, 1.4, math.inf]


@pytest.mark.parametrize("n", [(0, 0), (1, 0), (2, 1), (4, 3), (10, 6)])
@pytest.mark.parametrize("split", [0.0, 0.1, 0.4, 2.0])
def test_margin_is_the_spectrum_of_one_population(n, split):
    got = joint.spectra(BENT, GROWN, split, STATES, n)[:, :, :, 0].sum(-1)
    want = cs.spectra(BENT, STATES, n[0])
    got[:, 0, 0] = want[:, 0, 0] = 0  # what the first population does not show
    got[:, 2, n[0]] = want[:, 2, n[0]] = 0
    np.testing.assert_allclose(got, want, rtol=1e-6, atol=1e-9)


@pytest.mark.parametrize("na", [(2, 0), (1, 1)])
@pytest.mark.parametrize("split", [0.1, 0.4, 2.0])
def test_margin_of_the_second_population(na, split):
    """Over all states, the second population's samples are a coalescent of its own model and then the first's."""
    n = (3, 4)
    met = BENT if na == (2, 0) else joint.apart(BENT, split)
    weights = np.array([math.exp(-met.hazard(a)) - math.exp(-met.hazard(b)) for a, b in zip(STATES, STATES[1:])])
    mixed = np.einsum("m,mabcd->abcd", weights, joint.spectra(BENT, GROWN, split, STATES, n, na))
    all_ = n[1] + na[1]
    got = np.zeros(all_ + 1)
    for d in range(na[1] + 1):
        got[d : d + n[1] + 1] += mixed.sum((0, 1))[d]
    want = joint.plain(joint.spliced(GROWN, BENT, split), all_)
    np.testing.assert_allclose(got[1:all_], want[1:all_], rtol=1e-6)


def test_no_split_is_one_population():
    got = joint.spectra(BENT, GROWN, 0.0, STATES, (3, 2))
    whole = cs.spectra(BENT, STATES, 5)
    sums = np.zeros_like(whole)
    for b1 in range(4):
        for b2 in range(3):
            sums[:, :, b1 + b2] += got[:, :, b1, 0, b2]
    sums[:, 2, 5] = whole[:, 2, 5]
    np.testing.assert_allclose(sums, whole, rtol=1e-9, atol=1e-12)


def test_a_pair_apart_alone():
    got = joint.spectra(BENT, GROWN, 0.4, STATES, (0, 0), (1, 1))
    times = dm.meeting_times(joint.apart(BENT, 0.4), STATES)
    assert not got[0].any() and np.isnan(times[0])
    np.testing.assert_allclose(got[1:, 1, 0, 0, 0], times[1:], rtol=1e-8)
    np.testing.assert_allclose(got[1:, 0, 0, 1, 0], times[1:], rtol=1e-8)


def simulated(split, low, high, n, na, runs, seed):
    """Plain coalescents of two populations, kept where the pair meets in the interval."""
    rng, out, kept = np.random.default_rng(seed), np.zeros((na[0] + 1, n[0] + 1, na[1] + 1, n[1] + 1)), 0
    for _ in range(runs):
        blocks = [(0, (1, 0, 0, 0))] * na[0] + [(0, (0, 1, 0, 0))] * n[0] + [(1, (0, 0, 1, 0))] * na[1] + [(1, (0, 0, 0, 1))] * n[1]
        t, met, own = 0.0, None, np.zeros_like(out)
        while len(blocks) > 1:
            waits = []
            for p, model in enumerate((BENT, GROWN)):
                k = len(blocks) if t >= split else sum(q == p for q, _ in blocks)
                if k > 1 and not (p and t >= split):
                    waits.append((model.inverse(model.hazard(t) + rng.exponential(2 / (k * (k - 1)))), p))
            to, p = min(waits, default=(math.inf, 0))
            if t < split <= to:
                to, p = split, None
            for _, b in blocks:
                own[b] += to - t
            t = to
            if p is None:
                continue
            here = [i for i, (q, _) in enumerate(blocks) if t > split or q == p]
            i, j = rng.choice(here, 2, replace=False)
            x, y = blocks[i][1], blocks[j][1]
            if x[0] + x[2] == y[0] + y[2] == 1:
                met = t
            blocks = [b for k, b in enumerate(blocks) if k not in (i, j)] + [(blocks[i][0], tuple(a + b for a, b in zip(x, y)))]
        if low <= met < high:
            out, kept = out + own, kept + 1
    out[0, 0, 0, 0] = out[-1, -1, -1, -1] = 0
    return out / kept


@pytest.mark.parametrize("na", [(2, 0), (1, 1)])
def test_against_simulation(na):
    low, high = (0.1, 0.9) if na == (2, 0) else (0.6, 1.4)
    got = joint.spectra(BENT, GROWN, 0.5, [0.0, low, high, math.inf], (2, 2), na)[1]
    want = simulated(0.5, low, high, (2, 2), na, 9000, 3)
    np.testing.assert_allclose(got, want, rtol=0.12, atol=0.015)


def test_second_population_without_samples():
    keys = [(a, b, 3, 0, 0, 0) for a in (-1, 0, 1, 2) for b in range(4)] + [(-1, 0, 0, 0, 0, 0), (1, 0, 0, 0, 0, 0), (2, 1, 2, 0, 0, 0)]
    one = cs.sample_model(BENT, STATES, 0.01, 0.02, [k[:3] for k in keys], 3)
    two = joint.model_of(BENT, GROWN, 0.4, STATES, 0.01, 0.02, keys)
    np.testing.assert_allclose(two.pi, one.pi)
    np.testing.assert_allclose(two.transition, one.transition)
    for k in keys:
        if k[0] < 0 and k[2] == 0:
            continue
        np.testing.assert_allclose(two.emission[k], one.emission[k[:3]], rtol=1e-6)


@pytest.mark.parametrize("na", [(2, 0), (1, 1)])
def test_pairs_of_models_side_by_side(na, monkeypatch):
    """Each with its own split, 0 included; passes do not grow with their number."""
    one, two, splits = [BENT, FLAT, GROWN, BENT], [GROWN, BENT, FLAT, FLAT], np.array([0.4, 0.0, 0.2, 2.0])
    moves, move = [], cs_chain.move
    monkeypatch.setattr(cs_chain, "move", lambda self, *x: (moves.append(1), move(self, *x))[1])
    got = joint.spectra_of(dm.Many.of(one), dm.Many.of(two), splits, STATES, (2, 1), na)
    few = len(moves)
    joint.spectra_of(dm.Many.of(one * 50), dm.Many.of(two * 50), np.tile(splits, 50), STATES, (2, 1), na)
    assert len(moves) == 2 * few
    for i, (a, b, split) in enumerate(zip(one, two, splits)):
        np.testing.assert_allclose(got[..., i], joint.spectra(a, b, float(split), STATES, (2, 1), na), rtol=1e-9, atol=1e-12)


def test_second_margin_over_models(spark):
    """The second population's samples are a coalescent of its own model and then the first's, for each pair of a table."""
    sides = [(BENT, GROWN, 0.4), (FLAT, BENT, 2.0), (GROWN, FLAT, 0.0)]
    rows = [(i, p, float(t), float(a), s) for i, (one, two, s) in enumerate(sides) for p, m in ((2, two), (1, one)) for t, a in zip(m.t, m.a)]
    df = spark.createDataFrame(rows, "model_id long, population int, t0 double, size double, split double")
    got = joint.over_models(df, [0.0, math.inf], (1, 2)).where("b2 = 1").groupBy("model_id").sum("length").orderBy("model_id").collect()
    want = [joint.plain(joint.spliced(two, one, s), 2)[1] for one, two, s in sides]
    np.testing.assert_allclose([r[1] for r in got], want, rtol=1e-8)
