"""Conditioned spectra against closed forms and a simulation."""

import math

import numpy as np
import pytest

from spanlake.operators import conditioned as cs
from spanlake.operators import demography as dm

FLAT = dm.Steps(np.array([0.0]), np.array([1.0]))
BENT = dm.Steps(np.array([0.0, 0.3, 1.2]), np.array([1.0, 0.2, 3.0]))


@pytest.mark.parametrize("n", [0, 1, 3, 8, 30])
def test_constant_size(n):
    got = cs.marginal(cs.spectra(FLAT, [0.0, math.inf], n)[0])
    np.testing.assert_allclose(got, 2 / np.arange(1, n + 2), rtol=1e-9)


@pytest.mark.parametrize("n", [0, 2, 10, 20])
def test_pair_branches_are_twice_the_meeting_time(n):
    states = [0.0, 0.5, 1.0, 2.0, math.inf]
    for model in (FLAT, BENT):
        np.testing.assert_allclose(cs.spectra(model, states, n)[:, 1].sum(1), 2 * dm.meeting_times(model, states), rtol=1e-8)


def test_states_mix_to_the_whole():
    states = [0.0, 0.2, 0.7, 1.5, math.inf]
    mixed = np.einsum("m,mab->ab", dm.initial(BENT, states), cs.spectra(BENT, states, 6))
    np.testing.assert_allclose(mixed, cs.spectra(BENT, [0.0, math.inf], 6)[0], rtol=1e-8, atol=1e-12)


def _simulated(model, low, high, n, runs, seed):
    """Branch lengths of standard coalescents, kept where the pair meets in the interval."""
    rng, out, kept = np.random.default_rng(seed), np.zeros((3, n + 1)), 0
    for _ in range(runs):
        blocks, r, t, met, own = [(1, 0), (1, 0), *[(0, 1)] * n], 0.0, 0.0, None, np.zeros((3, n + 1))
        while len(blocks) > 1:
            r += rng.exponential(2 / (len(blocks) * (len(blocks) - 1)))
            now = model.inverse(r)
            for d, u in blocks:
                own[d, u] += now - t
            t = now
            i, j = rng.choice(len(blocks), 2, replace=False)
            if blocks[i][0] == blocks[j][0] == 1:
                met = t
            blocks = [x for k, x in enumerate(blocks) if k not in (i, j)] + [(blocks[i][0] + blocks[j][0], blocks[i][1] + blocks[j][1])]
        if low <= met < high:
            out, kept = out + own, kept + 1
    return out / kept


def test_against_simulation():
    got = cs.spectra(BENT, [0.0, 0.4, 1.0, math.inf], 3)[1]
    want = _simulated(BENT, 0.4, 1.0, 3, 12000, 5)
    want[2, 3] = 0
    np.testing.assert_allclose(got, want, rtol=0.12, atol=0.02)


def test_bins_and_emissions():
    assert cs.bins((0, 0, 4), 4) == {(0, 0): 1.0}
    assert cs.bins((2, 4, 4), 4, 0.25) == {(0, 0): 1.0}
    assert cs.bins((1, 1, 4), 4, 0.25) == {(1, 1): 0.75, (1, 3): 0.25}
    states = [0.0, 0.2, 0.7, 1.5, math.inf]
    known = [(a, b, m) for m in (0, 2, 4) for a in (-1, 0, 1, 2) for b in range(m + 1)]
    e = cs.emissions(BENT, states, 0.05, known, 4)
    assert all((v > 0).all() and (v <= 1 + 1e-9).all() for v in e.values())
    full = cs.with_mutation(cs.spectra(BENT, states, 4), 0.05)
    np.testing.assert_allclose(full.sum((1, 2)), 1, atol=1e-8)
    assert cs.marginal(cs.spectra(FLAT, [0.0, math.inf], 4)[0], True).sum() == pytest.approx((2 / np.arange(1, 6)).sum())


def test_histories():
    from spanlake.operators import models

    human, saw = models.human(), models.sawtooth()
    assert [round(x[1] * 20000 * 29) for x in human] == [10000, 70000, 200000, 200001]
    assert saw[0][2:] == (5.0, 5.0) and saw[1][3] == pytest.approx(0.5, rel=1e-4) and saw[2][3] == pytest.approx(5.0, rel=1e-3)
    times, sizes = models.stepped(human)
    assert len(times) == 28 and sizes[-1] == 4.0 and times == sorted(times)


def test_estimate_with_samples(spark):
    rows = [(c, i, 40 + (7 * i + c) % 60, a, b, 4) for c in range(3) for i in range(60) for a, b in [((i + c) % 3 % 2, (i * 5 + c) % 4)]]
    df = spark.createDataFrame(rows, "contig_id int, seq int, span int, a1 int, b1 int, nb1 int")
    model, history = dm.estimate(df, [0.0, 0.5], [0.0, 0.4, 1.0, math.inf], 0.01, 0.01, rounds=2, build=cs.sample_model)
    assert len(model.a) == 2 and history[-1] >= history[0] - 1e-6 * abs(history[0])


MANY = [FLAT, BENT, dm.Steps(np.array([0.0, 0.125, 0.5, 2.0]), np.array([0.25, 3.0, 40.0, 0.5])), dm.Steps(np.array([0.0, 0.7]), np.array([0.05, 2.0]))]


@pytest.mark.parametrize("n", [0, 2, 6])
def test_models_side_by_side(n, monkeypatch):
    """Models of unlike pieces give what each gives alone, and passes do not grow with their number."""
    states, moves, move = [0.0, 0.0625, 0.5, 2.0, math.inf], [], cs._Chain.move
    monkeypatch.setattr(cs._Chain, "move", lambda self, *x: (moves.append(1), move(self, *x))[1])
    got = cs.spectra_of(dm.Many.of(MANY), states, n)
    few = len(moves)
    cs.spectra_of(dm.Many.of(MANY * 50), states, n)
    assert len(moves) == 2 * few
    for i, model in enumerate(MANY):
        np.testing.assert_allclose(got[..., i], cs.spectra(model, states, n), rtol=1e-10, atol=1e-13)
        np.testing.assert_allclose(got[:, 1, :, i].sum(1), 2 * dm.meeting_times(model, states), rtol=1e-9)
    np.testing.assert_array_equal(dm.initial(dm.Many.of(MANY), states), np.stack([dm.initial(m, states) for m in MANY], -1))


def test_over_models(spark):
    """Any order of pieces, models of unlike pieces, more models than are moved at once; null for what has no mean time."""
    rows = [(f"m{i}", float(t), float(a) * (1 + i % 3)) for i in range(1100) for t, a in reversed(list(zip(MANY[i % 4].t, MANY[i % 4].a)))]
    df = spark.createDataFrame(rows, "model_id string, t0 double, size double")
    states = [0.0, 0.5, math.inf]
    got = {(r.model_id, r.m, r.a, r.b): r.length for r in cs.over_models(df, states, 1).collect()}
    assert len(got) == 1100 * 2 * 3 * 2
    for i in (0, 1, 2, 3, 6, 1099):
        want = cs.spectra(dm.Steps(MANY[i % 4].t, MANY[i % 4].a * (1 + i % 3)), states, 1)
        np.testing.assert_allclose([got[f"m{i}", *at] for at in np.ndindex(*want.shape)], want.ravel(), rtol=1e-10, atol=1e-13)
    never = spark.createDataFrame([("x", 0.0, math.inf), ("x", 1.0, 1.0)], df.schema)
    times = dm.per_model(never, lambda models: dm.meeting_times(models, [0.0, 0.5, math.inf]), "m int, t double").orderBy("m").collect()
    assert times[0].t is None and times[1].t == pytest.approx(2.0)


def test_mixed_over_models(spark):
    """The sample of all as states of one interval give it, for models of unlike pieces."""
    df = spark.createDataFrame([(f"m{i}", float(t), float(a)) for i, m in enumerate(MANY) for t, a in zip(m.t, m.a)], "model_id string, t0 double, size double")
    got = {(r.model_id, r.k): r.length for r in cs.mixed_over_models(df, [0.0, 0.2, 0.7, 1.5, math.inf], 3).collect()}
    assert len(got) == 4 * 4
    for i, model in enumerate(MANY):
        np.testing.assert_allclose([got[f"m{i}", k] for k in range(1, 5)], cs.marginal(cs.spectra(model, [0.0, math.inf], 3)[0]), rtol=1e-8)


def test_conditioned_spectra_in_one_pass(spark, tmp_path):
    """Rows of no user are a contig like others, and the table is read once, whose spectra meet no join."""
    import duckdb

    from spanlake.plans import scans

    c = duckdb.connect()
    c.execute("CREATE TABLE events AS SELECT * REPLACE (CASE WHEN user_id % 5 > 0 THEN user_id END AS user_id) FROM '/root/testdata/sf0.001/events.parquet'")
    c.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    got, want = scans.QUERIES["conditioned_spectra"](spark, str(tmp_path)), c.execute(scans.SQL["conditioned_spectra"]).fetchall()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert sum(r[0] is None for r in want) == 2
    assert plan.count("FileScan") == 1 and "Join" not in plan
