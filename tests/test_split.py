"""Split times and rates that were planted come back; parts of a model are made only when they must be."""

import json
import math

import numpy as np
import pytest

from spanlake import __main__ as commands
from spanlake.operators import conditioned as cs
from spanlake.operators import demography as dm
from spanlake.operators import hmm, joint, split

ONE = dm.Steps(np.array([0.0, 0.4, 1.0]), np.array([1.0, 0.5, 1.5]))
TWO = dm.Steps(np.array([0.0, 0.3, 2.0]), np.array([0.7, 2.0, 1.0]))
KEYS2 = "contig_id string, seq bigint, span bigint, a1 int, b1 int, nb1 int, a2 int, b2 int, nb2 int"


def planted(spark, kind, at, n=(3, 3), theta=0.01, bases=10_000_000):
    """Rows that show each full key as often as it is expected."""
    table = cs.with_mutation(joint.spectra(ONE, TWO, at, split.EVER, n, kind), theta)[0]
    whole = tuple(x - 1 for x in table.shape)
    rows = [(at4[0], at4[1], n[0], at4[2], at4[3], n[1], round(bases * float(table[at4]))) for at4 in np.ndindex(*table.shape) if at4 != whole]
    return spark.createDataFrame([(f"c{i % 3}", i, r[-1], *map(int, r[:-1])) for i, r in enumerate(rows) if r[-1]], KEYS2)


@pytest.mark.parametrize("kind", [split.TOGETHER, split.APART])
@pytest.mark.parametrize("scale", [True, False])
def test_planted_split(spark, kind, scale):
    rows = planted(spark, kind, 0.35)
    found = split.fit([split.counted(rows, kind)], ONE, TWO, 0.01, 1.5, error=0.0, scale=scale)
    assert abs(found.split - 0.35) < 0.02 and abs(found.scale - 1) < 0.03


def test_profile_table(spark):
    rows, at = planted(spark, split.APART, 0.5), [0.2, 0.5, 0.9]
    got = {}
    for r in split.profile_table(rows, split.APART, ONE, TWO, 0.01, at, (3, 3), 0.0).collect():
        got[r.split] = got.get(r.split, 0) + r.loglik
    want = {t: split.counted(rows, split.APART).loglik(ONE, TWO, t, 0.01, 0.0) for t in at}
    assert max(got, key=got.get) == 0.5
    np.testing.assert_allclose([got[t] for t in at], [want[t] for t in at], rtol=1e-12)


def test_rows_of_one_population_alone_are_refused():
    with pytest.raises(ValueError):
        split.fit([split.Counted(split.SECOND, {(0, 0, 3): 10})], ONE, TWO, 0.01, 1.0)


def test_split_and_posterior_commands(spark, tmp_path):
    rows = planted(spark, split.APART, 0.35, bases=200_000)
    rows.write.parquet(f"{tmp_path}/rows")
    for name, m in (("one", ONE), ("two", TWO)):
        line = json.dumps({"theta": 0.01, "rho": 0.01, "hidden_states": [0, 0.5, 1.0, "inf"], "model": {"class": "steps", "N0": 1e4, "knots": m.t.tolist(), "y": np.log(m.a).tolist()}})
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{tmp_path}/{name}")
    commands.main(["split", f"{tmp_path}/rows", f"{tmp_path}/out", f"{tmp_path}/one", f"{tmp_path}/two", "--max-split", "1.5", "--polarization-error", "0"], spark)
    model, _, got = commands._load(spark, f"{tmp_path}/out")
    assert abs(model[2] - 0.35) < 0.15 * 0.35 and got["model"]["class"] == "two"
    np.testing.assert_allclose(model[1].t, TWO.t)
    assert spark.read.parquet(f"{tmp_path}/out-rounds").count() > 3
    commands.main(["posterior", f"{tmp_path}/rows", f"{tmp_path}/post", f"{tmp_path}/out"], spark)
    gamma = [r.gamma for r in spark.read.parquet(f"{tmp_path}/post").collect()]
    assert len(gamma) == rows.count() and all(abs(sum(g) - 1) < 1e-9 for g in gamma)


def test_planted_theta_and_alpha_come_back(spark):
    """Bases drawn from the chain itself; the start is 5 times off."""
    states, rng = [0.0, 0.5, 1.2, math.inf], np.random.default_rng(2)
    keys = [(a, b, 2) for a in range(3) for b in range(3) if (a, b) != (2, 2)] + [(0, 0, 0), (1, 0, 0)]
    for name, theta, alpha in (("theta", 0.05, 1.0), ("alpha", 0.05, 3.0)):
        model = cs.sample_model(ONE, states, theta, 0.01, keys, 2, alpha=alpha)
        pool = keys[:-2] if name == "theta" else keys[-2:]
        rows, z = [], rng.choice(3, p=model.pi)
        weights = np.array([model.emission[k] for k in pool])
        weights = weights / weights.sum(0)
        for i in range(30_000):
            rows.append((f"c{i // 10_000}", i, 1, *pool[rng.choice(len(pool), p=weights[:, z])]))
            z = rng.choice(3, p=model.transition[z])
        df = spark.createDataFrame(rows, "contig_id string, seq bigint, span int, a1 int, b1 int, nb1 int")
        fit = dm.Fit(np.log(ONE.a), theta / 5 if name == "theta" else theta, 0.01, [], alpha=alpha / 5 if name == "alpha" else 1.0)
        made = {}
        hold = lambda y: ONE  # noqa: E731  # sizes are held: only the rate is learned
        parts = lambda s, k: cs.sample_parts(s, k, 2)
        dm.estimate(df, [0.0, 0.4, 1.0], states, fit.theta, 0.01, rounds=10, start=fit, learn=(name,), curve=hold, parts=parts, on=lambda m, s: made.update(s["made"]))
        got, want = getattr(fit, name), {"theta": theta, "alpha": alpha}[name]
        assert abs(got / want - 1) < 0.15, (name, got)
        assert made["spectra"] <= 1 and made["pi"] == made["transition"] == 1 and made["emission"] > 10
    with pytest.raises(ValueError):
        dm.estimate(df, [0.0], states, 0.1, 0.1, learn=("split",))


def test_parts_are_made_when_an_input_changes():
    keys = [(0, 0, 2), (1, 1, 2), (-1, 0, 0), (1, 0, 0)]
    states = [0.0, 0.5, math.inf]
    parts = cs.sample_parts(states, keys)
    for theta, rho, a in ((0.01, 0.01, 1.0), (0.01, 0.02, 1.0), (0.02, 0.02, 1.0), (0.02, 0.02, 1.0), (0.02, 0.02, 2.0)):
        model = dm.Steps(np.zeros(1), np.array([a]))
        got, want = parts.at(model, theta, rho, 1.0).hidden(), cs.sample_model(model, states, theta, rho, keys)
        np.testing.assert_allclose(got.pi, want.pi)
        np.testing.assert_allclose(got.transition, want.transition)
        for k in keys:
            np.testing.assert_allclose(got.emission[k], want.emission[k])
    assert parts.made == {"pi": 2, "transition": 3, "pair": 3, "spectra": 2, "table": 3, "emission": 3}


def test_expectation_is_that_of_the_statistics():
    rng, keys = np.random.default_rng(0), [(0, 0, 0), (1, 0, 0)]
    model = dm.pair_model(ONE, [0.0, 0.5, math.inf], 0.1, 0.1, keys)
    stats = [{"kind": "first", "key": "", "i": i, "j": 0, "value": rng.random()} for i in range(2)] + [{"kind": "xi", "key": "", "i": i, "j": j, "value": rng.random()} for i in range(2) for j in range(2)]
    stats += [{"kind": "gamma", "key": ",".join(map(str, k)), "i": i, "j": 0, "value": rng.random()} for k in keys for i in range(2)]
    np.testing.assert_allclose(dm.Expectation(stats, 2)(model), hmm.expectation(model.pi, model.transition, model.emission, stats))


def test_transition_against_a_numerical_integral():
    """The chain of the next base (as this one, floating, met elsewhere) in small steps of time, and the definition of the rows."""
    model, states, rho = dm.Steps(np.array([0.0, 0.4, 1.0]), np.array([1.0, 0.3, 2.0])), [0.0, 0.25, 0.7, 1.5, math.inf], 0.4

    def at(t, steps=4000):
        p, h = np.array([1.0, 0.0, 0.0]), t / steps
        for i in range(steps):
            def f(x, u):
                eta = 1 / model.a[np.searchsorted(model.t, u, "right") - 1]
                return x @ np.array([[-rho, rho, 0], [eta, -2 * eta, eta], [0, 0, 0]])
            u = i * h
            a = f(p, u); b = f(p + h / 2 * a, u + h / 2); c = f(p + h / 2 * b, u + h / 2); d = f(p + h * c, u + h * (1 - 1e-9))  # noqa: E702
            p = p + h / 6 * (a + 2 * b + 2 * c + d)
        return p

    got = dm.transition(model, states, rho, mix=0.0)
    grid = np.linspace(0, 60, 600_001)
    density = np.array([math.exp(-model.hazard(0))])
    size = model.a[np.searchsorted(model.t, grid, "right") - 1]
    hazard = np.r_[0, np.cumsum(np.diff(grid) / size[:-1])]
    density = np.exp(-hazard) / size
    met = [at(h)[2] if not math.isinf(h) else 1.0 for h in states]
    for j in range(4):
        inside = (grid >= states[j]) & (grid < states[j + 1])
        mean = (grid * density)[inside].sum() / density[inside].sum()
        want = np.zeros(4)
        for k in range(j):
            want[k] = met[k + 1] - met[k]
        for k in range(j + 1, 4):
            low, high = (math.exp(-model.hazard(x) + model.hazard(mean)) if not math.isinf(x) else 0.0 for x in (states[k], states[k + 1]))
            want[k] = at(mean)[1] * (low - high)
        want[j] = 1 - want.sum()
        np.testing.assert_allclose(got[j], want, rtol=2e-3, atol=1e-5)
