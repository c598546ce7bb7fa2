"""Joint spectra of two populations that split, and hidden Markov models of two-population keys.

Before the split (towards the present) the populations are apart, the first of the sizes of one model, the second of
another; beyond it there is one population, which goes on with the first model. The distinguished pair is in the first
population, or has one lineage in each.

What lies beyond the split is a conditioned spectrum of all samples as if they were taken at the split. Derived copies
there are dealt to the two populations (a hypergeometric draw), and in each they move on by a Moran chain whose
distinguished lineages keep what they carry. Where the pair meets before the split, its chain is one of n + 1 lineages down to
the meeting and of n beside a pair below it; the integral over the time of meeting is a block of one matrix exponential.
What lies before the split are the spectra of each population up to then."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import conditioned, moran
from . import demography as dm
from . import hmm


@lru_cache(maxsize=256)
def _rates(n: int, derived: int | None, of: int) -> np.ndarray:
    return np.array(moran.rates(n, derived, of), float)


def _down(n: int, derived: int, of: int, hazard: np.ndarray) -> np.ndarray:
    return moran.grown(_rates(n, derived, of), hazard)


def later(model: dm.Steps, t: float) -> dm.Steps:
    """The model from a time on, as times since then."""
    k = int(np.searchsorted(model.t, t, "right"))
    return dm.Steps(np.r_[0.0, model.t[k:] - t], model.a[k - 1 :])


def spliced(recent: dm.Steps, old: dm.Steps, t: float) -> dm.Steps:
    """One model up to a time, another from then on."""
    if t <= 0:
        return old
    tail = later(old, t)
    return dm.Steps(np.r_[recent.t[recent.t < t], tail.t + t], np.r_[recent.a[recent.t < t], tail.a])


#: Size of a population in which nobody meets.
NEVER = math.inf


def apart(model: dm.Steps, split: float) -> dm.Steps:
    """The model of a pair that cannot meet before the split."""
    return spliced(dm.Steps(np.zeros(1), np.array([NEVER])), model, split)


@lru_cache(maxsize=256)
def _dealt(n1: int, n2: int) -> np.ndarray:
    """Probability that of i + j derived copies among n1 + n2, i fall to the first n1: (i, j)."""
    c = conditioned._Binomials(n1 + n2)
    i, j = np.arange(n1 + 1)[:, None], np.arange(n2 + 1)[None, :]
    return np.exp(c(np.array(n1), i) + c(np.array(n2), j) - c(np.array(n1 + n2), i + j))


def _later(models: dm.Many, t: np.ndarray) -> dm.Many:
    """later() of many models: pieces before that time keep no length."""
    return dm.Many(np.maximum(models.t - t, 0.0), models.a)


def _shared(lengths: np.ndarray, n1: int, n2: int) -> np.ndarray:
    """Lengths (0 to n1 + n2, model) by number of copies, as lengths (model, i, j) by copies in each part."""
    return np.moveaxis(lengths[np.arange(n1 + 1)[:, None] + np.arange(n2 + 1)[None, :]], -1, 0) * _dealt(n1, n2)


def _across(one: np.ndarray, lengths: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Lengths of each model moved on in both populations, with the model as the last axis."""
    return np.moveaxis(np.swapaxes(one, 1, 2) @ lengths @ two, 0, -1)


def _plain(models: dm.Many, n: int, until: np.ndarray | None = None) -> np.ndarray:
    out = np.zeros((n + 1, len(models)))
    if n == 1 and until is not None:
        out[1] = until
    elif n > 1:
        found = conditioned.spectra_of(models, [0.0, math.inf], n - 2, math.inf if until is None else until)[0]
        for d in range(3):
            out[d : d + n - 1] += found[d]
        out[0] = 0.0
        if until is None:
            out[n] = 0.0
    return out


def plain(model: dm.Steps, n: int, until: float = math.inf) -> np.ndarray:
    """Branch lengths above 0..n of n samples up to a time; without a limit not those above all of them."""
    return _plain(dm.Many.of([model]), n, None if math.isinf(until) else np.array([until]))[:, 0]


def _met_above(models: dm.Many, split: np.ndarray, low: np.ndarray, high: np.ndarray, n1: int, n2: int, two: np.ndarray) -> np.ndarray:
    """(pair, others of 1, others of 2, model), given that a pair of the first population meets in [low, high) beyond the split;
    ``two`` moves the second population on from the split."""
    top = conditioned.spectra_of(_later(models, split), [low - split, high - split], n1 + n2)[0]
    hazard = models.hazard(split)
    out = np.stack([_across(_down(n1, d, 2, hazard), _shared(top[d], n1, n2), two) for d in range(3)])
    out[:, :, 0] += conditioned.spectra_of(models, [split, math.inf], n1, split)[0]
    return out


def _met_below(models: dm.Many, split: np.ndarray, low: np.ndarray, high: np.ndarray, n1: int, n2: int, two: np.ndarray, top: np.ndarray) -> np.ndarray:
    """The same where the pair meets before the split; ``top``: lengths beyond it of n1 + 1 samples and n2."""
    out = np.zeros((3, n1 + 1, n2 + 1, len(models)))
    out[:, :, 0] = conditioned.spectra_of(models, [low, high], n1, split)[0]
    r1, r2 = models.hazard(low), models.hazard(high)
    joined, share = _rates(n1 + 1, None, 2), np.arange(n1 + 2) / (n1 + 1)
    above = moran.grown(joined, models.hazard(split) - r2)
    for d, keep in ((0, np.eye(n1 + 2)[:, : n1 + 1] * (1 - share)[:, None]), (2, np.eye(n1 + 2)[:, 1:] * share[:, None])):
        beside = _rates(n1, d, 2)
        both = np.block([[joined, keep], [np.zeros((n1 + 1, n1 + 2)), beside - np.eye(n1 + 1)]])
        meeting = moran.grown(both, r2 - r1)[:, : n1 + 2, n1 + 2 :] / -np.expm1(r1 - r2)[:, None, None]
        out[d] += _across(above @ meeting @ moran.grown(beside, r1), top, two)
    return out


def _pair_in_one(model1: dm.Many, model2: dm.Many, split: np.ndarray, states: list[float], n1: int, n2: int) -> np.ndarray:
    out = np.zeros((len(states) - 1, 3, n1 + 1, 1, n2 + 1, len(model1)))
    two = moran.grown(_rates(n2, None, 2), model2.hazard(split))
    top = _shared(_plain(_later(model1, split), n1 + n2 + 1), n1 + 1, n2)
    alone = _plain(model2, n2, split)
    for i, (low, high) in enumerate(zip(states, states[1:], strict=False)):
        cut = np.minimum(np.maximum(split, low), high)
        s = [np.exp(-model1.hazard(x)) for x in (low, cut, high)]
        below, above = np.flatnonzero((low < split) & (s[0] > s[1])), np.flatnonzero((high > split) & (s[1] > s[2]))
        if len(below):
            share = ((s[0] - s[1]) / np.where(s[0] > s[2], s[0] - s[2], 1.0))[below]
            here = split[below]
            out[i, :, :, 0][..., below] += share * _met_below(model1.pick(below), here, np.full(len(below), low), np.minimum(high, here), n1, n2, two[below], top[below])
        if len(above):
            share = ((s[1] - s[2]) / np.where(s[0] > s[2], s[0] - s[2], 1.0))[above]
            here = split[above]
            out[i, :, :, 0][..., above] += share * _met_above(model1.pick(above), here, np.maximum(low, here), np.full(len(above), high), n1, n2, two[above])
        out[i, 0, 0, 0] += alone * (s[0] > s[2])
    return out


def _pair_apart(model1: dm.Many, model2: dm.Many, split: np.ndarray, states: list[float], n1: int, n2: int) -> np.ndarray:
    out = np.zeros((len(states) - 1, 2, n1 + 1, 2, n2 + 1, len(model1)))
    ones = [[_down(size, d, 1, model.hazard(split)) for d in (0, 1)] for size, model in ((n1, model1), (n2, model2))]
    alone = [_plain(model, size + 1, split) for size, model in ((n1, model1), (n2, model2))]
    for i, (low, high) in enumerate(zip(states, states[1:], strict=False)):
        top = conditioned.spectra_of(_later(model1, split), [np.maximum(low - split, 0.0), np.maximum(high - split, 0.0)], n1 + n2)[0]
        able = (high > split) & (top.any((0, 1)) if n1 + n2 else True)
        for d1, d2 in product((0, 1), repeat=2):
            out[i, d1, :, d2] += able * _across(ones[0][d1], _shared(top[d1 + d2] / (2 if d1 != d2 else 1), n1, n2), ones[1][d2])
        for k in range(1, n1 + 2):
            with_ = able * alone[0][k] * k / (n1 + 1)
            out[i, 1, k - 1, 0, 0] += with_
            out[i, 0, min(k, n1), 0, 0] += able * alone[0][k] - with_
        for k in range(1, n2 + 2):
            with_ = able * alone[1][k] * k / (n2 + 1)
            out[i, 0, 0, 1, k - 1] += with_
            out[i, 0, 0, 0, min(k, n2)] += able * alone[1][k] - with_
    return out


def spectra_of(model1: dm.Many, model2: dm.Many, split: float | np.ndarray, states: list[float], n: tuple[int, int], na: tuple[int, int] = (2, 0)) -> np.ndarray:
    """spectra() of many pairs of models at once, with the pair of models as the last axis; the split may be one for all or one for each."""
    if na not in ((2, 0), (1, 1)):
        raise ValueError("the pair is in the first population, or has one lineage in each")
    split = np.broadcast_to(np.asarray(split, float), len(model1))
    out = (_pair_in_one if na == (2, 0) else _pair_apart)(model1, model2, split, states, *n)
    out[:, 0, 0, 0, 0] = out[:, -1, -1, -1, -1] = 0.0
    return out


def spectra(model1: dm.Steps, model2: dm.Steps, split: float, states: list[float], n: tuple[int, int], na: tuple[int, int] = (2, 0)) -> np.ndarray:
    """Expected branch lengths (state, of the pair in 1, of n1, of the pair in 2, of n2) given the state in which the pair meets;
    zeros where it cannot. ``na``: lineages of the pair in each population, (2, 0) or (1, 1)."""
    return spectra_of(dm.Many.of([model1]), dm.Many.of([model2]), split, states, n, na)[..., 0]


def bins(key: hmm.Key, n: tuple[int, int], na: tuple[int, int], error: float = 0.5) -> dict[tuple[int, ...], float]:
    """Full observations (of the pair in 1, of n1, of the pair in 2, of n2) that a key of six numbers may stand for, and their
    weights, as conditioned.bins does it for one population."""
    sides = []
    for p in range(2):
        d, u, seen = key[3 * p : 3 * p + 3]
        sides.append([((a, full), math.comb(full, u) * math.comb(n[p] - full, seen - u) / math.comb(n[p], seen)) for a in ([d] if d >= 0 else range(na[p] + 1)) for full in range(u, n[p] - seen + u + 1)])
    whole, mix = (na[0], n[0], na[1], n[1]), {}
    for (one, w1), (two, w2) in product(*sides):
        at = one + two if one + two != whole else (0, 0, 0, 0)
        for to, w in ((at, 1 - error), (tuple(x - y for x, y in zip(whole, at, strict=True)), error)):
            if to != whole:
                mix[to] = mix.get(to, 0.0) + w * w1 * w2
    total = sum(mix.values())
    if total <= 0:
        raise ValueError(f"no observation fits {key}")
    return {k: w / total for k, w in mix.items() if w > 0}


@lru_cache(maxsize=64)
def _held(one: tuple, two: tuple, split: float, states: tuple[float, ...], n: tuple[int, int], na: tuple[int, int]) -> np.ndarray:
    return spectra(dm.Steps(*map(np.array, one)), dm.Steps(*map(np.array, two)), split, list(states), n, na)


def _values(model: dm.Steps) -> tuple:
    return tuple(model.t.tolist()), tuple(model.a.tolist())


def emissions(model1: dm.Steps, model2: dm.Steps, split: float, states: list[float], theta: float, keys: list[hmm.Key], n: tuple[int, int], na: tuple[int, int] = (2, 0), error: float = 0.5, alpha: float = 1.0) -> dict[hmm.Key, np.ndarray]:
    """Probabilities of each key of six numbers by state."""
    pair = dm.pair_emission(model1 if na == (2, 0) else apart(model1, split), states, theta, alpha)
    table, out = None, {}
    for key in keys:
        a = [key[3 * p] for p in range(2) if na[p]]
        if key[2] == key[5] == 0 and all(x < 0 for x in a):
            out[key] = np.ones(len(states) - 1)
        elif key[2] == key[5] == 0 and all(x >= 0 for x in a):
            out[key] = pair[sum(a) % 2]
        else:
            if table is None:
                table = conditioned.with_mutation(_held(_values(model1), _values(model2), split, tuple(states), n, na), theta)
            out[key] = sum(w * table[(slice(None), *at)] for at, w in bins(key, n, na, error).items())
    return out


def model_of(model1: dm.Steps, model2: dm.Steps, split: float, states: list[float], theta: float, rho: float, keys: list[hmm.Key], na: tuple[int, int] = (2, 0), n: tuple[int, int] | None = None, error: float = 0.5, alpha: float = 1.0) -> hmm.Model:
    """The hidden Markov model of two-population spans; ``n`` by default the most that a key has of each population."""
    n = n or reduce(lambda x, k: (max(x[0], k[2]), max(x[1], k[5])), keys, (0, 0))
    met = model1 if na == (2, 0) else apart(model1, split)
    return hmm.Model(dm.initial(met, states), dm.transition(met, states, rho), emissions(model1, model2, split, states, theta, keys, n, na, error, alpha))


def over_models(pieces: DataFrame, states: list[float], n: tuple[int, int], na: tuple[int, int] = (2, 0)) -> DataFrame:
    """model_id, m, a1, b1, a2, b2, length of every pair of models of a table (model_id, population 1 or 2, t0, size, split)."""
    row = F.struct(F.col("t0").cast("double").alias("t0"), F.col("size").cast("double").alias("size"))
    t1, a1, t2, a2 = dm.piece_lists(*[F.when(F.col("population") == p, row) for p in (1, 2)])
    table = pieces.groupBy("model_id").agg(t1.alias("t1"), a1.alias("a1"), t2.alias("t2"), a2.alias("a2"), F.first("split").cast("double").alias("split"))
    run = lambda one, two, split: spectra_of(one, two, split, states, n, na)
    return dm.many_rows(table, run, "m int, a1 int, b1 int, a2 int, b2 int, length double", 2, conditioned.together(n[0] + n[1] + 1))


def key_table(keys: DataFrame, model1: dm.Steps, model2: dm.Steps, split: float, states: list[float], theta: float, n: tuple[int, int], na: tuple[int, int] = (2, 0), error: float = 0.5) -> DataFrame:
    """Probability p of each distinct key of a table in each state m."""
    columns = hmm.key_columns(keys)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known = [tuple(r) for r in pdf.to_numpy(int).tolist()]
            found = emissions(model1, model2, split, states, theta, known, n, na, error)
            yield pd.DataFrame([(*k, m, float(p)) for k in known for m, p in enumerate(found[k])], columns=[*columns, "m", "p"])

    distinct = keys.select(*[F.col(c).cast("int").alias(c) for c in columns]).distinct()
    return distinct.mapInPandas(look, ", ".join(f"{c} int" for c in columns) + ", m int, p double")
