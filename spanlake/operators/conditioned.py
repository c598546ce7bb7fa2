"""Conditioned spectra of a distinguished pair among n other samples, and emissions of observation keys.

Until the pair meets, a sample of n + 2 is a coalescent in which the pair may not merge. All of its ranked histories are
equally likely, so a partition of the sample into blocks weighs as the product of the factorials of the block sizes, and
expected numbers of blocks of each kind are quotients of binomials. Once the pair has met, the same holds for the blocks
at that moment with the pair's block as one. Only the expected time spent at each number of blocks depends on the model.
It follows a chain that steps down through (blocks before the meeting) and (blocks at the meeting, blocks since), which
is moved by uniformisation: sums of positive terms, stable at every n."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import demography as dm
from . import hmm


#: In units of the slowest rate.
FAR = 50.0


class _Binomials:
    """Logarithms of binomials up to ``most``; minus infinity outside their range."""

    def __init__(self, most: int) -> None:
        self.logs = np.array([math.lgamma(i + 1) for i in range(most + 1)])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = np.broadcast_arrays(a, b)
        fine = (b >= 0) & (a >= b)
        x, y = np.where(fine, a, 0), np.where(fine, b, 0)
        return np.where(fine, self.logs[x] - self.logs[y] - self.logs[x - y], -np.inf)


@lru_cache(maxsize=8)
def shapes(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Expected blocks by number b of other samples in them. ``o`` counts the blocks beside the pair's two: single (o, b)
    with one of the pair and others (o, b) with none, before the meeting; others (o, k, b) and joint (o, k, b) with both,
    when o + 1 blocks at the meeting have become k + 1."""
    c = _Binomials(n + 6)
    o, b = np.arange(n + 1)[:, None], np.arange(n + 1)[None, :]
    whole = c(n + 3, o + 3)
    single = 2 * (b + 1) * np.exp(c(n - b + 1, o + 1) - whole)
    apart = np.where(b > 0, o * np.exp(c(n - b + 3, o + 2) - whole), 0)
    late, joint = np.zeros((n + 1, n + 1, n + 1)), np.zeros((n + 1, n + 1, n + 1))
    for p in range(1, n + 1):
        k, i, to = np.arange(2, p + 2)[:, None], np.arange(p + 1)[None, :], np.arange(p + 1)[:, None]
        total = c(p + 1, k)
        merged = np.where(i > 0, (k - 1) * np.exp(c(p - i + 1, k - 1) - total), 0)
        special = (i + 1) * np.exp(c(p - i - 1, k - 2) - total)
        held = np.where(to > 0, np.exp(c(b - 1, to - 1) + c(n - b + 3, p - to + 3) - c(n + 3, p + 3)), 0)
        both = np.exp(c(b + 3, to + 3) + c(n - b - 1, p - to - 1) - c(n + 3, p + 3))
        late[p, 1 : p + 1], joint[p, 1 : p + 1] = merged @ held, special @ both
    return single, apart, late, joint


class _Chain:
    """Masses of many models, an array (n + 3, n + 1, model). Rows 0 and 1 are of the blocks before the meeting: p, where the
    meeting is left out, and y, where it happens at rate 1; then g by (blocks at the meeting, blocks since)."""

    def __init__(self, n: int) -> None:
        o = np.arange(n + 1)
        self.n, self.before, self.after = n, (o + 2) * (o + 1) / 2 - 1, (o + 1) * o / 2
        self.most = (n + 2) * (n + 1) / 2
        leave = np.vstack([self.before, self.before + 1, np.tile(self.after, (n + 1, 1))])
        self.stay = (1 - leave / self.most)[:, :, None]
        self.fall = np.vstack([self.before, self.before, np.tile(self.after, (n + 1, 1))])[:, 1:, None] / self.most

    def none(self, models: int) -> np.ndarray:
        return np.zeros((self.n + 3, self.n + 1, models))

    def step(self, masses: np.ndarray) -> np.ndarray:
        """One jump of the uniformised chain."""
        out, o = masses * self.stay, np.arange(self.n + 1)
        out[:, :-1] += masses[:, 1:] * self.fall
        out[o + 2, o] += masses[1] / self.most
        return out

    def move(self, masses: np.ndarray, du: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Masses after each model's du, and their integrals over it. After FAR all that moves has moved, to one part in e**FAR."""
        near = np.minimum(du, FAR)
        parts = np.ceil(self.most * near / 32).astype(int)
        ends, totals = masses.copy(), np.zeros_like(masses)
        for part in range(parts.max(initial=0)):
            on = np.flatnonzero(parts > part)
            now, rate = ends[:, :, on], self.most * near[on] / parts[on]
            end, total = np.zeros_like(now), np.zeros_like(now)
            weights, top = [np.exp(-rate)], rate.max()
            while len(weights) < int(top + 12 * math.sqrt(top) + 30) and (len(weights) < 2 * top + self.n or weights[-1].max() > 1e-25):
                weights.append(weights[-1] * rate / len(weights))
            tails = np.cumsum(weights[:0:-1], 0)[::-1]  # what follows each jump, from the smallest on: short times keep their digits
            for weight, tail in zip(weights, [*tails, 0.0], strict=True):
                end += weight * now
                total += tail / self.most * now
                now = self.step(now)
            ends[:, :, on] = end
            totals[:, :, on] += total
        return ends, totals + np.maximum(du - FAR, 0.0) * ends

    def rest(self, y: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Integrals of y and g from here to infinity; g over at least two blocks."""
        ty, tg, g = np.zeros_like(y), np.zeros_like(g), g.copy()
        inflow = 0.0
        for o in range(self.n, -1, -1):
            ty[o] = (y[o] + inflow) / (self.before[o] + 1)
            inflow = ty[o] * self.before[o]
        o = np.arange(self.n + 1)
        g[o, o] += ty
        flow = np.zeros_like(y)
        for k in range(self.n, 0, -1):
            tg[:, k] = (g[:, k] + flow) / self.after[k]
            flow = tg[:, k] * self.after[k]
        return ty, tg


def spectra_of(models: dm.Many, states: list[float | np.ndarray], n: int, until: float | np.ndarray = math.inf) -> np.ndarray:
    """spectra() of many models at once, with the model as the last axis; states and ``until`` may be arrays of a number a model."""
    single, apart, late, joint = shapes(n)
    chain, m, count = _Chain(n), len(states) - 1, len(models)
    states, until = [np.broadcast_to(np.asarray(s, float), count) for s in states], np.broadcast_to(np.asarray(until, float), count)
    cuts = np.sort(np.vstack([models.t, *states, until]), axis=0)
    pieces = [(a, b, models.size(a)) for a, b in zip(cuts, cuts[1:], strict=False)]
    out = np.zeros((m, 3, n + 1, count))
    masses, seen = chain.none(count), np.zeros((n + 1, count))  # seen: time at each number of blocks up to the start of the state
    masses[0, n] = 1.0
    for a, b, size in pieces:
        on = (b <= np.minimum(states[0], until)) & (a < b) & np.isfinite(b)
        if on.any():
            masses, t = chain.move(masses, np.subtract(b, a, out=np.zeros(count), where=on) / size)
            seen = seen + t[0] * size
    for i, (low, high) in enumerate(zip(states, states[1:], strict=False)):
        first = models.hazard(low)
        ends = np.subtract(models.hazard(high), first, out=np.zeros(count), where=np.isfinite(first))
        met, left = -np.expm1(-ends), np.exp(-ends)
        able = met > 0
        met = np.where(able, met, 1.0)
        before, since = seen.copy(), np.zeros((n + 1, n + 1, count))
        masses[1], masses[2:] = masses[0] / met, 0.0
        for a, b, s in pieces:
            on = able & (b > low) & (a < until) & (a < b)
            if not on.any():
                continue
            inside, near, far = a < high, on & np.isfinite(b), np.flatnonzero(on & np.isinf(b))
            if near.any():
                start = masses.copy()
                start[:2] *= inside
                end, t = chain.move(start, np.subtract(b, a, out=np.zeros(count), where=near) / s)
                since += t[2:] * s
                before += (t[1] - t[0] * left / met) * s
                seen += t[0] * s
                end[:2] = np.where(near & inside, end[:2], masses[:2])
                masses = end
            if len(far):
                ty, tg = chain.rest((masses[1] * inside)[:, far], masses[2:, :, far])
                before[:, far] += ty * s[far]
                since[:, :, far] += tg * s[far]
        flat = since.reshape(-1, count)
        out[i, 1] = single.T @ before
        out[i, 0] = apart.T @ before + late.reshape(-1, n + 1).T @ flat
        out[i, 2] = joint.reshape(-1, n + 1).T @ flat
        out[i, 2, n] += np.where(np.isfinite(until), since[:, 0].sum(0), 0.0)
        out[i] *= able
    return out


def spectra(model: dm.Steps, states: list[float], n: int, until: float = math.inf) -> np.ndarray:
    """Expected branch lengths (state, 0..2 of the pair, 0..n others) above which a mutation would be seen so, given that the
    pair meets in the state's interval. A state in which no meeting is possible has zeros. With ``until`` only what lies
    before that time counts, but of all samples' common ancestor too, up to then."""
    return spectra_of(dm.Many.of([model]), states, n, until)[..., 0]


def over_models(pieces: DataFrame, states: list[float], n: int) -> DataFrame:
    """model_id, m, a, b, length: the spectra of every model of a table."""
    return dm.per_model(pieces, lambda models: spectra_of(models, states, n), "m int, a int, b int, length double", together(n))


def mixed(models: dm.Many, states: list[float], n: int) -> np.ndarray:
    """The spectrum (k - 1, model) of all n + 2 samples of many models: those of the states, mixed by their probabilities."""
    return marginal(np.einsum("mx,mabx->abx", dm.initial(models, states), spectra_of(models, states, n)))


def mixed_over_models(pieces: DataFrame, states: list[float], n: int) -> DataFrame:
    """model_id, k, length: mixed() of every model of a table, in one pass over it."""
    rows = dm.per_model(pieces, lambda models: mixed(models, states, n), "k int, length double", together(n))
    return rows.withColumn("k", F.col("k") + 1)


def together(n: int) -> int:
    """Models whose masses are moved at once: some 4 MB of them, and 1024 at most."""
    return max(1, min(1024, (1 << 19) // ((n + 3) * (n + 1))))


@lru_cache(maxsize=64)
def _held(t: tuple[float, ...], a: tuple[float, ...], states: tuple[float, ...], n: int) -> np.ndarray:
    """spectra() of models seen lately: a change of rates alone does not make them anew."""
    return spectra(dm.Steps(np.array(t), np.array(a)), list(states), n)


def marginal(spectrum: np.ndarray, folded: bool = False) -> np.ndarray:
    """The spectrum of all n + 2 samples from that of one state, k = 1 on; folded: k with its complement. Models may be a last axis."""
    n = spectrum.shape[1] - 1
    out = np.zeros((n + 3, *spectrum.shape[2:]))
    for d in range(3):
        out[d : d + n + 1] += spectrum[d]
    if folded:
        out = np.array([out[k] + (out[n + 2 - k] if 2 * k != n + 2 else 0) for k in range((n + 2) // 2 + 1)])
        return out[1:]
    return out[1 : n + 2]


def with_mutation(spectrum: np.ndarray, theta: float, floor: float = 1e-10) -> np.ndarray:
    """Probabilities of what is seen at a base: one mutation falls on the branches in proportion to their lengths."""
    flat = spectrum.reshape(len(spectrum), -1)
    length = flat.sum(1, keepdims=True)
    p = flat * np.where(length > 0, -np.expm1(-theta * length) / np.where(length > 0, length, 1), 0)
    p[:, 0] = 1 - p.sum(1) + p[:, 0]
    return np.maximum(p, floor).reshape(spectrum.shape)


def bins(key: hmm.Key, n: int, error: float = 0.5) -> dict[tuple[int, int], float]:
    """Full observations (of the pair, of n others) that a key may stand for, and their weights. A missing pair may be any;
    others seen at nb of n samples are drawn without replacement; with the probability ``error`` the alleles are swapped.
    All derived is as none derived."""
    d, u, seen = key
    mix: dict[tuple[int, int], float] = {}
    for a in [d] if d >= 0 else range(3):
        for full in range(u, n - seen + u + 1):
            weight = math.comb(full, u) * math.comb(n - full, seen - u) / math.comb(n, seen)
            at = (0, 0) if (a, full) == (2, n) else (a, full)
            for to, w in ((at, 1 - error), ((2 - at[0], n - at[1]), error)):
                if to != (2, n):
                    mix[to] = mix.get(to, 0.0) + w * weight
    total = sum(mix.values())
    if total <= 0:
        raise ValueError(f"no observation fits {key}")
    return {k: w / total for k, w in mix.items() if w > 0}


def emissions(model: dm.Steps, states: list[float], theta: float, keys: list[hmm.Key], n: int, error: float = 0.5, alpha: float = 1.0) -> dict[hmm.Key, np.ndarray]:
    """Probabilities of each key by state: 1 if all is missing, the pair's parity if only it is seen, else from the spectra."""
    pair = dm.pair_emission(model, states, theta, alpha)
    if all(key[2] == 0 for key in keys):
        return {key: np.ones(len(states) - 1) if key[0] < 0 else pair[key[0] % 2] for key in keys}
    table = with_mutation(_held(tuple(model.t.tolist()), tuple(model.a.tolist()), tuple(states), n), theta)
    out = {}
    for key in keys:
        if key[2] == 0:
            out[key] = np.ones(len(states) - 1) if key[0] < 0 else pair[key[0] % 2]
        else:
            out[key] = sum(w * table[:, a, b] for (a, b), w in bins(key, n, error).items())
    return out


def sample_model(model: dm.Steps, states: list[float], theta: float, rho: float, keys: list[hmm.Key], n: int | None = None, error: float = 0.5, alpha: float = 1.0) -> hmm.Model:
    """The hidden Markov model of spans with n others (default: the most that a key has)."""
    n = max((k[2] for k in keys), default=0) if n is None else n
    return hmm.Model(dm.initial(model, states), dm.transition(model, states, rho), emissions(model, states, theta, keys, n, error, alpha))


def sample_parts(states: list[float], keys: list[hmm.Key], n: int | None = None, error: float = 0.5) -> dm.Parts:
    """Parts of the model of spans with n others: spectra are kept while only rates change, transitions while theta does."""
    n = max((k[2] for k in keys), default=0) if n is None else n
    mixes = {k: bins(k, n, error) for k in keys if k[2]}

    def emission(p: dm.Parts) -> dict[hmm.Key, np.ndarray]:
        pair = p.get("pair")
        table = p.get("table") if mixes else None
        return {k: sum(w * table[:, a, b] for (a, b), w in mixes[k].items()) if k in mixes else np.ones(len(states) - 1) if k[0] < 0 else pair[k[0] % 2] for k in keys}

    return dm.Parts(states, keys, {
        "pi": lambda p: dm.initial(p.model, states),
        "transition": lambda p: dm.transition(p.model, states, p.now["rho"]),
        "pair": lambda p: dm.pair_emission(p.model, states, p.now["theta"], p.now["alpha"]),
        "spectra": lambda p: spectra(p.model, states, n),
        "table": lambda p: with_mutation(p.get("spectra"), p.now["theta"]),
        "emission": emission,
    })
