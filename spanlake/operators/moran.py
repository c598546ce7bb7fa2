"""Rate matrices of the Moran model and their eigensystems, exact where they are rational.

State i of n lineages: i carry the derived allele. A pair of lineages is replaced at rate 1, so i goes up or down at
i (n - i) / 2. With a distinguished pair of which d carry it, its lineages replace others too: up by d (n - i) and down by
(2 - d) i more."""

from __future__ import annotations

from fractions import Fraction

import numpy as np


def rates(n: int, pair: int | None = None, of: int = 2) -> list[list[Fraction]]:
    """``pair`` of the ``of`` distinguished lineages carry the allele; None: there are no distinguished lineages."""
    out = [[Fraction(0)] * (n + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        both = Fraction(i * (n - i), 2)
        if i < n:
            out[i][i + 1] = both + (pair or 0) * (n - i)
        if i:
            out[i][i - 1] = both + ((of - pair) * i if pair is not None else 0)
        out[i][i] = -sum(out[i])
    return out


def eigenvalues(n: int, pair: int | None = None) -> list[Fraction]:
    """Known in closed form: those of the coalescent's numbers of lineages, from the largest."""
    if pair is None:
        return [Fraction(-k * (k - 1), 2) for k in range(n + 1)]
    return [Fraction(1 - k * (k - 1) // 2) for k in range(2, n + 3)]


def _kernel(rows: list[list[Fraction]]) -> list[list[Fraction]]:
    """A basis of the vectors that a matrix sends to 0, by elimination."""
    a, lead, at = [list(r) for r in rows], [], 0
    width = len(a[0])
    for c in range(width):
        pivot = next((r for r in range(at, len(a)) if a[r][c]), None)
        if pivot is None:
            continue
        a[at], a[pivot] = a[pivot], a[at]
        a[at] = [x / a[at][c] for x in a[at]]
        for r in range(len(a)):
            if r != at and a[r][c]:
                f = a[r][c]
                a[r] = [x - f * y for x, y in zip(a[r], a[at], strict=True)]
        lead.append(c)
        at += 1
    out = []
    for c in (c for c in range(width) if c not in lead):
        v = [Fraction(0)] * width
        v[c] = Fraction(1)
        for r, p in enumerate(lead):
            v[p] = -a[r][c]
        out.append(v)
    return out


def eigensystem(n: int, pair: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues, vectors as columns, and their inverse; vectors are exact before they are rounded."""
    m, values, columns = rates(n, pair), [], []
    for value in sorted(set(eigenvalues(n, pair)), reverse=True):
        shifted = [[x - value * (i == j) for j, x in enumerate(row)] for i, row in enumerate(m)]
        for v in _kernel(shifted):
            values.append(float(value))
            columns.append([float(x) for x in v])
    u = np.array(columns).T
    return np.array(values), u, np.linalg.inv(u)


def after(n: int, t: float, pair: int | None = None) -> np.ndarray:
    """Transition probabilities after time t."""
    d, u, inverse = eigensystem(n, pair)
    return (u * np.exp(d * t)) @ inverse


def grown(q: np.ndarray, t: float | np.ndarray) -> np.ndarray:
    """exp(q t) of a matrix with no negative number off its diagonal, for one t or each of an array: a sum of positive terms
    over a short time, squared."""
    top, times = float(-q.diagonal().min()) or 1.0, np.atleast_1d(np.asarray(t, float))
    halves = np.maximum(0, np.ceil(np.log2(np.maximum(top * times, 1e-300)))).astype(int)
    x, step = top * times / 2.0**halves, np.eye(len(q)) + q / top
    power, weight, out = np.eye(len(q)), np.exp(-x), np.zeros((*times.shape, *q.shape))
    for k in range(1, 25):
        out += weight[:, None, None] * power
        power, weight = power @ step, weight * x / k
    for h in range(halves.max(initial=0)):
        on = halves > h
        out[on] = out[on] @ out[on]
    return out.reshape(*np.shape(t), *q.shape)
