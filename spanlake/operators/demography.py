"""Small numpy kernels of a step model, on the driver: hazard, meeting times, transitions, emissions, and an EM loop.

Sizes a_k on [t_k, t_{k+1}); the hazard is R(t), the integral of 1 / a."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hmm


@dataclass
class Steps:
    """A step model: start times (the first is 0) and sizes."""

    t: np.ndarray
    a: np.ndarray

    def hazard(self, x: float) -> float:
        if math.isinf(x):
            return math.inf
        ends = np.minimum(np.r_[self.t[1:], math.inf], x)
        return float(np.sum(np.maximum(ends - self.t, 0) / self.a))

    def inverse(self, y: float) -> float:
        at = np.array([self.hazard(t) for t in self.t])
        k = int(np.searchsorted(at, y, "right")) - 1
        return float(self.t[k] + (y - at[k]) * self.a[k])

    def survival(self, x: float, y: float, rate: float = 1.0) -> float:
        """Integral of exp(-rate R) from x to y."""
        cuts = [x, *[t for t in self.t if x < t < y], y]
        total = 0.0
        for p, q in zip(cuts, cuts[1:], strict=False):
            size = self.a[int(np.searchsorted(self.t, p, "right")) - 1]
            step = 1.0 if math.isinf(q) else -math.expm1(-rate * (q - p) / size)
            total += math.exp(-rate * self.hazard(p)) * (q - p if math.isinf(size) else step * size / rate)  # nobody meets at an infinite size
        return total

    def balanced(self, m: int) -> list[float]:
        """Break points of m intervals of equal meeting probability."""
        return [0.0, *[self.inverse(-math.log1p(-i / m)) for i in range(1, m)], math.inf]


@dataclass(frozen=True)
class Many:
    """Step models side by side: start times and sizes (piece, model). Where a model has fewer pieces than another, the times
    of the rest are infinite; pieces may be of no length."""

    t: np.ndarray
    a: np.ndarray

    @staticmethod
    def of(models: list[Steps]) -> Many:
        counts = np.array([len(m.t) for m in models])
        return Many.flat(counts, np.concatenate([m.t for m in models]), np.concatenate([m.a for m in models]))

    @staticmethod
    def flat(counts: np.ndarray, t: np.ndarray, a: np.ndarray) -> Many:
        """Of the pieces of all models, one model after the other."""
        if not counts.all() or not (a > 0).all():
            raise ValueError("a model needs a piece, and pieces need sizes above 0")
        there = np.arange(counts.max()) < counts[:, None]
        times, sizes = np.full(there.shape, math.inf), np.ones(there.shape)
        times[there], sizes[there] = t, a
        return Many(np.ascontiguousarray(times.T), np.ascontiguousarray(sizes.T))

    def __len__(self) -> int:
        return self.t.shape[1]

    def pick(self, at: np.ndarray) -> Many:
        return Many(self.t[:, at], self.a[:, at])

    def size(self, x: np.ndarray) -> np.ndarray:
        """Sizes at a time of each model."""
        return np.take_along_axis(self.a, ((self.t <= x).sum(0) - 1)[None], 0)[0]

    def hazard(self, x: float | np.ndarray) -> np.ndarray:
        x = np.broadcast_to(x, len(self))
        within = np.where(np.isinf(x), 0.0, x)
        ends = np.minimum(np.vstack([self.t[1:], np.full((1, len(self)), math.inf)]), within)
        return np.where(np.isinf(x), math.inf, (np.subtract(ends, self.t, out=np.zeros_like(self.t), where=ends > self.t) / self.a).sum(0))

    def survival(self, x: float, y: float) -> np.ndarray:
        """Integral of exp(-R) from x to y."""
        total = np.zeros(len(self))
        for k in range(len(self.t)):
            low = np.maximum(self.t[k], x)
            high = np.minimum(self.t[k + 1] if k + 1 < len(self.t) else math.inf, np.full(len(self), y))
            on = low < high
            long = np.subtract(high, low, out=np.zeros(len(self)), where=on)
            endless = np.isinf(self.a[k])
            part = np.where(endless, long, -np.expm1(-long / np.where(endless, 1.0, self.a[k])) * np.where(endless, 0.0, self.a[k]))
            total += np.where(on, np.exp(-self.hazard(np.where(on, low, 0.0))) * part, 0.0)
        return total


def piece_lists(*pieces: Column) -> list[Column]:
    """Aggregates: the times and the sizes of each model of structs (t0, size), in order of time."""
    sorted_ = [F.sort_array(F.collect_list(p)) for p in pieces]
    return [x for s in sorted_ for x in (s.getField("t0"), s.getField("size"))]


def many_rows(table: DataFrame, values: Callable[..., np.ndarray], schema: str, populations: int = 1, batch: int = 1024) -> DataFrame:
    """model_id, the indices and the value of each cell of arrays whose last axis is the model. ``table`` has a row a model:
    model_id, and for each population its times and its sizes as arrays, then numbers that ``values`` takes too."""
    kind, names = table.schema["model_id"].dataType.simpleString(), [c.split()[0] for c in schema.split(", ")]

    def models(times: pa.Array, sizes: pa.Array) -> Many:
        return Many.flat(*[x.to_numpy(zero_copy_only=False) for x in (pc.list_value_length(times), times.flatten(), sizes.flatten())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, batch):
                rows = whole.slice(start, batch)
                cells = [rows.column(i) for i in range(1, rows.num_columns)]
                taken = [models(*cells[2 * i : 2 * i + 2]) for i in range(populations)]
                found = values(*taken, *[x.to_numpy(zero_copy_only=False) for x in cells[2 * populations :]])
                *shape, count = found.shape
                at = np.indices(shape, np.int32).reshape(len(shape), -1)
                ids = rows.column(0).take(pa.array(np.repeat(np.arange(count), at.shape[1])))
                flat = np.ascontiguousarray(found.reshape(-1, count).T).ravel()
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(np.tile(i, count)) for i in at], pa.array(flat, from_pandas=True)], ["model_id", *names])

    return table.mapInArrow(run, f"model_id {kind}, {schema}")


def per_model(pieces: DataFrame, values: Callable[[Many], np.ndarray], schema: str, batch: int = 1024) -> DataFrame:
    """A row for each cell of the array (indices, model) that a function makes of many models of a table (model_id, t0, size)."""
    times, sizes = piece_lists(F.struct(F.col("t0").cast("double").alias("t0"), F.col("size").cast("double").alias("size")))
    table = pieces.groupBy("model_id").agg(times.alias("t"), sizes.alias("a"))
    return many_rows(table, values, schema, batch=batch)


def initial(model: Steps | Many, states: list[float], floor: float = 1e-20) -> np.ndarray:
    s = np.array([np.exp(-model.hazard(h)) for h in states])
    p = np.maximum(s[:-1] - s[1:], floor)
    return p / p.sum(0)


def meeting_times(model: Steps | Many, states: list[float]) -> np.ndarray:
    """Mean meeting time within each interval."""
    out = []
    for x, y in zip(states, states[1:], strict=False):
        sx, sy = np.exp(-model.hazard(x)), np.exp(-model.hazard(y))
        upper = 0.0 if math.isinf(y) else y * sy
        out.append(np.where(sx > sy, (x * sx - upper + model.survival(x, y)) / np.where(sx > sy, sx - sy, 1.0), math.nan))
    return np.array(out)


def three_state(c_rho: float, c_eta: float) -> np.ndarray:
    """exp of a piece for a pair: joined by descent without recombination, floating apart, met again."""
    sq = math.sqrt(4 * c_eta**2 + c_rho**2)
    if sq == 0:
        return np.eye(3)
    e, s, c = math.exp(-c_eta - c_rho / 2 + sq / 2), -math.expm1(-sq) / (2 * sq), (1 + math.exp(-sq)) / 2
    q = np.zeros((3, 3))
    q[0, :2] = e * (c + (2 * c_eta - c_rho) * s), 2 * e * c_rho * s
    q[1, :2] = 2 * e * c_eta * s, e * (c - (2 * c_eta - c_rho) * s)
    q[:2, 2] = 1 - q[:2, :2].sum(1)
    q[2, 2] = 1
    return q


def _upto(model: Steps, t: float, rho: float) -> np.ndarray:
    out, cuts = np.eye(3), [*[x for x in model.t if x < t], t]
    for p, q in zip(cuts, cuts[1:], strict=False):
        out = out @ three_state(rho * (q - p), (q - p) / model.a[int(np.searchsorted(model.t, p, "right")) - 1])
    return out


def transition(model: Steps, states: list[float], rho: float, mix: float = 1e-5, floor: float = 1e-20) -> np.ndarray:
    """Probability that the next base meets in interval k given that this one meets in j; rows sum to 1."""
    m = len(states) - 1
    at = [_upto(model, h, rho) if not math.isinf(h) else np.array([[0, 0, 1.0]] * 3) for h in states]
    mean = meeting_times(model, states)
    out = np.zeros((m, m))
    for j in range(m):
        for k in range(j):
            out[j, k] = at[k + 1][0, 2] - at[k][0, 2]
        if math.isnan(mean[j]):
            out[j, j] = 1 - out[j].sum()
            continue
        apart = _upto(model, mean[j], rho)[0, 1]
        base = model.hazard(mean[j])
        for k in range(j + 1, m):
            out[j, k] = apart * (math.exp(base - model.hazard(states[k])) - (0 if math.isinf(states[k + 1]) else math.exp(base - model.hazard(states[k + 1]))))
        out[j, j] = 1 - out[j].sum()
    out = np.maximum(out, floor)
    out = (1 - mix) * out + mix / m
    return out / out.sum(1, keepdims=True)


def pair_emission(model: Steps, states: list[float], theta: float, alpha: float = 1.0) -> np.ndarray:
    """Even and odd numbers of derived alleles of a pair, by state."""
    t = meeting_times(model, states)
    x = -2 * alpha * theta * np.where(np.isnan(t), 0, t)
    return np.where(np.isnan(t), 1e-20, np.stack([np.exp(x), -np.expm1(x)]))


def pair_model(model: Steps, states: list[float], theta: float, rho: float, keys: list[hmm.Key]) -> hmm.Model:
    """The hidden Markov model of the distinguished pair: missing pairs emit 1, others by parity."""
    e = pair_emission(model, states, theta)
    emission = {k: np.ones(len(states) - 1) if k[0] < 0 else e[k[0] % 2] for k in keys}
    return hmm.Model(initial(model, states), transition(model, states, rho), emission)


def golden(f: Callable[[float], float], a: float, b: float, steps: int = 24) -> float:
    """Minimum of a function of one variable between bounds."""
    g = (math.sqrt(5) - 1) / 2
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = f(c), f(d)
    for _ in range(steps):
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = f(d)
    return (a + b) / 2


def bounded(f: Callable[[float], float], a: float, b: float, tolerance: float = 1e-5, most: int = 60) -> float:
    """Minimum of a function of one variable between bounds: a parabola through the three best points where that step falls
    well inside and shrinks, else a golden section."""
    ratio = (3 - math.sqrt(5)) / 2
    x = w = v = a + ratio * (b - a)
    fx = fw = fv = f(x)
    last = before = b - a
    for _ in range(most):
        middle, near = (a + b) / 2, tolerance * (abs(x) + 1e-3)
        if abs(x - middle) <= 2 * near - (b - a) / 2:
            break
        up = (x - v) * (fx - fw)
        down = (x - w) * (fx - fv)
        over = 2 * (up - down)
        step = ((x - w) * down - (x - v) * up) / over if over else math.inf
        if abs(step) < abs(before) / 2 and a + near < x + step < b - near:
            before, last = last, step
        else:
            before = (b if x < middle else a) - x
            last = ratio * before
        u = x + (last if abs(last) >= near else math.copysign(near, last))
        fu = f(u)
        if fu <= fx:
            a, b = (x, b) if u >= x else (a, x)
            v, fv, w, fw, x, fx = w, fw, x, fx, u, fu
        else:
            a, b = (u, b) if u < x else (a, u)
            if fu <= fw or w == x:
                v, fv, w, fw = w, fw, u, fu
            elif fu <= fv or v in (x, w):
                v, fv = u, fu
    return x


def minimise(f: Callable[[np.ndarray], float], x: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 25, step: float = 1e-4, tolerance: float = 1e-7) -> np.ndarray:
    """Minimum between bounds by a quasi-Newton method: gradients by central differences, an inverse Hessian that is updated
    from their changes, coordinates at a bound held there, and a line search by halves."""
    x = np.clip(x, low, high)

    def slope(at: np.ndarray) -> np.ndarray:
        out = np.empty(len(at))
        for i in range(len(at)):
            up, down = at.copy(), at.copy()
            up[i], down[i] = min(at[i] + step, high[i]), max(at[i] - step, low[i])
            out[i] = (f(up) - f(down)) / (up[i] - down[i])
        return out

    value, g, h = f(x), slope(x), np.eye(len(x))
    for turn in range(rounds):
        free = ~(((x <= low) & (g > 0)) | ((x >= high) & (g < 0)))
        if not free.any():
            break
        inner = np.outer(free, free)
        d = -np.where(inner, h, 0) @ g
        if d @ g >= 0:
            h, d = np.eye(len(x)), -np.where(free, g, 0)
        if not turn:
            d = d / max(1.0, float(np.abs(d).max()))
        t = 1.0
        while t > 1e-8:
            to = np.clip(x + t * d, low, high)
            if (new := f(to)) < value + 1e-4 * float(g @ (to - x)):
                break
            t /= 2
        else:
            break
        g2 = slope(to)
        s, y = to - x, g2 - g
        if s @ y > 1e-12:
            r = 1 / (s @ y)
            left = np.eye(len(x)) - r * np.outer(s, y)
            h = left @ h @ left.T + r * np.outer(s, s)
        gain, x, value, g = value - new, to, new, g2
        if gain < tolerance * (1 + abs(value)):
            break
    return x


def roughness(y: np.ndarray) -> float:
    return float(np.sum(np.diff(y, 2) ** 2))


#: Bounds of log sizes; of each rate, as factors of its start; of alpha as it is.
LOW, HIGH = math.log(1e-4), math.log(1e4)
LEARNED: dict[str, tuple[float, float]] = {"rho": (1e-2, 1e2), "theta": (1e-2, 1e2), "alpha": (1e-2, 1e2)}


@dataclass
class Fit:
    """What an EM run has reached: log sizes, rates, log likelihoods so far, and whether it has ended."""

    y: np.ndarray
    theta: float
    rho: float
    history: list[float]
    done: bool = False
    alpha: float = 1.0


class Parts:
    """The parts of a hidden Markov model by what they depend on: a part is made anew only if one of its inputs has changed.
    ``made`` counts how often each was."""

    NEEDS = {"pi": ("sizes",), "transition": ("sizes", "rho"), "pair": ("sizes", "theta", "alpha"), "spectra": ("sizes",), "table": ("sizes", "theta"), "emission": ("sizes", "theta", "alpha")}

    def __init__(self, states: list[float], keys: list[hmm.Key], make: dict[str, Callable[..., object]], most: int = 4) -> None:
        self.states, self.keys, self.make, self.most = states, keys, make, most
        self.held: dict[str, dict] = {name: {} for name in make}
        self.made = dict.fromkeys(make, 0)
        self.now: dict[str, object] = {}

    def at(self, model: Steps, theta: float, rho: float, alpha: float) -> "Parts":
        self.now = {"sizes": (tuple(model.t.tolist()), tuple(model.a.tolist())), "theta": theta, "rho": rho, "alpha": alpha}
        self.model = model
        return self

    def get(self, name: str) -> object:
        held, key = self.held[name], tuple(self.now[x] for x in self.NEEDS[name])
        if key not in held:
            while len(held) >= self.most:
                held.pop(next(iter(held)))
            held[key] = self.make[name](self)
            self.made[name] += 1
        return held[key]

    def hidden(self) -> hmm.Model:
        return hmm.Model(self.get("pi"), self.get("transition"), self.get("emission"))


def pair_parts(states: list[float], keys: list[hmm.Key]) -> Parts:
    """Parts of the model of the distinguished pair alone."""
    return Parts(states, keys, {
        "pi": lambda p: initial(p.model, states),
        "transition": lambda p: transition(p.model, states, p.now["rho"]),
        "pair": lambda p: pair_emission(p.model, states, p.now["theta"], p.now["alpha"]),
        "emission": lambda p: {k: np.ones(len(states) - 1) if k[0] < 0 else p.get("pair")[k[0] % 2] for k in keys},
    })


def as_parts(build: Callable[..., hmm.Model]) -> Callable[[list[float], list[hmm.Key]], Parts]:
    """A function that builds a whole model (pi, transition and emissions together) as parts that all depend on everything."""

    class Whole(Parts):
        NEEDS = dict.fromkeys(("pi", "transition", "emission", "whole"), ("sizes", "theta", "rho", "alpha"))

    def parts(states: list[float], keys: list[hmm.Key]) -> Parts:
        return Whole(states, keys, {
            "whole": lambda p: build(p.model, states, p.now["theta"], p.now["rho"], keys),
            "pi": lambda p: p.get("whole").pi, "transition": lambda p: p.get("whole").transition, "emission": lambda p: p.get("whole").emission,
        })

    return parts


class Expectation:
    """The expected complete log likelihood of reduced statistics under a model; the statistics are turned into arrays once."""

    def __init__(self, stats: list, m: int) -> None:
        self.first, self.xi, self.gamma = np.zeros(m), np.zeros((m, m)), {}
        for r in stats:
            if r["kind"] == "first":
                self.first[r["i"]] += r["value"]
            elif r["kind"] == "xi":
                self.xi[r["i"], r["j"]] += r["value"]
            elif r["kind"] == "gamma":
                self.gamma.setdefault(tuple(map(int, r["key"].split(","))), np.zeros(m))[r["i"]] += r["value"]

    def __call__(self, model: hmm.Model) -> float:
        log = lambda x: np.log(np.maximum(x, 1e-20))
        return float(self.first @ log(model.pi) + (self.xi * log(model.transition)).sum() + sum(g @ log(model.emission[k]) for k, g in self.gamma.items()))


def estimate(
    spans: DataFrame,
    knots: list[float],
    states: list[float],
    theta: float,
    rho: float,
    rounds: int = 3,
    penalty: float = 0.0,
    on: Callable[[str, dict], None] | None = None,
    build: Callable[..., hmm.Model] | None = None,
    start: Fit | None = None,
    learn: tuple[str, ...] = (),
    together: bool = False,
    curve: Callable[[np.ndarray], Steps] | None = None,
    rough: Callable[[np.ndarray], float] = roughness,
    parts: Callable[[list[float], list[hmm.Key]], Parts] = pair_parts,
    block_rows: int | None = None,
) -> tuple[Steps, list[float]]:
    """EM on the distinguished pair, or with ``parts`` = conditioned.sample_parts on all samples; ``build`` makes a whole model
    instead. A round is one distributed E-step and a driver M-step: first all log sizes move together, then each rate of
    ``learn`` (names of LEARNED), then one knot at a time, last first, or all ``together`` by minimise(). The penalty is on
    ``rough``, in units of the size of the first expectation. ``on`` is told what happens, with a Fit that ``start`` takes to
    go on from: begin; pre, post E-step; pre M-step; post minimize of each parameter; post mini M-step of each knot; post
    M-step; converged; optimization finished. With ``block_rows`` contigs are worked on in blocks. Ends when the relative gain is small."""
    if set(learn) - set(LEARNED):
        raise ValueError(f"what can be learned: {', '.join(LEARNED)}")
    spans = spans.select("contig_id", "seq", "span", *hmm.key_columns(spans)).persist()
    keys = [tuple(r) for r in spans.select(*hmm.key_columns(spans)).distinct().collect()]  # few: counts of one sample
    fit = start or Fit(np.zeros(len(knots)), theta, rho, [])
    steps = curve or (lambda y: Steps(np.array(knots), np.exp(y)))
    held = (as_parts(build) if build else parts)(states, keys)
    tell = on or (lambda message, state: None)
    say = lambda message, **more: tell(message, {"round": len(fit.history), "fit": fit, "y": fit.y, "made": dict(held.made), **more})
    at = lambda y, **rates: held.at(steps(y), *(rates.get(n, getattr(fit, n)) for n in ("theta", "rho", "alpha"))).hidden()
    bounds = {n: (math.log(low * (1 if n == "alpha" else {"theta": theta, "rho": rho}[n])), math.log(high * (1 if n == "alpha" else {"theta": theta, "rho": rho}[n]))) for n, (low, high) in LEARNED.items()}
    say("begin")
    while not fit.done and len(fit.history) < rounds:
        model = at(fit.y)
        say("pre E-step")
        stats = hmm.reduced(hmm.statistics(spans, model, block_rows)).collect()  # keys times states
        fit.history.append(sum(r["value"] for r in stats if r["kind"] == "loglik"))
        say("post E-step", loglik=fit.history[-1])
        if len(fit.history) > 1 and 0 <= (fit.history[-2] - fit.history[-1]) / fit.history[-2] < 1e-4:
            fit.done = True
            say("converged")
            break
        expect = Expectation(stats, len(model.pi))
        scale = max(1.0, abs(expect(model)))

        def cost(y: np.ndarray, expect: Expectation = expect, scale: float = scale, **rates: float) -> float:
            return -expect(at(y, **rates)) / scale + penalty / scale * rough(y)

        say("pre M-step")
        fit.y = np.clip(fit.y + bounded(lambda v: cost(fit.y + v), -1.0, 1.0, 1e-3), LOW, HIGH)
        say("post minimize", parameter="scale")
        for name in learn:
            setattr(fit, name, math.exp(bounded(lambda v, name=name: cost(fit.y, **{name: math.exp(v)}), *bounds[name], 1e-4)))
            say("post minimize", parameter=name)
        if together:
            fit.y = minimise(cost, fit.y, np.full(len(fit.y), LOW), np.full(len(fit.y), HIGH), 8)
        else:
            for k in range(len(fit.y) - 1, -1, -1):
                moved = lambda v, k=k: cost(np.r_[fit.y[:k], v, fit.y[k + 1 :]])
                fit.y[k] = bounded(moved, max(fit.y[k] - 3, LOW), min(fit.y[k] + 3, HIGH), 1e-3)
                say("post mini M-step", knot=k)
        say("post M-step")
    spans.unpersist()
    fit.done = True
    say("optimization finished")
    return steps(fit.y), fit.history


def matched(curve: Callable[[np.ndarray], Callable[[np.ndarray], np.ndarray]], size: int, target: Steps, last: float, points: int = 400) -> np.ndarray:
    """Values with which a curve of log sizes that is linear in them comes closest, in squares, to a step model up to a time."""
    at = np.linspace(0, last, points, endpoint=False)
    columns = np.stack([curve(np.eye(size)[i])(at) for i in range(size)], axis=1)
    want = np.log(target.a[np.searchsorted(target.t, at, "right") - 1])
    return np.linalg.lstsq(columns, want, rcond=None)[0]
