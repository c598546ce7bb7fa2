"""Hidden Markov inference on span tables: a numpy kernel that steps over runs, and its grouped application.

Model matrices are small (M states) and travel with the function; data stay where they are. A run of span s costs one
power of its key's step matrix, by squaring, so spans are never expanded."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import positions

#: Of one population (a, b, nb), of two (a, b, nb, a, b, nb).
Key = tuple[int, ...]


@dataclass
class Model:
    """Initial distribution, transition matrix (rows: from) and emissions of each observation key."""

    pi: np.ndarray
    transition: np.ndarray
    emission: dict[Key, np.ndarray]
    _eigen: dict[Key, tuple] = field(default_factory=dict)
    _step: dict[tuple[int, Key], tuple[np.ndarray, float]] = field(default_factory=dict)

    def eigen(self, key: Key) -> tuple:
        """Eigenvalues and vectors of diag(e) T', with complex pairs kept."""
        if key not in self._eigen:
            d, p = np.linalg.eig(np.diag(self.emission[key]) @ self.transition.T)
            self._eigen[key] = d.astype(complex), p.astype(complex), np.linalg.inv(p.astype(complex)), np.abs(d).max()
        return self._eigen[key]


    def step(self, span: int, key: Key) -> tuple[np.ndarray, float]:
        """The scaled matrix of a run and the log of its scale; those met before are kept, up to a bound."""
        if (span, key) not in self._step:
            if len(self._step) >= 50_000:
                self._step.clear()
            top = self.eigen(key)[3]
            base = np.diag(self.emission[key] / top) @ self.transition.T  # no negative number: powers by squaring keep every digit
            self._step[span, key] = np.linalg.matrix_power(base, span), span * float(np.log(top))
        return self._step[span, key]


def _power_sums(d: np.ndarray, s: int) -> np.ndarray:
    """sum over i + j = s - 1 of d_a**i d_b**j."""
    ds = d**s
    gap = d[:, None] - d[None, :]
    close = np.abs(gap) < 1e-9 * np.abs(d).max()
    return np.where(close, s * ((d[:, None] + d[None, :]) / 2) ** (s - 1), (ds[:, None] - ds[None, :]) / np.where(close, 1, gap))


class Runs(NamedTuple):
    """Rows in order: the number of each one's (span, key), and those pairs."""

    which: np.ndarray
    pairs: list[tuple[int, Key]]


def runs(rows: list[tuple[int, Key]]) -> Runs:
    number: dict[tuple[int, Key], int] = {}
    return Runs(np.array([number.setdefault(r, len(number)) for r in rows], int), list(number))


def _steps(rows: Runs, model: Model) -> tuple[list[int], list[np.ndarray], float]:
    """The number of each row's (span, key), the scaled step matrix of each, and the log of all scales together."""
    found = [model.step(*r) for r in rows.pairs]
    return rows.which.tolist(), [m for m, _ in found], float(np.array([x for _, x in found])[rows.which].sum()) if len(rows.which) else 0.0


def forward_backward(rows: Runs | list[tuple[int, Key]], model: Model, start: np.ndarray | None = None, finish: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Log likelihood, posterior mass of each row (n x M, rows sum to their spans), expected transitions, and the posterior
    of the state before the first base. For a block within a sequence, ``start`` is the forward vector before it and
    ``finish`` the backward vector after it.

    Vectors go from row to row by real matrices, one for each (span, key); what a row adds is made for all rows of a
    (span, key) together."""
    rows = rows if isinstance(rows, Runs) else runs(rows)
    m, t, n = len(model.pi), model.transition, len(rows.which)
    which, matrices, loglik = _steps(rows, model)
    alphas, betas = np.empty((n + 1, m)), np.empty((n + 1, m))
    alphas[0] = a = model.pi if start is None else start
    for i, w in enumerate(which):
        x = matrices[w] @ a
        c = x.sum()
        loglik += np.log(c)
        a = np.maximum(x / c, 0)
        alphas[i + 1] = a
    betas[n] = b = np.ones(m) if finish is None else finish
    turned = [x.T.copy() for x in matrices]
    for i in range(n - 1, -1, -1):
        b = turned[which[i]] @ b
        b = np.maximum(b / b.max(), 0)
        betas[i] = b
    gamma, xi, at = np.zeros((n, m)), np.zeros((m, m)), rows.which
    for w, (s, key) in enumerate(rows.pairs):
        d, p, inv, top = model.eigen(key)
        dn, mine = d / top, np.flatnonzero(at == w)
        sums, scaled = _power_sums(dn, s), t * model.emission[key][None, :] / top
        for some in np.array_split(mine, -(-len(mine) // 4096)):
            inner = (alphas[some] @ inv.T)[:, :, None] * (betas[some + 1] @ p)[:, None, :] * sums
            moves = (p @ inner @ inv).real * scaled  # sum over steps of alpha_before beta_after', in scaled units
            moves *= (s / moves.sum((1, 2)))[:, None, None]
            moves = np.maximum(moves, 0)
            xi += moves.sum(0)
            gamma[some] = moves.sum(1)
    first = alphas[0] * betas[0]
    return loglik, gamma, xi, first / first.sum()


#: Rows of a block, where contigs are cut into blocks that are worked on side by side.
BLOCK = 16_384


def key_columns(rows: DataFrame) -> list[str]:
    """The columns of the key, of one population or of two."""
    return [c for c in ("a1", "b1", "nb1", "a2", "b2", "nb2") if c in rows.columns]


def _kept(rows: DataFrame) -> list[str]:
    return ["contig_id", "seq", "span", *key_columns(rows), *(["start"] if "start" in rows.columns else [])]


def _kind(rows: DataFrame) -> str:
    return rows.schema["contig_id"].dataType.simpleString()


def _rows_of(pdf: pd.DataFrame, ordered: bool = False) -> tuple[pd.DataFrame, Runs]:
    pdf = pdf if ordered else pdf.sort_values("seq")
    names = ["span", *[c for c in pdf.columns if c[0] in "abn" and c[-1].isdigit()]]
    cells = pdf[names].to_numpy(np.int64)
    code, place = np.zeros(len(cells), np.int64), 1
    for c in cells.T:  # one number for a row, where that fits; else rows are compared as such
        low, high = int(c.min(initial=0)), int(c.max(initial=0))
        code, place = code + (c - low) * place, place * (high - low + 1)
        if place > 1 << 62:
            break
    if place > 1 << 62:
        pairs, which = np.unique(cells, axis=0, return_inverse=True)
    else:
        _, at, which = np.unique(code, return_index=True, return_inverse=True)
        pairs = cells[at]
    return pdf, Runs(which.reshape(-1), [(r[0], tuple(r[1:])) for r in pairs.tolist()])


def _by_contig(spans: DataFrame, use: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``use`` of the rows of each contig in order. Contigs follow each other in a task, so a small one costs no batch of its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            names, done = pdf["contig_id"].to_numpy(), []
            edges = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)] if len(names) else [0]
            for a, b in zip(edges, edges[1:], strict=False):
                if held and held[-1]["contig_id"].iloc[0] != names[a]:
                    done.append(use(pd.concat(held) if len(held) > 1 else held[0]))
                    held = []
                held.append(pdf.iloc[a:b])
            if done:
                yield pd.concat(done)
        if held:
            yield use(pd.concat(held))

    return spans.select(*_kept(spans)).repartition("contig_id").sortWithinPartitions("contig_id", "seq").mapInPandas(run, schema)


def _blocks(spans: DataFrame, size: int) -> DataFrame:
    """Rows with ``block``, which grows along a contig: ranges of (contig_id, seq) cut every ``size`` rows, written once as
    both passes must see the same ones. No task holds a contig."""
    from ..sources.text import scratch

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, contig, n = TaskContext.get().partitionId(), None, 0
        for pdf in batches:
            names = pdf["contig_id"].to_numpy()
            if not len(names):
                continue
            first = np.r_[True, names[1:] != names[:-1]]
            at = np.arange(len(names))
            within = at - np.maximum.accumulate(np.where(first, at, 0))
            if names[0] == contig:
                within[np.maximum.accumulate(np.where(first, at, 0)) == 0] += n
            contig, n = names[-1], within[-1] + 1
            yield pdf.assign(block=part << 32 | within // size)

    path = scratch(spans.sparkSession, "blocks")
    columns = [f"{c} {'int' if c in key_columns(spans) else 'bigint'}" for c in _kept(spans)[1:]]
    ordered = spans.selectExpr("contig_id", *[f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in columns])
    ordered = ordered.repartitionByRange("contig_id", "seq").sortWithinPartitions("contig_id", "seq")
    schema = f"contig_id {_kind(spans)}, {', '.join(columns)}, block bigint"
    ordered.mapInPandas(cut, schema).write.parquet(path)
    return spans.sparkSession.read.schema(schema).parquet(path)


def _edges(blocks: DataFrame, model: Model) -> DataFrame:
    """contig_id, block, loglik, start, finish: the forward vector before each block and the backward vector after it. A block
    is one matrix; only these meet, contig by contig."""

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        sorted_, rows = _rows_of(pdf)
        which, matrices, scale = _steps(rows, model)
        whole = np.eye(len(model.pi))
        for w in which:
            whole = matrices[w] @ whole
            top = whole.max()
            whole, scale = whole / top, scale + np.log(top)
        return pd.DataFrame({"contig_id": sorted_["contig_id"].iloc[:1], "block": sorted_["block"].iloc[:1], "matrix": [whole.ravel().tolist()], "scale": [scale]})

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        matrices = [np.array(x).reshape(len(model.pi), -1) for x in pdf["matrix"]]
        a, b, starts, finishes, loglik = model.pi, np.ones(len(model.pi)), [], [], []
        for x, scale in zip(matrices, pdf["scale"], strict=True):
            starts.append(a)
            a = np.maximum(x @ a, 0)
            loglik.append(scale + np.log(a.sum()))
            a = a / a.sum()
        for x in reversed(matrices):
            finishes.append(b)
            b = np.maximum(x.T @ b, 0)
            b = b / b.max()
        return pd.DataFrame({"contig_id": pdf["contig_id"], "block": pdf["block"], "loglik": loglik, "start": starts, "finish": finishes[::-1]})

    products = blocks.groupBy("contig_id", "block").applyInPandas(product, f"contig_id {_kind(blocks)}, block bigint, matrix array<double>, scale double")
    return products.groupBy("contig_id").applyInPandas(scan, f"contig_id {_kind(blocks)}, block bigint, loglik double, start array<double>, finish array<double>")


def _applied(spans: DataFrame, model: Model, use: Callable[[pd.DataFrame, tuple, bool], pd.DataFrame], schema: str, size: int | None) -> DataFrame:
    """``use`` of each contig's rows, or of those of each block of ``size`` rows, with what forward_backward gives, and whether
    a contig begins there."""
    if not size:

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf, rows = _rows_of(pdf, True)
            return use(pdf, forward_backward(rows, model), True)

        return _by_contig(spans, whole, schema)
    blocks = _blocks(spans, size)
    edges = _edges(blocks, model)
    first = edges.groupBy("contig_id").agg(F.min("block").alias("block")).withColumn("first", F.lit(True))
    edges = edges.drop("loglik").join(first, ["contig_id", "block"], "left")

    def part(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        pdf, rows = _rows_of(left)
        return use(pdf, forward_backward(rows, model, np.array(right["start"].iloc[0]), np.array(right["finish"].iloc[0])), right["first"].iloc[0] is True or right["first"].iloc[0] == True)  # noqa: E712

    return blocks.groupBy("contig_id", "block").cogroup(edges.groupBy("contig_id", "block")).applyInPandas(part, schema)


def posterior(spans: DataFrame, model: Model, size: int | None = None) -> DataFrame:
    """contig_id, seq, start, span and gamma, the state probabilities of each run."""

    def run(pdf: pd.DataFrame, found: tuple, _: bool) -> pd.DataFrame:
        gamma = found[1] / found[1].sum(1, keepdims=True)
        return pd.DataFrame({**{c: pdf[c] for c in ("contig_id", "seq")}, **{c: pdf[c].astype("int64") for c in ("start", "span")}, "gamma": list(gamma)})

    return _applied(positions(spans), model, run, f"contig_id {_kind(spans)}, seq bigint, start bigint, span bigint, gamma array<double>", size)


def logliks(spans: DataFrame, model: Model, size: int | None = None) -> DataFrame:
    """contig_id and loglik, by forward passes only; with ``size``, from the matrices of blocks of so many rows."""
    if size:
        blocks = _edges(_blocks(spans, size), model)
        return blocks.groupBy("contig_id").agg(F.sum("loglik").alias("loglik"))

    def forward(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, rows = _rows_of(pdf, True)
        which, matrices, loglik = _steps(rows, model)
        a, scale = model.pi, 1.0
        for w in which:
            a = matrices[w] @ a
            c = a.sum()
            a = a / c
            scale *= c
            if not 1e-200 < scale < 1e200:
                loglik, scale = loglik + np.log(scale), 1.0
        return pd.DataFrame({"contig_id": pdf["contig_id"].iloc[:1], "loglik": [loglik + float(np.log(scale))]})

    return _by_contig(spans, forward, f"contig_id {_kind(spans)}, loglik double")


def statistics(spans: DataFrame, model: Model, size: int | None = None) -> DataFrame:
    """Sufficient statistics of each contig in long form: kind (loglik, first, gamma, xi), key, i, j, value; of each block
    of it, where a contig is cut."""
    columns = key_columns(spans)

    def run(pdf: pd.DataFrame, found: tuple, begins: bool) -> pd.DataFrame:
        ll, gamma, xi, first = found
        out = [("loglik", "", 0, 0, ll)] + ([("first", "", i, 0, v) for i, v in enumerate(first)] if begins else [])
        names, which = np.unique(pdf[columns].to_numpy(np.int64), axis=0, return_inverse=True)
        sums = np.zeros((len(names), gamma.shape[1]))
        np.add.at(sums, which.reshape(-1), gamma)
        out += [("gamma", ",".join(map(str, k)), i, 0, v) for k, g in zip(names.tolist(), sums, strict=True) for i, v in enumerate(g)]
        out += [("xi", "", i, j, xi[i, j]) for i in range(len(xi)) for j in range(len(xi))]
        frame = pd.DataFrame(out, columns=["kind", "key", "i", "j", "value"])
        frame.insert(0, "contig_id", pdf["contig_id"].iloc[0])
        return frame

    return _applied(spans, model, run, f"contig_id {_kind(spans)}, kind string, key string, i int, j int, value double", size)


def reduced(stats: DataFrame) -> DataFrame:
    """Statistics of all contigs; as many rows as keys and states ask for."""
    return stats.groupBy("kind", "key", "i", "j").agg(F.sum("value").alias("value"))


def perplexity(stats: DataFrame) -> DataFrame:
    """Occupancy of each state and the perplexity of the occupancy."""
    occ = stats.where("kind = 'gamma'").groupBy(F.col("i").alias("state")).agg(F.sum("value").alias("mass"))
    total = occ.agg(F.sum("mass").alias("total"))
    occ = occ.crossJoin(F.broadcast(total)).select("state", (F.col("mass") / F.col("total")).alias("occupancy"))
    ent = occ.agg(F.exp(-F.sum(F.when(F.col("occupancy") > 0, F.col("occupancy") * F.log("occupancy")).otherwise(0.0))).alias("perplexity"))
    return occ.crossJoin(F.broadcast(ent))  # one row


def expectation(pi: np.ndarray, transition: np.ndarray, emission: dict[Key, np.ndarray], stats: list) -> float:
    """Expected complete log likelihood from reduced statistics."""
    q = 0.0
    for r in stats:
        if r["kind"] == "first":
            q += r["value"] * np.log(max(pi[r["i"]], 1e-20))
        elif r["kind"] == "gamma":
            q += r["value"] * np.log(max(emission[tuple(map(int, r["key"].split(",")))][r["i"]], 1e-20))
        elif r["kind"] == "xi":
            q += r["value"] * np.log(max(transition[r["i"], r["j"]], 1e-20))
    return q
