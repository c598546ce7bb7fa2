"""When two populations split: a profile likelihood over the time of the split, with both models held.

Bases count one by one (one hidden state), so what the data say is how many bases show each key: one aggregation, small
whatever the input. Each set of rows has its own kind: joint rows of six columns with the pair in the first population or one
lineage in each, or rows of the second population alone, whose history is that of the second model up to the split and of
the first from then on. For each time of the split the models may be scaled by one factor; the profile is the best over it."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import conditioned, hmm, joint
from . import demography as dm

#: Kinds of rows: lineages of the pair in each population.
TOGETHER, APART, SECOND = (2, 0), (1, 1), (0, 2)
EVER = [0.0, math.inf]


def key_counts(spans: DataFrame) -> DataFrame:
    """Bases of each key."""
    return spans.groupBy(*hmm.key_columns(spans)).agg(F.sum("span").cast("bigint").alias("bases"))


@dataclass
class Counted:
    """Bases of the keys of one kind, and the sizes of the samples."""

    kind: tuple[int, int]
    bases: dict[hmm.Key, int]
    n: tuple[int, ...] = ()

    def __post_init__(self) -> None:
        self.n = self.n or tuple(max((k[i] for k in self.bases), default=0) for i in (2, 5)[: 1 if self.kind == SECOND else 2])

    def loglik(self, one: dm.Steps, two: dm.Steps, split: float, theta: float, error: float) -> float:
        keys = list(self.bases)
        if self.kind == SECOND:
            found = conditioned.emissions(joint.spliced(two, one, split), EVER, theta, keys, self.n[0], error)
        else:
            found = joint.emissions(one, two, split, EVER, theta, keys, self.n, self.kind, error)
        return math.fsum(n * math.log(max(float(found[k][0]), 1e-20)) for k, n in self.bases.items())


def counted(spans: DataFrame, kind: tuple[int, int]) -> Counted:
    columns = hmm.key_columns(spans)
    rows = key_counts(spans).collect()  # as many as a sample has keys
    return Counted(kind, {tuple(r[c] for c in columns): r["bases"] for r in rows})


@dataclass
class Split:
    """Where the fit is: the split, the factor of both models' sizes, and every (split, scale, log likelihood) tried."""

    split: float
    scale: float
    loglik: float
    tried: list[tuple[float, float, float]] = field(default_factory=list)


def scaled(model: dm.Steps, by: float) -> dm.Steps:
    return dm.Steps(model.t, model.a * by)


def fit(sets: list[Counted], one: dm.Steps, two: dm.Steps, theta: float, most: float, error: float = 0.5, scale: bool = True, on: Callable[[Split], None] | None = None, tolerance: float = 1e-3) -> Split:
    """The split between 0 and ``most`` of the highest profile likelihood; with ``scale`` both models' sizes are moved together
    by up to a factor e. ``on`` is told of every point of the profile."""
    if not any(s.kind != SECOND and s.bases for s in sets):
        raise ValueError("no rows of both populations: they do not say when they split")
    best = Split(most / 2, 1.0, -math.inf)

    def at(split: float, log_scale: float) -> float:
        by = math.exp(log_scale)
        return math.fsum(s.loglik(scaled(one, by), scaled(two, by), split, theta, error) for s in sets)

    def profile(split: float) -> float:
        log_scale = dm.bounded(lambda v: -at(split, v), -1.0, 1.0, tolerance) if scale else 0.0
        value = at(split, log_scale)
        best.tried.append((split, math.exp(log_scale), value))
        if value > best.loglik:
            best.split, best.scale, best.loglik = split, math.exp(log_scale), value
        if on:
            on(best)
        return -value

    dm.bounded(profile, 0.0, most, tolerance)
    return best


def profile_table(spans: DataFrame, kind: tuple[int, int], one: dm.Steps, two: dm.Steps, theta: float, splits: list[float], n: tuple[int, int], error: float = 0.5) -> DataFrame:
    """contig_id, split, loglik of each contig at each time of the split: probabilities of the table's keys by time, joined to
    the contigs' counts."""
    columns = hmm.key_columns(spans)
    counts = spans.groupBy("contig_id", *columns).agg(F.sum("span").cast("bigint").alias("bases"))
    keys = spans.select(*columns).distinct()

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known = [tuple(r) for r in pdf.to_numpy(int).tolist()]
            for t in splits:
                found = joint.emissions(one, two, t, EVER, theta, known, n, kind, error)
                yield pdf.assign(split=t, logp=[math.log(max(float(found[k][0]), 1e-20)) for k in known])

    schema = ", ".join(f"{c} int" for c in columns) + ", split double, logp double"
    table = keys.select(*[F.col(c).cast("int").alias(c) for c in columns]).mapInPandas(look, schema)
    rows = counts.join(table, columns)
    return rows.groupBy("contig_id", "split").agg(F.sum(F.col("bases") * F.col("logp")).alias("loglik"))
