"""Step models as tables of pieces (model_id, piece, t0, t1, size); the last piece has a null t1."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

#: Fixed values of the built-in histories. human: size at the start and end of each piece, in units of n0, and the years
#: at which the pieces but the last end. sawtooth: the first size, then times and the growth rates that hold from them on.
HUMAN = {"n0": 10000.0, "start": [10.0, 0.5, 1.0, 4.0], "end": [1.0, 0.5, 1.0, 4.0], "years": [10000.0, 70000.0, 200000.0], "generation": 29.0}
SAWTOOTH = {
    "n0": 14312.0,
    "first": 5.0,
    "events": [(0.000582262, 1318.18), (0.00232905, -329.546), (0.00931919, 82.3865), (0.0372648, -20.5966), (0.149059, 5.14916), (0.596236, 0.0)],
    "last": 0.1,
}


def ordered() -> WindowSpec:
    return Window.partitionBy("model_id").orderBy("t0")


def table(spark: SparkSession, models: dict[str, tuple[list[float], list[float]]]) -> DataFrame:
    """Pieces from start times and sizes."""
    rows = [(m, i, float(t), float(ts[i + 1]) if i + 1 < len(ts) else None, float(s)) for m, (ts, sizes) in models.items() for i, (t, s) in enumerate(zip(ts, sizes, strict=True))]
    return spark.createDataFrame(rows, "model_id string, piece int, t0 double, t1 double, size double")


def human() -> list[tuple[float, float, float, float]]:
    """Pieces (t0, t1, size at t0, size at t1) of the human history; times in units of 2 n0 generations; the last,
    which has no end, is given one year."""
    ends = [*HUMAN["years"], HUMAN["years"][-1] + 1]
    times = [0.0, *[y / (2 * HUMAN["n0"]) / HUMAN["generation"] for y in ends]]
    return list(zip(times, times[1:], HUMAN["start"], HUMAN["end"], strict=False))


def sawtooth() -> list[tuple[float, float, float, float]]:
    """Pieces (t0, t1, size at t0, size at t1) of the sawtooth history, in units of 2 n0 generations. The size at the end of
    its last piece is its start time, as its published form has it."""
    size, rate, before, out = SAWTOOTH["first"], 0.0, 0.0, []
    for time, growth in SAWTOOTH["events"]:
        end = size * math.exp(-rate * (time - before))
        out.append((2 * before, 2 * time, size, end))
        size, rate, before = end, growth, time
    return [*out, (2 * before, 2 * (before + SAWTOOTH["last"]), size, before)]


def stepped(growth: list[tuple[float, float, float, float]], parts: int = 25) -> tuple[list[float], list[float]]:
    """Start times and sizes of a step model that follows pieces of exponential growth: the size half way through each part."""
    times, sizes = [], []
    for t0, t1, a, b in growth:
        n = 1 if a == b else parts
        times += [t0 + (t1 - t0) * i / n for i in range(n)]
        sizes += [a * (b / a) ** ((i + 0.5) / n) for i in range(n)]
    return times, sizes


def clip(pieces: DataFrame, low: float = 1e-3, high: float = 1e3) -> DataFrame:
    return pieces.withColumn("size", F.greatest(F.lit(low), F.least(F.col("size"), F.lit(high))))


def hazard(pieces: DataFrame) -> DataFrame:
    """Cumulative hazard at the start of each piece."""
    area = (F.col("t1") - F.col("t0")) / F.col("size")
    return pieces.withColumn("hazard", F.coalesce(F.sum(area).over(ordered().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))


#: Models of at most so many pieces, all together and each, are sent to the points.
MOST_PIECES, MOST_OF_ONE = 100_000, 512


def as_of(points: DataFrame, pieces: DataFrame, at: str = "t") -> DataFrame:
    """Each point with the piece that holds it, or null before the first. Pieces are few and go to the points as one sorted
    array a model, so points are not shuffled; pieces beyond the bounds meet the points in one ordered pass."""
    names = [c for c in pieces.columns if c != "model_id"]
    sizes = pieces.groupBy("model_id").agg(F.count("*").alias("n")).agg(F.sum("n").alias("all"), F.max("n").alias("one")).first()
    if (sizes["all"] or 0) > MOST_PIECES or (sizes["one"] or 0) > MOST_OF_ONE:
        return _as_of_ordered(points, pieces, at)
    held = pieces.groupBy("model_id").agg(F.array_sort(F.collect_list(F.struct("t0", *[n for n in names if n != "t0"]))).alias("_pieces"))
    found = points.join(F.broadcast(held), "model_id", "left").withColumn("_piece", F.try_element_at(F.filter("_pieces", lambda p: p["t0"] <= F.col(at)), F.lit(-1)))
    return found.select("model_id", *[c for c in points.columns if c != "model_id"], *[F.col(f"_piece.{n}").alias(n) for n in names])


def _as_of_ordered(points: DataFrame, pieces: DataFrame, at: str) -> DataFrame:
    names = [c for c in pieces.columns if c != "model_id"]
    point_names = [c for c in points.columns if c != "model_id"]
    a = pieces.select("model_id", F.col("t0").alias("_at"), F.lit(0).alias("_kind"), F.struct(*names).alias("_piece"), *[F.lit(None).cast(points.schema[c].dataType).alias(f"_p_{c}") for c in point_names])
    b = points.select("model_id", F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(a.schema["_piece"].dataType).alias("_piece"), *[F.col(c).alias(f"_p_{c}") for c in point_names])
    w = Window.partitionBy("model_id").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_piece", F.last("_piece", ignorenulls=True).over(w)).where("_kind = 1")
    return both.select("model_id", *[F.col(f"_p_{c}").alias(c) for c in point_names], "_piece.*")


def hazard_at(points: DataFrame, pieces: DataFrame) -> DataFrame:
    """R(t) of each point."""
    found = as_of(points, hazard(pieces))
    return found.withColumn("r", F.col("hazard") + (F.col("t") - F.col("t0")) / F.col("size"))


def time_of(points: DataFrame, pieces: DataFrame) -> DataFrame:
    """The time at which the cumulative hazard reaches y."""
    h = hazard(pieces)
    found = as_of(points, h.withColumnsRenamed({"t0": "start", "hazard": "t0"}), "y")
    return found.withColumn("t", F.col("start") + (F.col("y") - F.col("t0")) * F.col("size"))


def initial(states: DataFrame, pieces: DataFrame, floor: float = 1e-20) -> DataFrame:
    """Probability that two lineages meet in each hidden interval; states: model_id, m, t (its lower end)."""
    at = hazard_at(states, pieces).withColumn("s", F.exp(-F.col("r")))
    w = Window.partitionBy("model_id").orderBy("t")
    p = F.greatest(F.col("s") - F.coalesce(F.lead("s").over(w), F.lit(0.0)), F.lit(floor))
    return at.withColumn("p", p).withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("model_id"))).select("model_id", "m", "t", "p")


def aggregate(pieces: DataFrame, how=F.avg) -> DataFrame:
    """A statistic of several models at the union of their knots."""
    knots = pieces.select(F.col("t0").alias("t")).distinct()
    points = pieces.select("model_id").distinct().crossJoin(F.broadcast(knots))  # knots of models, not data
    return as_of(points, pieces).groupBy("t").agg(how("size").alias("size"), F.count("*").alias("models"))


def _renumbered(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("model_id").orderBy("t0")
    return rows.select("model_id", (F.row_number().over(w) - 1).alias("piece"), "t0", F.lead("t0").over(w).alias("t1"), "size")


def splice(recent: DataFrame, ancient: DataFrame, split: float) -> DataFrame:
    """``recent`` up to the split and ``ancient`` after it; both keyed by model_id."""
    a = recent.where(F.col("t0") < split).select("model_id", "t0", "size")
    b = ancient.where(F.col("t1").isNull() | (F.col("t1") > split)).select("model_id", F.greatest("t0", F.lit(split)).alias("t0"), "size")
    return _renumbered(a.unionByName(b))


def shift(pieces: DataFrame, t: float) -> DataFrame:
    """The model as seen from time t on."""
    kept = pieces.where(F.col("t1").isNull() | (F.col("t1") > t))
    return _renumbered(kept.select("model_id", (F.greatest("t0", F.lit(t)) - t).alias("t0"), "size"))


def truncate(pieces: DataFrame, t: float) -> DataFrame:
    return _renumbered(pieces.where(F.col("t0") < t).select("model_id", "t0", "size"))


def reduced_emission(times: DataFrame, theta: float, alpha: float = 1.0) -> DataFrame:
    """Probabilities of an even and an odd number of derived alleles in a pair; times: m, t (mean meeting time)."""
    x = -2 * alpha * theta * F.col("t")
    return times.select("m", F.coalesce(F.exp(x), F.lit(1e-20)).alias("even"), F.coalesce(1 - F.exp(x), F.lit(1e-20)).alias("odd"))


def units(mu: float, r: float | None = None, n0: float | None = None) -> dict[str, float]:
    """Reference size, scaled mutation and recombination rates."""
    n0 = 5e-5 / mu if n0 is None else n0
    return {"n0": n0, "theta": 2 * n0 * mu, "rho": 2 * n0 * r if r else 2 * n0 * mu}


def with_units(rows: DataFrame) -> DataFrame:
    """The same for columns mu and r, of which r may be null or 0."""
    n0 = 5e-5 / F.col("mu")
    r = F.coalesce(F.nullif("r", F.lit(0.0)), F.col("mu"))
    return rows.withColumns({"n0": n0, "theta": 2 * n0 * F.col("mu"), "rho": 2 * n0 * r})


def growing(name: str, pieces: list[tuple[float, float, float, float]]) -> list[tuple[str, int, float, float, float, float]]:
    """Rows (model_id, piece, t0, t1, size0, size1) of a history of exponential pieces, the last without an end."""
    return [(name, i, t0, t1, a, b) for i, (t0, t1, a, b) in enumerate(pieces)]


def size_at(points: DataFrame, pieces: DataFrame) -> DataFrame:
    """The size at each point (model_id, t) of a history of exponential pieces; null beyond its last."""
    inside = as_of(points, pieces).withColumn("share", (F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0")))
    return inside.withColumn("size", F.when(F.col("t") < F.col("t1"), F.col("size0") * F.pow(F.col("size1") / F.col("size0"), F.col("share")))).drop("share")


def to_json(pieces: DataFrame) -> DataFrame:
    rows = pieces.groupBy("model_id").agg(F.array_sort(F.collect_list(F.struct("t0", "size"))).alias("p"))
    return rows.select("model_id", F.to_json(F.struct(F.transform("p", lambda x: x["t0"]).alias("knots"), F.transform("p", lambda x: x["size"]).alias("y"))).alias("model"))


def from_json(rows: DataFrame) -> DataFrame:
    m = rows.select("model_id", F.from_json("model", "knots array<double>, y array<double>").alias("m"))
    return _renumbered(m.select("model_id", F.explode(F.arrays_zip("m.knots", "m.y")).alias("z")).select("model_id", F.col("z.knots").alias("t0"), F.col("z.y").alias("size")))


def demography(pieces: DataFrame, n0: float) -> DataFrame:
    """Size-change events in generations for a coalescent simulator."""
    return pieces.select("model_id", (F.col("t0") * 2 * n0).alias("generation"), (F.col("size") * n0).alias("size"))


def step_plot(pieces: DataFrame, n0: float = 1.0) -> DataFrame:
    """label, x, y, plot_type, plot_num of a step plot."""
    return pieces.select(F.col("model_id").alias("label"), (F.col("t0") * 2 * n0).alias("x"), (F.col("size") * n0).alias("y"), F.lit("step").alias("plot_type"), (F.dense_rank().over(Window.orderBy("model_id")) - 1).alias("plot_num"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def poly(t: Column, coefficients: list[float]) -> Column:
    """A polynomial by Horner's rule."""
    return reduce(lambda acc, c: acc * t + F.lit(c), coefficients, F.lit(0.0))
