"""Observation keys: distinct keys, expansion of missing pairs, marginalisation, polarisation and emission mixtures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["a1", "b1", "nb1"]


def distinct(df: DataFrame) -> DataFrame:
    return df.select(*KEY).distinct()


def targets(df: DataFrame) -> DataFrame:
    """Distinct (span, key) of runs longer than one base."""
    return df.where("span > 1").select("span", *KEY).distinct()


def monomorphic(na: int = 2) -> Column:
    return ((F.col("a1") == 0) & (F.col("b1") == 0)) | ((F.col("a1") == na) & (F.col("b1") == F.col("nb1")))


def folded(keys: DataFrame, na: int = 2) -> DataFrame:
    """The key with ancestral and derived exchanged; a missing pair stays missing."""
    return keys.withColumns({"fa": F.when(F.col("a1") < 0, F.col("a1")).otherwise(na - F.col("a1")), "fb": F.col("nb1") - F.col("b1")})


def folded_inside(keys: DataFrame, na: tuple[int, ...] = (2,)) -> DataFrame:
    """The other rule of exchange: a pair that is seen is exchanged, a sample only if some but not all of it is derived."""
    out = {}
    for p, n in enumerate(na, 1):
        a, b, nb = F.col(f"a{p}"), F.col(f"b{p}"), F.col(f"nb{p}")
        out |= {f"fa{p}": F.when(a >= 0, n - a).otherwise(a), f"fb{p}": F.when((b > 0) & (b < nb), nb - b).otherwise(b)}
    return keys.withColumns(out)


def sampled(keys: DataFrame) -> DataFrame:
    """n: the undistinguished lineages that a key sees, over all populations."""
    columns = [c for c in keys.columns if c.startswith("nb")]
    return keys.withColumn("n", reduce(lambda x, y: x + y, [F.col(c) for c in columns]))


def most_sampled(df: DataFrame) -> DataFrame:
    """The largest sample, and the values that the pair takes, of each population."""
    pops = [c[1:] for c in df.columns if c[0] == "a" and c[1:].isdigit()]
    aggregates = [x for p in pops for x in (F.max(f"nb{p}").alias(f"n{p}"), F.array_sort(F.collect_set(f"a{p}")).alias(f"values{p}"))]
    return df.agg(*aggregates)


def cross(keys: DataFrame, n: tuple[int, ...], na: tuple[int, ...]) -> DataFrame:
    """Keys of several populations as mixtures of full keys: the bins of each population (every value of a missing pair,
    hypergeometric weights of its sample) in all combinations, with the product of their weights."""
    out = keys
    for p, (size, pair) in enumerate(zip(n, na, strict=True), 1):
        own = keys.select(*[F.col(f"{x}{p}").alias(f"{x}1") for x in ("a", "b", "nb")]).distinct()
        bins = marginalise(own, size).withColumn("to", F.explode(F.when(F.col("a1") < 0, F.sequence(F.lit(0), F.lit(pair))).otherwise(F.array("a1"))))
        bins = bins.select(*[F.col(f"{x}1").alias(f"{x}{p}") for x in ("a", "b", "nb")], F.col("to").alias(f"to_a{p}"), F.col("full").alias(f"to_b{p}"), F.col("weight").alias(f"_w{p}"))
        out = out.join(bins, [f"{x}{p}" for x in ("a", "b", "nb")])
    weight = reduce(lambda x, y: x * y, [F.col(f"_w{p}") for p in range(1, len(n) + 1)])
    return out.withColumn("weight", weight).drop(*[f"_w{p}" for p in range(1, len(n) + 1)])


def for_population(df: DataFrame, p: int) -> DataFrame:
    """The span rows of one population of several, as rows of one."""
    return df.select("contig_id", "seq", "span", *[F.col(f"{x}{p}").alias(f"{x}1") for x in ("a", "b", "nb")])


def expand_missing(keys: DataFrame, na: int = 2) -> DataFrame:
    """A missing pair stands for every number of derived alleles."""
    all_ = F.when(F.col("a1") < 0, F.sequence(F.lit(0), F.lit(na))).otherwise(F.array("a1"))
    return keys.select(*KEY, F.explode(all_).alias("a"))


def log_factorials(spark, n: int) -> DataFrame:
    """(i, lf): ln i! for i up to n, as running sums of logarithms."""
    rows = spark.range(n + 1).select(F.col("id").alias("i"), F.log(F.greatest(F.col("id"), F.lit(1))).alias("l"))
    return rows.select("i", F.sum("l").over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)).alias("lf"))


def marginalise(keys: DataFrame, n: int) -> DataFrame:
    """Keys with nb of n sampled alleles called, as a mixture of full keys: hypergeometric weights."""
    facts = log_factorials(keys.sparkSession, n).agg(F.array_sort(F.collect_list(F.struct("i", "lf"))).alias("f")).select(F.transform("f", lambda x: x["lf"]).alias("f"))
    rows = keys.where(F.col("nb1") <= n).crossJoin(F.broadcast(facts))  # one row of n + 1 numbers
    rows = rows.withColumn("full", F.explode(F.sequence(F.col("b1"), n + F.col("b1") - F.col("nb1"))))
    choose = lambda x, y: F.element_at("f", x + 1) - F.element_at("f", y + 1) - F.element_at("f", x - y + 1)
    weight = F.exp(choose(F.col("full"), F.col("b1")) + choose(n - F.col("full"), F.col("nb1") - F.col("b1")) - choose(F.lit(n), F.col("nb1")))
    return rows.select(*KEY, "full", weight.alias("weight"))


def polarise(weights: DataFrame, p: float, na: int = 2) -> DataFrame:
    """Each key's mass goes to its folded key with probability p. What is all derived is first taken as all ancestral; what
    is all derived after that goes, and the rest sums to 1 by ``grp``."""
    derived = (F.col("a1") == na) & (F.col("b1") == F.col("nb1"))
    start = weights.select("grp", *[F.when(derived, 0).otherwise(F.col(c)).alias(c) for c in ("a1", "b1")], "nb1", "mass")
    sides = F.array(F.struct("a1", "b1", (F.col("mass") * (1 - p)).alias("mass")), F.struct((na - F.col("a1")).alias("a1"), (F.col("nb1") - F.col("b1")).alias("b1"), (F.col("mass") * p).alias("mass")))
    both = start.select("grp", "nb1", F.inline(sides))
    kept = both.where(~derived & (F.col("mass") > 0)).groupBy("grp", *KEY).agg(F.sum("mass").alias("mass"))
    return kept.withColumn("mass", F.col("mass") / F.sum("mass").over(Window.partitionBy("grp")))


def emission_lookup(df: DataFrame, emission: DataFrame) -> DataFrame:
    """Rows with the probability of their key in each state; ``emission`` has a row for each distinct key and state."""
    return df.join(emission, KEY)


def mixture(bins: DataFrame, emission: DataFrame) -> DataFrame:
    """Probability of a key in state m: its bins' emissions by weight."""
    return bins.join(emission, ["a", "full"]).groupBy(*KEY, "m").agg(F.sum(F.col("weight") * F.col("p")).alias("p"))
