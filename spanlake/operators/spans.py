"""Operators on span tables: contig_id, seq, span and a, b, nb for each population (a1, b1, nb1, a2, ...).

Every stateful rule is arithmetic on the running position, so each operator is one window over (contig_id, seq) and narrow
steps after it. Rows are split at boundaries, never expanded to bases.

A window over a contig is one task. Where contigs are long, operators take ``width``: rows are worked on in blocks of that
many numbers of seq (so of at most as many rows), each block is summed up in one row, and a contig's window runs over these
rows only."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

def ordered() -> WindowSpec:
    """The rows of a contig in order."""
    return Window.partitionBy("contig_id").orderBy("seq")


def populations(df: DataFrame) -> list[str]:
    """The numbers of the populations, as text."""
    return sorted(m[1] for c in df.columns if (m := re.fullmatch(r"a(\d+)", c)))


def observation(df: DataFrame) -> list[str]:
    return [f"{x}{p}" for p in populations(df) for x in ("a", "b", "nb")]


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, conditions)


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, columns)


#: A width for long contigs.
WIDTH = 1 << 20


def running(df: DataFrame, value: Column, name: str, width: int | None = None) -> DataFrame:
    """The sum of a value up to each row of its contig."""
    if not width:
        return df.withColumn(name, F.sum(value).over(ordered().rowsBetween(Window.unboundedPreceding, 0)))
    keys = ["contig_id", "_block"]
    rows = df.withColumns({"_value": value, "_block": F.expr(f"seq div {width}")})
    ahead = Window.partitionBy("contig_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys).agg(F.sum("_value").alias("_sum")).select(*keys, F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    within = F.sum("_value").over(Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_within", within).join(sums, keys)
    return rows.withColumn(name, F.col("_ahead") + F.col("_within")).select(*df.columns, name)


def positions(df: DataFrame, width: int | None = None) -> DataFrame:
    """start and stop of each row, from 0, half open."""
    return running(df, F.col("span"), "stop", width).withColumn("start", F.col("stop") - F.col("span"))


def lengths(df: DataFrame) -> DataFrame:
    return df.groupBy("contig_id").agg(F.sum("span").alias("bases"), F.count("*").alias("rows"))


def islands(df: DataFrame, same: list[str], width: int | None = None) -> DataFrame:
    """island: the number of changes of ``same`` up to each row of a contig."""
    key = F.struct(*same)
    if not width:
        changed = F.when(F.lag(key).over(ordered()).eqNullSafe(key), 0).otherwise(1)
        return df.withColumn("island", F.sum(changed).over(ordered().rowsBetween(Window.unboundedPreceding, 0)))
    keys = ["contig_id", "_block"]
    inside = Window.partitionBy(*keys).orderBy("seq")
    rows = df.withColumn("_block", F.expr(f"seq div {width}")).withColumn("_key", key)
    changed = F.when(F.lag("_key").over(inside).isNull() | F.lag("_key").over(inside).eqNullSafe(F.col("_key")), 0).otherwise(1)
    rows = rows.withColumn("_new", changed).withColumn("_within", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    sums = rows.groupBy(*keys).agg(F.sum("_new").alias("_n"), F.min_by("_key", "seq").alias("_first"), F.max_by("_key", "seq").alias("_last"))
    blocks = Window.partitionBy("contig_id").orderBy("_block")
    edge = F.when(F.lag("_last").over(blocks).eqNullSafe(F.col("_first")), 0).otherwise(1)
    sums = sums.withColumn("_edge", edge)
    ahead = F.sum(F.col("_n") + F.col("_edge")).over(blocks.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    rows = rows.join(sums.select(*keys, ahead.alias("_ahead")), keys)
    return rows.withColumn("island", F.col("_ahead") + F.col("_within")).select(*df.columns, "island")


def compress(df: DataFrame, width: int | None = None) -> DataFrame:
    """Merge neighbours of equal observation; rows without bases go first, and do not part equal neighbours."""
    names = observation(df)
    grouped = islands(df.where("span > 0"), names, width).groupBy("contig_id", "island", *names)
    return grouped.agg(F.min("seq").alias("seq"), F.sum("span").alias("span")).select("contig_id", "seq", "span", *names)


def expand_counts(df: DataFrame) -> DataFrame:
    """Rows and bases by observation, were each run unpacked."""
    return df.groupBy(*observation(df)).agg(F.sum("span").alias("bases"), F.count("*").alias("runs"))


def unpack(df: DataFrame) -> DataFrame:
    """A row a base: place is the number of the base in its run."""
    rows = df.where("span > 0").withColumn("place", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("span").cast("bigint") - 1)))
    return rows.select("contig_id", "seq", "place", *observation(df))


def decompress_polymorphic(df: DataFrame) -> DataFrame:
    """Unit rows for spans that carry a derived allele."""
    poly = reduce(lambda x, y: x | y, [(F.col(f"a{p}") > 0) | (F.col(f"b{p}") > 0) for p in populations(df)])
    pieces = F.when(poly, F.array_repeat(F.lit(1), F.col("span"))).otherwise(F.array("span"))
    return df.select("contig_id", "seq", F.posexplode(pieces).alias("part", "span"), *observation(df))


def recode_nonseg(df: DataFrame, cutoff: int) -> DataFrame:
    """Non-segregating runs longer than the cutoff become missing."""
    quiet = (F.col("span") > cutoff) & _all([(F.col(f"a{p}") == 0) & (F.col(f"b{p}") == 0) for p in populations(df)])
    new = {f"a{p}": F.when(quiet, -1).otherwise(F.col(f"a{p}")) for p in populations(df)}
    return df.withColumns(new | {f"nb{p}": F.when(quiet, 0).otherwise(F.col(f"nb{p}")) for p in populations(df)})


def _derived(df: DataFrame, na: tuple[int, ...], missing_too: bool) -> Column:
    """Rows in which all that was seen is derived, of pair and sample in every population."""
    pops = populations(df)
    pair = _all([F.col(f"a{p}") == n for p, n in zip(pops, na, strict=True)])
    if missing_too:
        pair = pair | _all([F.col(f"a{p}") == -1 for p in pops])
    return pair & _all([F.col(f"b{p}") == F.col(f"nb{p}") for p in pops])


def recode_monomorphic(df: DataFrame, na: tuple[int, ...] = (2,)) -> DataFrame:
    """Rows where every allele is derived become rows without a derived allele; na: the pair's alleles of each population."""
    derived = _derived(df, na, False)
    return df.withColumns({f"{x}{p}": F.when(derived, 0).otherwise(F.col(f"{x}{p}")) for p in populations(df) for x in ("a", "b")})


def _broken(df: DataFrame, na: tuple[int, ...], n: tuple[int, ...] | None, strict: bool) -> Column:
    pops = populations(df)
    wrong = [(F.col(f"b{p}") > F.col(f"nb{p}")) | (F.col(f"a{p}") > most) for p, most in zip(pops, na, strict=True)]
    wrong += [F.col(f"nb{p}") > most for p, most in zip(pops, n, strict=True)] if n else []
    any_wrong = reduce(lambda x, y: x | y, wrong)
    return (F.col("span") <= 0) | (any_wrong if strict else (F.col("span") == 1) & any_wrong)


def bad_rows(df: DataFrame, na: tuple[int, ...] = (2,), n: tuple[int, ...] | None = None, strict: bool = True) -> DataFrame:
    """Rows that break the rules: no bases, more derived than sampled, more than na in the pair, more sampled than n. Without
    ``strict`` only unit rows are held to all but the first."""
    return df.where(_broken(df, na, n, strict))


def unfounded(df: DataFrame, na: tuple[int, ...] = (2,)) -> DataFrame:
    """Rows whose sample is all derived, with a pair that is so too or missing, lose the sample's derived alleles."""
    pops = populations(df)
    seen = reduce(lambda x, y: x | y, [F.col(f"nb{p}") > 0 for p in pops])
    derived = _derived(df, na, True) & seen
    return df.withColumns({f"b{p}": F.when(derived, 0).otherwise(F.col(f"b{p}")) for p in pops})


def validate(df: DataFrame, na: tuple[int, ...] = (2,), n: tuple[int, ...] | None = None, strict: bool = True) -> DataFrame:
    """unfounded(), then fail on a bad row."""
    out = unfounded(df, na)
    return out.withColumn("span", F.when(_broken(out, na, n, strict), F.raise_error(F.lit("invalid span row"))).otherwise(F.col("span")))


def required(df: DataFrame, what: str) -> DataFrame:
    """The same table; fails at once where it is empty."""
    if not df.limit(1).count():
        raise ValueError(f"nothing is left: {what}")
    return df


def load_checks(df: DataFrame, headers: DataFrame) -> DataFrame:
    """Contigs with rows, bases and whether what a data set must fulfil holds: at most two populations, two distinguished
    lineages in all and at most two in each, as many columns as populations. headers: contig_id, pids, undist, dist."""
    a = F.transform("dist", lambda x: F.size(x))
    pops = headers.select(F.explode("pids").alias("pid")).agg(F.count_distinct("pid").alias("n_pops"))
    fine = (F.size("dist") == F.size("undist")) & (F.size("dist") == len(populations(df))) & F.forall(a, lambda x: x.between(0, 2)) & (F.aggregate(a, F.lit(0), lambda x, y: x + y) == 2)
    rows = lengths(df).join(headers, "contig_id", "left").join(F.broadcast(pops))  # one row
    return rows.select("contig_id", "rows", "bases", F.coalesce(fine & (F.col("n_pops") <= 2), F.lit(False)).alias("ok"))


def informative(df: DataFrame) -> Column:
    pops = populations(df)
    return (_sum([F.col(f"a{p}") for p in pops]) > 0) | (_sum([F.col(f"b{p}") for p in pops]) > 0)


def drop_uninformative(df: DataFrame, keys: tuple[str, ...] = ("contig_id",)) -> DataFrame:
    """Keep the pieces with a row that carries a derived allele."""
    return df.join(df.where(informative(df)).select(*keys).distinct(), list(keys), "left_semi")


def drop_small(df: DataFrame, cutoff: int) -> DataFrame:
    """Keep the contigs of more than ``cutoff`` bases."""
    return df.join(lengths(df).where(F.col("bases") > cutoff).select("contig_id"), "contig_id", "left_semi")


def region(df: DataFrame, start: int, end: int) -> DataFrame:
    """Rows that end within [start, end], behind one missing base; seq of that base is -1."""
    names = observation(df)
    kept = positions(df).where(F.col("stop").between(start, end)).select("contig_id", "seq", "span", *names)
    return kept.unionByName(_missing(df.select("contig_id").distinct(), names))


def _missing(contigs: DataFrame, names: list[str]) -> DataFrame:
    values = [F.lit(-1 if n.startswith("a") else 0).alias(n) for n in names]
    return contigs.select("*", F.lit(-1).cast("bigint").alias("seq"), F.lit(1).alias("span"), *values)


def head(df: DataFrame, n: int = 10) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(ordered())).where(F.col("_n") <= n).drop("_n")


def thin(df: DataFrame, k: int, width: int | None = None) -> DataFrame:
    """Full observations at every k-th base only; elsewhere the undistinguished sample is dropped. Rows of a homozygous
    derived pair give an empty observation everywhere."""
    pops = populations(df)
    both = _sum([F.col(f"a{p}") for p in pops]) == 2
    rows = positions(df, width).withColumn("i", F.explode(F.expr(f"sequence(0L, stop div {k} - start div {k})")))
    mark, last = F.expr(f"(start div {k} + i) * {k}"), F.expr(f"i = stop div {k} - start div {k}")
    a = F.when(F.col("i") == 0, F.col("start")).otherwise(mark)
    b = F.when(last, F.col("stop")).otherwise(mark + (k - 1))
    pieces = F.array(F.struct(a.alias("at"), (b - a).alias("n"), F.lit(False).alias("full")), F.struct((mark + (k - 1)).alias("at"), F.when(last, F.lit(0)).otherwise(F.lit(1)).cast("bigint").alias("n"), F.lit(True).alias("full")))
    rows = rows.withColumn("piece", F.explode(pieces)).where("piece.n > 0")
    out = [F.when(both, 0).otherwise(F.col(f"a{p}")).alias(f"a{p}") for p in pops]
    out += [F.when(both | ~F.col("piece.full"), 0).otherwise(F.col(f"{x}{p}")).alias(f"{x}{p}") for p in pops for x in ("b", "nb")]
    return rows.select("contig_id", "seq", F.col("piece.at").alias("start"), F.col("piece.n").alias("span"), *out)


def default_thinning(n: int) -> int:
    return int(500 * math.log(2 + n))


def realign(df: DataFrame, w: int, width: int | None = None) -> DataFrame:
    """Split rows at every multiple of w; win is the number of the window."""
    rows = positions(df, width).withColumn("win", F.explode(F.expr(f"sequence(start div {w}, (stop - 1) div {w})")))
    a, b = F.greatest("start", F.col("win") * w), F.least("stop", (F.col("win") + 1) * w)
    return rows.select("contig_id", "seq", "win", a.alias("start"), (b - a).alias("span"), *observation(df))


def chunk(df: DataFrame, w: int, width: int | None = None) -> DataFrame:
    """Blocks of exactly w bases; a short tail goes."""
    rows = realign(df, w, width)
    full = F.sum("span").over(Window.partitionBy("contig_id", "win")) == w
    return rows.withColumn("_full", full).where("_full").drop("_full")


def break_long(df: DataFrame, cutoff: int, width: int | None = None) -> DataFrame:
    """Split contigs at missing runs of ``cutoff`` bases or more, which go; each piece, an empty one too, begins with one
    missing base."""
    names = observation(df)
    long = (F.col("span") >= cutoff) & _all([(F.col(f"a{p}") == -1) & (F.col(f"nb{p}") == 0) for p in populations(df)])
    rows = running(df.withColumn("long", long.cast("int")), F.col("long"), "piece", width)
    pieces = rows.groupBy("contig_id").agg(F.sum("long").alias("n")).select("contig_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n"))).alias("piece"))
    return rows.where("long = 0").select("contig_id", "piece", "seq", "span", *names).unionByName(_missing(pieces, names))


def group_rows(df: DataFrame, n: int) -> DataFrame:
    """The rows of grouped() with grp and place (0 to n - 1); rows without seq and observation complete a contig's last group."""
    names = observation(df)
    at = F.row_number().over(ordered()) - 1
    rows = df.select("contig_id", "seq", "span", *names, at.alias("_at"))
    rows = rows.select("contig_id", F.floor(F.col("_at") / n).alias("grp"), (F.col("_at") % n).cast("int").alias("place"), "seq", "span", *names)
    left = df.groupBy("contig_id").agg(F.count("*").alias("_n")).where(F.col("_n") % n > 0)
    left = left.select("contig_id", F.floor(F.col("_n") / n).alias("grp"), F.explode(F.sequence((F.col("_n") % n).cast("int"), F.lit(n - 1))).alias("place"))
    return rows.unionByName(left, allowMissingColumns=True)


def grouped(df: DataFrame, n: int) -> DataFrame:
    """Fixed-size groups of rows in order; ``filled`` rows would complete the last group."""
    rows = df.withColumn("grp", F.floor((F.row_number().over(ordered()) - 1) / n))
    return rows.groupBy("contig_id", "grp").agg(F.count("*").alias("rows"), F.sum("span").alias("bases"), (F.lit(n) - F.count("*")).alias("filled"))


def mutation_counts(df: DataFrame, w: int) -> DataFrame:
    """By window: bases where every pair is called, and those of them with an odd number of derived alleles."""
    pops = populations(df)
    called, odd = _all([F.col(f"a{p}") >= 0 for p in pops]), _sum([F.col(f"a{p}") for p in pops]) % 2 == 1
    return realign(df, w).groupBy("contig_id", "win").agg(F.sum(F.when(called, F.col("span")).otherwise(0)).alias("nm"), F.sum(F.when(called & odd, F.col("span")).otherwise(0)).alias("mut"))


def mutation_rates(df: DataFrame, w: int) -> DataFrame:
    return mutation_counts(df, w).where(F.col("nm") * 2 > w).select("contig_id", "win", (F.col("mut") * w / F.col("nm")).alias("rate"))


def quantiles(df: DataFrame, column: str, probabilities: tuple[float, ...], plot: float = 0.4) -> DataFrame:
    """Quantiles at plotting position (plot, plot). Values are counted first, so that the ordered window runs over distinct
    values, and only the order statistics that are asked for are looked up."""
    counts = df.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    upto = counts.withColumn("hi", F.sum("c").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("lo", F.col("hi") - F.col("c"))
    asked = df.agg(F.count("*").alias("n")).select("n", F.explode(F.array(*map(F.lit, probabilities))).alias("prob"))
    aleph = F.col("n") * F.col("prob") + plot + F.col("prob") * (1 - 2 * plot)
    asked = asked.withColumn("k", F.floor(F.greatest(F.lit(1.0), F.least(aleph, F.col("n") - 1.0)))).withColumn("g", F.greatest(F.lit(0.0), F.least(aleph - F.col("k"), F.lit(1.0))))
    asked = asked.where("n > 0")
    first, second = (upto.select(F.col("v").alias(n), F.col("lo").alias(f"{n}_lo"), F.col("hi").alias(f"{n}_hi")) for n in ("x", "y"))
    above = F.least(F.col("k") + 1, F.col("n"))
    found = F.broadcast(asked).join(first, (F.col("x_lo") < F.col("k")) & (F.col("k") <= F.col("x_hi")))  # a row for each probability
    found = F.broadcast(found).join(second, (F.col("y_lo") < above) & (above <= F.col("y_hi")))
    return found.select("prob", ((1 - F.col("g")) * F.col("x") + F.col("g") * F.col("y")).alias("value"))


def bin_observations(df: DataFrame, w: int, na: int = 2) -> DataFrame:
    """One row for each window of w bases: the first best-sampled one; where the best has two alleles only, the last
    heterozygous one from there on."""
    pops = populations(df)
    rows = realign(df, w)
    sample = _sum([F.col(f"nb{p}") + F.when(F.col(f"a{p}") >= 0, na).otherwise(0) for p in pops])
    het = _sum([F.greatest(F.col(f"a{p}"), F.lit(0)) for p in pops]) == 1
    win = Window.partitionBy("contig_id", "win")
    rows = rows.withColumns({"s": sample, "het": het}).withColumn("m", F.max("s").over(win))
    rows = rows.withColumn("f", F.min(F.when(F.col("s") == F.col("m"), F.col("start"))).over(win))
    preferred = F.when((F.col("m") == 2) & F.col("het") & (F.col("start") >= F.col("f")), F.col("start"))
    rows = rows.withColumn("rank", F.coalesce(preferred + 1, F.when(F.col("start") == F.col("f"), F.lit(0)), F.lit(-1)))
    names = observation(df)
    best = rows.groupBy("contig_id", "win").agg(F.max_by(F.struct(*names), "rank").alias("o"))
    return best.select("contig_id", F.col("win").alias("seq"), F.lit(1).alias("span"), "o.*")


def watterson(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Segregating bases over the bases weighted by their harmonic numbers; a pair counts once in a sample."""
    pops = populations(df)
    s = _sum([F.col(f"nb{p}") + F.when(F.col(f"a{p}") >= 0, 1).otherwise(0) for p in pops])
    seg = reduce(lambda x, y: x | y, [(F.col(f"a{p}") >= 1) | (F.col(f"b{p}") > 0) for p in pops])
    rows = df.withColumns({"_s": s, "_seg": seg}).where("_s > 0")
    weight = F.sum(F.col("span") * (F.log("_s") + F.lit(0.5) / F.col("_s") + F.lit(0.57721)))
    return rows.groupBy(*keys).agg((F.sum(F.when(F.col("_seg"), F.col("span")).otherwise(0)) / weight).alias("theta"))


def segregating(df: DataFrame) -> DataFrame:
    return df.groupBy("contig_id").agg(F.count_if(informative(df)).alias("sites"))


def transitions(df: DataFrame, state: str) -> DataFrame:
    """Counts of neighbouring states."""
    rows = df.withColumn("s2", F.lead(state).over(ordered())).where("s2 is not null")
    return rows.groupBy(F.col(state).alias("s1"), "s2").agg(F.count("*").alias("n"))


def blocks_text(df: DataFrame, w: int = 100, line: int = 79) -> DataFrame:
    """Each contig as text, one letter a bin: N missing, K heterozygous, T else; lines are numbered."""
    letter = F.when(F.col("a1") < 0, "N").when(F.col("a1") == 1, "K").otherwise("T")
    rows = bin_observations(df, w).select("contig_id", "seq", F.expr(f"seq div {line}").alias("line"), letter.alias("c"))
    return rows.groupBy("contig_id", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "c"))), lambda x: x["c"]), "").alias("text"))


def canonical(df: DataFrame) -> DataFrame:
    """Two populations, the distinguished one first: rows of pairs (0, 2) are swapped."""
    swap = F.col("dist2") == 2
    return df.withColumns({f"{x}{p}": F.when(swap, F.col(f"{x}{3 - p}")).otherwise(F.col(f"{x}{p}")) for p in (1, 2) for x in ("a", "b", "nb")})
