"""From genotype calls and interval masks to span tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import spans

#: Widths of cells as powers of 2; intervals of one width, each in two cells at most, that may be broadcast.
LEVELS, MOST_CELLS = (6, 10, 14, 18, 22, 26), 500_000


def snps(variants: DataFrame) -> DataFrame:
    """Records of at most two alleles of one letter; monomorphic ones pass."""
    one = F.forall("alts", lambda a: F.length(a) == 1)
    return variants.where((F.size("alts") <= 1) & (F.length("ref") == 1) & one)


def lineages(spark: SparkSession, populations: dict[str, list], distinguished: list[tuple] | None = None) -> DataFrame:
    """sid, hap, pop (from 1), dist: the role of each haplotype. The distinguished are two (sample, haplotype); by default
    both haplotypes of the first sample."""
    names = [sid for samples in populations.values() for sid in samples]
    if len(names) != len(set(names)):
        raise ValueError("a sample is named twice, or in two populations")
    pair = [(names[0], 0), (names[0], 1)] if distinguished is None else distinguished
    if len(set(pair)) != 2 or {sid for sid, _ in pair} - set(names):
        raise ValueError("two distinguished haplotypes of listed samples are needed")
    rows = [(sid, hap, pop, (sid, hap) in pair) for pop, samples in enumerate(populations.values(), 1) for sid in samples for hap in (0, 1)]
    return spark.createDataFrame(rows, f"sid {'int' if isinstance(names[0], int) else 'string'}, hap int, pop int, dist boolean")


def project_roles(calls: DataFrame, roles: DataFrame, populations: int = 1) -> DataFrame:
    """Long genotypes to one row a site, three columns a population: derived alleles of its distinguished haplotypes (-1 if
    one is missing, 0 if it has none), derived and called alleles of its others."""
    alleles = calls.select("contig", "pos", "sid", F.posexplode(F.array("h0", "h1")).alias("hap", "allele"))
    rows = alleles.join(F.broadcast(roles), ["sid", "hap"])  # a row for each sampled haplotype
    out = []
    for p in range(1, populations + 1):
        own, other = (F.col("pop") == p) & F.col("dist"), (F.col("pop") == p) & ~F.col("dist")
        lost = F.count_if(own & F.col("allele").isNull()) > 0
        out += [F.when(lost, -1).otherwise(F.coalesce(F.sum(F.when(own, F.col("allele"))), F.lit(0))).cast("int").alias(f"a{p}"), F.coalesce(F.sum(F.when(other, F.col("allele"))), F.lit(0)).cast("int").alias(f"b{p}"), F.count_if(other & F.col("allele").isNotNull()).cast("int").alias(f"nb{p}")]
    return rows.groupBy("contig", "pos").agg(*out)


def project(calls: DataFrame, distinguished: int = 1) -> DataFrame:
    """project_roles() for one population and both haplotypes of one sample, without a table of roles."""
    own = F.col("sid") == distinguished
    n = F.when(F.col("h0").isNull(), 0).otherwise(1) + F.when(F.col("h1").isNull(), 0).otherwise(1)
    d = F.coalesce("h0", F.lit(0)) + F.coalesce("h1", F.lit(0))
    sums = calls.groupBy("contig", "pos").agg(F.sum(F.when(own, n).otherwise(0)).alias("na"), F.sum(F.when(own, d).otherwise(0)).alias("da"), F.sum(F.when(~own, d).otherwise(0)).alias("b1"), F.sum(F.when(~own, n).otherwise(0)).alias("nb1"))
    return sums.select("contig", "pos", F.when(F.col("na") == 2, F.col("da")).otherwise(-1).cast("int").alias("a1"), F.col("b1").cast("int").alias("b1"), F.col("nb1").cast("int").alias("nb1"))


def fold_monomorphic(sites: DataFrame, na: tuple[int, ...] = (2,)) -> DataFrame:
    """Sites where all called alleles are derived count as sites without a derived one."""
    return spans.recode_monomorphic(sites, na)


def outside(sites: DataFrame, mask: DataFrame) -> DataFrame:
    """Sites in no mask interval. Intervals are dealt by their length to cells of LEVELS widths, so that one touches a few
    cells and, where they do not overlap, a cell holds a few; sites go past the cells of each width that there is. The range
    test is the rest of an equi-join, and cells are broadcast where they are few."""
    length = F.col("m_end") - F.col("m_start")
    level = F.coalesce(*[F.when(length <= (1 << n), F.lit(n)) for n in LEVELS], F.lit(LEVELS[-1]))
    dealt = mask.where(length > 0).select(F.col("contig").alias("_c"), "m_start", "m_end", level.alias("_l"))
    counts = {r["_l"]: r["n"] for r in dealt.groupBy("_l").agg(F.count("*").alias("n"), F.sum(length).alias("b")).collect()}  # a row a width
    for n in sorted(counts):
        cells = dealt.where(F.col("_l") == n).withColumn("_b", F.explode(F.expr(f"sequence(shiftright(m_start, {n}), shiftright(m_end - 1, {n}))")))
        cells = F.broadcast(cells) if counts[n] <= MOST_CELLS and n < LEVELS[-1] else cells
        at = F.col("pos") - 1
        on = (F.col("contig") == F.col("_c")) & (F.shiftright(at, n) == F.col("_b")) & (F.col("m_start") <= at) & (at < F.col("m_end"))
        sites = sites.join(cells, on, "left_anti")
    return sites


def merged(mask: DataFrame) -> DataFrame:
    """Disjoint intervals; touching ones join."""
    w = Window.partitionBy("contig").orderBy("m_start", "m_end")
    before = F.max("m_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = mask.withColumn("_new", F.when(before >= F.col("m_start"), 0).otherwise(1))
    rows = rows.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("contig", "_g").agg(F.min("m_start").alias("m_start"), F.max("m_end").alias("m_end")).drop("_g")


def first_per_position(calls: DataFrame, order: list[str]) -> DataFrame:
    w = Window.partitionBy("contig", "pos").orderBy(*order)
    return calls.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def duplicates(samples: DataFrame, keys: list[str]) -> DataFrame:
    return samples.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing_samples(asked: DataFrame, present: DataFrame) -> DataFrame:
    return asked.join(present, "sid", "left_anti")


def events(sites: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """Sites outside the mask and the mask's intervals, as (contig, a, b, masked) and the counts."""
    names = spans.observation(sites)
    rows = sites if mask is None else outside(sites, mask)
    out = rows.select("contig", (F.col("pos") - 1).alias("a"), F.col("pos").alias("b"), F.lit(False).alias("masked"), *names)
    if mask is None:
        return out
    none = [F.lit(-1 if n.startswith("a") else 0).alias(n) for n in names]
    return out.unionByName(merged(mask).select("contig", F.col("m_start").alias("a"), F.col("m_end").alias("b"), F.lit(True).alias("masked"), *none))


def gap_fill(rows: DataFrame, lengths: DataFrame, cutoff: int | None = None, drop_first_last: bool = False) -> DataFrame:
    """Non-segregating spans between events and up to the contig's length. A gap before a site that is longer than the cutoff
    is missing; gaps before masks and the tail are not. ``lengths``: contig, length, and n1 (n2) sampled haplotypes. With
    drop_first_last what is written first (the first gap; a site at the first base) and the tail are left out."""
    pops, names = spans.populations(rows), spans.observation(rows)
    sizes = [f"n{p}" for p in pops]
    # the end of a contig is a row too, and its gap is the tail: all comes from one pass over the events
    ends = lengths.select("contig", F.col("length").alias("a"), F.col("length").alias("b"), F.lit(False).alias("masked"), *[F.lit(0).alias(n) for n in names], *sizes, F.lit(True).alias("end"))
    both = rows.select("contig", "a", "b", "masked", *names, *[F.lit(None).cast("int").alias(n) for n in sizes], F.lit(False).alias("end")).unionByName(ends)
    contig, w = Window.partitionBy("contig"), Window.partitionBy("contig").orderBy("a")
    known = both.withColumns({"length": F.max(F.when(F.col("end"), F.col("a"))).over(contig), **{n: F.max(n).over(contig) for n in sizes}})
    known = known.withColumn("b", F.least("b", "length")).where("end or a < b")
    before = F.lag("b").over(w)
    known = known.withColumn("p", F.coalesce(before, F.lit(0).cast("bigint"))).withColumn("first", before.isNull())
    gap_first = F.col("first") & (F.col("masked") | (F.col("a") > F.col("p")))
    quiet = [x for p in pops for x in (F.lit(0).alias(f"a{p}"), F.lit(0).alias(f"b{p}"), F.col(f"n{p}").cast("int").alias(f"nb{p}"))]
    gap = F.struct(F.col("p").alias("at"), (F.col("a") - F.col("p")).alias("span"), *quiet, (gap_first | F.col("end")).alias("edge"), (~(F.col("masked") | F.col("end"))).alias("cut"))
    own = F.struct(F.col("a").alias("at"), (F.col("b") - F.col("a")).alias("span"), *names, (F.col("first") & ~gap_first).alias("edge"), F.lit(False).alias("cut"))
    out = known.select("contig", F.inline(F.array(gap, own))).where("span > 0")
    if drop_first_last:
        out = out.where("not edge")
    if cutoff is not None:
        long = F.col("cut") & (F.col("span") > cutoff)
        out = out.withColumns({n: F.when(long, -1 if n.startswith("a") else 0).otherwise(F.col(n)) for n in names})
    return out.select(F.col("contig").alias("contig_id"), F.col("at").alias("seq"), "span", *names)


def contig_lengths(sites: DataFrame, pad: int = 10) -> DataFrame:
    """contig, length and the largest sample, where neither a header nor a list of samples is there."""
    return sites.groupBy("contig").agg((F.max("pos") + pad).alias("length"), *[F.max(f"nb{p}").alias(f"n{p}") for p in spans.populations(sites)])


def track(calls: DataFrame, w: int) -> DataFrame:
    """Mean allele by window of positions; missing ones are skipped."""
    return calls.groupBy("contig", F.expr(f"pos div {w}").alias("win")).agg(F.avg("h0").alias("mean"), F.count("h0").alias("n"))
