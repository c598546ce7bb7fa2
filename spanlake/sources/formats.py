"""Readers and writers of other programs' formats: coalescence-rate tables, genotype matrices, mask sequences, per-base
bytes, arrays, tree tracks, segregating-site lists and curves."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_ROW = (1 << 33) - 1


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """line (from 0, without gaps) and value of one text file. Lines are counted by input split; what goes to the driver is
    one count for each."""
    rows = spark.read.text(path).select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW)).alias("i"), "value")
    counts = {r.part: r.n for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}
    starts = dict(zip(sorted(counts), np.cumsum([0, *[counts[k] for k in sorted(counts)]]).tolist(), strict=False))
    if not starts:
        return rows.select(F.col("i").alias("line"), "value")
    start = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv])
    return rows.select((start[F.col("part")] + F.col("i")).cast("bigint").alias("line"), "value")


def coalescence_rates(spark: SparkSession, path: str, model_id: str, mu: float) -> DataFrame:
    """Pieces of a table ``time_index left right rate``: times in units of 1 / mu generations become generations."""
    cells = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(r"value rlike '^\\s*[0-9]'").select(*[cells[i].cast("double").alias(n) for i, n in ((1, "left"), (3, "rate"))])
    w = Window.partitionBy("model_id").orderBy("t0")
    rows = rows.select(F.lit(model_id).alias("model_id"), (F.col("left") / mu).alias("t0"), (1 / F.col("rate") / (2 * mu)).alias("size"))
    return rows.select("model_id", (F.row_number().over(w) - 1).alias("piece"), "t0", F.lead("t0").over(w).alias("t1"), "size")


def genotype_matrix(spark: SparkSession, geno: str, snp: str) -> DataFrame:
    """contig, pos, sid, copies (null where 9) of a matrix of one digit a sample, a line for each line of the site list
    ``id contig map pos ref alt``."""
    cells = F.split(F.trim("value"), r"\s+")
    sites = numbered(spark, snp).select("line", cells[1].alias("contig"), cells[3].cast("bigint").alias("pos"))
    rows = numbered(spark, geno).join(sites, "line").select("contig", "pos", F.posexplode(F.split(F.trim("value"), "(?<=.)(?=.)")).alias("sid", "digit"))
    return rows.select("contig", "pos", "sid", F.when(F.col("digit") != "9", F.col("digit").cast("int")).alias("copies"))


def mask_sequence(spark: SparkSession, path: str, chromosome: str, keep: str = "1") -> DataFrame:
    """contig, m_start, m_end of the bases of one chromosome that are not ``keep``: runs within lines, to be merged with
    ingest.merged. A line's place comes from running lengths over the lines of that chromosome only."""
    lines = numbered(spark, path)
    heads = lines.where("value like '>%'").select("line", F.regexp_extract("value", r"^>\s*(\S+)", 1).alias("name"))
    names = sorted((r.line, r.name) for r in heads.collect())  # one row a chromosome
    at = next((i for i, (_, n) in enumerate(names) if n == chromosome), None)
    if at is None:
        raise ValueError(f"no sequence {chromosome}")
    stop = names[at + 1][0] if at + 1 < len(names) else None
    body = lines.where(F.col("line") > names[at][0]).where(F.lit(True) if stop is None else F.col("line") < stop).withColumn("value", F.trim("value"))
    w = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    body = body.withColumn("block", F.floor(F.col("line") / 4096)).withColumn("size", F.length("value"))
    offset = body.groupBy("block").agg(F.sum("size").alias("n")).select("block", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))
    inner = Window.partitionBy("block").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    placed = body.join(offset, "block").withColumn("base", F.col("base") + F.coalesce(F.sum("size").over(inner), F.lit(0)))

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for base, value in zip(batch["base"], batch["value"], strict=True):
                bad = np.frombuffer(value.encode(), np.uint8) != ord(keep)
                edges = np.flatnonzero(np.diff(np.r_[False, bad, False].astype(np.int8)))
                out += [(chromosome, base + a, base + b) for a, b in edges.reshape(-1, 2).tolist()]
            yield pd.DataFrame(out, columns=["contig", "m_start", "m_end"])

    return placed.select("base", "value").mapInPandas(runs, "contig string, m_start bigint, m_end bigint")


def base_runs(spark: SparkSession, path: str) -> DataFrame:
    """file, start, span, value: runs of equal signed bytes of binary files; a file is one sequence and fits a task."""

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                x = np.frombuffer(content, np.int8)
                at = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, int)
                yield pd.DataFrame({"file": name, "start": at, "span": np.diff(np.r_[at, len(x)]), "value": x[at].astype(np.int32)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(runs, "file string, start bigint, span bigint, value int")


def array_rows(spark: SparkSession, path: str, array: str) -> DataFrame:
    """file, row and values of a two-dimensional array of .npz files."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    x = np.atleast_2d(z[array]).astype(float)
                for a in range(0, len(x), 1024):
                    yield pd.DataFrame({"file": name, "row": np.arange(a, min(a + 1024, len(x))), "values": list(x[a : a + 1024])})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "file string, row bigint, values array<double>")


def meeting_time(tree: str, first: str, second: str) -> float | None:
    """Half the path between two leaves of a Newick tree: the time of their common ancestor where all leaves are of now."""
    stack: list[dict[str, float]] = [{}]
    done: dict[str, float] = {}
    i, n = 0, len(tree)
    while i < n:
        c = tree[i]
        i += 1
        if c == "(":
            stack.append({})
        elif c in ",)":
            stack[-1] |= done
            if first in stack[-1] and second in stack[-1]:
                return (stack[-1][first] + stack[-1][second]) / 2
            done = stack.pop() if c == ")" else {}
        elif c == ";":
            break
        else:
            j = i
            while j < n and tree[j] not in "(),;":
                j += 1
            name, _, length = tree[i - 1 : j].strip().partition(":")
            if name in (first, second) and not done:
                done = {name: 0.0}
            done = {k: v + float(length or 0) for k, v in done.items()}
            i = j
    return None


def tree_track(trees: DataFrame, first: str, second: str) -> DataFrame:
    """Rows of ``trees`` (with the column newick) with t, the meeting time of two leaves; null where one is not there."""

    @F.pandas_udf("double")
    def time(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else meeting_time(x, first, second))

    return trees.withColumn("t", time("newick"))


def switched(calls: DataFrame, rate: float, seed: int) -> DataFrame:
    """Calls with phasing errors: from a site where a sample has a derived allele its haplotypes change places with
    probability ``rate``, until the next such change. What is drawn follows from seed, contig, pos and sid."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "contig", "pos", "sid").cast("binary")), 1, 12), 16, 10).cast("bigint")
    turn = ((F.coalesce("h0", F.lit(0)) + F.coalesce("h1", F.lit(0)) > 0) & (bits < int(rate * (1 << 48)))).cast("int")
    w = Window.partitionBy("contig", "sid").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = calls.withColumn("_turn", turn).withColumn("_odd", F.sum("_turn").over(w) % 2 == 1)
    swap = lambda a, b: F.when(F.col("_odd"), F.col(b)).otherwise(F.col(a))
    return rows.select(*[swap("h0", "h1").alias(c) if c == "h0" else swap("h1", "h0").alias(c) if c == "h1" else c for c in calls.columns])


def segregating_list(calls: DataFrame, switch_error: float = 0.0, seed: int = 0) -> DataFrame:
    """Lines ``contig, pos, bases since the last site, alleles`` of segregating sites whose alleles are all known."""
    calls = switched(calls, switch_error, seed) if switch_error else calls
    allele = lambda h: F.when(F.col(h) == 0, "A").when(F.col(h) > 0, "C").otherwise("?")
    sites = calls.groupBy("contig", "pos").agg(F.array_sort(F.collect_list(F.struct("sid", F.concat(allele("h0"), allele("h1")).alias("x")))).alias("xs"))
    sites = sites.select("contig", "pos", F.array_join(F.transform("xs", lambda v: v["x"]), "").alias("alleles")).where("alleles like '%A%' and alleles like '%C%' and alleles not like '%?%'")
    before = F.coalesce(F.lag("pos").over(Window.partitionBy("contig").orderBy("pos")), F.lit(0))
    return sites.select("contig", "pos", (F.col("pos") - before).alias("since"), "alleles")


def split_at_gaps(sites: DataFrame, gap: int, least: int = 500_000) -> DataFrame:
    """contig, piece, first, last, sites: pieces between gaps of at least ``gap`` bases; pieces shorter than ``least`` go."""
    w = Window.partitionBy("contig").orderBy("pos")
    new = F.when(F.col("pos") - F.lag("pos").over(w) >= gap, 1).otherwise(0)
    pieces = sites.select("contig", "pos", new.alias("new")).withColumn("piece", F.sum("new").over(w))
    pieces = pieces.groupBy("contig", "piece").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("sites"))
    return pieces.where(F.col("last") - F.col("first") >= least)


def write_curves(curves: DataFrame, path: str) -> None:
    """CSV with a header: label, x, y, plot_type, plot_num."""
    curves.select("label", "x", "y", "plot_type", "plot_num").write.option("header", True).csv(path)
