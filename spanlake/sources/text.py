"""Text formats: span files with a header line, manifests, variant calls, interval masks. Compression goes by the suffix.

A span file is ``# label {json}`` and then one line of integers a row: span, then a, b and nb of each population."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spans import observation

HEADER = "version string, pids array<string>, undist array<array<array<string>>>, dist array<array<array<string>>>"
#: Rows of a partition are numbered by the low 33 bits of monotonically_increasing_id.
_ROW = (1 << 33) - 1


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of the session; where none is set, as in tests, in a temporary one, if all runs on one
    machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    folder = folder or "file://" + tempfile.mkdtemp(prefix="spanlake-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def expand(spark: SparkSession, arguments: list[str]) -> list[str]:
    """Paths; ``@file`` stands for the paths that the file lists. Each path is named once, in any order."""
    plain = {a for a in arguments if not a.startswith("@")}
    lists = [a[1:] for a in arguments if a.startswith("@")]
    if lists:  # names of files, not data
        plain |= {r.value.strip() for r in spark.read.text(lists).where("trim(value) <> ''").distinct().collect()}
    return sorted(plain)


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, seq, value. A block's start plus the number of the line within its task grows along a file: a block is read
    whole by one task, and holds fewer lines than bytes."""
    seq = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW))
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), seq.alias("seq"), "value")


def headers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file and the fields of its header; a header without populations fails."""
    found = _lines(spark, paths).select("file", F.regexp_extract("value", r"^#[^{]*(\{.*\})\s*$", 1).alias("json")).where("json <> ''")
    rows = found.select("file", F.from_json("json", HEADER).alias("h")).select("file", "h.*")
    return rows.withColumn("pids", F.coalesce("pids", F.raise_error(F.lit("header without pids")).cast("array<string>")))


def read_spans(spark: SparkSession, paths: str | list[str], populations: int = 1, contig: Column | None = None) -> DataFrame:
    """Span rows in file order; the contig is the file, or ``contig``, made from the column ``file``."""
    rows = _lines(spark, paths).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    names = ["span", *[f"{x}{p + 1}" for p in range(populations) for x in ("a", "b", "nb")]]
    cells = F.split(F.trim("value"), r"\s+")
    rows = rows.select((F.col("file") if contig is None else contig).alias("contig_id"), "seq", cells.alias("_cells"))
    return rows.select("contig_id", "seq", *[F.col("_cells")[i].cast("int").alias(n) for i, n in enumerate(names)])


def empty_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Files that hold lines, but no row."""
    row = ~F.col("value").startswith("#") & (F.trim("value") != "")
    return _lines(spark, paths).groupBy("file").agg(F.count_if(row).alias("rows")).where("rows = 0").select("file")


def write_spans(spans: DataFrame, path: str, header: DataFrame | None = None, label: str = "spans", codec: str = "gzip") -> None:
    """One folder ``contig_id=...`` with one file for each contig, rows in order, behind its header (contig_id, header)."""
    rows = spans.select("contig_id", F.col("seq").cast("bigint").alias("seq"), F.concat_ws(" ", "span", *observation(spans)).alias("value"))
    if header is not None:
        first = F.lit(-(1 << 62)).cast("bigint").alias("seq")
        rows = rows.unionByName(header.select("contig_id", first, F.concat(F.lit(f"# {label} "), "header").alias("value")))
    rows = rows.repartition("contig_id").sortWithinPartitions("contig_id", "seq")
    rows.select("contig_id", "value").write.partitionBy("contig_id").option("compression", codec).text(path)


def sample_list(text: str, spark: SparkSession | None = None) -> tuple[str, list[str]]:
    """``population:a,b,c``, or ``population:@file`` with a name on each line."""
    population, _, names = text.partition(":")
    if not population or not names:
        raise ValueError("samples are given as population:name,name or population:@file")
    if names.startswith("@") and spark is not None:  # a list of samples, not data
        return population, [r.value.strip() for r in spark.read.text(names[1:]).where("trim(value) <> ''").collect()]
    return population, names.split(",")


def vcf_samples(spark: SparkSession, path: str) -> list[str]:
    line = spark.read.text(path).where(F.col("value").startswith("#CHROM")).first()
    if line is None:
        raise ValueError(f"no line of column names in {path}")
    return line.value.split("\t")[9:]


def read_variants(spark: SparkSession, path: str, contig: str | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
    """contig, pos, ref, alts and the genotypes of the samples in order, as text; of one contig, from position ``low`` to
    ``high``, where asked: then only its part of an indexed file is read."""
    cells = F.split("value", "\t")
    asked = [F.col(c) == v if c == "contig" else F.col(c) >= v if v is low else F.col(c) <= v for c, v in (("contig", contig), ("pos", low), ("pos", high)) if v is not None]
    table = f"{path.rstrip('/')}.ranges"
    if asked and exists(spark, table):
        from . import indexed

        rows = reduce(DataFrame.where, asked, indexed.lines(spark, path)).select(cells.alias("f"))
    else:
        rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != "")).select(cells.alias("f"))
        rows = rows.select("f", F.col("f")[0].alias("contig"), F.col("f")[1].cast("bigint").alias("pos"))
        rows = reduce(DataFrame.where, asked, rows).select("f")
    alts = F.when(F.col("f")[4] == ".", F.array().cast("array<string>")).otherwise(F.split(F.col("f")[4], ","))
    calls = F.transform(F.slice("f", F.lit(10), F.greatest(F.size("f") - 9, F.lit(0))), lambda x: F.split(x, ":")[0])
    return rows.select(F.col("f")[0].alias("contig"), F.col("f")[1].cast("bigint").alias("pos"), F.col("f")[3].alias("ref"), alts.alias("alts"), calls.alias("calls"))


def genotypes(variants: DataFrame, samples: list[str], diploid: list[str] | None = None) -> DataFrame:
    """contig, pos, sid, h0, h1: 1 for any allele that is not the reference's, null for a missing one. A call of other than
    two alleles fails for a sample of ``diploid``."""
    rows = variants.select("contig", "pos", F.posexplode("calls").alias("_i", "_g")).withColumn("_h", F.split("_g", r"[|/]"))
    named = F.element_at(F.array(*map(F.lit, samples)), F.col("_i") + 1)
    if diploid:
        wrong = named.isin(diploid) & (F.size("_h") != 2)
        rows = rows.withColumn("_h", F.when(wrong, F.raise_error(F.format_string("no diploid call at %s:%d", "contig", "pos"))).otherwise(F.col("_h")))
    allele = lambda k: F.when(F.get("_h", F.lit(k)) == ".", None).otherwise((F.get("_h", F.lit(k)) != "0").cast("int"))
    return rows.select("contig", "pos", named.alias("sid"), allele(0).alias("h0"), allele(1).alias("h1"))


def declared_lengths(spark: SparkSession, path: str) -> DataFrame:
    """contig and length, of the header."""
    rows = spark.read.text(path).where(F.col("value").startswith("##contig"))
    number = F.regexp_extract("value", r"length=(\d+)", 1)
    return rows.select(F.regexp_extract("value", r"ID=([^,>]+)", 1).alias("contig"), F.when(number != "", number).cast("bigint").alias("length"))


def write_vcf(calls: DataFrame, path: str, samples: list, lengths: DataFrame) -> None:
    """Genotypes as ordered text; the header leads the first part."""
    letter = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    sites = calls.groupBy("contig", "pos").agg(F.map_from_entries(F.collect_list(F.struct(F.col("sid").cast("string"), F.concat(letter("h0"), F.lit("/"), letter("h1"))))).alias("g"))
    cells = [F.coalesce(F.try_element_at("g", F.lit(str(s))), F.lit("./.")) for s in samples]
    body = sites.select(F.lit(1).alias("k"), "contig", "pos", F.concat_ws("\t", "contig", F.col("pos").cast("string"), F.lit("."), F.lit("A"), F.lit("C"), F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT"), *cells).alias("value"))
    spark = calls.sparkSession
    names = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *map(str, samples)])
    fixed = spark.createDataFrame([(0, "", 0, "##fileformat=VCFv4.2"), (0, "", 2, names)], "k int, contig string, pos bigint, value string")
    known = lengths.select(F.lit(0).alias("k"), F.lit("").alias("contig"), F.lit(1).cast("bigint").alias("pos"), F.format_string("##contig=<ID=%s,length=%d>", "contig", "length").alias("value"))
    reduce(DataFrame.unionByName, [fixed, known, body]).orderBy("k", "contig", "pos").select("value").write.text(path)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """contig, m_start, m_end (half open); further columns are not read."""
    rows = spark.read.csv(path, sep="\t", comment="#", schema="contig string, m_start bigint, m_end bigint")
    return rows.where("m_end is not null and not (contig rlike '^(track|browser)\\\\b')")
