"""Queries that go through files, streams and SQL table functions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tables
from ..operators import density, ingest, spans
from ..sources import chunks, formats, indexed, text
from ..streaming import runs
from .model_tables import QUERIES, SQL
from .queries import COUNTS, OBS, REALIGN, RUNS, SITES, on_calls, on_spans

__all__ = ["QUERIES", "SQL"]

WIDE = 0.05


def _contig_of_file(calls: DataFrame) -> DataFrame:
    spark, path = calls.sparkSession, text.scratch(calls.sparkSession, "calls")
    samples = [r.sid for r in calls.select("sid").distinct().orderBy("sid").collect()]  # columns of the file
    text.write_vcf(calls, path, samples, calls.groupBy("contig").agg(F.max("pos").alias("length")))
    indexed.index(spark, path, size=1 << 16)
    back = text.genotypes(text.read_variants(spark, path, "chr2", 100, 15_000), samples)
    return ingest.project(back)


on_calls("vcf_contig_scan", _contig_of_file, f"{SITES} SELECT * FROM sites WHERE contig = 'chr2' AND pos BETWEEN 100 AND 15000")


def _chunk_files(df: DataFrame) -> DataFrame:
    path = text.scratch(df.sparkSession, "chunks")
    cut = chunks.numbered(spans.chunk(df, 1000), ["contig_id", "win"])
    chunks.write_chunks(cut, path, '# spans {"version": "1", "pids": ["p"]}')
    back = text.read_spans(df.sparkSession, path, contig=F.regexp_extract("file", r"chunk(\d+)\.gz", 1).cast("bigint"))
    line = F.row_number().over(spans.ordered()).cast("bigint").alias("line")
    return back.select(F.col("contig_id").alias("chunk"), line, "span", *spans.observation(df))


on_spans("chunk_roundtrip", _chunk_files, f"""{REALIGN(1000)}, whole AS (SELECT * FROM aligned QUALIFY sum(span) OVER (PARTITION BY contig_id, win) = 1000),
n AS (SELECT *, dense_rank() OVER (ORDER BY contig_id, win) - 1 AS chunk FROM whole)
SELECT chunk, row_number() OVER (PARTITION BY chunk ORDER BY seq) AS line, CAST(span AS INT) AS span, {OBS} FROM n""")


def _sql(df: DataFrame, call: str) -> DataFrame:
    spark, view = df.sparkSession, f"spans_{uuid.uuid4().hex}"
    tables.register(spark)
    df.createOrReplaceTempView(view)
    return spark.sql(f"SELECT * FROM {call.format(f'TABLE({view}) PARTITION BY contig_id ORDER BY (seq)')}")


on_spans("sql_thin", lambda df: _sql(df, "thin({}, 10)"))
SQL["sql_thin"] = SQL["thin"].replace("stop - start AS span", "CAST(stop - start AS BIGINT) AS span")
on_spans("sql_realign", lambda df: _sql(df, "realign({}, 50)"))
SQL["sql_realign"] = SQL["realign"]
on_spans("sql_break_long", lambda df: _sql(df, "break_long({}, 30)").select("contig_id", "piece", "seq", F.col("span").cast("int").alias("span"), *spans.observation(df)))
SQL["sql_break_long"] = SQL["break_long_spans"]


def _streamed(df: DataFrame) -> DataFrame:
    """The rows as a stream of four parts in order, each a run of the query from where the one before ended, and a last one
    that only lets time go on. No contig is idle for longer than all rows take."""
    spark, folder = df.sparkSession, text.scratch(df.sparkSession, "stream")
    first, last = (x or 0 for x in df.agg(F.min("seq"), F.max("seq")).first())
    idle = last - min(first, 0) + 60
    timed = df.withColumn("ts", F.timestamp_seconds(F.col("seq") + 86_400))  # time 0 is where watermarks begin
    timed = timed.select("contig_id", "seq", "span", "a1", "b1", "nb1", "ts")
    end = F.timestamp_seconds(F.lit(last + idle + 100_000))
    tick = spark.range(1).select(F.lit(None).cast(timed.schema["contig_id"].dataType).alias("contig_id"), F.lit(last).alias("seq"), F.lit(0).alias("span"), *[F.lit(0).alias(c) for c in ("a1", "b1", "nb1")], end.alias("ts"))
    parts = [timed.where((F.col("seq") * 4 > i * last) & (F.col("seq") * 4 <= (i + 1) * last) | (F.col("seq") <= 0) & F.lit(i == 0)) for i in range(4)]
    out = None
    for part in (*parts, tick):
        part.write.mode("append").parquet(f"{folder}/in")
        out = runs.compress(spark.readStream.schema(timed.schema).parquet(f"{folder}/in"), idle=f"{idle} seconds")
        query = out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start(f"{folder}/out")
        query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


on_spans("streamed_runs", _streamed, f"{RUNS} SELECT * FROM runs")


# long contigs: rows in blocks of seq, a row a block in the contigs' windows
for _name, _run in (
    ("span_positions", lambda df: spans.positions(df, 500)), ("rle_compress", lambda df: spans.compress(df, 500)), ("thin", lambda df: spans.thin(df, 10, 500)),
    ("realign", lambda df: spans.realign(df, 50, 500)), ("chunk_exact", lambda df: spans.chunk(df, 500, 500)), ("break_long_spans", lambda df: spans.break_long(df, 30, 500)),
):
    on_spans(f"{_name}_blocks", _run)
    SQL[f"{_name}_blocks"] = SQL[_name]

# densities of window rates
_shares = lambda df: spans.mutation_rates(df, 50).select((F.col("rate") / 50).alias("x"))
SHARES = "x AS (SELECT mut / nm AS x FROM counts WHERE nm * 2 > 50)"
KERNEL = f"exp(CASE WHEN y > 0 THEN CASE WHEN x > 0 THEN y / {WIDE} * ln(x) ELSE -1e300 END ELSE 0 END + CASE WHEN y < 1 THEN CASE WHEN x < 1 THEN (1 - y) / {WIDE} * ln(1 - x) ELSE -1e300 END ELSE 0 END - lgamma(1 + y / {WIDE}) - lgamma(1 + (1 - y) / {WIDE}) + lgamma(2 + 1 / {WIDE}))"
DENSE = lambda n: f"{COUNTS(50)}, {SHARES}, g AS (SELECT CAST(i AS DOUBLE) / {n} AS y FROM range({n + 1}) AS t(i)), d AS (SELECT y, avg({KERNEL}) AS density FROM x, g GROUP BY 1)"
on_spans("rate_density", lambda df: density.density(_shares(df), "x", [i / 40 for i in range(41)], WIDE).withColumn("density", F.round("density", 6)), f"{DENSE(40)} SELECT y, round(density, 6) AS density FROM d")
PROBABILITIES = [0.1, 0.5, 0.9]


def _rate_quantiles(df: DataFrame) -> DataFrame:
    found = density.quantiles(_shares(df), "x", PROBABILITIES, WIDE, 100)
    return df.sparkSession.createDataFrame([(p, round(q, 6)) for p, q in zip(PROBABILITIES, found, strict=True)], "p double, q double")


on_spans("rate_density_quantiles", _rate_quantiles, f"""{DENSE(100)},
a AS (SELECT y, coalesce(sum(s) OVER (ORDER BY y), 0) AS area FROM (SELECT y, (density + lag(density) OVER (ORDER BY y)) / 2 AS s FROM d)),
n AS (SELECT y, area / max(area) OVER () AS area FROM a), l AS (SELECT y, area, lag(y) OVER (ORDER BY y) AS y0, lag(area) OVER (ORDER BY y) AS a0 FROM n)
SELECT p, round(y0 + (y - y0) * (p - a0) / (area - a0), 6) AS q FROM l, (SELECT unnest({PROBABILITIES})::DOUBLE AS p) WHERE a0 < p AND p <= area""")


# runs as bases, rows in groups of equal size, times of trees
on_spans("rle_unpack", lambda df: spans.unpack(spans.compress(df)), f"{RUNS} SELECT contig_id, seq, unnest(range(span)) AS place, {OBS} FROM runs")
on_spans("group_rows", lambda df: spans.group_rows(df, 7), f""", n AS (SELECT *, row_number() OVER (PARTITION BY contig_id ORDER BY seq) - 1 AS i FROM spans),
c AS (SELECT contig_id, count(*) AS n FROM spans GROUP BY 1)
SELECT contig_id, i // 7 AS grp, CAST(i % 7 AS INT) AS place, seq, span, {OBS} FROM n
UNION ALL SELECT contig_id, n // 7, CAST(unnest(range(n % 7, 7)) AS INT), NULL, NULL, NULL, NULL, NULL FROM c WHERE n % 7 > 0""")


def _tree_runs(df: DataFrame) -> DataFrame:
    """The meeting time of two leaves along a contig, from trees as text, in runs."""
    deep = (1 + F.col("seq") % 3).cast("int")
    tree = F.format_string("((a:%d,b:%d):2,(c:1,d:1):%d);", deep, deep, deep + 1)
    times = formats.tree_track(df.select("contig_id", "seq", "span", tree.alias("newick")), "a", "b").drop("newick")
    runs_ = spans.islands(times, ["t"]).groupBy("contig_id", "island", "t").agg(F.min("seq").alias("seq"), F.sum("span").alias("span"))
    return runs_.select("contig_id", "seq", "span", "t")


on_spans("tree_track_runs", _tree_runs, """, l AS (SELECT *, CAST(1 + seq % 3 AS DOUBLE) AS t FROM spans),
c AS (SELECT *, CASE WHEN lag(t) OVER (PARTITION BY contig_id ORDER BY seq) = t THEN 0 ELSE 1 END AS ch FROM l),
g AS (SELECT *, sum(ch) OVER (PARTITION BY contig_id ORDER BY seq) AS g FROM c)
SELECT contig_id, min(seq) AS seq, CAST(sum(span) AS BIGINT) AS span, t FROM g GROUP BY contig_id, g, t""")


# the list of segregating sites, with phasing errors
ALLELE = lambda h: f"CASE WHEN {h} = 0 THEN 'A' WHEN {h} > 0 THEN 'C' ELSE '?' END"
on_calls("segregating_list", lambda c: formats.segregating_list(c.where("sid <= 4"), 0.3, 5), f""", t AS (SELECT *, CASE WHEN coalesce(h0, 0) + coalesce(h1, 0) > 0
  AND CAST('0x' || substr(md5(concat_ws(':', '5', contig, CAST(pos AS VARCHAR), CAST(sid AS VARCHAR))), 1, 12) AS BIGINT) < {int(0.3 * (1 << 48))} THEN 1 ELSE 0 END AS turn FROM geno WHERE sid <= 4),
o AS (SELECT *, sum(turn) OVER (PARTITION BY contig, sid ORDER BY pos) % 2 = 1 AS odd FROM t),
w AS (SELECT contig, pos, sid, CASE WHEN odd THEN h1 ELSE h0 END AS h0, CASE WHEN odd THEN h0 ELSE h1 END AS h1 FROM o),
l AS (SELECT contig, pos, string_agg({ALLELE('h0')} || {ALLELE('h1')}, '' ORDER BY sid) AS alleles FROM w GROUP BY 1, 2),
k AS (SELECT * FROM l WHERE alleles LIKE '%A%' AND alleles LIKE '%C%' AND alleles NOT LIKE '%?%')
SELECT contig, pos, pos - coalesce(lag(pos) OVER (PARTITION BY contig ORDER BY pos), 0) AS since, alleles FROM k""")
