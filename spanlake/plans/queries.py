"""The registered queries on span, genotype and model tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest, keys, models, sampling, spans, splines
from ..sources import text
from ..sources.adapters import GENO_SQL, MASK_SQL, SPANS_SQL, genotypes, masks
from ..sources.adapters import spans as span_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def on_spans(name: str, run: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda s, d: run(span_table(s, d))
    if sql:
        SQL[name] = f"WITH {SPANS_SQL}{sql if sql.lstrip().startswith(',') else ' ' + sql}"


def on_calls(name: str, run: Callable[..., DataFrame], sql: str | None = None, mask: bool = False) -> None:
    QUERIES[name] = lambda s, d: run(genotypes(s, d), masks(s, d)) if mask else run(genotypes(s, d))
    if sql:
        SQL[name] = f"WITH {GENO_SQL}, {MASK_SQL}{sql if sql.lstrip().startswith(',') else ' ' + sql}"


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


OBS = "a1, b1, nb1"
# running positions, runs
on_spans("span_positions", spans.positions, "SELECT * FROM placed")
on_spans("contig_lengths", spans.lengths, "SELECT contig_id, CAST(sum(span) AS BIGINT) AS bases, count(*) AS rows FROM spans GROUP BY 1")
RUNS = f""", l AS (SELECT *, lag(struct_pack({', '.join(f'{x} := {x}' for x in ('a1', 'b1', 'nb1'))})) OVER (PARTITION BY contig_id ORDER BY seq) IS NOT DISTINCT FROM struct_pack({', '.join(f'{x} := {x}' for x in ('a1', 'b1', 'nb1'))}) AS same FROM spans),
i AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY contig_id ORDER BY seq) AS g FROM l),
runs AS (SELECT contig_id, min(seq) AS seq, CAST(sum(span) AS BIGINT) AS span, {OBS} FROM i GROUP BY contig_id, g, {OBS})"""
on_spans("rle_compress", spans.compress, f"{RUNS} SELECT * FROM runs")
on_spans("rle_expand_counts", lambda df: spans.expand_counts(spans.compress(df)), f"{RUNS} SELECT {OBS}, CAST(sum(span) AS BIGINT) AS bases, count(*) AS runs FROM runs GROUP BY {OBS}")
on_spans("decompress_polymorphic", lambda df: spans.decompress_polymorphic(df), f""", p AS (SELECT *, a1 > 0 OR b1 > 0 AS poly FROM spans)
SELECT contig_id, seq, CAST(k AS INT) AS part, CASE WHEN poly THEN 1 ELSE span END AS span, {OBS} FROM (SELECT *, unnest(range(0, CASE WHEN poly THEN span ELSE 1 END)) AS k FROM p)""")
# recodes and filters
on_spans("recode_nonseg", lambda df: spans.recode_nonseg(df, 30), "SELECT contig_id, seq, span, CASE WHEN span > 30 AND a1 = 0 AND b1 = 0 THEN -1 ELSE a1 END AS a1, b1, CASE WHEN span > 30 AND a1 = 0 AND b1 = 0 THEN 0 ELSE nb1 END AS nb1 FROM spans")
on_spans("recode_monomorphic", spans.recode_monomorphic, "SELECT contig_id, seq, span, CASE WHEN a1 = 2 AND b1 = nb1 THEN 0 ELSE a1 END AS a1, CASE WHEN a1 = 2 AND b1 = nb1 THEN 0 ELSE b1 END AS b1, nb1 FROM spans")
on_spans("validate_bad_rows", lambda df: spans.bad_rows(df, (1,)), f"SELECT contig_id, seq, span, {OBS} FROM spans WHERE span <= 0 OR b1 > nb1 OR a1 > 1")
on_spans("validate_bad_rows_lenient", lambda df: spans.bad_rows(df, (1,), strict=False), f"SELECT contig_id, seq, span, {OBS} FROM spans WHERE span <= 0 OR (span = 1 AND (b1 > nb1 OR a1 > 1))")
EDGE_SQL = """, edge AS (SELECT contig_id, seq, span, a1, CASE WHEN seq % 5 = 0 THEN nb1 ELSE b1 END AS b1, nb1 FROM spans),
two AS (SELECT *, CAST(CASE WHEN a1 < 0 THEN -1 ELSE seq % 2 END AS INT) AS a2, CAST(CASE WHEN seq % 3 = 0 THEN 3 WHEN seq % 3 = 1 THEN 1 ELSE 0 END AS INT) AS b2, CAST(CASE WHEN seq % 3 = 2 THEN 0 ELSE 3 END AS INT) AS nb2 FROM edge)"""


def _edge(df: DataFrame) -> DataFrame:
    """Rows with samples that are all derived beside pairs of every kind."""
    return df.withColumn("b1", F.when(F.col("seq") % 5 == 0, F.col("nb1")).otherwise(F.col("b1")))


def _two(df: DataFrame) -> DataFrame:
    """Two populations with one distinguished lineage each, so far as a1 is not 2."""
    third = F.col("seq") % 3
    return _edge(df).withColumns({"a2": F.when(F.col("a1") < 0, -1).otherwise((F.col("seq") % 2).cast("int")), "b2": F.when(third == 0, 3).when(third == 1, 1).otherwise(0), "nb2": F.when(third == 2, 0).otherwise(3)})


on_spans("validate", lambda df: spans.validate(_edge(df), n=(4,)), f"{EDGE_SQL} SELECT contig_id, seq, span, a1, CASE WHEN a1 IN (2, -1) AND b1 = nb1 AND nb1 > 0 THEN 0 ELSE b1 END AS b1, nb1 FROM edge")
on_spans("validate_two", lambda df: spans.unfounded(_two(df), (1, 1)), f"""{EDGE_SQL} SELECT contig_id, seq, span, a1, CASE WHEN z THEN 0 ELSE b1 END AS b1, nb1, a2, CASE WHEN z THEN 0 ELSE b2 END AS b2, nb2
FROM (SELECT *, ((a1 = 1 AND a2 = 1) OR (a1 = -1 AND a2 = -1)) AND b1 = nb1 AND b2 = nb2 AND nb1 + nb2 > 0 AS z FROM two)""")
on_spans("bad_rows_two", lambda df: spans.bad_rows(_two(df), (1, 1), (4, 2)), f"{EDGE_SQL} SELECT contig_id, seq, span, a1, b1, nb1, a2, b2, nb2 FROM two WHERE span <= 0 OR a1 > 1 OR a2 > 1 OR b1 > nb1 OR b2 > nb2 OR nb1 > 4 OR nb2 > 2")
on_spans("recode_monomorphic_two", lambda df: spans.recode_monomorphic(_two(df), (1, 1)), f"""{EDGE_SQL} SELECT contig_id, seq, span, CASE WHEN z THEN 0 ELSE a1 END AS a1, CASE WHEN z THEN 0 ELSE b1 END AS b1, nb1, CASE WHEN z THEN 0 ELSE a2 END AS a2, CASE WHEN z THEN 0 ELSE b2 END AS b2, nb2
FROM (SELECT *, a1 = 1 AND a2 = 1 AND b1 = nb1 AND b2 = nb2 AS z FROM two)""")
REALIGN = lambda w: f""", cells AS (SELECT contig_id, seq, {OBS}, start, stop, unnest(range(start // {w}, (stop - 1) // {w} + 1)) AS win FROM placed),
aligned AS (SELECT contig_id, seq, win, greatest(start, win * {w}) AS start, least(stop, (win + 1) * {w}) - greatest(start, win * {w}) AS span, {OBS} FROM cells)"""  # noqa: E731
on_spans("drop_uninformative", lambda df: spans.drop_uninformative(spans.realign(df, 50), ("contig_id", "win")), f"{REALIGN(50)} SELECT a.* FROM aligned a SEMI JOIN (SELECT contig_id, win FROM aligned WHERE a1 > 0 OR b1 > 0) b ON a.contig_id = b.contig_id AND a.win = b.win")
on_spans("drop_small_contigs", lambda df: spans.drop_small(df, 1200), f"SELECT contig_id, seq, span, {OBS} FROM spans WHERE contig_id IN (SELECT contig_id FROM spans GROUP BY 1 HAVING sum(span) > 1200)")
on_spans("region_slice", lambda df: spans.region(df, 200, 700), f"SELECT contig_id, seq, span, {OBS} FROM placed WHERE stop BETWEEN 200 AND 700 UNION ALL SELECT DISTINCT contig_id, -1, 1, -1, 0, 0 FROM spans")
on_spans("head_per_contig", spans.head, f"SELECT contig_id, seq, span, {OBS} FROM spans QUALIFY row_number() OVER (PARTITION BY contig_id ORDER BY seq) <= 10")
# splitting
on_spans("thin", lambda df: spans.thin(df, 10), f""", m AS (SELECT *, unnest(range(0, stop // 10 - start // 10 + 1)) AS i FROM placed),
g AS (SELECT contig_id, seq, {OBS}, CASE WHEN i = 0 THEN start ELSE (start // 10 + i) * 10 END AS start, CASE WHEN i = stop // 10 - start // 10 THEN stop ELSE (start // 10 + i) * 10 + 9 END AS stop, false AS f FROM m
  UNION ALL SELECT contig_id, seq, {OBS}, (start // 10 + i) * 10 + 9, (start // 10 + i) * 10 + 10, true FROM m WHERE i < stop // 10 - start // 10)
SELECT contig_id, seq, start, stop - start AS span, CASE WHEN a1 = 2 THEN 0 ELSE a1 END AS a1, CASE WHEN a1 = 2 OR NOT f THEN 0 ELSE b1 END AS b1, CASE WHEN a1 = 2 OR NOT f THEN 0 ELSE nb1 END AS nb1 FROM g WHERE stop > start""")
on_spans("realign", lambda df: spans.realign(df, 50), f"{REALIGN(50)} SELECT * FROM aligned")
on_spans("chunk_exact", lambda df: spans.chunk(df, 500), f"{REALIGN(500)} SELECT * FROM aligned QUALIFY sum(span) OVER (PARTITION BY contig_id, win) = 500")
on_spans("break_long_spans", lambda df: spans.break_long(df, 30), f""", r AS (SELECT *, CASE WHEN span >= 30 AND a1 = -1 AND nb1 = 0 THEN 1 ELSE 0 END AS long FROM spans),
q AS (SELECT *, sum(long) OVER (PARTITION BY contig_id ORDER BY seq) AS piece FROM r)
SELECT contig_id, CAST(piece AS BIGINT) AS piece, seq, span, {OBS} FROM q WHERE long = 0
UNION ALL SELECT contig_id, unnest(range(0, n + 1)), -1, 1, -1, 0, 0 FROM (SELECT contig_id, CAST(sum(long) AS BIGINT) AS n FROM r GROUP BY 1)""")
on_spans("group_fixed_n", lambda df: spans.grouped(df, 7), """, r AS (SELECT *, (row_number() OVER (PARTITION BY contig_id ORDER BY seq) - 1) // 7 AS grp FROM spans)
SELECT contig_id, grp, count(*) AS rows, CAST(sum(span) AS BIGINT) AS bases, 7 - count(*) AS filled FROM r GROUP BY 1, 2""")
# windows
COUNTS = lambda w: REALIGN(w) + ", counts AS (SELECT contig_id, win, CAST(sum(CASE WHEN a1 >= 0 THEN span ELSE 0 END) AS BIGINT) AS nm, CAST(sum(CASE WHEN a1 = 1 THEN span ELSE 0 END) AS BIGINT) AS mut FROM aligned GROUP BY 1, 2)"
on_spans("windowed_mutation_counts", lambda df: spans.mutation_counts(df, 50), f"{COUNTS(50)} SELECT * FROM counts")
on_spans("mutation_rate_windows", lambda df: rounded(spans.mutation_rates(df, 50), "rate"), f"{COUNTS(50)} SELECT contig_id, win, round(mut * 50 / nm, 6) AS rate FROM counts WHERE nm * 2 > 50")
on_spans("mutation_quantiles", lambda df: rounded(spans.quantiles(spans.mutation_rates(df, 50), "rate", (0.0, 0.05, 0.95, 1.0)), "value"), f"""{COUNTS(50)}, v AS (SELECT mut * 50 / nm AS x, row_number() OVER (ORDER BY mut * 50 / nm) AS r, count(*) OVER () AS n FROM counts WHERE nm * 2 > 50),
p AS (SELECT prob, n, n * prob + 0.4 + prob * 0.2 AS al FROM (SELECT CAST(unnest([0.0, 0.05, 0.95, 1.0]) AS DOUBLE) AS prob), (SELECT max(n) AS n FROM v)),
k AS (SELECT prob, n, floor(greatest(1, least(al, n - 1))) AS k, greatest(0, least(1, al - floor(greatest(1, least(al, n - 1))))) AS g FROM p)
SELECT prob, round((1 - g) * a.x + g * b.x, 6) AS value FROM k JOIN v a ON a.r = k JOIN v b ON b.r = least(k + 1, k.n)""")
on_spans("bin_observations", lambda df: spans.bin_observations(df, 50), f"""{REALIGN(50)}, s AS (SELECT *, nb1 + CASE WHEN a1 >= 0 THEN 2 ELSE 0 END AS s FROM aligned),
m AS (SELECT *, max(s) OVER (PARTITION BY contig_id, win) AS m FROM s),
f AS (SELECT *, min(CASE WHEN s = m THEN start END) OVER (PARTITION BY contig_id, win) AS f FROM m),
c AS (SELECT *, max(CASE WHEN m = 2 AND a1 = 1 AND start >= f THEN start END) OVER (PARTITION BY contig_id, win) AS c FROM f)
SELECT contig_id, win AS seq, 1 AS span, {OBS} FROM c WHERE start = coalesce(c, f)""")
THETA = "sum(CASE WHEN a1 >= 1 OR b1 > 0 THEN span ELSE 0 END) / sum(span * (ln(s) + 0.5 / s + 0.57721))"
on_spans("watterson", lambda df: rounded(spans.watterson(df), "theta"), f"SELECT round({THETA}, 6) AS theta FROM (SELECT *, nb1 + CASE WHEN a1 >= 0 THEN 1 ELSE 0 END AS s FROM spans) WHERE s > 0")
on_spans("watterson_per_contig", lambda df: rounded(spans.watterson(spans.compress(df), ("contig_id",)), "theta"), f"{RUNS} SELECT contig_id, round({THETA}, 6) AS theta FROM (SELECT *, nb1 + CASE WHEN a1 >= 0 THEN 1 ELSE 0 END AS s FROM runs) WHERE s > 0 GROUP BY 1")
on_spans("segregating_sites", spans.segregating, "SELECT contig_id, count(*) FILTER (WHERE a1 > 0 OR b1 > 0) AS sites FROM spans GROUP BY 1")
on_spans("empirical_transition", lambda df: spans.transitions(df, "a1"), "SELECT s1, s2, count(*) AS n FROM (SELECT a1 AS s1, lead(a1) OVER (PARTITION BY contig_id ORDER BY seq) AS s2 FROM spans) WHERE s2 IS NOT NULL GROUP BY 1, 2")
on_spans("tmrca_track", lambda df: spans.compress(df.withColumns({"a1": F.lit(0), "b1": F.expr("CAST(seq % 3 AS INT)"), "nb1": F.lit(3)})).select("contig_id", "seq", "span", F.col("b1").alias("level")), """, l AS (SELECT *, CAST(seq % 3 AS INT) AS level FROM spans), c AS (SELECT *, CASE WHEN lag(level) OVER (PARTITION BY contig_id ORDER BY seq) = level THEN 0 ELSE 1 END AS ch FROM l),
g AS (SELECT *, sum(ch) OVER (PARTITION BY contig_id ORDER BY seq) AS g FROM c) SELECT contig_id, min(seq) AS seq, CAST(sum(span) AS BIGINT) AS span, level FROM g GROUP BY contig_id, g, level""")
on_spans("psmc_blocks", lambda df: spans.blocks_text(df, 50, 10), f"""{REALIGN(50)}, s AS (SELECT *, nb1 + CASE WHEN a1 >= 0 THEN 2 ELSE 0 END AS s FROM aligned), m AS (SELECT *, max(s) OVER (PARTITION BY contig_id, win) AS m FROM s),
f AS (SELECT *, min(CASE WHEN s = m THEN start END) OVER (PARTITION BY contig_id, win) AS f FROM m), c AS (SELECT *, max(CASE WHEN m = 2 AND a1 = 1 AND start >= f THEN start END) OVER (PARTITION BY contig_id, win) AS c FROM f)
SELECT contig_id, win // 10 AS line, string_agg(CASE WHEN a1 < 0 THEN 'N' WHEN a1 = 1 THEN 'K' ELSE 'T' END, '' ORDER BY win) AS text FROM c WHERE start = coalesce(c, f) GROUP BY 1, 2""")
# ingest
SITES = """, sites AS (SELECT contig, pos, CAST(CASE WHEN sum(CASE WHEN sid = 1 THEN (h0 IS NOT NULL)::INT + (h1 IS NOT NULL)::INT ELSE 0 END) = 2 THEN sum(CASE WHEN sid = 1 THEN coalesce(h0, 0) + coalesce(h1, 0) ELSE 0 END) ELSE -1 END AS INT) AS a1,
CAST(sum(CASE WHEN sid <> 1 THEN coalesce(h0, 0) + coalesce(h1, 0) ELSE 0 END) AS INT) AS b1, CAST(sum(CASE WHEN sid <> 1 THEN (h0 IS NOT NULL)::INT + (h1 IS NOT NULL)::INT ELSE 0 END) AS INT) AS nb1 FROM geno GROUP BY 1, 2)"""


def _variants(calls: DataFrame) -> DataFrame:
    letters = F.array(*[F.lit(x) for x in ("A", "C", "G", "T", "AT")])
    pick = lambda k: F.element_at(letters, (F.col("pos") % k + 1).cast("int"))
    alts = F.when(F.col("pos") % 7 == 0, F.array()).when(F.col("pos") % 11 == 0, F.array(pick(3), pick(4))).otherwise(F.array(pick(5)))
    return calls.select("contig", "pos").distinct().select("contig", "pos", pick(4).alias("ref"), alts.alias("alts"))


on_calls("snp_filter", lambda c: ingest.snps(_variants(c)).select("contig", "pos", "ref", F.concat_ws(",", "alts").alias("alt")), """, v AS (SELECT DISTINCT contig, pos FROM geno), l AS (SELECT contig, pos, ['A', 'C', 'G', 'T', 'AT'] AS x FROM v),
w AS (SELECT contig, pos, x[pos % 4 + 1] AS ref, CASE WHEN pos % 7 = 0 THEN [] WHEN pos % 11 = 0 THEN [x[pos % 3 + 1], x[pos % 4 + 1]] ELSE [x[pos % 5 + 1]] END AS alts FROM l)
SELECT contig, pos, ref, coalesce(array_to_string(alts, ','), '') AS alt FROM w WHERE len(alts) <= 1 AND length(ref) = 1 AND len(list_filter(alts, lambda a: length(a) <> 1)) = 0""")
on_calls("genotype_project", ingest.project, f"{SITES} SELECT * FROM sites")
on_calls("fold_monomorphic", lambda c: ingest.fold_monomorphic(ingest.project(c)), f"{SITES} SELECT contig, pos, CASE WHEN a1 = 2 AND b1 = nb1 THEN 0 ELSE a1 END AS a1, CASE WHEN a1 = 2 AND b1 = nb1 THEN 0 ELSE b1 END AS b1, nb1 FROM sites")
on_calls("mask_anti_join", lambda c, m: ingest.outside(ingest.project(c), m), f"{SITES} SELECT * FROM sites s WHERE NOT EXISTS (SELECT 1 FROM mask m WHERE m.contig = s.contig AND m_start <= pos - 1 AND pos - 1 < m_end)", mask=True)
GAPS = lambda cutoff: f"""lens AS (SELECT contig, max(pos) + 10 AS length, max(nb1) AS n FROM sites GROUP BY 1),
k AS (SELECT e.contig, a, least(b, length) AS b, a1, b1, nb1, n, length, masked FROM ev e JOIN lens USING (contig) WHERE a < least(b, length)),
p AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY contig ORDER BY a), 0) AS p FROM k),
filled AS (SELECT contig AS contig_id, p AS seq, a - p AS span, CASE WHEN a - p > {cutoff} AND NOT masked THEN -1 ELSE 0 END AS a1, 0 AS b1, CASE WHEN a - p > {cutoff} AND NOT masked THEN 0 ELSE n END AS nb1 FROM p WHERE a > p
  UNION ALL SELECT contig, a, b - a, a1, b1, nb1 FROM p
  UNION ALL SELECT contig, max(b), any_value(length) - max(b), 0, 0, any_value(n) FROM k GROUP BY contig HAVING any_value(length) > max(b))"""  # noqa: E731
EVENTS = "ev AS (SELECT contig, pos - 1 AS a, pos AS b, false AS masked, a1, b1, nb1 FROM sites)"
on_calls("gap_fill", lambda c: ingest.gap_fill(ingest.events(s := ingest.project(c)), ingest.contig_lengths(s), 5), f"{SITES}, {EVENTS}, {GAPS(5)} SELECT * FROM filled")
MASKED = """mm AS (SELECT *, max(m_end) OVER (PARTITION BY contig ORDER BY m_start, m_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM mask),
mg AS (SELECT *, sum(CASE WHEN pe >= m_start THEN 0 ELSE 1 END) OVER (PARTITION BY contig ORDER BY m_start, m_end) AS g FROM mm),
mi AS (SELECT contig, min(m_start) AS a, max(m_end) AS b FROM mg GROUP BY contig, g),
ev AS (SELECT contig, pos - 1 AS a, pos AS b, false AS masked, a1, b1, nb1 FROM sites s WHERE NOT EXISTS (SELECT 1 FROM mask m WHERE m.contig = s.contig AND m_start <= pos - 1 AND pos - 1 < m_end)
  UNION ALL SELECT contig, a, b, true, -1, 0, 0 FROM mi)"""
on_calls("vcf_to_spans", lambda c, m: spans.compress(ingest.gap_fill(ingest.events(s := ingest.fold_monomorphic(ingest.project(c)), m), ingest.contig_lengths(s), 40)), f"""{SITES.replace('sites AS', 'sites0 AS')}, sites AS (SELECT contig, pos, CASE WHEN a1 = 2 AND b1 = nb1 THEN 0 ELSE a1 END AS a1, CASE WHEN a1 = 2 AND b1 = nb1 THEN 0 ELSE b1 END AS b1, nb1 FROM sites0), {MASKED}, {GAPS(40)},
l AS (SELECT *, lag([a1, b1, nb1]) OVER (PARTITION BY contig_id ORDER BY seq) IS NOT DISTINCT FROM [a1, b1, nb1] AS same FROM filled), i AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY contig_id ORDER BY seq) AS g FROM l)
SELECT contig_id, min(seq) AS seq, CAST(sum(span) AS BIGINT) AS span, a1, b1, nb1 FROM i GROUP BY contig_id, g, a1, b1, nb1""", mask=True)
on_calls("merged_mask", lambda c, m: ingest.merged(m), f", {MASKED.split('ev AS')[0].rstrip().rstrip(',')} SELECT contig, a AS m_start, b AS m_end FROM mi", mask=True)
on_calls("first_record_per_pos", lambda c: ingest.first_per_position(c, ["sid"]), "SELECT * FROM geno QUALIFY row_number() OVER (PARTITION BY contig, pos ORDER BY sid) = 1")
on_calls("duplicate_samples", lambda c: ingest.duplicates((s := c.select("sid").distinct()).union(s.where("sid % 3 = 1")), ["sid"]), "SELECT sid, count(*) AS n FROM (SELECT DISTINCT sid FROM geno UNION ALL (SELECT DISTINCT sid FROM geno WHERE sid % 3 = 1)) GROUP BY 1 HAVING count(*) > 1")
_roles = lambda c: ingest.lineages(c.sparkSession, {"p": [1, 2, 3], "q": [4, 5, 6, 7]}, [(2, 0), (5, 1)])
TWO_SITES = """, hap AS (SELECT contig, pos, sid, 0 AS hap, h0 AS x FROM geno UNION ALL SELECT contig, pos, sid, 1, h1 FROM geno),
role AS (SELECT *, CASE WHEN sid <= 3 THEN 1 ELSE 2 END AS pop, (sid = 2 AND hap = 0) OR (sid = 5 AND hap = 1) AS dist FROM hap),
sites2 AS (SELECT contig, pos, CAST(CASE WHEN count(*) FILTER (pop = 1 AND dist AND x IS NULL) > 0 THEN -1 ELSE coalesce(sum(x) FILTER (pop = 1 AND dist), 0) END AS INT) AS a1, CAST(coalesce(sum(x) FILTER (pop = 1 AND NOT dist), 0) AS INT) AS b1, CAST(count(x) FILTER (pop = 1 AND NOT dist) AS INT) AS nb1,
  CAST(CASE WHEN count(*) FILTER (pop = 2 AND dist AND x IS NULL) > 0 THEN -1 ELSE coalesce(sum(x) FILTER (pop = 2 AND dist), 0) END AS INT) AS a2, CAST(coalesce(sum(x) FILTER (pop = 2 AND NOT dist), 0) AS INT) AS b2, CAST(count(x) FILTER (pop = 2 AND NOT dist) AS INT) AS nb2 FROM role GROUP BY 1, 2)"""
on_calls("project_two", lambda c: ingest.project_roles(c, _roles(c), 2), f"{TWO_SITES} SELECT * FROM sites2")
on_calls("vcf_to_spans_two", lambda c, m: spans.compress(ingest.gap_fill(ingest.events(s := ingest.fold_monomorphic(ingest.project_roles(c, _roles(c), 2), (1, 1)), m), ingest.contig_lengths(s))).groupBy("contig_id", "a1", "b1", "nb1", "a2", "b2", "nb2").agg(F.sum("span").alias("bases"), F.count("*").alias("runs")), f"""{TWO_SITES}, sites AS (SELECT contig, pos, CASE WHEN z THEN 0 ELSE a1 END AS a1, CASE WHEN z THEN 0 ELSE b1 END AS b1, nb1, CASE WHEN z THEN 0 ELSE a2 END AS a2, CASE WHEN z THEN 0 ELSE b2 END AS b2, nb2 FROM (SELECT *, a1 = 1 AND a2 = 1 AND b1 = nb1 AND b2 = nb2 AS z FROM sites2)),
lens AS (SELECT contig, max(pos) + 10 AS length, max(nb1) AS n1, max(nb2) AS n2 FROM sites GROUP BY 1),
{MASKED.split('ev AS')[0].rstrip().rstrip(',')},
base AS (SELECT contig, unnest(range(0, length)) AS i, n1, n2 FROM lens),
seen AS (SELECT base.contig, i, CASE WHEN m.contig IS NOT NULL THEN -1 ELSE coalesce(s.a1, 0) END AS a1, CASE WHEN m.contig IS NOT NULL THEN 0 ELSE coalesce(s.b1, 0) END AS b1, CASE WHEN m.contig IS NOT NULL THEN 0 ELSE coalesce(s.nb1, n1) END AS nb1, CASE WHEN m.contig IS NOT NULL THEN -1 ELSE coalesce(s.a2, 0) END AS a2, CASE WHEN m.contig IS NOT NULL THEN 0 ELSE coalesce(s.b2, 0) END AS b2, CASE WHEN m.contig IS NOT NULL THEN 0 ELSE coalesce(s.nb2, n2) END AS nb2
  FROM base LEFT JOIN sites s ON s.contig = base.contig AND s.pos = i + 1 LEFT JOIN mi m ON m.contig = base.contig AND m.a <= i AND i < m.b)
SELECT contig AS contig_id, a1, b1, nb1, a2, b2, nb2, count(*) AS bases, count(*) FILTER (new) AS runs FROM (SELECT *, lag([a1, b1, nb1, a2, b2, nb2]) OVER (PARTITION BY contig ORDER BY i) IS DISTINCT FROM [a1, b1, nb1, a2, b2, nb2] AS new FROM seen) GROUP BY ALL""", mask=True)
on_calls("missing_samples", lambda c: ingest.missing_samples(c.sparkSession.range(12).select(F.col("id").cast("int").alias("sid")), c.select("sid").distinct()), "SELECT CAST(i AS INT) AS sid FROM range(12) AS t(i) WHERE i NOT IN (SELECT sid FROM geno)")
# spectra
D = ", d AS (SELECT contig, pos, CAST(sum(coalesce(h0, 0) + coalesce(h1, 0)) AS BIGINT) AS d, CAST(sum((h0 IS NOT NULL)::INT + (h1 IS NOT NULL)::INT) AS BIGINT) AS n FROM geno GROUP BY 1, 2)"
on_calls("sfs", sampling.spectrum, f"{D} SELECT n, d AS k, count(*) AS sites FROM d GROUP BY 1, 2")
on_calls("sfs_folded", lambda c: sampling.spectrum(c, True), f"{D} SELECT n, least(d, n - d) AS k, count(*) AS sites FROM d GROUP BY 1, 2")
on_calls("segregating_positions", sampling.segregating, f"{D} SELECT contig, pos FROM d WHERE d > 0 AND d < n")
on_calls("maf_filter", lambda c: sampling.by_frequency(c, 0.1, 0.9), f"{D} SELECT * FROM d WHERE n > 0 AND d / n BETWEEN 0.1 AND 0.9")
on_spans("undistinguished_sfs", sampling.marginal_spectrum, "SELECT nb1, a1 + b1 AS k, CAST(sum(span) AS BIGINT) AS bases FROM spans WHERE a1 >= 0 GROUP BY 1, 2")
on_spans("undistinguished_sfs_folded", lambda df: sampling.marginal_spectrum(df, True), "SELECT nb1, least(a1 + b1, 2 + nb1 - a1 - b1) AS k, CAST(sum(span) AS BIGINT) AS bases FROM spans WHERE a1 >= 0 GROUP BY 1, 2")
on_calls("missingness_per_sample", lambda c: rounded(sampling.missingness(c), "missing"), "SELECT sid, round(avg(CASE WHEN h0 IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing FROM geno GROUP BY 1")
on_calls("nan_mean_track", lambda c: rounded(ingest.track(c, 100), "mean"), "SELECT contig, pos // 100 AS win, round(avg(h0), 6) AS mean, count(h0) AS n FROM geno GROUP BY 1, 2")
# keys
KEYS = ", ks AS (SELECT DISTINCT a1, b1, nb1 FROM spans)"
on_spans("distinct_keys", keys.distinct, f"{KEYS} SELECT * FROM ks")
on_spans("span_targets", keys.targets, f"SELECT DISTINCT span, {OBS} FROM spans WHERE span > 1")
on_spans("fold_keys", lambda df: keys.folded(keys.distinct(df)), f"{KEYS} SELECT *, CASE WHEN a1 < 0 THEN a1 ELSE 2 - a1 END AS fa, nb1 - b1 AS fb FROM ks")
on_spans("key_expand_missing", lambda df: keys.expand_missing(keys.distinct(df)), f"{KEYS} SELECT *, unnest(CASE WHEN a1 < 0 THEN [0, 1, 2] ELSE [a1] END) AS a FROM ks")
LF = ", lf AS (SELECT i, sum(ln(greatest(i, 1))) OVER (ORDER BY i) AS f FROM range(0, 7) AS t(i))"
HYPER = f"{KEYS}{LF}, hy AS (SELECT ks.*, unnest(range(b1, 6 + b1 - nb1 + 1)) AS full_ FROM ks), mg AS (SELECT a1, b1, nb1, CAST(full_ AS INT) AS \"full\", exp(f1.f - f2.f - f3.f + f4.f - f5.f - f6.f - (f7.f - f8.f - f9.f)) AS weight FROM hy JOIN lf f1 ON f1.i = full_ JOIN lf f2 ON f2.i = b1 JOIN lf f3 ON f3.i = full_ - b1 JOIN lf f4 ON f4.i = 6 - full_ JOIN lf f5 ON f5.i = nb1 - b1 JOIN lf f6 ON f6.i = 6 - full_ - nb1 + b1 JOIN lf f7 ON f7.i = 6 JOIN lf f8 ON f8.i = nb1 JOIN lf f9 ON f9.i = 6 - nb1)"
on_spans("hypergeom_marginalize", lambda df: rounded(keys.marginalise(keys.distinct(df), 6), "weight"), f"{HYPER} SELECT a1, b1, nb1, \"full\", round(weight, 6) AS weight FROM mg")
on_spans("polarize_keys", lambda df: rounded(keys.polarise(df.where("a1 >= 0 and nb1 > 0").groupBy(F.expr("contig_id % 5").alias("grp"), *keys.KEY).agg(F.sum("span").cast("double").alias("mass")), 0.25), "mass"), """, m AS (SELECT contig_id % 5 AS grp, CASE WHEN a1 = 2 AND b1 = nb1 THEN 0 ELSE a1 END AS a1, CASE WHEN a1 = 2 AND b1 = nb1 THEN 0 ELSE b1 END AS b1, nb1, CAST(sum(span) AS DOUBLE) AS mass FROM spans WHERE a1 >= 0 AND nb1 > 0 GROUP BY ALL),
u AS (SELECT grp, a1, b1, nb1, mass * 0.75 AS mass FROM m UNION ALL SELECT grp, 2 - a1, nb1 - b1, nb1, mass * 0.25 FROM m), s AS (SELECT grp, a1, b1, nb1, sum(mass) AS mass FROM u WHERE NOT (a1 = 2 AND b1 = nb1) GROUP BY ALL)
SELECT grp, a1, b1, nb1, round(mass / sum(mass) OVER (PARTITION BY grp), 6) AS mass FROM s""")


def _emission(df: DataFrame) -> DataFrame:
    return keys.distinct(df).select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("m")).withColumn("p", 1 / (2.0 + F.col("m") + F.col("b1") + F.abs("a1")))


on_spans("emission_lookup", lambda df: rounded(keys.emission_lookup(df, F.broadcast(_emission(df))).groupBy("contig_id", "m").agg(F.sum(F.col("span") * F.log("p")).alias("ll")), "ll"), "SELECT contig_id, m, round(sum(span * ln(1 / (2.0 + m + b1 + abs(a1)))), 6) AS ll FROM spans, (SELECT CAST(unnest([0, 1, 2, 3]) AS INT) AS m) GROUP BY 1, 2")
on_spans("emission_mixture", lambda df: rounded(keys.mixture(keys.marginalise(keys.distinct(df).where("a1 >= 0"), 6).withColumn("a", F.col("a1")), df.sparkSession.range(3).select(F.col("id").cast("int").alias("a")).select("a", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("full")).select("a", "full", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("m")).withColumn("p", 1 / (1.0 + F.col("a") + F.col("full") * F.col("m")))), "p"), f"{HYPER} SELECT a1, b1, nb1, m, round(sum(weight / (1.0 + a1 + \"full\" * m)), 6) AS p FROM mg, (SELECT CAST(unnest([0, 1, 2]) AS INT) AS m) WHERE a1 >= 0 GROUP BY ALL")
# sets, folds, draws
_half = lambda c, k: c.where(F.col("sid") % 2 == k).select("sid")
on_calls("populations_union", lambda c: _half(c, 0).union(_half(c, 1)).distinct(), "SELECT DISTINCT sid FROM geno")
on_calls("populations_disjoint", lambda c: _half(c, 0).intersect(c.where("sid < 4").select("sid")), "SELECT DISTINCT sid FROM geno WHERE sid % 2 = 0 AND sid < 4")
on_calls("undist_except", lambda c: c.select("sid").distinct().select("sid", F.explode(F.array(F.lit(0), F.lit(1))).alias("hap")).exceptAll(c.where("sid = 1").select("sid").distinct().select("sid", F.explode(F.array(F.lit(0), F.lit(1))).alias("hap"))), "SELECT sid, unnest([0, 1]) AS hap FROM (SELECT DISTINCT sid FROM geno WHERE sid <> 1)")
on_spans("kfold_assign", lambda df: sampling.folds(df.select("contig_id").distinct(), 4), "SELECT contig_id, CAST(ntile(4) OVER (ORDER BY contig_id) - 1 AS INT) AS fold FROM (SELECT DISTINCT contig_id FROM spans)")
on_spans("train_complement", lambda df: df.join(sampling.folds(df.select("contig_id").distinct(), 4).where("fold <> 1"), "contig_id").groupBy("fold").agg(F.count("*").alias("rows"), F.sum("span").alias("bases")), ", f AS (SELECT contig_id, CAST(ntile(4) OVER (ORDER BY contig_id) - 1 AS INT) AS fold FROM (SELECT DISTINCT contig_id FROM spans)) SELECT fold, count(*) AS rows, CAST(sum(span) AS BIGINT) AS bases FROM spans JOIN f USING (contig_id) WHERE fold <> 1 GROUP BY 1")
on_spans("bootstrap_chunks", lambda df: sampling.bootstrap(df.select("contig_id").distinct(), 100, 7), ", n AS (SELECT contig_id, row_number() OVER (ORDER BY contig_id) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT contig_id FROM spans)) SELECT i AS draw, contig_id FROM range(100) AS t(i) JOIN n ON k = CAST('0x' || substr(md5('7:' || CAST(i AS VARCHAR)), 1, 12) AS BIGINT) % n")
# splines
SPLINES = {kind: splines.fit(kind, [0.0, 0.25, 0.75, 1.5, 2.0], [0.5, 1.0, 0.75, 0.875, 2.0]) for kind in ("cubic", "pchip", "akima", "piecewise")}
_curves = ", ".join(f"('{m}', {t!r}::DOUBLE, " + ", ".join(f"{float(v)!r}::DOUBLE" for v in c) + ")" for m, s in SPLINES.items() for t, c in zip(s.x.tolist(), s.c.tolist(), strict=True))
_kind = lambda: F.element_at(F.array(*map(F.lit, SPLINES)), (F.col("contig_id") % 4 + 1).cast("int"))
QUERIES["spline_asof"] = lambda s, d: rounded(splines.values(span_table(s, d).select(_kind().alias("model_id"), "seq", (F.col("span") / 16).alias("t")), splines.pieces(s, SPLINES)), "y")
SQL["spline_asof"] = f"WITH {SPANS_SQL}, c AS (SELECT * FROM (VALUES {_curves}) AS v(model_id, t0, c0, c1, c2, c3)), p AS (SELECT {list(SPLINES)}[contig_id % 4 + 1] AS model_id, seq, span / 16 AS t FROM spans) SELECT p.model_id, seq, t, round(c0 + c1 * (t - t0) + c2 * (t - t0) ** 2 + c3 * (t - t0) ** 3, 6) AS y FROM p ASOF JOIN c ON p.model_id = c.model_id AND p.t >= c.t0"


# text formats: written to the shared folder and read again
def _span_text(df: DataFrame) -> DataFrame:
    path = text.scratch(df.sparkSession, "spans")
    text.write_spans(df, path, df.select("contig_id").distinct().withColumn("header", F.lit('{"version": "1", "pids": ["p"]}')))
    return text.read_spans(df.sparkSession, path, contig=F.regexp_extract("file", "contig_id=([^/]+)", 1).cast("bigint"))


def _vcf_text(calls: DataFrame) -> DataFrame:
    spark, path = calls.sparkSession, text.scratch(calls.sparkSession, "calls")
    samples = [r.sid for r in calls.select("sid").distinct().orderBy("sid").collect()]  # columns of the file
    text.write_vcf(calls, path, samples, calls.groupBy("contig").agg(F.max("pos").alias("length")))
    back = text.genotypes(text.read_variants(spark, path), text.vcf_samples(spark, path))
    return ingest.project(back.withColumn("sid", F.col("sid").cast("int")))


on_spans("span_text_roundtrip", lambda df: _span_text(df).select("contig_id", F.row_number().over(spans.ordered()).alias("line"), "span", "a1", "b1", "nb1"), f"SELECT contig_id, row_number() OVER (PARTITION BY contig_id ORDER BY seq) AS line, span, {OBS} FROM spans")
on_calls("vcf_text_roundtrip", _vcf_text, f"{SITES} SELECT * FROM sites")


# inference; no SQL counterpart but for the weaker check of rows
def _pair_model(_: DataFrame | None):
    from ..operators import demography as dm

    known = [(a, b, n) for a in (-1, 0, 1, 2) for n in (0, 4) for b in range(n + 1)]
    steps = dm.Steps(dm.np.array([0.0, 0.2, 1.0]), dm.np.array([1.0, 0.3, 2.0]))
    return dm.pair_model(steps, steps.balanced(8), 0.05, 0.02, known)


def _stats(df: DataFrame) -> DataFrame:
    from ..operators import hmm

    return hmm.statistics(spans.compress(df), _pair_model(df))


def hmm_loglik(df: DataFrame) -> DataFrame:
    from ..operators import hmm

    return hmm.logliks(spans.compress(df), _pair_model(df))


def _posterior(df: DataFrame) -> DataFrame:
    from ..operators import hmm

    found = hmm.posterior(spans.compress(df), _pair_model(df))
    return rounded(found.select("contig_id", "seq", "start", "span", F.posexplode("gamma").alias("m", "p")), "p")


def _perplexity(df: DataFrame) -> DataFrame:
    from ..operators import hmm

    return rounded(hmm.perplexity(_stats(df)), "occupancy", "perplexity")


on_spans("hmm_loglik", lambda df: rounded(hmm_loglik(df), "loglik"))
on_spans("hmm_posterior", _posterior)
on_spans("gamma_sums", lambda df: rounded(_stats(df).where("kind = 'gamma'").groupBy("key", "i").agg(F.sum("value").alias("mass")), "mass"))
on_spans("occupancy_perplexity", _perplexity)


def _sample_model(df: DataFrame):
    return sample_model([(r.a1, r.b1, r.nb1) for r in keys.distinct(df).collect()])  # at most a few for each number of samples


def sample_model(known: list[tuple[int, int, int]]):
    from ..operators import conditioned
    from ..operators import demography as dm

    steps = dm.Steps(dm.np.array([0.0, 0.2, 1.0]), dm.np.array([1.0, 0.3, 2.0]))
    return conditioned.sample_model(steps, steps.balanced(8), 0.05, 0.02, known)


def _sample_loglik(df: DataFrame) -> DataFrame:
    from ..operators import hmm

    return rounded(hmm.logliks(spans.compress(df), _sample_model(df)), "loglik")


on_spans("sample_loglik", _sample_loglik)
