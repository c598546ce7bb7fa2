"""Queries on model tables: each contig of the span table gives a model, whose sizes follow what its rows show."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import conditioned, joint, measures, models, moran
from ..operators import demography as dm
from ..sources.adapters import SPANS_SQL
from ..sources.adapters import spans as span_table
from .more import QUERIES, SQL, TWO_KEYS, UNIFORM, _forward
from .queries import EDGE_SQL, LF, _two, on_spans, rounded

TIMES = [0.0, 0.125, 0.5, 2.0]
_LIST = "[" + ", ".join(f"{t}::DOUBLE" for t in TIMES) + "]"

PIECES = f"""{SPANS_SQL},
shown AS (SELECT contig_id, i, sum(CASE WHEN seq % 4 = i AND a1 >= 0 THEN span ELSE 0 END) AS x,
  sum(CASE WHEN seq % 4 = i AND a1 > 0 THEN span ELSE 0 END) AS y FROM spans, range(4) AS t(i) GROUP BY 1, 2),
pieces AS (SELECT CAST(contig_id AS VARCHAR) AS model_id, CAST(i AS INT) AS piece, {_LIST}[i + 1] AS t0, {_LIST}[i + 2] AS t1,
  0.25 + CAST(x AS DOUBLE) / (10 + 4 * CAST(y AS DOUBLE)) AS size FROM shown),
hz AS (SELECT *, coalesce(sum((t1 - t0) / size) OVER (PARTITION BY model_id ORDER BY t0
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS hazard FROM pieces)"""


def pieces_of(df: DataFrame) -> DataFrame:
    """model_id, piece, t0, t1, size: four pieces a contig, of the shares of derived bases among a quarter of its rows each."""
    part = lambda i, seen: F.sum(F.when((F.col("seq") % 4 == i) & seen, F.col("span")).otherwise(0)).cast("double")
    sizes = [(F.lit(0.25) + part(i, F.col("a1") >= 0) / (10 + 4 * part(i, F.col("a1") > 0))).alias(f"s{i}") for i in range(4)]
    rows = df.groupBy(F.col("contig_id").cast("string").alias("model_id")).agg(*sizes)
    all_ = [F.struct(F.lit(i).alias("piece"), F.lit(t).alias("t0"), F.lit(e).cast("double").alias("t1"), F.col(f"s{i}").alias("size")) for i, (t, e) in enumerate(zip(TIMES, [*TIMES[1:], None], strict=True))]
    return rows.select("model_id", F.inline(F.array(*all_)))


def on_models(name: str, run: Callable[[DataFrame, DataFrame], DataFrame], sql: str) -> None:
    """A query of (pieces, span rows) and what follows WITH spans, pieces and their hazards."""

    def query(spark, sf_dir: str) -> DataFrame:
        df = span_table(spark, sf_dir)
        return run(pieces_of(df), df)

    QUERIES[name] = query
    SQL[name] = f"WITH {PIECES}{sql if sql.lstrip().startswith(',') else ' ' + sql}"


def points(df: DataFrame, scale: int, name: str) -> DataFrame:
    return df.select(F.col("contig_id").cast("string").alias("model_id"), "seq", (F.col("span") / scale).alias(name))


POINTS = lambda scale, name: f", p AS (SELECT CAST(contig_id AS VARCHAR) AS model_id, seq, span / {scale} AS {name} FROM spans)"
on_models("cumulative_hazard", lambda p, df: rounded(models.hazard(p), "size", "hazard"), "SELECT model_id, piece, t0, t1, round(size, 6) AS size, round(hazard, 6) AS hazard FROM hz")
on_models("hazard_asof", lambda p, df: rounded(models.hazard_at(points(df, 16, "t"), p).select("model_id", "seq", "t", "r"), "r"), f"""{POINTS(16, 't')}
SELECT p.model_id, seq, t, round(hazard + (t - t0) / size, 6) AS r FROM p ASOF JOIN hz ON p.model_id = hz.model_id AND p.t >= hz.t0""")
on_models("hazard_inverse", lambda p, df: rounded(models.time_of(points(df, 8, "y"), p).select("model_id", "seq", "y", "t"), "t"), f"""{POINTS(8, 'y')}
SELECT p.model_id, seq, y, round(t0 + (y - hazard) * size, 6) AS t FROM p ASOF JOIN hz ON p.model_id = hz.model_id AND p.y >= hz.hazard""")
_grid = lambda p: p.select("model_id").distinct().withColumn("m", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(7).cast("bigint")))).withColumn("t", F.col("m") / 4)
on_models("initial_distribution", lambda p, df: rounded(models.initial(_grid(p), p), "p"), """,
p AS (SELECT model_id, i AS m, i / 4 AS t FROM (SELECT DISTINCT model_id FROM pieces), range(8) AS t(i)),
s AS (SELECT p.model_id, m, t, exp(-(hazard + (t - t0) / size)) AS s FROM p ASOF JOIN hz ON p.model_id = hz.model_id AND p.t >= hz.t0),
q AS (SELECT *, greatest(s - coalesce(lead(s) OVER (PARTITION BY model_id ORDER BY t), 0), 1e-20) AS p FROM s)
SELECT model_id, m, t, round(p / sum(p) OVER (PARTITION BY model_id), 6) AS p FROM q""")
on_models("stepfun_average", lambda p, df: rounded(models.aggregate(p), "size"), """,
k AS (SELECT DISTINCT t0 AS t FROM pieces), p AS (SELECT model_id, t FROM k, (SELECT DISTINCT model_id FROM pieces))
SELECT t, round(avg(size), 6) AS size, count(*) AS models FROM p ASOF JOIN hz ON p.model_id = hz.model_id AND p.t >= hz.t0 GROUP BY t""")
on_models("splice_models", lambda p, df: rounded(models.splice(p, p.withColumn("size", 2 * F.col("size")), 0.4).select("model_id", "piece", "t0", "t1", "size"), "size"), """,
u AS (SELECT model_id, t0, size FROM pieces WHERE t0 < 0.4 UNION ALL SELECT model_id, greatest(t0, 0.4), 2 * size FROM pieces WHERE t1 IS NULL OR t1 > 0.4)
SELECT model_id, CAST(row_number() OVER w - 1 AS INT) AS piece, t0, lead(t0) OVER w AS t1, round(size, 6) AS size FROM u WINDOW w AS (PARTITION BY model_id ORDER BY t0)""")
on_models("shift_model", lambda p, df: rounded(models.shift(p, 0.2), "t0", "t1", "size"), """,
u AS (SELECT model_id, greatest(t0, 0.2) - 0.2 AS t0, size FROM pieces WHERE t1 IS NULL OR t1 > 0.2)
SELECT model_id, CAST(row_number() OVER w - 1 AS INT) AS piece, round(t0, 6) AS t0, round(lead(t0) OVER w, 6) AS t1, round(size, 6) AS size
FROM u WINDOW w AS (PARTITION BY model_id ORDER BY t0)""")
_times = lambda df: df.select(F.col("seq").alias("m"), F.when(F.col("seq") % 9 > 0, F.col("span") / 16).alias("t"))
on_models("reduced_emission", lambda p, df: rounded(models.reduced_emission(_times(df), 0.05, 2.0), "even", "odd"), """
SELECT seq AS m, round(coalesce(exp(-0.2 * t), 1e-20), 6) AS even, round(coalesce(1 - exp(-0.2 * t), 1e-20), 6) AS odd
FROM (SELECT seq, CASE WHEN seq % 9 > 0 THEN span / 16 END AS t FROM spans)""")
on_models("model_json_roundtrip", lambda p, df: rounded(models.from_json(models.to_json(p)), "size"), "SELECT model_id, piece, t0, t1, round(size, 6) AS size FROM pieces")

HAZ = lambda t, name: f"{name} AS (SELECT model_id, hazard + ({t} - t0) / size AS r FROM hz WHERE t0 <= {t} AND (t1 IS NULL OR {t} < t1))"
on_models("random_times", lambda p, df: rounded(measures.random_times(p, 0.05, 1.5, 20, 9), "t"), f""",
{HAZ(0.05, 'lo')}, {HAZ(1.5, 'hi')}, d AS (SELECT i AS draw, {UNIFORM(9, 'i')} AS u FROM range(20) AS t(i)),
y AS (SELECT lo.model_id, draw, lo.r - ln(1 - u * (1 - exp(lo.r - hi.r))) AS y FROM lo JOIN hi USING (model_id), d)
SELECT y.model_id, draw, round(t0 + (y - hazard) * size, 6) AS t FROM y ASOF JOIN hz ON y.model_id = hz.model_id AND y.y >= hz.hazard""")
on_models("model_with_knots", lambda p, df: rounded(measures.with_knots(p, [0.5, 0.2, 1.5]), "size"), """,
k AS (SELECT unnest([0.2, 0.5, 1.5]) AS t), u AS (SELECT model_id, t0, size FROM pieces UNION
  SELECT model_id, CAST(t AS DOUBLE), size FROM pieces, k WHERE t > t0 AND (t1 IS NULL OR t < t1))
SELECT model_id, CAST(row_number() OVER w - 1 AS INT) AS piece, t0, lead(t0) OVER w AS t1, round(size, 6) AS size FROM u WINDOW w AS (PARTITION BY model_id ORDER BY t0)""")
_offsets = lambda df: df.groupBy((F.col("contig_id") % 7 + 1).cast("int").alias("number")).agg((F.max("span") / 4).alias("offset"))
on_models("models_and_offsets", lambda p, df: rounded(measures.offset(p, _offsets(df)), "size"), """,
n AS (SELECT model_id, CAST(row_number() OVER (ORDER BY model_id) - 1 AS INT) AS number FROM (SELECT DISTINCT model_id FROM pieces)),
o AS (SELECT CAST(contig_id % 7 + 1 AS INT) AS number, max(span) / 4 AS "offset" FROM spans GROUP BY 1),
b AS (SELECT coalesce(n.number, o.number) AS number, model_id, coalesce(o.offset, 0) AS "offset" FROM n FULL JOIN o USING (number))
SELECT number, b.model_id, "offset", t0 + "offset" AS x, round(size, 6) AS size FROM b LEFT JOIN pieces p ON b.model_id = p.model_id""")
on_models("truncated_model", lambda p, df: rounded(models.truncate(p, 0.4), "size"), """
SELECT model_id, piece, t0, lead(t0) OVER (PARTITION BY model_id ORDER BY t0) AS t1, round(size, 6) AS size FROM pieces WHERE t0 < 0.4""")
on_models("clipped_model", lambda p, df: rounded(models.clip(p, 0.4, 0.9), "size"), "SELECT model_id, piece, t0, t1, round(least(greatest(size, 0.4), 0.9), 6) AS size FROM pieces")
on_models("demography_events", lambda p, df: rounded(models.demography(p, 1e4), "size"), "SELECT model_id, t0 * 20000 AS generation, round(size * 10000, 6) AS size FROM pieces")
on_models("step_plot", lambda p, df: rounded(models.step_plot(p, 1e4), "y"), """
SELECT model_id AS label, t0 * 20000 AS x, round(size * 10000, 6) AS y, 'step' AS plot_type, CAST(dense_rank() OVER (ORDER BY model_id) - 1 AS INT) AS plot_num FROM pieces""")
_rates = lambda df: df.groupBy("contig_id").agg((F.max("span") * 1e-9).alias("mu"), F.when(F.col("contig_id") % 3 > 0, F.min("span") * 1e-10).otherwise(0.0).alias("r"))
on_models("scaled_units", lambda p, df: rounded(models.with_units(_rates(df)), "n0", "theta", "rho"), """,
m AS (SELECT contig_id, max(span) * 1e-9::DOUBLE AS mu, CASE WHEN contig_id % 3 > 0 THEN min(span) * 1e-10::DOUBLE ELSE 0 END AS r FROM spans GROUP BY 1)
SELECT contig_id, mu, r, round(5e-5::DOUBLE / mu, 6) AS n0, 1e-4::DOUBLE AS theta, round(CASE WHEN r > 0 THEN 1e-4::DOUBLE / mu * r ELSE 1e-4::DOUBLE END, 6) AS rho FROM m""")


def _sizes(df: DataFrame) -> DataFrame:
    rows = models.growing("human", models.human()) + models.growing("sawtooth", models.sawtooth())
    known = df.sparkSession.createDataFrame(rows, "model_id string, piece int, t0 double, t1 double, size0 double, size1 double")
    at = df.select(F.when(F.col("contig_id") % 2 == 0, "human").otherwise("sawtooth").alias("model_id"), "seq", (F.col("span") / 128).alias("t"))
    return rounded(models.size_at(at, known).select("model_id", "seq", "t", "piece", "size"), "size")


on_models("built_in_histories", lambda p, df: _sizes(df), """,
h AS (SELECT * FROM (VALUES (0, 0.0, 10000.0, 10.0, 1.0), (1, 10000.0, 70000.0, 0.5, 0.5), (2, 70000.0, 200000.0, 1.0, 1.0), (3, 200000.0, 200001.0, 4.0, 4.0)) AS v(piece, y0, y1, a, b)),
e AS (SELECT * FROM (VALUES (0, 0.0, 0.000582262, 0.0), (1, 0.000582262, 0.00232905, 1318.18), (2, 0.00232905, 0.00931919, -329.546), (3, 0.00931919, 0.0372648, 82.3865),
  (4, 0.0372648, 0.149059, -20.5966), (5, 0.149059, 0.596236, 5.14916)) AS v(piece, g0, g1, rate)),
r AS (SELECT piece, g0, g1, 5 * exp(-sum(x) OVER (ORDER BY piece) + x) AS a, 5 * exp(-sum(x) OVER (ORDER BY piece)) AS b FROM (SELECT *, CAST(rate * (g1 - g0) AS DOUBLE) AS x FROM e)),
g AS (SELECT 'human' AS model_id, piece, CAST(y0 AS DOUBLE) / 20000 / 29 AS t0, CAST(y1 AS DOUBLE) / 20000 / 29 AS t1, CAST(a AS DOUBLE) AS size0, CAST(b AS DOUBLE) AS size1 FROM h
  UNION ALL SELECT 'sawtooth', piece, CAST(2 * g0 AS DOUBLE), CAST(2 * g1 AS DOUBLE), a, b FROM r
  UNION ALL SELECT 'sawtooth', 6, CAST(2 * g1 AS DOUBLE), CAST(2 * g1 AS DOUBLE) + 0.2, b, CAST(g1 AS DOUBLE) FROM r WHERE piece = 5),
p AS (SELECT CASE WHEN contig_id % 2 = 0 THEN 'human' ELSE 'sawtooth' END AS model_id, seq, span / 128 AS t FROM spans)
SELECT p.model_id, seq, t, CAST(piece AS INT) AS piece, CASE WHEN t < t1 THEN round(size0 * (size1 / size0) ** ((t - t0) / (t1 - t0)), 6) END AS size
FROM p ASOF JOIN g ON p.model_id = g.model_id AND p.t >= g.t0""")

# spectra and meeting times of every model, by closed forms
EVER = [0.0, math.inf]
STATES = [0.0, 0.0625, 0.125, 0.5, 2.0, math.inf]
CUTS = "(VALUES (0, 0, 0.0::DOUBLE, 0.0625::DOUBLE), (1, 0, 0.0625, 0.125), (2, 1, 0.125, 0.5), (3, 2, 0.5, 2.0), (4, 3, 2.0, NULL)) AS c(m, piece, a, b)"
MEAN = "CASE WHEN b IS NULL THEN a + size ELSE (a * exp(-a / size) - b * exp(-b / size)) / (exp(-a / size) - exp(-b / size)) + size END"


def _mean_times(p: DataFrame) -> DataFrame:
    return dm.per_model(p, lambda models: dm.meeting_times(models, STATES), "m int, t double")


on_models("meeting_times", lambda p, df: rounded(_mean_times(p), "t"), f"SELECT model_id, m, round({MEAN}, 6) AS t FROM pieces JOIN {CUTS} USING (piece)")
on_models("pair_branches", lambda p, df: rounded(conditioned.over_models(p, STATES, 2).where("a = 1").groupBy("model_id", "m").agg(F.sum("length").alias("mass")), "mass"),
          f"SELECT model_id, m, round(2 * {MEAN}, 6) AS mass FROM pieces JOIN {CUTS} USING (piece)")
AREA = lambda c: f"sum(exp(-{c} * hazard) * size / {c} * CASE WHEN t1 IS NULL THEN 1 ELSE 1 - exp(-{c} * (t1 - t0) / size) END)"
# a sample of three: spectra by state, mixed by the probability of each state
on_models("conditioned_spectra", lambda p, df: rounded(conditioned.mixed_over_models(p, STATES, 1), "length"), f""",
x AS (SELECT model_id, {AREA(3)} AS t3, {AREA(1)} AS t1 FROM hz GROUP BY 1), y AS (SELECT model_id, t3, 1.5 * (t1 - t3) AS t2 FROM x)
SELECT model_id, CAST(k AS INT) AS k, round(CASE WHEN k = 1 THEN 3 * t3 + t2 ELSE t2 END, 6) AS length FROM y, range(1, 3) AS r(k)""")
_flat = lambda p: p.where("piece = 0").withColumn("t1", F.lit(None).cast("double"))
on_models("constant_spectrum", lambda p, df: rounded(conditioned.over_models(_flat(p), EVER, 3).groupBy("model_id", (F.col("a") + F.col("b")).alias("k")).agg(F.sum("length").alias("length")).where("k between 1 and 4"), "length"),
          "SELECT model_id, CAST(k AS INT) AS k, round(2 * size / k, 6) AS length FROM pieces, range(1, 5) AS r(k) WHERE piece = 0")
_sizes_seen = lambda df: df.select((F.col("nb1") + F.col("span") % 3 + 1).cast("int").alias("n")).distinct()


def _eigenvalues(batches):
    import pandas as pd

    for pdf in batches:
        rows = [(n, d, i, float(x)) for n in pdf["n"].tolist() for d in (0, 1, 2) for i, x in enumerate(moran.eigensystem(n, d)[0])]
        yield pd.DataFrame(rows, columns=["n", "pair", "i", "value"])


on_models("moran_eigenvalues", lambda p, df: _sizes_seen(df).mapInPandas(_eigenvalues, "n int, pair int, i int, value double"), """,
s AS (SELECT DISTINCT CAST(nb1 + span % 3 + 1 AS INT) AS n FROM spans)
SELECT n, CAST(pair AS INT) AS pair, CAST(k - 2 AS INT) AS i, CAST(1 - k * (k - 1) / 2 AS DOUBLE) AS value FROM s, range(0, 3) AS p(pair), range(2, 10) AS t(k) WHERE k < n + 3""")

# two populations: the first has a contig's model, the second the same with its sizes halved, the split is at 0.5 or 2
SPLIT = "CASE WHEN CAST(model_id AS BIGINT) % 2 = 0 THEN 0.5 ELSE 2.0 END"


def _pairs(p: DataFrame) -> DataFrame:
    split = F.when(F.col("model_id").cast("bigint") % 2 == 0, 0.5).otherwise(2.0)
    both = p.withColumn("population", F.explode(F.array(F.lit(1), F.lit(2))))
    return both.withColumns({"size": F.when(F.col("population") == 2, F.col("size") / 2).otherwise(F.col("size")), "split": split})


on_models("joint_first_margin", lambda p, df: rounded(joint.over_models(_pairs(p), STATES, (1, 1)).where("a1 = 1").groupBy("model_id", "m").agg(F.sum("length").alias("mass")), "mass"),
          f"SELECT model_id, m, round(2 * {MEAN}, 6) AS mass FROM pieces JOIN {CUTS} USING (piece)")
_SPLICED = f""",
z AS (SELECT model_id, t0, t1, CASE WHEN t0 < {SPLIT} THEN size / 2 ELSE size END AS size FROM pieces),
hz2 AS (SELECT *, coalesce(sum((t1 - t0) / size) OVER (PARTITION BY model_id ORDER BY t0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS hazard FROM z)"""
on_models("joint_second_margin", lambda p, df: rounded(joint.over_models(_pairs(p), EVER, (1, 2)).where("b2 = 1").groupBy("model_id").agg(F.sum("length").alias("length")), "length"),
          f"{_SPLICED} SELECT model_id, round(2 * {AREA(1)}, 6) AS length FROM hz2 GROUP BY 1")
on_models("joint_pair_apart", lambda p, df: rounded(joint.over_models(_pairs(p), STATES, (0, 0), (1, 1)).where("a1 + a2 = 1 and length > 0").select("model_id", "m", "a1", "length"), "length"),
          f"SELECT model_id, m, CAST(a1 AS INT) AS a1, round({MEAN}, 6) AS length FROM pieces JOIN {CUTS} USING (piece), range(2) AS r(a1) WHERE a >= {SPLIT}")

# inference on two-population rows
ONE, TWO = dm.Steps(dm.np.array([0.0, 0.2, 1.0]), dm.np.array([1.0, 0.3, 2.0])), dm.Steps(dm.np.array([0.0, 0.5]), dm.np.array([0.5, 1.5]))
AT, N2, THETA = 0.3, (4, 3), 0.05
BROKEN = [0.0, 0.3, 0.8, 1.6, math.inf]
_apart = lambda df: _two(df).where("a1 <= 1 and b1 <= nb1 and b2 <= nb2")
_lengths = joint.spectra(ONE, TWO, AT, BROKEN, N2, (1, 1))
_pairs_seen = dm.pair_emission(joint.apart(ONE, AT), BROKEN, THETA)
_table = ", ".join(f"({m}, {a}, {b}, {c}, {d}, {float(x)!r}::DOUBLE)" for (m, a, b, c, d), x in dm.np.ndenumerate(_lengths))
_seen = ", ".join(f"({m}, {i}, {float(x)!r}::DOUBLE)" for i, row in enumerate(_pairs_seen) for m, x in enumerate(row))
on_spans("joint_spectrum_keys", lambda df: rounded(joint.key_table(_apart(df).select("a1", "b1", "nb1", "a2", "b2", "nb2"), ONE, TWO, AT, BROKEN, THETA, N2, (1, 1)), "p"), f"""{TWO_KEYS}{LF},
k AS (SELECT * FROM k2 WHERE a1 <= 1), lengths AS (SELECT * FROM (VALUES {_table}) AS v(m, f1, g1, f2, g2, x)), pair AS (SELECT * FROM (VALUES {_seen}) AS v(m, i, p)),
whole AS (SELECT m, sum(x) AS l FROM lengths GROUP BY 1),
raw AS (SELECT lengths.*, CASE WHEN l > 0 THEN x * (1 - exp(-{THETA} * l)) / l ELSE 0 END AS q FROM lengths JOIN whole USING (m)),
probs AS (SELECT m, f1, g1, f2, g2, greatest(CASE WHEN f1 + g1 + f2 + g2 = 0 THEN 1 - sum(q) OVER (PARTITION BY m) + q ELSE q END, 1e-10) AS q FROM raw),
choose AS (SELECT x.i AS n, y.i AS k, exp(x.f - y.f - z.f) AS c FROM lf x, lf y, lf z WHERE y.i <= x.i AND z.i = x.i - y.i AND x.i <= 4),
s1 AS (SELECT *, unnest(range(b1, {N2[0]} + b1 - nb1 + 1)) AS g1, unnest(range(b1, {N2[0]} + b1 - nb1 + 1)) - b1 AS o1 FROM k),
s2 AS (SELECT *, unnest(range(b2, {N2[1]} + b2 - nb2 + 1)) AS g2, unnest(range(b2, {N2[1]} + b2 - nb2 + 1)) - b2 AS o2 FROM s1),
s3 AS (SELECT *, unnest(CASE WHEN a1 < 0 THEN [0, 1] ELSE [a1] END) AS f1 FROM s2), s4 AS (SELECT *, unnest(CASE WHEN a2 < 0 THEN [0, 1] ELSE [a2] END) AS f2 FROM s3),
w AS (SELECT s4.*, c1.c * c2.c / c3.c * c4.c * c5.c / c6.c AS w FROM s4 JOIN choose c1 ON c1.n = g1 AND c1.k = b1 JOIN choose c2 ON c2.n = {N2[0]} - g1 AND c2.k = nb1 - b1 JOIN choose c3 ON c3.n = {N2[0]} AND c3.k = nb1
  JOIN choose c4 ON c4.n = g2 AND c4.k = b2 JOIN choose c5 ON c5.n = {N2[1]} - g2 AND c5.k = nb2 - b2 JOIN choose c6 ON c6.n = {N2[1]} AND c6.k = nb2),
z AS (SELECT *, f1 = 1 AND f2 = 1 AND g1 = {N2[0]} AND g2 = {N2[1]} AS mono FROM w),
y AS (SELECT a1, b1, nb1, a2, b2, nb2, CASE WHEN mono THEN 0 ELSE f1 END AS f1, CASE WHEN mono THEN 0 ELSE g1 END AS g1, CASE WHEN mono THEN 0 ELSE f2 END AS f2, CASE WHEN mono THEN 0 ELSE g2 END AS g2, w FROM z),
sides AS (SELECT *, 0.5 * w AS v FROM y UNION ALL SELECT a1, b1, nb1, a2, b2, nb2, 1 - f1, {N2[0]} - g1, 1 - f2, {N2[1]} - g2, w, 0.5 * w FROM y),
kept AS (SELECT *, v / sum(v) OVER (PARTITION BY a1, b1, nb1, a2, b2, nb2) AS share FROM sides WHERE NOT (f1 = 1 AND f2 = 1 AND g1 = {N2[0]} AND g2 = {N2[1]})),
mixed AS (SELECT a1, b1, nb1, a2, b2, nb2, m, sum(share * q) AS p FROM kept JOIN probs USING (f1, g1, f2, g2) GROUP BY ALL)
SELECT k.a1, k.b1, k.nb1, k.a2, k.b2, k.nb2, mixed.m, round(CASE WHEN k.nb1 + k.nb2 = 0 AND k.a1 < 0 AND k.a2 < 0 THEN 1 WHEN k.nb1 + k.nb2 = 0 AND k.a1 >= 0 AND k.a2 >= 0 THEN pair.p ELSE mixed.p END, 6) AS p
FROM k JOIN mixed USING (a1, b1, nb1, a2, b2, nb2) LEFT JOIN pair ON pair.m = mixed.m AND pair.i = (k.a1 + k.a2) % 2""")

_KNOWN2 = [(a, b, n, c, d, e) for a in (-1, 0, 1) for n in (0, 4) for b in range(n + 1) for c in ((-1,) if a < 0 else (0, 1)) for d, e in ((0, 0), (1, 3), (3, 3))]
_MODEL2 = joint.model_of(ONE, TWO, AT, BROKEN, THETA, 0.02, _KNOWN2, (1, 1), N2)


def _two_loglik(df: DataFrame) -> DataFrame:
    from ..operators import hmm
    from ..operators import spans as sp

    rows = _apart(df)
    known = [tuple(r) for r in rows.select(*hmm.key_columns(rows)).distinct().collect()]  # counts of two small samples
    return rounded(hmm.logliks(sp.compress(rows), joint.model_of(ONE, TWO, AT, BROKEN, THETA, 0.02, known, (1, 1), N2)), "loglik")


on_spans("hmm_loglik_two", _two_loglik)
SQL["hmm_loglik_two"] = _forward(_MODEL2, EDGE_SQL, "(SELECT * FROM two WHERE a1 <= 1)")
