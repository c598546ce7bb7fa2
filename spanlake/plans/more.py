"""Further registered queries: two populations, panels, measures, model tables, scalar functions, inference; with SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import ingest, keys, measures, panels, sampling, spans
from ..sources import formats
from ..sources.adapters import GENO_SQL, SPANS_SQL
from ..sources.adapters import spans as span_table
from . import queries as base
from .queries import EDGE_SQL, LF, QUERIES, SITES, SQL, _two, on_calls, on_spans, rounded

UNIFORM = lambda seed, *names: f"(CAST('0x' || substr(md5('{seed}:' || " + " || ':' || ".join(f"CAST({n} AS VARCHAR)" for n in names) + "), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0"

# two populations
TWO_KEYS = f"{EDGE_SQL}, k2 AS (SELECT DISTINCT a1, b1, nb1, a2, b2, nb2 FROM two WHERE b1 <= nb1 AND b2 <= nb2)"
_keys2 = lambda df: _two(df).where("b1 <= nb1 and b2 <= nb2").select("a1", "b1", "nb1", "a2", "b2", "nb2").distinct()
on_spans("distinct_keys_two", _keys2, f"{TWO_KEYS} SELECT * FROM k2")
on_spans("fold_block_keys", lambda df: keys.folded_inside(_keys2(df), (2, 1)), f"""{TWO_KEYS}
SELECT *, CASE WHEN a1 >= 0 THEN 2 - a1 ELSE a1 END AS fa1, CASE WHEN b1 BETWEEN 1 AND nb1 - 1 THEN nb1 - b1 ELSE b1 END AS fb1,
  CASE WHEN a2 >= 0 THEN 1 - a2 ELSE a2 END AS fa2, CASE WHEN b2 BETWEEN 1 AND nb2 - 1 THEN nb2 - b2 ELSE b2 END AS fb2 FROM k2""")
on_spans("sampled_lineages", lambda df: keys.sampled(_keys2(df)), f"{TWO_KEYS} SELECT *, nb1 + nb2 AS n FROM k2")
on_spans("most_sampled", lambda df: keys.most_sampled(_two(df)).select("n1", "n2", F.concat_ws(",", F.transform("values1", lambda x: x.cast("string"))).alias("values1"), F.concat_ws(",", F.transform("values2", lambda x: x.cast("string"))).alias("values2")), f"""{EDGE_SQL}
SELECT max(nb1) AS n1, max(nb2) AS n2, array_to_string(list_sort(list(DISTINCT a1)), ',') AS values1, array_to_string(list_sort(list(DISTINCT a2)), ',') AS values2 FROM two""")
CHOOSE = lambda n, k: f"(SELECT exp(x.f - y.f - z.f) FROM lf x, lf y, lf z WHERE x.i = {n} AND y.i = {k} AND z.i = {n} - ({k}))"
on_spans("key_cross_two", lambda df: rounded(keys.cross(_keys2(df).where("a1 <= 1"), (5, 4), (1, 1)), "weight"), f"""{TWO_KEYS}{LF},
s1 AS (SELECT a1, b1, nb1, unnest(range(b1, 5 + b1 - nb1 + 1)) AS f1 FROM (SELECT DISTINCT a1, b1, nb1 FROM k2)), s2 AS (SELECT a2, b2, nb2, unnest(range(b2, 4 + b2 - nb2 + 1)) AS f2 FROM (SELECT DISTINCT a2, b2, nb2 FROM k2)),
w1 AS (SELECT *, unnest(CASE WHEN a1 < 0 THEN [0, 1] ELSE [a1] END) AS t1, {CHOOSE('f1', 'b1')} * {CHOOSE('5 - f1', 'nb1 - b1')} / {CHOOSE('5', 'nb1')} AS w1 FROM s1),
w2 AS (SELECT *, unnest(CASE WHEN a2 < 0 THEN [0, 1] ELSE [a2] END) AS t2, {CHOOSE('f2', 'b2')} * {CHOOSE('4 - f2', 'nb2 - b2')} / {CHOOSE('4', 'nb2')} AS w2 FROM s2)
SELECT k2.*, CAST(t1 AS INT) AS to_a1, CAST(f1 AS INT) AS to_b1, CAST(t2 AS INT) AS to_a2, CAST(f2 AS INT) AS to_b2, round(w1 * w2, 6) AS weight FROM k2 JOIN w1 USING (a1, b1, nb1) JOIN w2 USING (a2, b2, nb2) WHERE a1 <= 1""")
on_spans("for_population", lambda df: spans.compress(keys.for_population(_two(df), 2)).groupBy("contig_id", "a1", "b1", "nb1").agg(F.sum("span").alias("bases"), F.count("*").alias("runs")), f"""{EDGE_SQL},
l AS (SELECT *, CASE WHEN lag([a2, b2, nb2]) OVER (PARTITION BY contig_id ORDER BY seq) = [a2, b2, nb2] THEN 0 ELSE 1 END AS new FROM two)
SELECT contig_id, a2 AS a1, b2 AS b1, nb2 AS nb1, CAST(sum(span) AS BIGINT) AS bases, CAST(sum(new) AS BIGINT) AS runs FROM l GROUP BY ALL""")
on_spans("canonical_order", lambda df: spans.canonical(_two(df).withColumn("dist2", F.when(F.col("contig_id") % 2 == 0, 2).otherwise(1))).drop("dist2"), f"""{EDGE_SQL} SELECT contig_id, seq, span, CASE WHEN s THEN a2 ELSE a1 END AS a1, CASE WHEN s THEN b2 ELSE b1 END AS b1, CASE WHEN s THEN nb2 ELSE nb1 END AS nb1,
CASE WHEN s THEN a1 ELSE a2 END AS a2, CASE WHEN s THEN b1 ELSE b2 END AS b2, CASE WHEN s THEN nb1 ELSE nb2 END AS nb2 FROM (SELECT *, contig_id % 2 = 0 AS s FROM two)""")
on_spans("monomorphic_rows", lambda df: df.where(keys.monomorphic()).groupBy("a1", "b1", "nb1").agg(F.sum("span").alias("bases")), "SELECT a1, b1, nb1, CAST(sum(span) AS BIGINT) AS bases FROM spans WHERE (a1 = 0 AND b1 = 0) OR (a1 = 2 AND b1 = nb1) GROUP BY ALL")
on_spans("load_checks", lambda df: spans.load_checks(df, df.select("contig_id").distinct().selectExpr("contig_id", "array('p') as pids", "array(array(array('s', '0'))) as undist", "CASE WHEN contig_id % 3 = 0 THEN array(array(array('a', '0'))) ELSE array(array(array('a', '0'), array('a', '1'))) END AS dist")),
         "SELECT contig_id, count(*) AS rows, CAST(sum(span) AS BIGINT) AS bases, contig_id % 3 <> 0 AS ok FROM spans GROUP BY contig_id")
on_spans("break_merged", lambda df: panels.break_merged(df, 33), f"""{base.RUNS}, n AS (SELECT *, CASE WHEN span > 33 AND lead(seq) OVER (PARTITION BY contig_id ORDER BY seq) IS NOT NULL THEN 1 ELSE 0 END AS long FROM runs),
p AS (SELECT *, CAST(sum(long) OVER (PARTITION BY contig_id ORDER BY seq) AS BIGINT) AS piece FROM n), f AS (SELECT *, row_number() OVER (PARTITION BY contig_id, piece ORDER BY seq) AS r FROM p WHERE long = 0)
SELECT contig_id, piece, seq, 0 AS part, CASE WHEN r = 1 THEN 1 ELSE span END AS span, a1, b1, nb1 FROM f UNION ALL SELECT contig_id, piece, seq, 1, span - 1, a1, b1, nb1 FROM f WHERE r = 1 AND span > 1""")
on_spans("first_last_dropped", lambda df: df.withColumns({"_f": F.row_number().over(spans.ordered()), "_l": F.lead("seq").over(spans.ordered())}).where("_f > 1 and _l is not null").groupBy("contig_id").agg(F.count("*").alias("rows"), F.sum("span").alias("bases")),
         "SELECT contig_id, count(*) AS rows, CAST(sum(span) AS BIGINT) AS bases FROM (SELECT *, row_number() OVER w AS f, row_number() OVER (PARTITION BY contig_id ORDER BY seq DESC) AS l FROM spans WINDOW w AS (PARTITION BY contig_id ORDER BY seq)) WHERE f > 1 AND l > 1 GROUP BY 1")

# panels
on_calls("gap_fill_drop_first_last", lambda c: ingest.gap_fill(ingest.events(s := ingest.project(c)), ingest.contig_lengths(s), 5, True), f"{SITES}, {base.EVENTS}, {base.GAPS(5)} SELECT * FROM filled f WHERE seq <> 0 AND NOT EXISTS (SELECT 1 FROM (SELECT contig, max(pos) AS p FROM sites GROUP BY 1) s WHERE s.contig = f.contig_id AND f.seq = s.p)")
on_calls("unique_positions", lambda c: panels.unique_positions(c.select("contig", F.floor(F.col("pos") / 3).alias("pos"), (F.col("pos") * 10 + F.col("sid")).alias("line"))).select("contig", "pos", "line"), "SELECT contig, pos // 3 AS pos, min(pos * 10 + sid) AS line FROM geno GROUP BY 1, 2")
_one = lambda c: ingest.lineages(c.sparkSession, {"p": [1, 2, 3, 4, 5, 6, 7]}, [(1, 0), (1, 1)])
on_calls("panel_to_spans", lambda c: panels.to_spans(c, _one(c), c.groupBy("contig").agg((F.max("pos") + 3).alias("length")).withColumn("n1", F.lit(12))), """, v AS (SELECT contig, pos FROM (SELECT contig, pos, h0 AS x FROM geno UNION ALL SELECT contig, pos, h1 FROM geno) GROUP BY 1, 2 HAVING count(*) FILTER (x IS DISTINCT FROM 0) > 0 AND count(*) FILTER (x IS DISTINCT FROM 1) > 0),
g AS (SELECT * FROM geno SEMI JOIN v USING (contig, pos)), s AS (SELECT contig, pos, CAST(coalesce(CASE WHEN count(*) FILTER (sid = 1 AND (h0 IS NULL OR h1 IS NULL)) > 0 THEN -1 END, sum(h0 + h1) FILTER (sid = 1), 0) AS INT) AS a1,
  CAST(coalesce(sum(coalesce(h0, 0) + coalesce(h1, 0)) FILTER (sid > 1), 0) AS INT) AS b1, CAST(count(h0) FILTER (sid > 1) + count(h1) FILTER (sid > 1) AS INT) AS nb1 FROM g GROUP BY 1, 2),
p AS (SELECT *, coalesce(lag(pos) OVER (PARTITION BY contig ORDER BY pos), 0) AS before FROM s), len AS (SELECT contig, max(pos) + 3 AS length FROM geno GROUP BY 1)
SELECT contig AS contig_id, before AS seq, pos - 1 - before AS span, 0 AS a1, 0 AS b1, 12 AS nb1 FROM p WHERE pos - 1 > before UNION ALL SELECT contig, pos - 1, 1, a1, b1, nb1 FROM p
UNION ALL SELECT contig, coalesce(m, 0), length - coalesce(m, 0), 0, 0, 12 FROM len LEFT JOIN (SELECT contig, max(pos) AS m FROM s GROUP BY 1) USING (contig)""")
on_calls("perturbed_calls", lambda c: panels.perturbed(c, 0.05, 0.1, 3), ", ".join([""] + [f"q AS (SELECT *, {UNIFORM(3, 'contig', 'pos', 'sid')} AS f0, {UNIFORM(4, 'contig', 'pos', 'sid')} AS m0, {UNIFORM(13, 'contig', 'pos', 'sid')} AS f1, {UNIFORM(14, 'contig', 'pos', 'sid')} AS m1 FROM geno)"])
         + " SELECT contig, pos, sid, CASE WHEN m0 < 0.1 THEN NULL WHEN f0 < 0.05 THEN 1 - h0 ELSE h0 END AS h0, CASE WHEN m1 < 0.1 THEN NULL WHEN f1 < 0.05 THEN 1 - h1 ELSE h1 END AS h1 FROM q")
on_calls("per_base_default", lambda c: panels.per_base(c.select("contig").distinct().select("contig", F.explode(F.expr("sequence(1L, 300L)")).alias("pos")).withColumn("called", F.col("pos") % 5 != 0), ingest.project(c).select("contig", "pos", F.col("a1").alias("gt"))),
         f"{SITES} SELECT contig, pos, CASE WHEN pos % 5 = 0 THEN -1 ELSE coalesce(a1, 0) END AS gt FROM (SELECT contig, unnest(range(1, 301)) AS pos FROM (SELECT DISTINCT contig FROM geno)) LEFT JOIN sites USING (contig, pos)")
on_calls("zipped_streams", lambda c: panels.zipped([c.where(f"sid = {i}").select("contig", "pos", F.col(h).alias("v")) for i, h in ((1, "h0"), (2, "h1"), (3, "h0"))]), "SELECT a.contig, a.pos, a.h0 AS v0, b.h1 AS v1, c.h0 AS v2 FROM geno a JOIN geno b USING (contig, pos) JOIN geno c USING (contig, pos) WHERE a.sid = 1 AND b.sid = 2 AND c.sid = 3")
on_calls("distinguished_sfs", lambda c: rounded(panels.distinguished_spectrum(ingest.project(c).where("a1 >= 0").select(F.col("contig").alias("draw"), "a1", "b1"), c.select(F.col("contig").alias("draw")).distinct().withColumn("t", F.substring("draw", 4, 1).cast("double")), 0.5, 2.5), "mean"),
         f"{SITES} SELECT a1, b1, round(count(*) / (SELECT count(DISTINCT contig) FROM geno WHERE contig IN ('chr1', 'chr2')), 6) AS mean FROM sites WHERE a1 >= 0 AND contig IN ('chr1', 'chr2') GROUP BY 1, 2")
on_calls("subpanel", lambda c: sampling.subpanel(c, 4).groupBy("contig", "pos").agg(F.count("*").alias("n")), "SELECT contig, pos, least(4, count(h0) + count(h1)) AS n FROM geno GROUP BY 1, 2 HAVING count(h0) + count(h1) > 0")
on_calls("split_at_gaps", lambda c: formats.split_at_gaps(c.select("contig", "pos").distinct(), 9, 20), """, s AS (SELECT DISTINCT contig, pos FROM geno), n AS (SELECT *, CASE WHEN pos - lag(pos) OVER w >= 9 THEN 1 ELSE 0 END AS new FROM s WINDOW w AS (PARTITION BY contig ORDER BY pos)),
p AS (SELECT *, CAST(sum(new) OVER (PARTITION BY contig ORDER BY pos) AS BIGINT) AS piece FROM n) SELECT contig, piece, min(pos) AS first, max(pos) AS last, count(*) AS sites FROM p GROUP BY 1, 2 HAVING max(pos) - min(pos) >= 20""")

# measures
_masses = lambda df, k: df.where(f"contig_id % 2 = {k} and a1 >= 0").groupBy("a1", "b1", "nb1").agg(F.sum("span").alias("s")).select("a1", "b1", "nb1", (F.col("s") + 0.0).alias("mass"))
on_spans("spectrum_divergence", lambda df: rounded(measures.divergence(_masses(df, 0), _masses(df, 1), ["a1", "b1", "nb1"]), "kl"), """, m AS (SELECT contig_id % 2 AS k, a1, b1, nb1, sum(span) AS mass FROM spans WHERE a1 >= 0 GROUP BY ALL)
SELECT round(sum(p.mass * (ln(p.mass) - ln(q.mass))), 6) AS kl FROM m p LEFT JOIN m q ON q.k = 1 AND p.a1 = q.a1 AND p.b1 = q.b1 AND p.nb1 = q.nb1 WHERE p.k = 0""")
on_spans("exact_sums", lambda df: df.withColumn("x", F.col("span") / 7.0).groupBy("a1").agg(measures.exact_sum("x", 12).alias("x")), "SELECT a1, CAST(sum(CAST(span / 7.0 AS DECIMAL(38, 12))) AS DOUBLE) AS x FROM spans GROUP BY a1")
_post = lambda df: df.select("contig_id", "seq", "span", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("m")).withColumns({"time": (F.col("m") + 1) / 2, "p": 1.0 + (F.col("seq") * (F.col("m") + 3)) % 7})
POST = ", po AS (SELECT contig_id, seq, span, m, (m + 1) / 2 AS time, 1.0 + (seq * (m + 3)) % 7 AS p FROM spans, (SELECT CAST(unnest([0, 1, 2, 3]) AS INT) AS m))"
on_spans("decoded_states", lambda df: rounded(measures.decoded(_post(df)), "mean"), f"{POST} SELECT contig_id, seq, span, (list(m ORDER BY p DESC, m))[1] AS best, round(sum(CAST(time * p AS DOUBLE)) / CAST(sum(p) AS DOUBLE), 6) AS mean FROM po GROUP BY ALL")
on_spans("decoding_error", lambda df: rounded(measures.decoding_error(measures.decoded(_post(df)), df.select("contig_id", "seq", (F.col("seq") % 5 / 2).alias("t"))), "mse"), f"""{POST}, d AS (SELECT contig_id, seq, span, sum(CAST(time * p AS DOUBLE)) / CAST(sum(p) AS DOUBLE) AS mean FROM po GROUP BY ALL)
SELECT contig_id, round(sum(span * (mean - (seq % 5) / 2) ** 2) / sum(span), 6) AS mse FROM d GROUP BY 1""")
_scores = lambda df: df.groupBy((F.col("contig_id") % 4).alias("fold"), (F.col("seq") % 3).cast("double").alias("penalty")).agg(F.sum(F.col("span") % 11).cast("double").alias("loglik"))
on_spans("cv_best_penalty", lambda df: measures.best_penalty(_scores(df)), ", s AS (SELECT contig_id % 4 AS fold, CAST(seq % 3 AS DOUBLE) AS penalty, CAST(sum(span % 11) AS DOUBLE) AS loglik FROM spans GROUP BY ALL) SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY fold ORDER BY loglik DESC, penalty) = 1")
on_spans("states_not_ascending", lambda df: measures.not_ascending(df.select(F.col("contig_id").alias("model_id"), F.col("seq").alias("m"), F.col("span").cast("double").alias("t"))), "SELECT * FROM (SELECT contig_id AS model_id, seq AS m, CAST(span AS DOUBLE) AS t, lag(CAST(span AS DOUBLE)) OVER (PARTITION BY contig_id ORDER BY seq) AS before FROM spans) WHERE t <= before")

# scalar functions over the spans
SCALARS = {
    "trunc": (lambda x: fn.trunc(-x) + 0.0, "trunc(-x) + 0.0"), "csch": (lambda x: fn.csch(x), "1 / sinh(x)"), "sech": (lambda x: fn.sech(x), "1 / cosh(x)"), "coth": (lambda x: fn.coth(x), "1 / tanh(x)"), "acot": (lambda x: fn.acot(x), "atan(1 / x)"),
    "acsc": (lambda x: fn.acsc(1 + x), "asin(1 / (1 + x))"), "asec": (lambda x: fn.asec(1 + x), "acos(1 / (1 + x))"), "acoth": (lambda x: fn.acoth(1 + x), "atanh(1 / (1 + x))"), "acsch": (lambda x: fn.acsch(x), "asinh(1 / x)"),
    "asech": (lambda x: fn.asech(1 / (1 + x)), "acosh(1 + x)"), "lgamma": (lambda x: fn.lgamma(x), "lgamma(x)"), "gamma": (lambda x: fn.gamma(x), "gamma(x)"), "isinf": (lambda x: fn.isinf(F.when(x > 1, math.inf).otherwise(x)), "x > 1"),
    "modulus": (lambda x: fn.polar(x, -x)["modulus"], "sqrt(2 * x * x)"), "phase": (lambda x: fn.polar(x, -x)["phase"], "-pi() / 4"), "re": (lambda x: fn.rect(x, F.lit(2.0))["re"], "x * cos(2.0)"), "im": (lambda x: fn.rect(x, F.lit(2.0))["im"], "x * sin(2.0)"),
    "digamma": (lambda x: fn.digamma(x), "(SELECT -0.5772156649015329 + sum(1 / (k + 1.0) - 1 / (k + x)) + (x - 1) / 20000.0 FROM range(20000) AS t(k))"), "lbeta": (lambda x: fn.lbeta(x, F.lit(1.5)), "lgamma(x) + lgamma(1.5) - lgamma(x + 1.5)"),
    "erf": (lambda x: fn.erf(x), "CASE WHEN x > 5 THEN 1 ELSE (SELECT 2 / sqrt(pi()) * sum((CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * k + 1) * ln(x) - lgamma(k + 1.0)) / (2 * k + 1)) FROM range(40) AS t(k)) END"), "erfc": (lambda x: fn.erfc(x) + fn.erf(x), "1.0"),
}
_digits = {"digamma": 3, "erf": 6}
on_spans("scalar_functions", lambda df: df.select("span").distinct().select("span", *[(e if n == "isinf" else F.round(e, _digits.get(n, 6))).alias(n) for n, (make, _) in SCALARS.items() for e in [make(F.col("span") / 16.0)]]),
         ", v AS (SELECT DISTINCT span, span / 16.0::DOUBLE AS x FROM spans) SELECT span, " + ", ".join(f"({q}) AS \"{n}\"" if n == "isinf" else f"round(CAST({q} AS DOUBLE), {_digits.get(n, 6)}) AS \"{n}\"" for n, (_, q) in SCALARS.items()) + " FROM v")


# inference: the forward pass base by base, from the model's numbers
def _forward(model, ctes: str = "", source: str = "spans") -> str:
    """Log likelihood of each contig: a reduction over its bases that carries the scaled forward vector."""
    known = list(model.emission)
    vector = lambda x: "[" + ", ".join(repr(float(v)) for v in x) + "]"
    into = "[" + ", ".join(vector(c) for c in model.transition.T) + "]"
    seen = "[" + ", ".join(vector(model.emission[k]) for k in known) + "]"
    columns = ", ".join(("a1", "b1", "nb1", "a2", "b2", "nb2")[: len(known[0])])
    named = ", ".join(f"({i}, {', '.join(map(str, k))})" for i, k in enumerate(known, 1))
    return f"""WITH {SPANS_SQL}{ctes}, known AS (SELECT * FROM (VALUES {named}) AS v(k, {columns})),
bases AS (SELECT contig_id, seq, k, unnest(range(span)) AS u FROM {source} JOIN known USING ({columns})),
chains AS (SELECT contig_id, list({{'k': k, 'v': {vector(model.pi)}, 'll': 0.0::DOUBLE}} ORDER BY seq, u) AS xs FROM bases GROUP BY 1)
SELECT contig_id, round(list_reduce(list_prepend({{'k': 0, 'v': {vector(model.pi)}, 'll': 0.0::DOUBLE}}, xs), lambda x, y:
  list_transform([list_transform(range(1, {len(model.pi) + 1}), lambda j: list_extract(list_extract({seen}, y.k), j) * list_dot_product(x.v, list_extract({into}, j)))],
    lambda r: {{'k': y.k, 'v': list_transform(r, lambda z: z / list_sum(r)), 'll': x.ll + ln(list_sum(r))}})[1]).ll, 6) AS loglik FROM chains"""


SQL["hmm_loglik"] = _forward(base._pair_model(None))
SQL["sample_loglik"] = _forward(base.sample_model([(a, b, n) for a in (-1, 0, 1, 2) for n in (0, 4) for b in range(n + 1)]))


def _posterior(model) -> str:
    """post: the state probabilities at each base of a contig, by a recursion from either end."""
    known, m = list(model.emission), len(model.pi)
    vector = lambda x: "[" + ", ".join(repr(float(v)) for v in x) + "]"
    rows = lambda xs: "[" + ", ".join(map(vector, xs)) + "]"
    named = ", ".join(f"({i}, {a}, {b}, {n})" for i, (a, b, n) in enumerate(known, 1))
    norm = lambda x: f"list_transform([{x}], lambda r: list_transform(r, lambda z: z / list_sum(r)))[1]"
    ahead = f"list_transform(range(1, {m + 1}), lambda j: list_extract(list_extract({rows(model.emission[k] for k in known)}, b.k), j) * list_dot_product(v, list_extract({rows(model.transition.T)}, j)))"
    back = f"list_transform(range(1, {m + 1}), lambda i: list_dot_product(list_transform(range(1, {m + 1}), lambda j: list_extract(list_extract({rows(model.emission[k] for k in known)}, b.k), j) * w[j]), list_extract({rows(model.transition)}, i)))"
    return f"""WITH RECURSIVE {SPANS_SQL}, known AS (SELECT * FROM (VALUES {named}) AS v(k, a1, b1, nb1)),
units AS (SELECT contig_id, seq, k, unnest(range(span)) AS u FROM spans JOIN known USING (a1, b1, nb1)),
bases AS MATERIALIZED (SELECT contig_id, seq, k, row_number() OVER (PARTITION BY contig_id ORDER BY seq, u) AS t FROM units), ends AS (SELECT contig_id, max(t) AS n FROM bases GROUP BY 1),
f(contig_id, t, v) AS (SELECT contig_id, CAST(0 AS BIGINT), {vector(model.pi)} FROM ends UNION ALL SELECT b.contig_id, b.t, {norm(ahead)} FROM f JOIN bases b ON b.contig_id = f.contig_id AND b.t = f.t + 1),
g(contig_id, t, w) AS (SELECT contig_id, n, list_transform(range({m}), lambda i: 1.0::DOUBLE) FROM ends UNION ALL SELECT b.contig_id, b.t - 1, {norm(back)} FROM g JOIN bases b ON b.contig_id = g.contig_id AND b.t = g.t),
post AS (SELECT b.contig_id, b.seq, b.k, b.t, unnest(range({m})) AS m, unnest(list_transform(range(1, {m + 1}), lambda j: v[j] * w[j] / list_dot_product(v, w))) AS p FROM bases b JOIN f USING (contig_id, t) JOIN g USING (contig_id, t))"""


POSTERIOR = _posterior(base._pair_model(None))
SQL["gamma_sums"] = f"{POSTERIOR} SELECT a1 || ',' || b1 || ',' || nb1 AS key, CAST(m AS INT) AS i, round(sum(p), 6) AS mass FROM post JOIN known USING (k) GROUP BY ALL"
SQL["occupancy_perplexity"] = f"""{POSTERIOR}, o AS (SELECT CAST(m AS INT) AS state, sum(p) / (SELECT sum(p) FROM post) AS occupancy FROM post GROUP BY 1)
SELECT state, round(occupancy, 6) AS occupancy, round((SELECT exp(-sum(occupancy * ln(occupancy))) FROM o), 6) AS perplexity FROM o"""
SQL["hmm_posterior"] = f"""{POSTERIOR}, l AS (SELECT *, CASE WHEN lag(k) OVER (PARTITION BY contig_id, m ORDER BY t) = k THEN 0 ELSE 1 END AS new FROM post),
r AS (SELECT *, sum(new) OVER (PARTITION BY contig_id, m ORDER BY t) AS run FROM l)
SELECT contig_id, min(seq) AS seq, min(t) - 1 AS start, count(*) AS span, CAST(m AS INT) AS m, round(avg(p), 6) AS p FROM r GROUP BY contig_id, m, run"""
