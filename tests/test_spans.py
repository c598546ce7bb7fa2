"""Worked cases of the span operators, and slow per-base loops beside them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlake import functions as fn
from spanlake.operators import demography, hmm, ingest, spans

SCHEMA = "contig_id bigint, seq bigint, span int, a1 int, b1 int, nb1 int"


def table(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], SCHEMA)


def values(df, *order):
    return [tuple(r) for r in df.orderBy("contig_id", *order).select("span", "a1", "b1", "nb1").collect()]


def random_rows(seed, n=40):
    rng = np.random.default_rng(seed)
    return [(int(rng.integers(1, 15)), int(a := rng.integers(-1, 3)), int(rng.integers(0, 5)) if a > 0 else 0, 4) for _ in range(n)]


def test_equal_neighbours_merge(spark):
    assert values(spans.compress(table(spark, [(1, 0, 0, 0), (2, 0, 0, 0)])), "seq") == [(3, 0, 0, 0)]
    two = spark.createDataFrame([(1, 0, 2, 0, 0, 4), (2, 0, 3, 0, 0, 4)], SCHEMA)
    assert len(values(spans.compress(two), "seq")) == 2


def test_thin_then_compress(spark):
    rows = [(3314, 0, 0, 0), (1, 1, 0, 0), (6685, 0, 0, 0)]
    thinned = spans.thin(table(spark, rows), 2).select("contig_id", F.col("start").alias("seq"), "span", "a1", "b1", "nb1")
    assert values(spans.compress(thinned), "seq") == rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_thin_and_realign_against_loops(spark, seed):
    rows = random_rows(seed)
    bases = [(a, b, n) for s, a, b, n in rows for _ in range(s)]
    want = [(0, 0, 0) if a == 2 else (a, b, n) if (p + 1) % 7 == 0 else (a, 0, 0) for p, (a, b, n) in enumerate(bases)]
    got = [(a, b, n) for s, a, b, n in values(spans.thin(table(spark, rows), 7), "start") for _ in range(s)]
    assert got == want
    cut = values(spans.realign(table(spark, rows), 10), "start")
    assert [(a, b, n) for s, a, b, n in cut for _ in range(s)] == bases
    assert all(e // 10 == (e - 1) // 10 or e % 10 == 0 for e in np.cumsum([r[0] for r in cut]))


def test_break_long_keeps_empty_pieces(spark):
    rows = [(50, -1, 0, 0), (60, -1, 0, 0), (5, 1, 0, 4)]
    got = spans.break_long(table(spark, rows), 50).orderBy("piece", "seq").select("piece", "span", "a1").collect()
    assert [tuple(r) for r in got] == [(0, 1, -1), (1, 1, -1), (2, 1, -1), (2, 5, 1)]


def test_bad_rows_strict_and_lenient(spark):
    rows = [(1, 0, 5, 4), (1, 3, 0, 4), (0, 0, 0, 4), (5, 0, 5, 4), (5, 0, 0, 4)]
    assert spans.bad_rows(table(spark, rows)).count() == 4
    assert spans.bad_rows(table(spark, rows), strict=False).count() == 3


def test_quantiles_at_plotting_position(spark):
    x = [0.1, 0.2, 0.2, 0.5, 0.9]
    got = {r.prob: r.value for r in spans.quantiles(spark.createDataFrame([(v,) for v in x], "rate double"), "rate", (0.0, 0.5, 1.0)).collect()}
    assert got == pytest.approx({0.0: 0.1, 0.5: 0.2, 1.0: 0.9})
    assert spans.quantiles(spark.createDataFrame([], "rate double"), "rate", (0.5,)).count() == 0


def test_masks_and_gaps_cover_the_contig(spark):
    sites = spark.createDataFrame([("c", 3, 1, 0, 4), ("c", 8, 0, 1, 4)], "contig string, pos bigint, a1 int, b1 int, nb1 int")
    mask = spark.createDataFrame([("c", 6, 9), ("c", 5, 7)], "contig string, m_start bigint, m_end bigint")
    lengths = spark.createDataFrame([("c", 12, 4)], "contig string, length bigint, n1 int")
    got = ingest.gap_fill(ingest.events(sites, mask), lengths).orderBy("seq").collect()
    assert [(r.seq, r.span, r.a1) for r in got] == [(0, 2, 0), (2, 1, 1), (3, 2, 0), (5, 4, -1), (9, 3, 0)]


def written(events, length, quiet, cutoff, skip):
    """What a writer gives that goes over the events in order: (span, counts)."""
    out, last, first = [], 0, True

    def write(span, counts):
        nonlocal first
        if not (first and skip) and span > 0:
            out.append((span, counts))
        first = False

    missing = tuple(-1 if i % 3 == 0 else 0 for i in range(len(quiet)))
    for a, b, counts in events:
        if counts is None:
            write(a - last, quiet)
            write(b - a, missing)
        else:
            if a > last:
                write(a - last, missing if cutoff is not None and a - last > cutoff else quiet)
            write(1, counts)
        last = b
    if not skip:
        write(length - last, quiet)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_gaps_against_a_writer(spark, seed):
    rng = np.random.default_rng(seed)
    cuts = np.sort(rng.choice(np.arange(1, 90), 8, replace=False)).tolist()
    mask = [(a, b) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
    positions = sorted({1 if seed == 1 else 50, *rng.choice(np.arange(1, 100), 9).tolist()})
    sites = [(p, tuple(int(x) for x in (rng.integers(-1, 2), rng.integers(0, 3), 4, rng.integers(0, 2), rng.integers(0, 2), 3))) for p in positions]
    left = [(p - 1, p, c) for p, c in sites if not any(a <= p - 1 < b for a, b in mask)]
    events = sorted([*left, *[(a, b, None) for a, b in mask]], key=lambda e: e[0])
    names = ["a1", "b1", "nb1", "a2", "b2", "nb2"]
    table = spark.createDataFrame([("c", p, *c) for p, c in sites], "contig string, pos bigint, " + ", ".join(f"{n} int" for n in names))
    masks = spark.createDataFrame([("c", a, b) for a, b in mask], "contig string, m_start bigint, m_end bigint")
    lengths = spark.createDataFrame([("c", 120, 4, 3), ("empty", 7, 4, 3)], "contig string, length bigint, n1 int, n2 int")
    for cutoff in (None, 5):
        for skip in (False, True):
            rows = ingest.gap_fill(ingest.events(table, masks), lengths, cutoff, skip).orderBy("contig_id", "seq").collect()
            got = [(r.span, tuple(r[n] for n in names)) for r in rows if r.contig_id == "c"]
            assert got == written(events, 120, (0, 0, 4, 0, 0, 3), cutoff, skip), (cutoff, skip)
            assert [r.span for r in rows if r.contig_id == "empty"] == ([] if skip else [7])


def test_validation_against_a_loop(spark):
    """Two populations; edge rows and random ones."""
    rng = np.random.default_rng(6)
    rows = [(1, -1, 4, 4, -1, 3, 3), (1, 1, 4, 4, 1, 3, 3), (1, -1, 0, 0, -1, 0, 0), (1, 1, 0, 5, 1, 0, 0), (5, 1, 5, 4, 0, 0, 0), (0, 0, 0, 4, 0, 0, 3), (1, 2, 0, 4, 0, 0, 3), (1, -1, 4, 4, 1, 3, 3)]
    rows += [tuple(int(x) for x in (rng.integers(0, 4), rng.integers(-1, 3), rng.integers(0, 5), rng.integers(0, 5), rng.integers(-1, 3), rng.integers(0, 4), rng.integers(0, 4))) for _ in range(300)]
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "contig_id bigint, seq bigint, span int, a1 int, b1 int, nb1 int, a2 int, b2 int, nb2 int")

    def zeroed(r):
        s, a1, b1, n1, a2, b2, n2 = r
        pair = (a1, a2) == (1, 1) or (a1, a2) == (-1, -1)
        return (s, a1, 0, n1, a2, 0, n2) if pair and b1 == n1 and b2 == n2 and max(n1, n2) > 0 else r

    got = [tuple(r)[2:] for r in spans.unfounded(df, (1, 1)).orderBy("seq").collect()]
    assert got == [zeroed(r) for r in rows]
    for strict in (True, False):
        bad = lambda r: r[0] <= 0 or (strict or r[0] == 1) and (r[1] > 1 or r[4] > 1 or r[2] > r[3] or r[5] > r[6] or r[3] > 4 or r[6] > 3)
        assert {r.seq for r in spans.bad_rows(df, (1, 1), (4, 3), strict).collect()} == {i for i, r in enumerate(rows) if bad(r)}
    fine = df.where("seq in (0, 1, 2)")
    assert [r.b1 for r in spans.validate(fine, (1, 1), (4, 3)).orderBy("seq").collect()] == [0, 0, 0]
    with pytest.raises(Exception, match="invalid span row"):
        spans.validate(df, (1, 1)).collect()
    with pytest.raises(ValueError):
        spans.required(df.where("false"), "rows")


def test_masks_of_all_lengths(spark):
    rng = np.random.default_rng(9)
    lengths = [1, 3, 64, 65, 1000, 5000, 70_000, 3_000_000]
    mask = [("c" if i % 2 else "d", int(a), int(a) + n) for i, (a, n) in enumerate(zip(rng.integers(0, 20_000_000, 24), lengths * 3, strict=True))]
    edges = [(c, p) for c, a, b in mask for p in (a, a + 1, b, b + 1) if p > 0]
    sites = sorted({*edges, *[("c", int(p)) for p in rng.integers(1, 20_000_000, 300)]})
    df = spark.createDataFrame([(c, p, 0, 0, 4) for c, p in sites], "contig string, pos bigint, a1 int, b1 int, nb1 int")
    got = {(r.contig, r.pos) for r in ingest.outside(df, spark.createDataFrame(mask, "contig string, m_start bigint, m_end bigint")).collect()}
    assert got == {(c, p) for c, p in sites if not any(m == c and a <= p - 1 < b for m, a, b in mask)}


def test_runs_equal_unit_rows():
    steps = demography.Steps(np.array([0.0, 0.5]), np.array([1.0, 0.4]))
    keys = [(-1, 0, 0), (0, 0, 4), (1, 0, 4)]
    model = demography.pair_model(steps, steps.balanced(5), 0.1, 0.05, keys)
    rows = [(7, keys[1]), (1, keys[2]), (5, keys[0]), (30, keys[1]), (2, keys[2])]
    units = [(1, k) for s, k in rows for _ in range(s)]
    (l1, g1, x1, f1), (l2, g2, x2, f2) = hmm.forward_backward(rows, model), hmm.forward_backward(units, model)
    assert l1 == pytest.approx(l2) and np.allclose(x1, x2) and np.allclose(f1, f2)
    cuts = np.cumsum([0] + [s for s, _ in rows])
    assert np.allclose(g1, [g2[a:b].sum(0) for a, b in zip(cuts, cuts[1:], strict=False)])
    a, loglik = model.pi, 0.0
    for _, k in units:
        a = (a @ model.transition) * model.emission[k]
        loglik += np.log(a.sum())
        a = a / a.sum()
    assert l1 == pytest.approx(loglik)


def test_blocks_of_a_contig_give_the_same(spark):
    steps = demography.Steps(np.array([0.0, 0.5]), np.array([1.0, 0.4]))
    rng = np.random.default_rng(2)
    keys = [(-1, 0, 0), (0, 0, 4), (1, 0, 4)]
    model = demography.pair_model(steps, steps.balanced(5), 0.1, 0.05, keys)
    rows = [(c, i, int(rng.integers(1, 40)), *keys[rng.integers(0, 3)]) for c, n in ((1, 300), (2, 7), (3, 41)) for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    one, many = hmm.reduced(hmm.statistics(df, model)), hmm.reduced(hmm.statistics(df, model, 20))
    a, b = ({(r.kind, r.key, r.i, r.j): r.value for r in x.collect()} for x in (one, many))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-8) for k in a)
    a, b = ({r.contig_id: r.loglik for r in hmm.logliks(df, model, n).collect()} for n in (1000, 20))
    assert a == pytest.approx(b) and sum(a.values()) == pytest.approx(one.where("kind = 'loglik'").first()["value"])
    a, b = ({(r.contig_id, r.seq): (r.start, r.gamma) for r in hmm.posterior(df, model, n).collect()} for n in (1000, 20))
    assert a.keys() == b.keys() and len(a) == len(rows)
    assert all(a[k][0] == b[k][0] and np.allclose(a[k][1], b[k][1]) for k in a)


def test_demographic_kernels():
    steps = demography.Steps(np.array([0.0]), np.array([1.0]))
    assert steps.hazard(2.0) == 2.0 and steps.inverse(2.0) == 2.0
    states = steps.balanced(4)
    assert np.allclose(demography.initial(steps, states), 0.25)
    assert demography.meeting_times(steps, [0.0, np.inf])[0] == pytest.approx(1.0)
    q, term = np.eye(3), np.eye(3)
    rate = np.array([[-0.3, 0.3, 0], [0.5, -1.0, 0.5], [0, 0, 0]])
    got = demography.three_state(0.3, 0.5)
    assert np.allclose(got.sum(1), 1) and (got >= 0).all()
    for i in range(1, 40):
        term = term @ rate / i
        q = q + term
    assert np.allclose(got, q)
    assert np.allclose(demography.transition(steps, states, 0.1).sum(1), 1)


def test_em_raises_the_likelihood(spark):
    rows = [(20, 0, 0, 4), (1, 1, 0, 4)] * 15 + [(100, 0, 0, 4)] * 3
    df = spark.createDataFrame([(c, i, *r) for c in range(2) for i, r in enumerate(rows)], SCHEMA)
    states = demography.Steps(np.array([0.0]), np.array([1.0])).balanced(4)
    _, history = demography.estimate(df, [0.0, 1.0], states, 0.05, 0.02, rounds=3)
    assert history[1] > history[0]


def test_scalar_functions(spark):
    r = spark.range(1).select(fn.erf(F.lit(0.5)).alias("e"), fn.erfc(F.lit(3.0)).alias("c"), fn.lgamma(F.lit(4.5)).alias("g"), fn.trunc(F.lit(-2.7)).alias("t")).first()
    assert r.e == pytest.approx(0.5204998778, abs=1e-9) and r.c == pytest.approx(2.209049699858544e-05, rel=1e-6)
    assert r.g == pytest.approx(2.453736570842443, abs=1e-9) and r.t == -2


def test_blocks_equal_the_windows_of_a_contig(spark):
    rng = random.Random(3)
    rows = [(c, i * 3, rng.randrange(1, 40), rng.choice([-1, 0, 0, 1, 2]), 0, rng.choice([0, 4])) for c in range(3) for i in range(400 if c else 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    key = lambda d: sorted(tuple(r[c] for c in sorted(d.columns)) for r in d.collect())
    for run in (spans.positions, spans.compress, lambda d, width=None: spans.thin(d, 7, width), lambda d, width=None: spans.realign(d, 50, width), lambda d, width=None: spans.chunk(d, 100, width), lambda d, width=None: spans.break_long(d, 20, width)):
        want = key(run(df))
        for width in (10, 100, 5000):
            assert key(run(df, width=width)) == want
    assert spans.positions(df.where("false"), 10).count() == 0


def test_a_long_contig_is_many_tasks(spark):
    df = spark.range(400_000).selectExpr("'c' AS contig_id", "id AS seq", "CAST(1 + id % 5 AS INT) AS span", "CAST(id % 3 = 0 AS INT) AS a1", "0 AS b1", "4 AS nb1")
    spread = lambda d: d.groupBy(F.spark_partition_id()).agg(F.max("stop")).collect()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert len(spread(spans.positions(df))) == 1
        assert len(spread(spans.positions(df, 25_000))) == 4  # all partitions of the session
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    last = spans.positions(df, 25_000).agg(F.max("stop")).first()[0]
    assert last == df.agg(F.sum("span")).first()[0]
