"""Other formats, stages, streamed runs and commands."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlake.__main__ import main
from spanlake.operators import spans, splines
from spanlake.plans.stages import Stages
from spanlake.sources import formats
from spanlake.functions import tables
from spanlake.streaming import runs

SPANS = "contig_id bigint, seq bigint, span int, a1 int, b1 int, nb1 int"


def _spans(spark):
    rows = [(c, i, 30 + (7 * i + c) % 50, (i + c) % 3 % 2, (i * 5 + c) % 3, 2) for c in range(2) for i in range(40)]
    return spark.createDataFrame(rows, SPANS)


def test_text_tables(spark, tmp_path):
    (tmp_path / "m").write_text("time_index\tleft\tright\tlambda\n0\t0\t0.001\t100\n1\t0.001\tinf\t50\n")
    got = formats.coalescence_rates(spark, str(tmp_path / "m"), "m", 1e-8).orderBy("piece").collect()
    assert [(r.t0, r.t1, r.size) for r in got] == [(0.0, pytest.approx(1e5), pytest.approx(5e5)), (pytest.approx(1e5), None, pytest.approx(1e6))]
    (tmp_path / "g").write_text("0129\n2290\n")
    (tmp_path / "s").write_text("rs1 1 0.0 100 A C\nrs2 2 0.0 50 G T\n")
    got = formats.genotype_matrix(spark, str(tmp_path / "g"), str(tmp_path / "s")).orderBy("contig", "sid").collect()
    assert [tuple(r) for r in got] == [("1", 100, 0, 0), ("1", 100, 1, 1), ("1", 100, 2, 2), ("1", 100, 3, None), ("2", 50, 0, 2), ("2", 50, 1, 2), ("2", 50, 2, None), ("2", 50, 3, 0)]
    (tmp_path / "f").write_text(">a\n0000\n>b x\n1100\n0111\n1N\n>c\n0\n")
    got = formats.mask_sequence(spark, str(tmp_path / "f"), "b").orderBy("m_start").collect()
    assert [tuple(r) for r in got] == [("b", 2, 4), ("b", 4, 5), ("b", 9, 10)]
    with pytest.raises(ValueError):
        formats.mask_sequence(spark, str(tmp_path / "f"), "z")


def test_binary(spark, tmp_path):
    (tmp_path / "x.seq").write_bytes(np.array([1, 1, -1, 0, 0], np.int8).tobytes())
    got = formats.base_runs(spark, str(tmp_path / "x.seq")).orderBy("start").collect()
    assert [(r.start, r.span, r.value) for r in got] == [(0, 2, 1), (2, 1, -1), (3, 2, 0)]
    np.savez(tmp_path / "x.npz", g=np.array([[1, 2], [3, 4]]))
    got = formats.array_rows(spark, str(tmp_path / "x.npz"), "g").orderBy("row").collect()
    assert [(r.row, list(r["values"])) for r in got] == [(0, [1.0, 2.0]), (1, [3.0, 4.0])]


def test_trees(spark):
    tree = "((1:0.5,2:0.5):1.0,(3:0.25,4:0.25):1.25);"
    assert [formats.meeting_time(tree, "1", x) for x in "234"] == [0.5, 1.5, 1.5]
    df = spark.createDataFrame([(tree,), (None,), ("(5:1,6:1);",)], "newick string")
    assert [r.t for r in formats.tree_track(df, "3", "4").collect()] == [0.25, None, None]


def test_sites(spark, tmp_path):
    rows = [("c", p, s, h, 0) for p, h in ((10, 1), (15, 0), (40, 1)) for s in (1, 2)] + [("c", 50, 1, None, 1)]
    calls = spark.createDataFrame(rows, "contig string, pos int, sid int, h0 int, h1 int")
    got = formats.segregating_list(calls).orderBy("pos").collect()
    assert [tuple(r) for r in got] == [("c", 10, 10, "CACA"), ("c", 40, 30, "CACA")]
    got = formats.split_at_gaps(calls.select("contig", "pos").distinct(), 20, 5).orderBy("piece").collect()
    assert [tuple(r) for r in got] == [("c", 0, 10, 15, 2), ("c", 1, 40, 50, 2)]


def test_stages(spark):
    s = Stages(_spans(spark)).add(coarse=lambda d: d.withColumns({"b1": F.lit(0), "nb1": F.lit(2)})).add(runs=spans.compress)
    assert s["coarse"].count() == 80 and s.result().count() < 80
    assert s.add(none=lambda d: d.where("false")).result().count() == 0
    with pytest.raises(ValueError):
        s.add(runs=spans.compress)


def test_streamed_runs(spark, tmp_path):
    """Each part of the rows is one run of the query, which is started anew from its checkpoint; no contig has a closing row."""
    df = _spans(spark).withColumn("b1", F.lit(0))
    timed = df.withColumn("ts", F.timestamp_seconds(F.col("seq") * 60 + 86_400))
    later = timed.limit(1).select(F.lit(None).cast(timed.schema["contig_id"].dataType).alias("contig_id"), *[c for c in df.columns if c != "contig_id"], F.timestamp_seconds(F.lit(1_000_000)).alias("ts"))
    for part in (timed.where("seq < 8"), timed.where("seq >= 8 and seq < 15"), timed.where("seq >= 15"), later.select(timed.columns)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        rows = spark.readStream.schema(timed.schema).parquet(str(tmp_path / "in"))
        query = runs.compress(rows, idle="2 hours").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(tuple(r) for r in spans.compress(df).select(*runs.COLUMNS).collect())


def test_streamed_groups_of_contigs(spark, tmp_path):
    """Contigs of one group end each at its own time, and go on in later runs of the query."""
    rows = [("a", 1, 5, 0), ("b", 2, 3, 1), ("a", 3, 2, 0), ("c", 4, 1, 1), ("b", 200, 4, 1), ("b", 201, 1, 0), (None, 230, 0, 0), ("b", 240, 2, 0), ("c", 241, 6, 1), (None, 9000, 0, 0)]
    cells = "contig_id string, seq long, span int, a1 int"
    held, got = [], []
    for part in (rows[:4], rows[4:7], rows[7:9], rows[9:]):
        df = spark.createDataFrame(part, cells).select("*", F.lit(0).alias("b1"), F.lit(4).alias("nb1"), F.timestamp_seconds(F.col("seq") * 60).alias("ts"))
        df.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        out = runs.compress(stream, idle="220 minutes", groups=1)
        out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(120)
        got = sorted((r.contig_id, r.seq, r.span, r.a1) for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect())
        held.append(got)
    assert held[0] == []
    assert held[1] == [("a", 1, 7, 0), ("b", 2, 7, 1), ("c", 4, 1, 1)]
    assert held[2] == held[1]
    assert held[3] == [("a", 1, 7, 0), ("b", 2, 7, 1), ("b", 201, 3, 0), ("c", 4, 1, 1), ("c", 241, 6, 1)]


def test_streamed_runs_of_distant_rows(spark):
    """A contig that shows nothing for two of the four parts keeps its run."""
    from spanlake.plans import scans

    rows = [(1, 1, 5, 0, 0, 4), (1, 19_000, 7, 0, 0, 4), *[(2, s, 1, s // 1000 % 2, 0, 4) for s in range(2, 20_001, 500)]]
    df = spark.createDataFrame(rows, "contig_id long, seq long, span int, a1 int, b1 int, nb1 int")
    got = sorted(tuple(r) for r in scans._streamed(df).collect())
    assert got == sorted(tuple(r) for r in spans.compress(df).select(*runs.COLUMNS).collect())
    assert (1, 1, 12, 0, 0, 4) in got


def test_table_functions(spark):
    tables.register(spark)
    df = _spans(spark).withColumn("note", F.lit("x"))
    df.createOrReplaceTempView("rows_of_spans")
    call = lambda name, n: spark.sql(f"SELECT * FROM {name}(TABLE(rows_of_spans) PARTITION BY contig_id ORDER BY (seq), {n})")
    key = lambda d: sorted(tuple(r[c] for c in sorted(d.columns)) for r in d.collect())
    for n in (1, 3, 10):
        assert key(call("thin", n)) == key(spans.thin(df, n))
        assert key(call("realign", n)) == key(spans.realign(df, n))
        assert key(call("break_long", n)) == key(spans.break_long(df, n))
    with pytest.raises(Exception, match="above 0"):
        call("thin", 0).collect()
    with pytest.raises(Exception, match="misses"):
        spark.sql("SELECT * FROM thin(TABLE(SELECT 1 AS seq) PARTITION BY seq ORDER BY (seq), 2)").collect()


def test_commands(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    _spans(spark).write.parquet(at("in"))
    main(["estimate", at("in"), at("m"), "--mu", "1e-8", "--knots", "3", "--em-iterations", "1", "--bin", "5", "--thinning", "3"], spark)
    main(["posterior", at("in"), at("p"), at("m")], spark)
    assert spark.read.parquet(at("p")).count() == 80
    main(["plot", at("m"), at("c")], spark)
    assert spark.read.option("header", True).csv(at("c")).count() >= 3
    main(["chunk", at("in"), at("k"), "--size", "200", "--draws", "5"], spark)
    assert spark.read.parquet(at("k")).agg(F.sum("span")).first()[0] == 1000
    main(["cv", at("in"), at("v"), "--mu", "1e-8", "--knots", "2", "--em-iterations", "1", "--bin", "5", "--thinning", "3", "--penalties", "0", "10"], spark)
    best, scores = spark.read.parquet(at("v") + "/best").collect(), spark.read.parquet(at("v") + "/scores").collect()
    assert {r.fold for r in best} == {0, 1} and len(scores) == 4
    assert all(r.loglik == max(x.loglik for x in scores if x.fold == r.fold) for r in best)
    with pytest.raises(SystemExit):
        main(["estimate", at("in"), at("n"), "--mu", "1"], spark)


def test_convert(spark, tmp_path):
    head = ["##fileformat=VCFv4.2", "##contig=<ID=c,length=60>", "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "s1", "s2"])]
    rows = ["\t".join(["c", str(p), ".", "A", "C", ".", ".", ".", "GT", x, y]) for p, x, y in ((10, "0/1", "0/0"), (30, "0|0", "1|1"), (45, "./.", "0/1"))]
    (tmp_path / "v.vcf").write_text("\n".join(head + rows) + "\n")
    main(["convert", str(tmp_path / "v.vcf"), str(tmp_path / "o"), "p:s1,s2"], spark)
    read = lambda n, *names: [tuple(r[x] for x in ("span", *(names or ("a1", "b1", "nb1")))) for r in spark.read.parquet(str(tmp_path / n)).orderBy("seq").collect()]
    assert read("o") == [(9, 0, 0, 2), (1, 1, 0, 2), (19, 0, 0, 2), (1, 0, 2, 2), (14, 0, 0, 2), (1, -1, 1, 2), (15, 0, 0, 2)]
    # the first record of a position counts; two populations; haploid calls and unknown samples are refused
    more = rows[:2] + ["\t".join(["c", "30", ".", "A", "G", ".", ".", ".", "GT", "1|1", "1|1"])] + rows[2:]
    (tmp_path / "w.vcf").write_text("\n".join(head + more) + "\n")
    (tmp_path / "names").write_text("s2\n")
    main(["convert", str(tmp_path / "w.vcf"), str(tmp_path / "o2"), "p:s1", f"q:@{tmp_path / 'names'}", "--distinguished", "s1", "s2", "--drop-first-last"], spark)
    assert read("o2", "a1", "b1", "nb1", "a2", "b2", "nb2") == [(1, 0, 1, 1, 0, 0, 1), (19, 0, 0, 1, 0, 0, 1), (1, 0, 0, 1, 1, 1, 1), (14, 0, 0, 1, 0, 0, 1), (1, -1, 0, 0, 1, 0, 1)]
    (tmp_path / "h.vcf").write_text("\n".join([*head, "\t".join(["c", "3", ".", "A", "C", ".", ".", ".", "GT", "1", "0/1"])]) + "\n")
    with pytest.raises(Exception, match="no diploid call at c:3"):
        main(["convert", str(tmp_path / "h.vcf"), str(tmp_path / "o3"), "p:s1,s2"], spark)
    with pytest.raises(SystemExit):
        main(["convert", str(tmp_path / "v.vcf"), str(tmp_path / "o4"), "p:s1,nobody"], spark)
    main(["convert", str(tmp_path / "v.vcf"), str(tmp_path / "o5"), "p:s1,nobody", "--ignore-missing", "--length", "50"], spark)
    assert read("o5")[-1] == (5, 0, 0, 0)


def test_spline_rules_by_their_definitions():
    h, line = np.array([1.0, 2.0, 0.5]), np.array([3.0, 3.0, 3.0])
    for rule in (splines.monotone, splines.local):
        assert np.allclose(rule(h, line), 3.0)  # a line stays a line
    assert splines.monotone(h, np.array([1.0, -1.0, 2.0]))[1:3].tolist() == [0.0, 0.0]
    x = np.array([0.0, 1.0, 3.0, 3.5, 5.0])
    for y in (np.array([0.0, 0.1, 4.0, 4.01, 9.0]), np.array([5.0, 1.0, 0.9, 0.2, 0.0])):
        v = splines.fit("pchip", x, y)(np.linspace(0, 5, 400))
        assert (np.diff(v) * np.sign(y[-1] - y[0]) >= -1e-12).all()  # monotone data, monotone curve
    bump = splines.fit("akima", np.arange(9.0), np.array([0, 0, 0, 0, 1, 0, 0, 0, 0.0]))
    assert np.allclose(bump(np.r_[np.linspace(0, 2, 9), np.linspace(6, 8, 9)]), 0)  # an outlier stays local
    parabola = splines.fit("akima", np.arange(6.0), np.arange(6.0) ** 2)
    assert np.allclose(parabola(np.linspace(0, 5, 51)), np.linspace(0, 5, 51) ** 2)


def test_basis_splines_and_common_knots():
    x = [0.0, 0.5, 2.0, 3.0]
    assert np.allclose(splines.basis(x, [2.0] * 6)(np.linspace(0, 3, 31)), 2)  # the basis sums to 1
    t = np.r_[[0.0] * 3, x, [3.0] * 3]
    line = [t[i + 1 : i + 4].mean() for i in range(6)]  # control points of the identity
    assert np.allclose(splines.basis(x, line)(np.linspace(0, 3, 31)), np.linspace(0, 3, 31))
    curve = splines.basis(x, [1.0, 3.0, -1.0, 0.5, 2.0, 1.0])
    for k in (1, 2):  # twice differentiable at inner knots
        d = [np.polynomial.polynomial.polyder(curve.c[k - 1], i) for i in range(3)]
        assert np.allclose([np.polynomial.polynomial.polyval(x[k] - x[k - 1], q) for q in d], [curve.c[k, 0], curve.c[k, 1], 2 * curve.c[k, 2]])
    a, b = splines.aligned(curve, splines.fit("akima", [0.0, 1.0, 3.0], [1.0, 2.0, 0.0]))
    at = np.linspace(0, 3, 31)
    assert a.x.tolist() == b.x.tolist() == [0.0, 0.5, 1.0, 2.0, 3.0] and np.allclose(a(at), curve(at))


def test_rates_become_a_model(spark, tmp_path):
    from spanlake import __main__ as commands

    (tmp_path / "m").write_text("time_index\tleft\tright\tlambda\n0\t0\t0.001\t100\n1\t0.001\tinf\t50\n")
    main(["rates", str(tmp_path / "m"), str(tmp_path / "out"), "--mu", "1e-8"], spark)
    model, states, got = commands._load(spark, str(tmp_path / "out"))
    n0 = got["model"]["N0"]
    assert np.allclose(model.t * 2 * n0, [0, 1e5]) and np.allclose(model.a * n0, [5e5, 1e6]) and len(states) == 33 and states[-1] == np.inf
    with pytest.raises(SystemExit):
        main(["chunk", "x", "y", "--size", "0"], spark)
