"""Round trips of the text formats, and splines against their definitions."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlake.operators import splines
from spanlake.sources import text


def test_span_files_round_trip(spark, tmp_path):
    rows = [(c, i, 1 + (i * 7 + c) % 5, i % 3 - 1, 0, 4) for c in (1, 2) for i in range(500)]
    df = spark.createDataFrame(rows, "contig_id int, seq int, span int, a1 int, b1 int, nb1 int").repartition(7)
    head = spark.createDataFrame([(c, '{"version": "1", "pids": ["p"], "dist": [[["a", 0], ["a", 1]]]}') for c in (1, 2)], "contig_id int, header string")
    path = f"file://{tmp_path}/spans"
    text.write_spans(df, path, head)
    got = text.read_spans(spark, path, contig=F.regexp_extract("file", "contig_id=([^/]+)", 1).cast("int")).orderBy("contig_id", "seq").collect()
    assert [(r.contig_id, r.span, r.a1, r.b1, r.nb1) for r in got] == [(r[0], *r[2:]) for r in rows]
    found = text.headers(spark, path).collect()
    assert len(found) == 2 and found[0].pids == ["p"] and found[0].dist == [[["a", "0"], ["a", "1"]]]
    assert text.empty_files(spark, path).count() == 0


def test_lines_keep_their_order_over_splits(spark, tmp_path):
    (tmp_path / "long.txt").write_text("# x\n" + "".join(f"{i} 0 0 4\n" for i in range(1, 5001)))
    with gzip.open(tmp_path / "short.txt.gz", "wt") as f:
        f.write("1 0 0 4\n2 0 0 4\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = text.read_spans(spark, f"file://{tmp_path}").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    files = {r.contig_id for r in got}
    assert len(files) == 2 and len({(r.contig_id, r.seq) for r in got}) == 5002
    for f in files:
        spans = [r.span for r in sorted((r for r in got if r.contig_id == f), key=lambda r: r.seq)]
        assert spans == list(range(1, len(spans) + 1))


def test_manifest_header_and_samples(spark, tmp_path):
    (tmp_path / "list").write_text("b\na\n\n")
    assert text.expand(spark, ["a", f"@{tmp_path}/list"]) == ["a", "b"]
    (tmp_path / "bad").write_text('# x {"version": "1"}\n')
    with pytest.raises(Exception, match="pids"):
        text.headers(spark, f"{tmp_path}/bad").collect()
    assert text.empty_files(spark, f"{tmp_path}/bad").count() == 1
    assert text.sample_list("p:a,b") == ("p", ["a", "b"])
    with pytest.raises(ValueError, match="population"):
        text.sample_list("p")


def test_variant_calls_and_masks(spark, tmp_path):
    lines = ["##fileformat=VCFv4.2", "##contig=<ID=1,length=99>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tx\ty", "1\t5\t.\tA\tC,G\t.\t.\t.\tGT:DP\t0|2:7\t./1:3", "1\t6\t.\tA\t.\t.\t.\t.\tGT\t0/0\t."]
    (tmp_path / "a.vcf").write_text("\n".join(lines) + "\n")
    (tmp_path / "m.bed").write_text("1\t3\t9\textra\n")
    path = f"{tmp_path}/a.vcf"
    rows = text.read_variants(spark, path)
    assert [tuple(r) for r in rows.select("pos", "alts").orderBy("pos").collect()] == [(5, ["C", "G"]), (6, [])]
    got = text.genotypes(rows, text.vcf_samples(spark, path)).orderBy("pos", "sid").collect()
    assert [(r.sid, r.h0, r.h1) for r in got] == [("x", 0, 1), ("y", None, 1), ("x", 0, 0), ("y", None, None)]
    assert tuple(text.declared_lengths(spark, path).first()) == ("1", 99)
    assert tuple(text.read_bed(spark, f"{tmp_path}/m.bed").first()) == ("1", 3, 9)


@pytest.mark.parametrize("kind", ["cubic", "pchip", "akima", "piecewise"])
def test_splines_meet_their_knots_and_are_flat_outside(kind):
    x, y = [0.0, 1.0, 2.5, 3.0, 5.0], [1.0, 2.0, 2.5, 4.0, 4.5]
    s = splines.fit(kind, x, y)
    assert np.allclose(s(np.array(x)), y)
    assert np.allclose(s(np.array([-3.0, 9.0])), [1.0, 4.5])
    grid = s(np.linspace(0, 5, 400))
    if kind in ("pchip", "piecewise"):
        assert (np.diff(grid) >= -1e-12).all()
    if kind != "piecewise":
        total, e = 0.0, 1e-4
        for p, q in zip(x, x[1:], strict=False):
            t = p + (np.arange(1000) + 0.5) * (q - p) / 1000
            second = (s(t + e) - 2 * s(t) + s(t - e)) / e**2
            total += np.mean(second**2) * (q - p)
        assert s.roughness() == pytest.approx(total, rel=1e-4)


def test_cubic_reproduces_a_cubic_with_level_ends():
    x = np.array([0.0, 0.4, 0.7, 1.0])
    s = splines.fit("cubic", x, 3 * x**2 - 2 * x**3)
    t = np.linspace(0, 1, 50)
    assert np.allclose(s(t), 3 * t**2 - 2 * t**3)


def test_spline_table_gives_the_same_values(spark):
    s = {k: splines.fit(k, [0.0, 1.0, 2.0, 4.0], [0.0, 1.0, 0.5, 2.0]) for k in ("cubic", "akima")}
    points = spark.createDataFrame([(k, v / 4 - 1) for k in s for v in range(28)], "model_id string, t double")
    for r in splines.values(points, splines.pieces(spark, s)).collect():
        assert r.y == pytest.approx(float(s[r.model_id](np.array([r.t]))[0]))


def test_commands_read_span_files(spark, tmp_path):
    from spanlake import __main__ as commands

    head = '# spans {"version": "1", "pids": ["p", "q"], "undist": [[["s", 0]], [["t", 0]]], "dist": %s}\n'
    (tmp_path / "one.txt").write_text(head % '[[["s", 0], ["s", 1]], []]' + "5 0 0 2 0 0 3\n1 1 1 2 0 3 3\n")
    (tmp_path / "two.txt").write_text(head % '[[], [["t", 0], ["t", 1]]]' + "7 0 0 2 1 2 3\n")
    (tmp_path / "list").write_text(f"{tmp_path}/one.txt\n{tmp_path}/two.txt\n")
    got = sorted((r.span, r.a1, r.b1, r.nb1, r.a2, r.b2, r.nb2) for r in commands._rows(spark, f"@{tmp_path}/list").collect())
    assert got == [(1, 1, 1, 2, 0, 3, 3), (5, 0, 0, 2, 0, 0, 3), (7, 1, 2, 3, 0, 0, 2)]
    (tmp_path / "bad.txt").write_text(head % '[[["s", 0]], []]' + "5 0 0 2 0 0 3\n")
    (tmp_path / "none.txt").write_text(head % '[[["s", 0], ["s", 1]], []]')
    for name in ("bad.txt", "none.txt"):
        with pytest.raises(SystemExit):
            commands._rows(spark, f"{tmp_path}/{name}")
    spark.createDataFrame([("c", 0, 0, 0, 0, 2)], "contig_id string, seq bigint, span int, a1 int, b1 int, nb1 int").write.parquet(f"{tmp_path}/zero")
    with pytest.raises(SystemExit):
        commands._rows(spark, f"{tmp_path}/zero")
