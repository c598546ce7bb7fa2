"""Scans of one contig, and chunk files."""

import gzip
import os
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from spanlake import __main__ as commands
from spanlake.operators import spans
from spanlake.sources import chunks, indexed, text

ROWS = "contig_id string, seq bigint, span int, a1 int, b1 int, nb1 int"


def members(data, size=30_000):
    out = b""
    for i in range(0, len(data), size):
        press = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = press.compress(data[i : i + size]) + press.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data[i : i + size]), len(data[i : i + size]))
    return out


@pytest.fixture(scope="module")
def calls(tmp_path_factory):
    folder, rng = tmp_path_factory.mktemp("calls"), random.Random(1)
    lines = ["##x", "#CHROM\tPOS"] + [f"chr{c}\t{p}\t.\tA\tC\t" + "x" * rng.randrange(300) for c in range(1, 6) for p in sorted(rng.sample(range(1, 100_000), 2000))]
    raw = ("\n".join(lines) + "\n").encode()
    (folder / "a.vcf").write_bytes(raw)
    (folder / "b.vcf.gz").write_bytes(members(raw, 3000))
    with gzip.open(folder / "c.vcf.gz", "wb") as f:
        f.write(raw)
    (folder / "d.vcf").write_bytes(b"chr1\t5\tno line end")
    return folder, [x for x in lines if not x.startswith("#")]


@pytest.mark.parametrize(("name", "size", "share"), [("a.vcf", 100_000, 0.4), ("a.vcf", 777, 0.22), ("b.vcf.gz", 3000, 0.4), ("c.vcf.gz", 50_000, 1.1)])
def test_rows_and_bytes(spark, calls, name, size, share):
    folder, lines = calls
    path = str(folder / name)
    table = indexed.index(spark, path, f"{path}-{size}", size)
    found = indexed.lines(spark, path, table)
    assert sorted(r.value for r in found.collect()) == sorted(lines)
    one = found.where("contig = 'chr3' and pos between 20000 and 30000 and value like '%x%'")
    assert sorted(r.value for r in one.collect()) == sorted(x for x in lines if x.startswith("chr3\t") and 20_000 <= int(x.split("\t")[1]) <= 30_000 and "x" in x)
    assert found.where("contig in ('chr1', 'chr5') and pos < 500").count() == sum(x.split("\t")[0] in ("chr1", "chr5") and int(x.split("\t")[1]) < 500 for x in lines)
    assert found.where("contig = 'none'").count() == 0
    reader = indexed.VariantReader({"path": path, "index": table})
    assert not list(reader.pushFilters([indexed.EqualTo(("contig",), "chr3"), indexed.GreaterThan(("pos",), 1)]))
    assert sum(b - a for p in reader.partitions() for a, b in p.ranges) < share * os.path.getsize(path)


def test_file_without_a_last_line_end(spark, calls):
    path = str(calls[0] / "d.vcf")
    indexed.index(spark, path, size=3)
    assert [r.value for r in indexed.lines(spark, path).collect()] == ["chr1\t5\tno line end"]


def test_variants_of_a_contig(spark, tmp_path):
    head = "##contig=<ID=c1,length=50>\n##contig=<ID=c2,length=60>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts\tt\n"
    body = "".join(f"c{c}\t{p}\t.\tA\tC\t.\t.\t.\tGT\t0/1\t{p % 2}/1\n" for c in (1, 2) for p in range(3, 40, 4))
    (tmp_path / "x.vcf").write_text(head + body)
    path = str(tmp_path / "x.vcf")
    plain = sorted(map(str, text.read_variants(spark, path, "c2", 10, 30).collect()))
    commands.main(["index", path, "--range", "64"], spark)
    assert sorted(map(str, text.read_variants(spark, path, "c2", 10, 30).collect())) == plain and len(plain) == 5
    commands.main(["convert", path, f"{path}-one", "p:s,t", "--contig", "c2"], spark)
    commands.main(["convert", path, f"{path}-all", "p:s,t"], spark)
    one, all_ = (spark.read.parquet(f"{path}-{x}") for x in ("one", "all"))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, all_.where("contig_id = 'c2'").collect()))
    with pytest.raises(SystemExit):
        commands.main(["convert", path, f"{path}-no", "p:s,t", "--mask", "m.bed", "--missing-cutoff", "5"], spark)


def rows_of(spark):
    return spark.createDataFrame([(f"c{c}", i, 7, i % 3, i % 2, 2) for c in range(3) for i in range(20)], ROWS)


def test_chunk_files(spark, tmp_path):
    cut = chunks.numbered(spans.chunk(rows_of(spark), 20), ["contig_id", "win"])
    path = f"{tmp_path}/out"
    chunks.write_chunks(cut, path, '# spans {"pids": ["p"]}', "piece")
    assert sorted(os.listdir(path)) == sorted(f"piece{i}.gz" for i in range(21))
    back = text.read_spans(spark, path, contig=F.regexp_extract("file", r"piece(\d+)\.gz", 1).cast("bigint"))
    key = lambda df, c: sorted((r[c], *[r[x] for x in ("span", "a1", "b1", "nb1")]) for r in df.collect())
    assert key(back, "contig_id") == key(cut, "chunk")
    assert text.headers(spark, path).count() == 21


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    cut = chunks.numbered(spans.chunk(rows_of(spark), 20), ["contig_id", "win"])
    bad = cut.withColumn("span", F.when((F.col("chunk") == 20) & (F.col("start") % 20 == 0), F.raise_error(F.lit("no"))).otherwise(F.col("span")).cast("int"))
    path = f"{tmp_path}/out"
    with pytest.raises(Exception):  # noqa: B017
        chunks.write_chunks(bad, path)
    assert not os.path.exists(path) or os.listdir(path) == []


def test_chunk_command(spark, tmp_path):
    rows_of(spark).write.parquet(f"{tmp_path}/in")
    (tmp_path / "first.txt").write_text('# spans {"pids": ["p"]}\n5 0 0 2\n')
    commands.main(["chunk", f"{tmp_path}/in", f"{tmp_path}/text", "--size", "20", "--draws", "9", "--text", f"{tmp_path}/first.txt"], spark)
    assert sorted(os.listdir(f"{tmp_path}/text")) == sorted(f"chunk{i}.gz" for i in range(9))
    assert spark.read.text(f"{tmp_path}/text").where("value like '#%'").count() == 9
