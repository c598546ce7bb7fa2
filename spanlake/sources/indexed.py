"""Variant calls by place: a table of where each contig's lines lie in the files, and a scan that reads only what it needs.

``index`` cuts files into ranges of bytes, in parallel, and writes for each range and contig the first and last position.
The data source ``variant_lines`` takes filters on contig and pos: whole ranges are left out by the table, lines within a
range by the filter itself, so Spark has nothing left to test.

Files are plain text, or gzip of many small members that say their size (as block compression of calls writes them); other
gzip files are one range. A range has the lines that begin after its first byte, up to one that begins at its end."""

from __future__ import annotations

import gzip
import os
import re
import struct
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

RANGE = 4 << 20
#: Neighbouring ranges that one task reads.
TOGETHER = 8
SCHEMA = "contig string, pos bigint, value string"
_TABLE = "path string, kind string, start bigint, stop bigint, contig string, low bigint, high bigint, n bigint"


def store(path: str) -> tuple[fs.FileSystem, str]:
    path = re.sub(r"^file:/*", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def _size(head: bytes) -> int:
    """Bytes of the member that begins so; 0 if it does not say."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04" or head[12:14] != b"BC":
        return 0
    return struct.unpack("<H", head[16:18])[0] + 1


def kind_of(path: str) -> str:
    where, name = store(path)
    with where.open_input_stream(name, compression=None) as f:
        head = f.read(18)
    return "members" if _size(head) else "gzip" if head[:2] == b"\x1f\x8b" else "text"


def _members(f: pa.NativeFile, at: int) -> Iterator[tuple[int, bytes]]:
    """Where each member begins, and what it holds."""
    size = f.size()
    while at < size:
        f.seek(at)
        n = _size(f.read(18))
        f.seek(at)
        yield at, gzip.decompress(f.read(n))
        at += n


def lines_of(path: str, kind: str, start: int, stop: int) -> list[bytes]:
    """The lines of a range."""
    where, name = store(path)
    with where.open_input_file(name) as f:
        if kind == "gzip":
            return gzip.decompress(f.read()).split(b"\n") if start == 0 else []
        more: Iterator[bytes]
        if kind == "text":
            f.seek(start)
            data = f.read(stop - start)
            more = iter(lambda: f.read(1 << 16), b"")
        else:
            f.seek(start)
            window, at = f.read(min(stop - start, 1 << 17)), 0
            while start and not _size(window[at : at + 18]):
                at = window.find(b"\x1f\x8b\x08\x04", at + 1)
                if at < 0:
                    return []
            members, own = _members(f, start + at), []
            rest: list[bytes] = []
            for place, piece in members:
                if place >= stop:
                    rest = [piece]
                    break
                own.append(piece)
            data, more = b"".join(own), (x for part in (iter(rest), (p for _, p in members)) for x in part)
        if start:
            cut = data.find(b"\n")
            if cut < 0:
                return []
            data = data[cut + 1 :]
        tail = []
        for piece in more:
            end = piece.find(b"\n")
            tail.append(piece if end < 0 else piece[:end])
            if end >= 0:
                break
    return (data + b"".join(tail)).split(b"\n")


def table_of(lines: list[bytes]) -> pa.Table:
    """contig, pos and value of the lines that are calls."""
    values = pa.array([x for x in lines if x and not x.startswith(b"#")], pa.binary()).cast(pa.string())
    cells = pc.split_pattern(values, "\t", max_splits=2)
    if not len(values):
        return pa.table({"contig": pa.array([], pa.string()), "pos": pa.array([], pa.int64()), "value": values})
    return pa.table({"contig": pc.list_element(cells, 0), "pos": pc.list_element(cells, 1).cast(pa.int64()), "value": values})


def index(spark: SparkSession, path: str, to: str | None = None, size: int = RANGE) -> str:
    """Write the table of a file's, or folder's, ranges; returns where it is, by default beside the file."""
    to = to or f"{path.rstrip('/')}.ranges"

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, start, stop in pdf.itertuples(index=False, name=None):
                kind = kind_of(path)
                found = table_of(lines_of(path, kind, start, stop)).group_by("contig").aggregate([("pos", "min"), ("pos", "max"), ("pos", "count")])
                rows = found.to_pandas().rename(columns={"pos_min": "low", "pos_max": "high", "pos_count": "n"})
                yield rows.assign(path=path, kind=kind, start=start, stop=stop)[[c.split()[0] for c in _TABLE.split(", ")]]

    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(size).cast("bigint"))
    ranges = files.select("path", F.explode(starts).alias("start"), "length")
    ranges = ranges.select("path", "start", F.least(F.col("start") + size, "length").alias("stop")).repartition("path", "start")
    ranges.mapInPandas(look, _TABLE).write.mode("overwrite").parquet(to)
    return to


class Ranges(InputPartition):
    def __init__(self, path: str, kind: str, ranges: list[tuple[int, int]]) -> None:
        self.path, self.kind, self.ranges = path, kind, ranges


_TESTS = {EqualTo: "equal", EqualNullSafe: "equal", GreaterThan: "greater", GreaterThanOrEqual: "greater_equal", LessThan: "less", LessThanOrEqual: "less_equal"}


class VariantReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.table, self.tests = options.get("index") or f"{options['path'].rstrip('/')}.ranges", []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else ""
            if name not in ("contig", "pos") or not isinstance(f, (*_TESTS, In, IsNotNull)):
                yield f
            elif isinstance(f, In):
                self.tests.append((name, "in", tuple(f.value)))
            elif not isinstance(f, IsNotNull):  # a call always has both
                self.tests.append((name, _TESTS[type(f)], f.value))

    def _may_hold(self, name: str, test: str, value: Any) -> pc.Expression:
        """Whether a range may hold lines that pass."""
        contig, low, high = pc.field("contig"), pc.field("low"), pc.field("high")
        if name == "contig":
            return contig.isin(list(value)) if test == "in" else getattr(pc, test)(contig, value)
        if test == "in":
            return (low <= max(value)) & (high >= min(value))
        return {"equal": (low <= value) & (high >= value), "greater": high > value, "greater_equal": high >= value, "less": low < value, "less_equal": low <= value}[test]

    def partitions(self) -> list[Ranges]:
        where, name = store(self.table)
        wanted = pc.scalar(True)
        for test in self.tests:
            wanted = wanted & self._may_hold(*test)
        rows = ds.dataset(name, filesystem=where, format="parquet").to_table(columns=["path", "kind", "start", "stop"], filter=wanted, use_threads=False).to_pandas()
        out: list[Ranges] = []
        for path, kind, start, stop in rows.drop_duplicates().sort_values(["path", "start"]).itertuples(index=False, name=None):
            last = out[-1] if out else None
            if last and last.path == path and last.ranges[-1][1] == start and len(last.ranges) < TOGETHER:
                last.ranges.append((start, stop))
            else:
                out.append(Ranges(path, kind, [(start, stop)]))
        return out or [Ranges("", "text", [])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for start, stop in partition.ranges:
            rows = table_of(lines_of(partition.path, partition.kind, start, stop))
            for name, test, value in self.tests:
                rows = rows.filter(pc.is_in(rows[name], pa.array(value, rows[name].type)) if test == "in" else getattr(pc, test)(rows[name], value))
            yield from rows.to_batches()


class VariantLines(DataSource):
    """Options: path; index, where it is not beside the path."""

    @classmethod
    def name(cls) -> str:
        return "variant_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> VariantReader:
        return VariantReader(dict(self.options))


def lines(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """contig, pos and value (the line) of calls that have been indexed; filter it by contig and pos."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VariantLines)
    reader = spark.read.format("variant_lines").option("path", path)
    return (reader.option("index", table) if table else reader).load()
