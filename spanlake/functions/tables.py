"""Table functions for SQL over span rows: ``SELECT * FROM thin(TABLE(t) PARTITION BY contig_id ORDER BY (seq), 10)``.

Each takes the rows of a contig in order, whatever other columns there are, and has the columns of its input for a result: the
position within the contig is all it keeps. They give the rows of the functions of the same name in ``operators.spans``,
which a DataFrame should use."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


def _named(table: AnalyzeArgument, size: AnalyzeArgument, more: list[str], name: str) -> AnalyzeResult:
    """The input's key and observation columns beside those of the function."""
    if not table.isTable:
        raise ValueError(f"{name} takes TABLE(...) PARTITION BY contig_id ORDER BY (seq), and a number")
    if size.value is None or int(size.value) <= 0:
        raise ValueError(f"{name} needs a number above 0")
    found = {f.name: f.dataType for f in table.dataType.fields}
    if missing := {"contig_id", "seq", "span", "a1", "b1", "nb1"} - set(found):
        raise ValueError(f"{name} misses the columns {', '.join(sorted(missing))}")
    out = StructType().add("contig_id", found["contig_id"]).add("seq", LongType())
    for c in more:
        out = out.add(c, LongType())
    out = out.add("span", LongType())
    for c in found:
        if re.fullmatch(r"(a|b|nb)\d+", c):
            out = out.add(c, IntegerType())
    return AnalyzeResult(out)


class _Ordered:
    """Where the next row of the contig begins."""

    def __init__(self) -> None:
        self.at = 0

    def _place(self, row: Row) -> tuple[int, int]:
        start, self.at = self.at, self.at + int(row["span"])
        return start, self.at

    @staticmethod
    def _seen(row: Row) -> list[str]:
        return [c for c in row.asDict() if re.fullmatch(r"(a|b|nb)\d+", c)]


@udtf
class Thin(_Ordered):
    """Full observations at every k-th base only: contig_id, seq, start, span and the observation."""

    @staticmethod
    def analyze(table: AnalyzeArgument, k: AnalyzeArgument) -> AnalyzeResult:
        return _named(table, k, ["start"], "thin")

    def eval(self, row: Row, k: int) -> Iterator[tuple]:
        start, stop = self._place(row)
        names = self._seen(row)
        both = sum(int(row[c]) for c in names if c.startswith("a")) == 2
        full = [0 if both else row[c] for c in names]
        part = [0 if both or not c.startswith("a") else row[c] for c in names]
        at = start
        for mark in range(start // k * k + k - 1, stop, k):
            if mark > at:
                yield (row["contig_id"], row["seq"], at, mark - at, *part)
            yield (row["contig_id"], row["seq"], mark, 1, *full)
            at = mark + 1
        if stop > at:
            yield (row["contig_id"], row["seq"], at, stop - at, *part)


@udtf
class Realign(_Ordered):
    """Rows split at every multiple of w: contig_id, seq, win, start, span and the observation."""

    @staticmethod
    def analyze(table: AnalyzeArgument, w: AnalyzeArgument) -> AnalyzeResult:
        return _named(table, w, ["win", "start"], "realign")

    def eval(self, row: Row, w: int) -> Iterator[tuple]:
        start, stop = self._place(row)
        seen = [row[c] for c in self._seen(row)]
        for win in range(start // w, (stop - 1) // w + 1):
            a, b = max(start, win * w), min(stop, (win + 1) * w)
            yield (row["contig_id"], row["seq"], win, a, b - a, *seen)


@udtf
class BreakLong(_Ordered):
    """Contigs cut at missing rows of ``cutoff`` bases or more, which go; each piece begins with one missing base: contig_id,
    seq, piece, span and the observation."""

    def __init__(self) -> None:
        super().__init__()
        self.piece = -1

    @staticmethod
    def analyze(table: AnalyzeArgument, cutoff: AnalyzeArgument) -> AnalyzeResult:
        return _named(table, cutoff, ["piece"], "break_long")

    def eval(self, row: Row, cutoff: int) -> Iterator[tuple]:
        names = self._seen(row)
        long = int(row["span"]) >= cutoff and all(row[c] == (-1 if c.startswith("a") else 0) for c in names if not re.fullmatch(r"b\d+", c))
        if self.piece < 0 or long:
            for _ in range((self.piece < 0) + long):
                self.piece += 1
                yield (row["contig_id"], -1, self.piece, 1, *[-1 if c.startswith("a") else 0 for c in names])
        if not long:
            yield (row["contig_id"], row["seq"], self.piece, int(row["span"]), *[row[c] for c in names])


FUNCTIONS = {"thin": Thin, "realign": Realign, "break_long": BreakLong}


def register(spark: SparkSession) -> None:
    """Make the table functions known to SQL in a session."""
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)
