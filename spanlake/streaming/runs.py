"""Run-length compression of a stream of span rows.

The state of a contig is its last run. A different observation closes it at once; where none follows, a timer does: when the
watermark has passed the time of the run's last row by ``idle``, the contig is taken to have ended. Rows of a contig come in
order of their times; rows behind the watermark are dropped by Spark, as in any stateful query. Contigs are dealt by a hash to
groups, whose last runs are one state with one timer, the first that is due: calls grow with the groups, not with the contigs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import NumericType

COLUMNS = ["contig_id", "seq", "span", "a1", "b1", "nb1"]
_HELD = "seq long, span long, a1 long, b1 long, nb1 long, due long"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Runs(StatefulProcessor):
    def __init__(self, idle: int, kind: str) -> None:
        self.idle, self.kind = idle, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getListState("held", f"contig_id {self.kind}, {_HELD}")

    def _keep(self, runs: list[tuple], timer: int | None) -> None:
        """Holds these runs; ``timer`` is the one that is set."""
        due = min(r[-1] for r in runs)
        self.held.put(runs)
        if timer != due:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True)
        pdf = pdf[(pdf["span"] > 0) & (pdf["part"] >= 0)]  # rows without a contig move the watermark only
        if not len(pdf):
            return
        before = list(self.held.get()) if self.held.exists() else []
        held = pd.DataFrame(before, columns=[*COLUMNS, "due"])
        contigs = pd.concat([held["contig_id"], pdf["contig_id"]], ignore_index=True) if before else pdf["contig_id"]
        codes, names = pd.factorize(contigs)
        found = np.vstack([held[COLUMNS[1:]].to_numpy(np.int64), pdf[COLUMNS[1:]].to_numpy(np.int64)])
        due, late = np.zeros(len(names), np.int64), np.full(len(names), np.iinfo(np.int64).min)
        due[codes[: len(held)]] = held["due"].to_numpy(np.int64)
        np.maximum.at(late, codes[len(held) :], pdf["time"].to_numpy(np.int64) + self.idle)
        due = np.where(late > np.iinfo(np.int64).min, late, due)
        order = np.lexsort((found[:, 0], np.arange(len(found)) >= len(held), codes))
        found, codes = found[order], codes[order]
        new = np.flatnonzero(np.r_[True, (found[1:, 2:] != found[:-1, 2:]).any(1) | (codes[1:] != codes[:-1])])
        merged, codes = found[new], codes[new]
        merged[:, 1] = np.add.reduceat(found[:, 1], new)
        last = np.r_[codes[1:] != codes[:-1], True]
        ends = codes[last]
        self._keep(list(zip(np.asarray(names)[ends].tolist(), *merged[last].T.tolist(), due[ends].tolist(), strict=True)), min((r[-1] for r in before), default=None))
        if not last.all():
            out = pd.DataFrame(merged[~last], columns=COLUMNS[1:])
            out.insert(0, "contig_id", np.asarray(names)[codes[~last]])
            yield out

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        held = list(self.held.get()) if self.held.exists() else []
        ended, rest = [r for r in held if r[-1] <= now], [r for r in held if r[-1] > now]
        if rest and ended:
            self._keep(rest, None)
        elif ended:
            self.held.clear()
        if ended:
            yield pd.DataFrame([r[:-1] for r in ended], columns=COLUMNS)

    def close(self) -> None:
        pass


def compress(rows: DataFrame, time: str = "ts", delay: str = "0 seconds", idle: str = "10 minutes", groups: int = 256) -> DataFrame:
    """Merged runs of each contig, given out as soon as a different observation follows or the contig has been idle. ``time``
    is the column of event times; rows whose contig is null only let time go on. A task has the rows that
    one of the ``groups`` of contigs has in a batch at a time; their number stays as long as the checkpoint. Needs the RocksDB state
    store, which is set where the session has not chosen one."""
    spark, name = rows.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(name, ""):
        spark.conf.set(name, _STORE)
    kind = rows.schema["contig_id"].dataType.simpleString()
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)
    cells = [F.col(c).cast("long" if c in ("seq", "span") else "int").alias(c) for c in COLUMNS[1:]]
    part = F.when(F.col("contig_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("contig_id"), F.lit(groups))).alias("part")
    # pandas would make floats of numbers among nulls
    contig = F.coalesce("contig_id", F.lit(0).cast(kind)).alias("contig_id") if isinstance(rows.schema["contig_id"].dataType, NumericType) else F.col("contig_id")
    timed = rows.withWatermark(time, delay).select(part, contig, *cells, time, F.unix_millis(time).alias("time"))
    schema = f"contig_id {kind}, seq long, span long, a1 int, b1 int, nb1 int"
    return timed.groupBy("part").transformWithStateInPandas(_Runs(wait, kind), schema, "Append", "EventTime")
