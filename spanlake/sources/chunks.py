"""Chunk files: a data source that writes one file of span rows a chunk, each behind the same header, all of them or none.

Tasks write under names that no reader looks at, each attempt its own; the driver gives them their names when all tasks are
done, and takes them away when the job fails."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.window import Window

from ..operators.spans import observation
from .indexed import store


@dataclass
class Written(WriterCommitMessage):
    chunks: list[int]
    attempt: str


class ChunkWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.prefix, self.header = options["path"].rstrip("/"), options.get("prefix", "chunk"), options.get("header", "")
        self.job = uuid.uuid4().hex

    def _pending(self, *more: object) -> str:
        return "/".join([store(self.folder)[1], f"_pending-{self.job}", *map(str, more)])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, task = store(self.folder)[0], TaskContext.get()
        attempt = f"{task.partitionId()}-{task.taskAttemptId()}"
        where.create_dir(self._pending(attempt))
        done: list[int] = []
        out = None
        for batch in iterator:
            chunk = batch.column("chunk").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)] if len(chunk) else [0]
            cells = [batch.column(c).cast(pa.string()) for c in batch.schema.names if c not in ("chunk", "seq")]
            text = pc.binary_join_element_wise(*cells, " ")
            for a, b in zip(edges, edges[1:]):
                if not done or done[-1] != int(chunk[a]):
                    if out:
                        out.close()
                    done.append(int(chunk[a]))
                    out = pa.CompressedOutputStream(where.open_output_stream(self._pending(attempt, done[-1]), compression=None), "gzip")
                    if self.header:
                        out.write(f"{self.header}\n".encode())
                out.write(("\n".join(text.slice(a, b - a).to_pylist()) + "\n").encode())
        if out:
            out.close()
        return Written(done, attempt)

    def commit(self, messages: list[Written | None]) -> None:
        where, folder = store(self.folder)
        chunks = [c for m in messages if m for c in m.chunks]
        if len(chunks) != len(set(chunks)):
            self.abort(messages)
            raise ValueError("rows of a chunk must come to one task, in order: see write_chunks")
        for m in messages:
            for c in m.chunks if m else []:
                where.move(self._pending(m.attempt, c), f"{folder}/{self.prefix}{c}.gz")
        where.delete_dir(self._pending())

    def abort(self, messages: list[Written | None]) -> None:
        where = store(self.folder)[0]
        if where.get_file_info(self._pending()).type != fs.FileType.NotFound:
            where.delete_dir(self._pending())


class SpanChunks(DataSource):
    """Options: path, a folder; prefix of the files' names; header, a line that leads each file."""

    @classmethod
    def name(cls) -> str:
        return "span_chunks"

    def writer(self, schema: object, overwrite: bool) -> ChunkWriter:
        return ChunkWriter(dict(self.options))


def numbered(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows with ``chunk``: 0, 1, ... in the order of what names a chunk. One row a chunk is in the window, not data."""
    order = rows.select(*names).distinct().withColumn("chunk", (F.row_number().over(Window.orderBy(*names)) - 1).cast("bigint"))
    return rows.join(order, names)


def write_chunks(rows: DataFrame, path: str, header: str = "", prefix: str = "chunk") -> None:
    """Files ``prefix``0.gz, ``prefix``1.gz, ... of rows (chunk, seq, span and observations), each behind the header."""
    spark = rows.sparkSession
    spark.dataSource.register(SpanChunks)
    ordered = rows.select(F.col("chunk").cast("bigint").alias("chunk"), F.col("seq").cast("bigint").alias("seq"), "span", *observation(rows))
    ordered = ordered.repartition("chunk").sortWithinPartitions("chunk", "seq")
    ordered.write.format("span_chunks").option("path", path).option("prefix", prefix).option("header", header).mode("append").save()
