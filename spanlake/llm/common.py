"""What the operators share: reading, written tables in the shared folder, small helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, as in tests, a temporary one, if all runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spanlake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage, survives lost executors."""
    modest(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stashed = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of stash() that nothing reads any more, and let Spark clear shuffle files of plans out of use."""
    jvm, path = df.sparkSession._jvm, df._stashed
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
    tidy(df.sparkSession)


def tidy(spark: SparkSession) -> None:
    """Spark removes the shuffle files of plans that are garbage; ask for a collection, so that they go soon."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


#: Rows in an Arrow batch: documents may be long, and a batch is in memory on both sides of the worker's pipe.
BATCH_ROWS = 256


def modest(spark: SparkSession) -> None:
    """Use small Arrow batches where the session has not chosen a size itself."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    modest(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, n: int) -> Column:
    """crc32 of a value as text, modulo n; null has none."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n
