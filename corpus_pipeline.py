"""The corpus pipeline: documents to sharded training data in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanlake.llm import decontaminate, mixing, neardup, quality, sharding
from spanlake.llm.common import documents, stash, table


def good_only(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it learns from all labels. Null and empty texts are scored as empty
    ones; rows are judged one by one, whatever their ids; an empty table stays empty; all columns are kept."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays; five-word shingles, similarity from 0.8 on. Documents without words
    or id are linked with nothing and stay; rows of one id are judged by their texts; all columns are kept."""
    return neardup.survivors(docs, shingle=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that mostly consist of them go. Null and empty texts stay as they are; items
    without words match nothing; an empty benchmark changes nothing; all columns are kept."""
    return decontaminate.cut(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in no order: the shards deal them anew. A null text has no words and is not
    in the mix; rows of equal id and text are taken in turn; an empty table gives an empty one."""
    return mixing.mixed(docs, ordered=False)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with shard and slot. A null id is a key of its own, a null text has size 16; rows of equal id
    share a shard; columns named as a result is are called in_<name>."""
    return sharding.shard(docs, keep=tuple(docs.columns))


STAGES = [("quality", good_only), ("near_duplicates", one_of_each), ("decontamination", without_benchmark), ("mixing", mixed), ("sharding", sharded)]

#: The classifier of the first stage is not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written and read again, so an empty table goes through them all."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
