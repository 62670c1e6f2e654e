"""A training corpus from `documents`: good texts, one of each near-duplicate class, no benchmark items, mixed and sharded.

A stage is (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonaris.llm import decontam, minhash, mixing, quality, scratch, sharding

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_own: set[str] = set()  # what the last stage wrote for itself


def _stage(work: Stage) -> Stage:
    """A stage that begins by deleting the tables that the stage before wrote for itself: that one's result is written by now."""

    @wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch.drop(_own)
        held = scratch.paths()
        out = work(spark, docs, sf_dir)
        _own.clear()
        _own.update(scratch.paths() - held)
        return out

    return run


@_stage
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on all labels, scores 0.5 or more.

    Null and empty texts are judged like any other, null doc_ids and repeated rows by their text; columns may have any name; an
    empty table gives no rows.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the least doc_id.

    Texts without words and rows with a null doc_id stay, rows that share a doc_id stay or go together; columns may have any name; an
    empty table gives no rows.
    """
    return minhash.drop_near_duplicates(docs)


@_stage
def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts and rows with a null doc_id stay, rows that share a doc_id stay or go together; columns may have any name;
    an empty table gives no rows, an empty benchmark keeps all.
    """
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, stored in the order of the source mix.

    A null source is one of its own; null ids and texts and repeated rows are placed like any other; columns may have any name; an empty
    table gives no rows.
    """
    return mixing.in_mix_order(docs)


@_stage
def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of nearly equal bytes, runs of the stored order, so that each has the mix of sources.

    Files are ordered by their part number, then by name, and rows by their place in a file; docs that come from no file are ordered by doc_id.
    Null texts and ids and repeated rows are placed like any other; further columns, of any name, are ignored; an empty table gives no rows.
    """
    if docs.inputFiles():
        name = F.col("_metadata.file_name")
        number = F.coalesce(F.regexp_extract(name, r"(\d+)", 1).try_cast("bigint"), F.lit(0))
        docs = docs.select("doc_id", "text", number.alias("number"), name.alias("name"), F.col("_metadata.row_index").alias("row"))
        return sharding.shard_documents(docs, order=[F.col("number"), F.col("name"), F.col("row")])
    return sharding.shard_documents(docs)


STAGES = [("quality", good_quality), ("near_duplicates", one_of_each), ("decontamination", no_benchmark), ("mixing", mixed), ("sharding", sharded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier's fit and BagMinHash have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None
