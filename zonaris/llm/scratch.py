"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session. Where it is unset a temporary folder is made and set on a local master of one process (tests); on
    a cluster, whose machines would each write to a folder of their own, RuntimeError is raised."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "local")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="zonaris-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet below the shared folder and read it back, which cuts its lineage.

    The table survives the loss of any executor; it stays until `drop_scratch` or the end of the driver.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/zonaris/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    _written.append((spark, path))
    gc.collect()  # the written plan is garbage now; once it is collected, Spark's cleaner drops its shuffle files
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that `materialize` returned and that nothing reads any more."""
    folders = {f.rsplit("/", 1)[0].split(":", 1)[-1].lstrip("/") for f in df.inputFiles()}
    for entry in [x for x in _written if x[1].split(":", 1)[-1].lstrip("/") in folders]:
        _delete(*entry)
        _written.remove(entry)


def paths() -> set[str]:
    """The tables that `materialize` wrote and that are still there."""
    return {path for _, path in _written}


def drop(gone: set[str]) -> None:
    """Delete those of `paths()`; results that read them must be written before."""
    for entry in [x for x in _written if x[1] in gone]:
        _delete(*entry)
        _written.remove(entry)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_scratch() -> None:
    """Delete every table that `materialize` wrote; results that still read them must be written before."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session has ended already: nothing is left to delete with
            return


atexit.register(drop_scratch)
