"""Tables that a job writes for itself, in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; on a local master of one process (tests) a temporary folder is made and set where it is unset, elsewhere RuntimeError is raised."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "local")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="zonaris-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_made: list[tuple[SparkSession, str]] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder. It is deleted when the driver ends, or by `drop_folders`."""
    path = f"{shared_folder(spark)}/zonaris/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any file system that the cluster knows."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_folders() -> None:
    """Delete all that `new_folder` gave out; results that still read it must be written before."""
    while _made:
        spark, path = _made.pop()
        try:
            delete(spark, path)
        except Exception:  # the session has ended already: nothing is left to delete with
            return


atexit.register(drop_folders)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet and read back, which cuts its lineage and survives the loss of any executor."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
