"""Streams over files: windowed counts and keyed state, with results as a table of the shared folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from zonaris.sources.shared import new_folder


def file_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of the Parquet file or folder of files at `path`, with the schema that it has now.

    A stream takes a plain path for a folder, so the last letter is written as a pattern, which fits a single file too.
    """
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)


def window_counts(stream: DataFrame, at: str, width: str, key: str, late: str | None = None) -> DataFrame:
    """(hour, key, n): counts in fixed windows of `width`, by window start.

    With `late`, a watermark: windows older than that behind the latest row are closed and their state is dropped, and rows later than
    that are not counted. Without it late rows still count and state is kept for every window, which is for bounded input only.
    """
    stream = stream if late is None else stream.withWatermark(at, late)
    return stream.groupBy(F.window(at, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), key, "n")


def latest_by_batch(updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Run an aggregating stream over all that is there and return each key's last row.

    Every batch writes its changed rows under its own number, so a batch that runs again after a failure replaces itself. A stream
    without a batch gives no rows.
    """
    spark = updates.sparkSession
    path = new_folder(spark, "stream")
    updates.sparkSession.createDataFrame([], updates.schema).write.parquet(f"{path}/out/batch=-1")
    rest = [c for c in updates.columns if c not in keys]

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    updates.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    seen = spark.read.schema(StructType([*updates.schema.fields, StructField("batch", LongType())])).parquet(f"{path}/out")
    return seen.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*keys, "last.*")
