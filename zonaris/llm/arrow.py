"""Columns computed from texts in Arrow batches.

Only the texts enter Python. Ids and all other columns stay in the JVM, so they keep their type and value whatever they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .textkit import chunks

BATCH_BYTES = 4 << 20


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """While it lasts, the session has `value` for `name`."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def small_batches(spark: SparkSession, most: int = 2 * BATCH_BYTES):
    """While it lasts, jobs of the session send Python at most about `most` bytes at once; for tables whose rows are large."""
    return setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def sizes_of(texts: pa.Array) -> list[int]:
    """Bytes of each text; null is 0."""
    return pc.fill_null(pc.binary_length(texts), 0).to_pylist()


def text_function(work: Callable[[list], pa.Array], kind: str, most: int = BATCH_BYTES):
    """A column function of type `kind` of one string or binary column.

    `work` gives one value for each of its texts (some of them None); it is called with consecutive texts of about `most`
    bytes together, and with a longer text alone.
    """

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [work(texts[s].to_pylist()) for s in chunks(sizes_of(texts), most)]
            yield pa.concat_arrays(parts) if parts else work([])

    return run


def list_function(work: Callable[[pa.ListArray], pa.Array], kind: str, most: int = BATCH_BYTES // 8):
    """A column function of type `kind` of one list column; `work` is called with consecutive lists of about `most` values together."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            sizes = pc.fill_null(pc.list_value_length(rows), 0).to_pylist()
            parts = [work(rows[s]) for s in chunks(sizes, most)]
            yield pa.concat_arrays(parts) if parts else work(rows)

    return run


def struct(**columns: pa.Array | Sequence | np.ndarray) -> pa.StructArray:
    """A struct column of equally long columns."""
    return pa.StructArray.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))


def lists(ends: np.ndarray, values: np.ndarray | pa.Array) -> pa.ListArray:
    """Lists `values[ends[i] : ends[i + 1]]`."""
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))


def row_function(work: Callable[[list], Iterator[tuple[np.ndarray, dict]]], keep: Sequence[str], most: int = BATCH_BYTES):
    """A mapInArrow function: `work` gives, for the texts of column `text`, several times (index of the text, columns); the
    columns of `keep` are repeated beside them as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for s in chunks(sizes_of(texts), most):
                for row, columns in work(texts[s].to_pylist()):
                    at = pa.array(np.asarray(row, np.int64) + s.start)
                    cols = {**{k: batch.column(k).take(at) for k in keep}, **columns}
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in cols.values()], names=list(cols))

    return run
