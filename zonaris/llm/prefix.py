"""Global order and prefix sums without a single-partition window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize


def ranked(df: DataFrame, order: Sequence[Column], size: Column, group: Column | None = None) -> DataFrame:
    """(row, group, before_rows, before_size): the columns of `df` as one struct, and how many rows, and how much `size`, come before it.

    `order` are columns, ascending with nulls first. With `group`, both count within the row's group (else null). Rows are dealt by range
    of the order, so a group or a value with many rows is spread over several partitions; each partition's totals become
    offsets (one row for each partition and group is all that meets in one place), and a running sum inside the partition
    gives the rest. The dealt rows are written once, so that both steps see the same partitions. Rows that are equal in
    `order` are dealt by their place in the input, so that many of them are spread as well. Names of `df` may be any; an empty table gives no
    rows; a null size counts as nothing.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    keys = [f"k{i}" for i in range(len(order))] + ["tie"]
    g = F.lit(None).cast("int") if group is None else group
    d = df.select(F.struct("*").alias("row"), g.alias("group"), size.alias("size"), *(c.alias(k) for c, k in zip(order, keys, strict=False)), F.monotonically_increasing_id().alias("tie"))
    dealt = materialize(d.repartitionByRange(n, *(["group"] if group is not None else []), *keys).withColumn("part", F.spark_partition_id()), "dealt")
    totals = dealt.groupBy("group", "part").agg(F.count("*").alias("r"), F.sum("size").alias("s"))
    ahead = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("group").alias("g"), F.col("part").alias("p"), *(F.coalesce(F.sum(x).over(ahead), F.lit(0)).alias(y) for x, y in (("r", "r0"), ("s", "s0"))))
    inside = Window.partitionBy("part", "group").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    local = dealt.withColumn("rn", zero(F.count("*").over(inside))).withColumn("sum", zero(F.sum("size").over(inside)))
    joined = local.join(offsets, (local["part"] == offsets["p"]) & local["group"].eqNullSafe(offsets["g"]))
    return joined.select("row", "group", (F.col("r0") + F.col("rn")).alias("before_rows"), (F.col("s0") + F.col("sum")).alias("before_size"))


def prefix_sums(df: DataFrame, order: Sequence[Column], size: Column, group: Column | None = None) -> DataFrame:
    """`df` with `_before_rows` and `_before_size` of `ranked`; columns of these two names are replaced."""
    own = [F.col(f"row.`{c.replace('`', '``')}`").alias(c) for c in df.columns if c not in ("_before_rows", "_before_size")]
    return ranked(df, order, size, group).select(*own, F.col("before_rows").alias("_before_rows"), F.col("before_size").alias("_before_size"))
