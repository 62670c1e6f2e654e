"""Comparison of runs and annotations: drift, field-wise verdicts, completeness, exact tests, as-of joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drift(old: DataFrame, new: DataFrame, key: str, group: str) -> DataFrame:
    """(group, n_union, n_added, n_removed, drift): one aggregation marks the sides of each key, so nothing is joined."""
    sides = old.select(key, group, F.lit(1).alias("o"), F.lit(0).alias("n")).unionByName(new.select(key, group, F.lit(0).alias("o"), F.lit(1).alias("n")))
    sides = sides.groupBy(group, key).agg(F.max("o").alias("o"), F.max("n").alias("n"))
    out = sides.groupBy(group).agg(F.count("*").alias("n_union"), F.count_if(F.col("o") == 0).alias("n_added"), F.count_if(F.col("n") == 0).alias("n_removed"))
    return out.withColumn("drift", (F.col("n_added") + F.col("n_removed")) / F.col("n_union"))


def compare_fields(expected: DataFrame, actual: DataFrame, key: str, fields: Sequence[str], tolerance: float) -> DataFrame:
    """(key, field, verdict): equal, different, missing or unexpected."""
    long = lambda d, v: d.unpivot([key], list(fields), "field", v)
    d = long(expected, "want").withColumn("_e", F.lit(True)).join(long(actual, "got").withColumn("_a", F.lit(True)), [key, "field"], "full")
    verdict = F.when(F.col("_e").isNull(), "unexpected").when(F.col("_a").isNull(), "missing").when(F.abs(F.col("want") - F.col("got")) <= tolerance, "equal").otherwise("different")
    return d.select(key, "field", verdict.alias("verdict"))


def verdicts(truth: DataFrame, found: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n_true, n_found, n_both, verdict): exact, partial, wrong, fp (nothing expected) or fn (nothing found)."""
    both = truth.select(key, value, F.lit(1).alias("t"), F.lit(0).alias("f")).unionByName(found.select(key, value, F.lit(0).alias("t"), F.lit(1).alias("f")))
    both = both.groupBy(key, value).agg(F.max("t").alias("t"), F.max("f").alias("f"))
    c = both.groupBy(key).agg(F.sum("t").alias("n_true"), F.sum("f").alias("n_found"), F.sum(F.col("t") * F.col("f")).alias("n_both"))
    v = F.when(F.col("n_true") == 0, "fp").when(F.col("n_found") == 0, "fn").when((F.col("n_both") == F.col("n_true")) & (F.col("n_both") == F.col("n_found")), "exact").when(F.col("n_both") > 0, "partial").otherwise("wrong")
    return c.withColumn("verdict", v)


def completeness(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """(field, total, known, percent) of all rows; one scan, one row for each check."""
    one = df.agg(F.count("*").alias("total"), *(F.count_if(c).alias(f"_{i}") for i, c in enumerate(checks.values())))
    rows = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"_{i}").alias("known")) for i, f in enumerate(checks)))
    return one.select("total", F.inline(rows)).select("field", "total", "known", F.try_divide(100.0 * F.col("known"), F.col("total")).alias("percent"))


def mcnemar(b: Column, c: Column) -> Column:
    """Two-sided exact p value of discordant counts `b` and `c`: twice the lower binomial tail at 1/2, by logarithms."""
    n, least = b + c, F.least(b, c)
    first = -n * F.log(F.lit(2.0))
    one = F.lit(1).cast("bigint")

    def add(state: Column, k: Column) -> Column:
        log = state["log"] + F.log((n - k + 1) / k)
        return F.struct(log.alias("log"), (state["sum"] + F.exp(log)).alias("sum"))

    start = F.struct(first.alias("log"), F.exp(first).alias("sum"))
    tail = F.when(least == 0, F.exp(first)).otherwise(F.aggregate(F.sequence(one, F.greatest(least, one)), start, add)["sum"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def as_of(probes: DataFrame, versions: DataFrame, key: str, at: str, since: str) -> DataFrame:
    """Probes with the latest `since` of their key's versions that is not after `at`, else null: both sides are sorted
    together once for each key, so no pairs are made."""
    v = versions.select(key, F.col(since).alias(at), F.col(since), F.lit(0).alias("_probe"))
    both = v.unionByName(probes.withColumn("_probe", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "_probe").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(since, F.last(since, ignorenulls=True).over(w)).where("_probe = 1").drop("_probe")
