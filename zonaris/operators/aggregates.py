"""Aggregates: shares with completeness, precedence, conflicts, histograms, intervals, statistics of evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonaris.sources.shared import written


def share_completeness(parts: DataFrame, wholes: DataFrame, key: str, part: str, whole: str, tolerance: float = 0.1) -> DataFrame:
    """(key, measured, whole, share, is_complete, reasons): a missing or zero whole gives a null share, never 100 %."""
    got = parts.groupBy(key).agg(F.sum(part).alias("measured"))
    out = wholes.select(key, F.col(whole).alias("whole")).join(got, key, "left")
    share = F.when(F.col("whole") > 0, 100.0 * F.col("measured") / F.col("whole"))
    out = out.withColumn("share", share)
    reasons = F.array_compact(F.array(F.when(F.coalesce(F.col("whole") <= 0, F.lit(True)), "no_boundary"), F.when(F.col("measured").isNull(), "no_zones"), F.when(F.abs(F.col("share") - 100) > tolerance, "share_sum_out_of_tolerance")))
    return out.withColumn("reasons", F.concat_ws(",", reasons)).withColumn("is_complete", F.col("reasons") == "")


def worst_of(df: DataFrame, key: str, status: str, precedence: Sequence[str]) -> DataFrame:
    """(key, status): of each key's statuses the one that comes first in `precedence`; others count last."""
    rank = F.lit(len(precedence))
    for i, s in reversed(list(enumerate(precedence))):
        rank = F.when(F.col(status) == s, i).otherwise(rank)
    worst = F.min(rank).alias("_r")
    names = F.array(*(F.lit(s) for s in [*precedence, "unknown"]))
    return df.groupBy(key).agg(worst).select(key, names[F.col("_r")].alias("status"))


def conflict_groups(df: DataFrame, code: str, value: str) -> DataFrame:
    """(code, n_values, n_rows) of the codes with more than one distinct value."""
    return df.groupBy(code).agg(F.countDistinct(value).alias("n_values"), F.count("*").alias("n_rows")).where("n_values > 1")


def coalesce_dedupe(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row for each key: of each column the first value that is not null, in `order`."""
    firsts = (F.min(F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("v"))))["v"].alias(c) for c in columns)
    return df.groupBy(key).agg(*firsts)


def class_histogram(df: DataFrame, value: Column, breaks: Sequence[float], key: str) -> DataFrame:
    """(key, class, n, share): counts by class [breaks[i], breaks[i+1]), the last one open; empty classes are listed."""
    bucket = F.lit(None)
    for i, b in reversed(list(enumerate(breaks))):
        bucket = F.when(value >= b, F.lit(i)).otherwise(bucket) if i == len(breaks) - 1 else F.when((value >= b) & (value < breaks[i + 1]), F.lit(i)).otherwise(bucket)
    got = df.select(key, bucket.alias("class")).where("class is not null").groupBy(key, "class").agg(F.count("*").alias("n"))
    every = df.select(key).distinct().withColumn("class", F.explode(F.sequence(F.lit(0), F.lit(len(breaks) - 1))))
    out = every.join(got, [key, "class"], "left").na.fill(0, ["n"])
    return out.withColumn("share", F.try_divide(100.0 * F.col("n"), F.sum("n").over(Window.partitionBy(key))))


def circular_mean(df: DataFrame, angle: Column, key: str) -> DataFrame:
    """(key, mean_deg, resultant, n) of angles in degrees."""
    r = F.radians(angle)
    got = df.groupBy(key).agg(F.sum(F.sin(r)).alias("s"), F.sum(F.cos(r)).alias("c"), F.count(angle).alias("n"))
    mean = F.pmod(F.degrees(F.atan2("s", "c")) + 360, F.lit(360.0))
    return got.select(key, mean.alias("mean_deg"), (F.sqrt(F.col("s") * F.col("s") + F.col("c") * F.col("c")) / F.col("n")).alias("resultant"), "n")


def nearest_rank(df: DataFrame, key: str, value: str, p: float) -> DataFrame:
    """(key, value): the ceil(p * n)-th smallest, by rank instead of a gathered list."""
    by = Window.partitionBy(key)
    d = df.where(F.col(value).isNotNull()).select(key, value, F.row_number().over(by.orderBy(value)).alias("_rn"), F.count("*").over(by).alias("_n"))
    return d.where(F.col("_rn") == F.greatest(F.lit(1), F.ceil(F.col("_n") * F.lit(p).cast("decimal(10,4)")))).select(key, value)


def percentiles(df: DataFrame, key: str, value: str, shares: Sequence[float], near: float = 0.001) -> DataFrame:
    """(key, p0, p1, ...): exact percentiles with linear interpolation (as `percentile`) of the values that are not null, for few large groups.

    No task holds a group. A sketch of each group gives cuts just below and above each percentile, rows are counted between them, and only the
    parts in which the wanted ranks lie are put in order. The cuts decide the work, never the result; a cut's own value is a part by itself, so ties
    do not widen a part. The cuts are written, as a sketch made again may differ; they and the parts are a few rows a group.
    """
    d = df.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).cast("double").alias("v"))
    around = sorted({min(1.0, max(0.0, p + e)) for p in shares for e in (-near, near)})
    cuts = written(d.groupBy(F.col("k").alias("of")).agg(F.percentile_approx("v", around, 10_000).alias("cuts")), "cuts")
    part = reduce(lambda a, b: a + b, ((F.col("v") >= F.col("cuts")[i]).cast("int") + (F.col("v") > F.col("cuts")[i]).cast("int") for i in range(len(around))))
    d = d.join(F.broadcast(cuts), F.col("k").eqNullSafe(F.col("of"))).select("k", part.alias("part"), "v")
    sizes, group = d.groupBy("k", "part").agg(F.count("*").alias("n")), Window.partitionBy("k")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col("k").alias("of"), F.col("part").alias("in"), "n", before(group.orderBy("part")).alias("start"), F.sum("n").over(group).alias("all"))
    place = [F.lit(float(p)) * (F.col("all") - 1) for p in shares]
    ranks = F.array(*(F.struct(F.lit(i).alias("i"), x.alias("place"), r.alias("rank")) for i, x in enumerate(place) for r in (F.floor(x), F.ceil(x))))
    wanted = written(sizes.select("*", F.inline(F.array_distinct(ranks))).where("rank >= start and rank < start + n").drop("n", "all"), "wanted")
    d = d.join(F.broadcast(wanted.select("of", "in", "start").distinct()), F.col("k").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in"))).groupBy("k", "part", "start", "v").agg(F.count("*").alias("n"))
    d = d.select("k", "part", "v", "n", (F.col("start") + before(Window.partitionBy("k", "part").orderBy("v"))).alias("first"))
    d = d.join(F.broadcast(wanted), F.col("k").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n")))
    share = 1 - F.abs(F.col("place") - F.col("rank"))
    ends = d.groupBy("k", "i").agg(F.when(F.min("v") == F.max("v"), F.min("v")).otherwise(F.sum(share * F.col("v"))).alias("x"))
    return ends.groupBy(F.col("k").alias(key)).agg(*(F.max(F.when(F.col("i") == i, F.col("x"))).alias(f"p{i}") for i in range(len(shares))))


def merge_intervals(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, start, end): half-open intervals merged where they overlap or touch."""
    by = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    d = df.select(key, start, end).withColumn("_new", F.coalesce((F.col(start) > reach).cast("int"), F.lit(1)))
    d = d.withColumn("_island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def interval_gaps(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, start, end) of the holes between a key's merged intervals."""
    m = merge_intervals(df, key, start, end)
    nxt = F.lead(start).over(Window.partitionBy(key).orderBy(start))
    return m.select(key, F.col(end).alias(start), nxt.alias(end)).where(F.col(end).isNotNull())


def outermost(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """The intervals that lie in no other one of their key; of equal ones all but the first go."""
    by = Window.partitionBy(key).orderBy(F.col(start), F.desc(end)).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_reach", F.max(end).over(by)).where(F.col("_reach").isNull() | (F.col("_reach") < F.col(end))).drop("_reach")


def wilson(successes: Column, total: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson interval; null for no trials."""
    n = F.when(total > 0, total.cast("double"))
    p = successes / n
    centre, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.greatest(F.lit(0.0), (centre - spread) / (1 + z * z / n)), F.least(F.lit(1.0), (centre + spread) / (1 + z * z / n))


def confusion(df: DataFrame, truth: Column, guess: Column, key: str) -> DataFrame:
    """(key, tp, fp, fn, tn, precision, recall, f1); a ratio without a base is null."""
    d = df.groupBy(key).agg(F.count_if(truth & guess).alias("tp"), F.count_if(~truth & guess).alias("fp"), F.count_if(truth & ~guess).alias("fn"), F.count_if(~truth & ~guess).alias("tn"))
    d = d.withColumn("precision", F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")))
    return d.withColumn("f1", F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def cohen_kappa(df: DataFrame, a: Column, b: Column, key: str) -> DataFrame:
    """(key, n, kappa) of two yes/no annotators; 1 when chance alone would always agree."""
    d = df.groupBy(key).agg(F.count("*").alias("n"), F.count_if(a == b).alias("same"), F.count_if(a).alias("pa"), F.count_if(b).alias("pb"))
    n = F.col("n").cast("double")
    chance = (F.col("pa") * F.col("pb") + (n - F.col("pa")) * (n - F.col("pb"))) / (n * n)
    return d.select(key, "n", F.when(chance >= 1, 1.0).otherwise((F.col("same") / n - chance) / (1 - chance)).alias("kappa"))


def reliability(df: DataFrame, p: Column, y: Column, bins: int = 10) -> DataFrame:
    """(bin, n, mean_p, rate, brier_sum): probabilities in equal bins, 1.0 in the last one."""
    b = F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")
    return df.select(b.alias("bin"), p.alias("p"), y.cast("double").alias("y")).groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("rate"), F.sum((F.col("p") - F.col("y")) ** 2).alias("brier_sum"))


def calibration_errors(table: DataFrame) -> DataFrame:
    """(n, brier, ece) over a reliability table."""
    return table.agg(F.sum("n").alias("n"), (F.sum("brier_sum") / F.sum("n")).alias("brier"), (F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"))


def affine_fit(df: DataFrame, x: Column, y: Column, key: str) -> DataFrame:
    """(key, n, slope, intercept, rmse) of the least-squares line; null where x does not vary."""
    d = df.groupBy(key).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"))
    left = F.greatest(F.lit(0.0), F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx")))
    return d.select(key, "n", "slope", "intercept", F.sqrt(left / F.col("n")).alias("rmse"))
