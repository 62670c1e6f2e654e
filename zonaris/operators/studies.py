"""Evaluation studies: exact tests, bootstrap, calibration, fits, agreement, gates; and sampling of grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonaris.functions.legal import arrow


def _fisher(a, b, c, d):
    from math import exp, lgamma

    if None in (a, b, c, d):
        return None
    ln = lambda n: lgamma(n + 1)
    r, s, k, n = a + b, c + d, a + c, a + b + c + d
    base = ln(r) + ln(s) + ln(k) + ln(n - k) - ln(n)
    return min(1.0, sum(exp(base - ln(x) - ln(r - x) - ln(k - x) - ln(s - k + x)) for x in range(a, min(r, k) + 1)))


def fisher_upper(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Upper-tail p value of Fisher's exact test of a 2 x 2 table of counts."""
    import pyarrow as pa

    return arrow(_fisher, "double", pa.float64())(*(x.cast("bigint") for x in (a, b, c, d)))


#: Cumulative probabilities of a Poisson variable of mean 1.
_POISSON = np.cumsum([np.exp(-1) / float(np.prod(np.arange(1, k + 1))) for k in range(12)]).tolist()


def cluster_bootstrap(rows: DataFrame, cluster: str, base: Column, candidate: Column, rounds: int, seed: int) -> DataFrame:
    """(n_clusters, difference, low, high): mean candidate minus mean base, with the 2.5 and 97.5 percentiles over seeded rounds.

    Each round weighs every cluster by a Poisson number of mean 1 drawn from a hash of seed, round and cluster, which is a bootstrap without
    an index of clusters: one pass, and a result that does not depend on partitions. Rounds are summed before they meet.
    """
    per = rows.groupBy(cluster).agg(F.sum(base).alias("b"), F.sum(candidate).alias("c"), F.count("*").alias("n"))
    drawn = per.select("*", F.explode(F.sequence(F.lit(0), F.lit(rounds))).alias("round"))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "round", F.col(cluster).cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    w = sum(((u >= p).cast("int") for p in _POISSON[1:]), (u >= _POISSON[0]).cast("int"))
    w = F.when(F.col("round") == 0, 1).otherwise(w)  # round 0 is the sample itself
    each = drawn.withColumn("w", w).groupBy("round").agg(*(F.sum(F.col(x) * F.col("w")).alias(x) for x in ("b", "c", "n")), F.count("*").alias("clusters"))
    d = each.withColumn("d", F.when(F.col("n") > 0, (F.col("c") - F.col("b")) / F.col("n")))
    of = lambda p: F.percentile(F.when(F.col("round") > 0, F.col("d")), F.lit(p))
    return d.agg(F.max("clusters").alias("n_clusters"), F.max(F.when(F.col("round") == 0, F.col("d"))).alias("difference"), of(0.025).alias("low"), of(0.975).alias("high"))


def isotonic(bins: DataFrame, at: str, value: str, weight: str) -> DataFrame:
    """`bins` with `fit`: the non-decreasing least-squares fit of `value`. The bins are bounded in number.

    Pooling adjacent violators ends where the greatest of all least means lies: for each bin the maximum over starts at or before it of the
    minimum over ends at or after it of the weighted mean between them, so two bounded self joins give it.
    """
    b = bins.select(F.col(at).alias("k"), (F.col(value) * F.col(weight)).alias("s"), F.col(weight).alias("w"))
    up = Window.orderBy("k")
    run = b.select("k", F.sum("s").over(up).alias("s1"), F.sum("w").over(up).alias("w1"), "s", "w")
    start = run.select(F.col("k").alias("i"), (F.col("s1") - F.col("s")).alias("s0"), (F.col("w1") - F.col("w")).alias("w0"))
    end = run.select(F.col("k").alias("j"), "s1", "w1")
    mean = F.broadcast(start).join(F.broadcast(end), F.col("i") <= F.col("j")).select("i", "j", ((F.col("s1") - F.col("s0")) / (F.col("w1") - F.col("w0"))).alias("m"))
    least = mean.withColumn("low", F.min("m").over(Window.partitionBy("i").orderBy(F.desc("j")).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    fit = least.withColumn("fit", F.max("low").over(Window.partitionBy("j").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("i = j").select(F.col("i").alias(at), "fit")
    return bins.join(fit, at)


def threshold_for(bins: DataFrame, at: str, good: str, total: str, precision: float) -> DataFrame:
    """(threshold, precision, coverage): the least score bin from which on the share of good ones is at least `precision`; nulls if none."""
    down = Window.orderBy(F.desc(at))
    d = bins.withColumns({"g": F.sum(good).over(down), "t": F.sum(total).over(down)}).withColumn("all", F.sum(total).over(Window.partitionBy()))
    ok = d.where(F.col("g") / F.col("t") >= precision)
    return ok.agg(F.min_by(F.struct(F.col(at).alias("threshold"), (F.col("g") / F.col("t")).alias("precision"), (F.col("t") / F.col("all")).alias("coverage")), at).alias("r")).select("r.*")


def logistic_fit(rows: DataFrame, features: Sequence[Column], label: Column, prior: Sequence[float], strength: float, signs: Sequence[int], steps: int = 30) -> list[float]:
    """Weights of a logistic model (intercept first) with an L2 pull to `prior` and, where a sign is not 0, weights of that sign.

    Newton steps on sums of gradient and curvature that one aggregation gives; the driver solves a system as large as there are features. A
    weight that a step takes over its bound stays there and the others are solved again. A null feature or label leaves a row out.
    """
    cols = [F.lit(1.0), *features]
    k = len(cols)
    d = rows.select(*(c.cast("double").alias(f"x{i}") for i, c in enumerate(cols)), label.cast("double").alias("y")).dropna()
    target, w = np.array(prior, float), np.array(prior, float)
    bound = np.array(signs)
    for _ in range(steps):
        z = sum((float(w[i]) * F.col(f"x{i}") for i in range(1, k)), F.lit(float(w[0])))
        p = 1 / (1 + F.exp(-z))
        g = [F.sum((F.col("y") - p) * F.col(f"x{i}")) for i in range(k)]
        h = [F.sum(p * (1 - p) * F.col(f"x{i}") * F.col(f"x{j}")) for i in range(k) for j in range(k)]
        got = d.agg(*(x.alias(f"v{n}") for n, x in enumerate([*g, *h]))).first()
        v = np.array([x or 0.0 for x in got])
        grad = v[:k] - strength * (w - target)
        curve = v[k:].reshape(k, k) + strength * np.eye(k)
        free = np.ones(k, bool)
        while True:
            step = np.zeros(k)
            step[free] = np.linalg.solve(curve[np.ix_(free, free)], (grad - curve[:, ~free] @ -w[~free] if (~free).any() else grad)[free])
            step[~free] = -w[~free]
            new = w + step
            over = free & (bound != 0) & (new * bound < 0)
            if not over.any():
                break
            free &= ~over
        moved = float(np.abs(new - w).max())
        w = new
        if moved < 1e-10:
            break
    return w.tolist()


def affine_plane(rows: DataFrame, x: str, y: str, u: str, v: str) -> DataFrame:
    """(n, a, b, c, d, e, f, rmse): u = a x + b y + c and v = d x + e y + f by least squares; null where the points lie on a line."""
    n = F.count("*")
    mean = rows.agg(*(F.avg(k).alias(f"m_{k}") for k in (x, y, u, v)))
    d = rows.crossJoin(F.broadcast(mean)).select(*((F.col(k) - F.col(f"m_{k}")).alias(k) for k in (x, y, u, v)), *(f"m_{k}" for k in (x, y, u, v)))
    s = d.agg(n.alias("n"), *(F.sum(F.col(p) * F.col(q)).alias(f"{p}_{q}") for p, q in ((x, x), (x, y), (y, y), (x, u), (y, u), (x, v), (y, v), (u, u), (v, v))), *(F.first(f"m_{k}").alias(f"m_{k}") for k in (x, y, u, v)))
    col = F.col
    det = col(f"{x}_{x}") * col(f"{y}_{y}") - col(f"{x}_{y}") * col(f"{x}_{y}")
    ok = lambda e: F.when(F.abs(det) > 1e-9, e / det)
    first = lambda k: ok(col(f"{x}_{k}") * col(f"{y}_{y}") - col(f"{y}_{k}") * col(f"{x}_{y}"))
    second = lambda k: ok(col(f"{y}_{k}") * col(f"{x}_{x}") - col(f"{x}_{k}") * col(f"{x}_{y}"))
    s = s.withColumns({"a": first(u), "b": second(u), "d": first(v), "e": second(v)})
    s = s.withColumns({"c": col(f"m_{u}") - col("a") * col(f"m_{x}") - col("b") * col(f"m_{y}"), "f": col(f"m_{v}") - col("d") * col(f"m_{x}") - col("e") * col(f"m_{y}")})
    rest = sum((col(f"{k}_{k}") - col(p) * col(f"{x}_{k}") - col(q) * col(f"{y}_{k}") for k, p, q in ((v, "d", "e"),)), col(f"{u}_{u}") - col("a") * col(f"{x}_{u}") - col("b") * col(f"{y}_{u}"))
    return s.select("n", "a", "b", "c", "d", "e", "f", F.sqrt(F.greatest(rest, F.lit(0.0)) / col("n")).alias("rmse"))


def gate(metrics: DataFrame, name: str, value: str, least: Mapping[str, float], most: Mapping[str, float]) -> DataFrame:
    """(name, value, bound, passed) for each bound of an acceptance gate; a metric that is missing does not pass."""
    spark = metrics.sparkSession
    bounds = spark.createDataFrame([(k, "least", float(v)) for k, v in least.items()] + [(k, "most", float(v)) for k, v in most.items()], "g string, side string, bound double")
    d = bounds.join(metrics, F.col("g") == F.col(name), "left")
    passed = F.when(F.col("side") == "least", F.col(value) >= F.col("bound")).otherwise(F.col(value) <= F.col("bound"))
    return d.select(F.col("g").alias("name"), F.col(value).alias("value"), "side", "bound", F.coalesce(passed, F.lit(False)).alias("passed"))


def subtract_intervals(base: DataFrame, cut: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, start, end): what is left of half-open intervals without others; parts that touch are one. Sweeps over the ends, no pairs."""
    mark = lambda d, up, which: d.select(key, F.inline(F.array(F.struct(F.col(start).alias("at"), F.lit(up).alias("b") if which == "b" else F.lit(0).alias("b"), F.lit(up).alias("c") if which == "c" else F.lit(0).alias("c")), F.struct(F.col(end).alias("at"), F.lit(-up).alias("b") if which == "b" else F.lit(0).alias("b"), F.lit(-up).alias("c") if which == "c" else F.lit(0).alias("c")))))
    ends = mark(base, 1, "b").unionByName(mark(cut, 1, "c")).groupBy(key, "at").agg(F.sum("b").alias("b"), F.sum("c").alias("c"))
    w = Window.partitionBy(key).orderBy("at")
    d = ends.select(key, "at", ((F.sum("b").over(w) > 0) & (F.sum("c").over(w) == 0)).alias("on"))
    d = d.withColumn("before", F.lag("on", 1, False).over(w)).where("on <> before").withColumn("to", F.lead("at").over(w))
    return d.where("on").select(key, F.col("at").alias(start), F.col("to").alias(end))


def previous_within(rows: DataFrame, key: str, at: str, is_noun: Column, gap: int) -> DataFrame:
    """`rows` with `noun_at`: for each other row the place of the nearest noun before it, at most `gap` away, else null."""
    w = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(is_noun, F.col(at)), True).over(w)
    return rows.withColumn("noun_at", F.when(~is_noun & (F.col(at) - last <= gap), last))


def bilinear(points: DataFrame, grid: DataFrame, key: str) -> DataFrame:
    """(key, z) of points (key, x, y) on a grid (i, j, z) with x along j and y along i; null where one of the four cells is missing."""
    i, j = F.floor("y"), F.floor("x")
    corner = [F.struct((i + di).alias("i"), (j + dj).alias("j"), ((1 - F.abs(F.col("y") - i - di)) * (1 - F.abs(F.col("x") - j - dj))).alias("w")) for di in (0, 1) for dj in (0, 1)]
    need = points.select(key, F.inline(F.array(*corner))).where("w > 0")
    d = need.join(grid, ["i", "j"], "left").groupBy(key).agg(F.sum(F.col("w") * F.col("z")).alias("z"), F.count("*").alias("n"), F.count("z").alias("m"))
    return d.select(key, F.when(F.col("n") == F.col("m"), F.col("z")).alias("z"))
