"""Equal shapes are worked once, and every row still gets its result."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tests.conftest import SMALL
from zonaris.functions import geometry as G
from zonaris.operators import classes as C
from zonaris.operators import polygons as P
from zonaris.operators import spatial as S
from zonaris.plans import catalog, polygons, relational, textual  # noqa: F401  (they add to the catalogue)


def squares(spark, n, places=1, side=10.0):
    """`n` squares (k) in `places` places 1 m apart."""
    x = (F.col("id") % places).cast("double")
    return P.boxed(spark.range(n).select(F.col("id").alias("k"), G.box_shape(x, F.lit(0.0), x + side, F.lit(side)).alias("shape")))


def test_each_keeps_every_row_and_nulls(spark):
    d = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "k int, v string")
    seen = []
    got = C.each(d, ["v"], lambda v: seen.append(v.count()) or v.withColumn("n", F.coalesce(F.length("v"), F.lit(0)))).collect()
    assert seen == [3] and sorted((r["k"], r["v"] or "", r["n"]) for r in got) == [(1, "a", 1), (2, "a", 1), (3, "", 0), (4, "", 0), (5, "b", 1)]


def test_pairs_of_equal_shapes_are_refined_once(spark):
    a, seen = squares(spark, 40, 2), []
    got = P.pairs(a, a, 50.0, lambda p: seen.append(p.count()) or P.met(p))
    assert seen == [4] and got.count() == 1600
    assert {(r["l_k"] % 2 == r["r_k"] % 2, r["area"]) for r in got.select("l_k", "r_k", "area").collect()} == {(True, 100.0), (False, 90.0)}
    assert P.self_overlaps(a, "k", 50.0, 0.1).count() == 780


def test_masks_hold_one_zone_of_equal_shape(spark):
    z = squares(spark, 30, 2).withColumnRenamed("k", "z")
    got = {(r["k"], r["z"]): r["area"] for r in P.masked_areas(squares(spark, 3), z, "k", "z", -F.col("z"), 50.0).collect()}
    assert got == {(k, z): a for k in range(3) for z, a in ((29, 90.0), (28, 10.0))}
    assert P.twice(z).count() == 4
    assert {(r["covered"], r["overlap"]) for r in P.coverage(squares(spark, 3), z, "k", 50.0).collect()} == {(100.0, 100.0)}


def test_nearest_of_many_in_one_place(spark):
    near = P.nearest_k(squares(spark, 4), squares(spark, 30, 2).withColumnRenamed("k", "b"), "k", "b", 3, 5.0, 50.0)
    assert sorted((r["l_k"], r["r_b"], r["rank"]) for r in near.collect()) == [(k, b, b + 1) for k in range(4) for b in range(3)]
    points = spark.range(20).select(F.col("id").alias("p"), F.lit(12.0).alias("x"), F.lit(5.0).alias("y"))
    got = S.nearest_k(squares(spark, 4), points, "k", "p", 2, 5.0, 50.0).collect()
    assert sorted((r["l_k"], r["r_p"], r["distance"]) for r in got) == [(k, p, 2.0) for k in range(4) for p in range(2)]
    got = S.nearest_expanding(squares(spark, 4), points, "k", "p", (1, 3), 50.0).collect()
    assert sorted((r["k"], r["nearest"], r["radius"]) for r in got) == [(k, 0, 3.0) for k in range(4)]


def test_equal_boxes_are_chained(spark):
    d = spark.createDataFrame([(5, 0, 0, 2, 2), (6, 0, 0, 2, 2), (7, 1, 1, 3, 3), (8, 90, 90, 91, 91), (2, 50, 50, 51, 51), (3, 50, 50, 51, 51), (9, 70, 70, 70, 71), (10, 70, 70, 70, 71)], "k int, x0 int, y0 int, x1 int, y1 int")
    assert sorted(tuple(r) for r in relational.chained(d, "k").collect()) == [(2, 2), (3, 2), (5, 5), (6, 5), (7, 5)]


def test_channels_lay_out_no_pairs(spark):
    plan = catalog.QUERIES["two_channel_match"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_event_that_comes_again_is_one_row(spark, tmp_path):
    for t in os.listdir(SMALL):
        if t != "events.parquet":
            os.symlink(f"{SMALL}/{t}", tmp_path / t)
    e = spark.read.parquet(f"{SMALL}/events.parquet")
    e.unionByName(e.limit(7)).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = catalog.QUERIES["point_coverage"](spark, str(tmp_path))
    assert got.count() == e.count() == got.select("event_id").distinct().count()


def test_a_frequent_word_is_dealt_to_many_tasks(spark):
    from zonaris.operators import search

    q = spark.createDataFrame([(1, "long street")], "q int, query string")
    labels = spark.range(200).select(F.col("id").alias("k"), F.lit("long street").alias("label"), F.lit("city").alias("kind"))
    got = search.search(q, "q", labels, "k", 5, "kind", F.lit(0.0), F.lit(True))
    assert [r["k"] for r in got.orderBy("rank").collect()] == [0, 1, 2, 3, 4]
    assert "salt" in got._jdf.queryExecution().optimizedPlan().toString()


def test_equal_quotes_are_looked_up_once(spark, tmp_path):
    p = spark.read.parquet(f"{SMALL}/part.parquet").limit(1)
    p.drop("p_partkey").crossJoin(spark.range(6, 66, 6).withColumnRenamed("id", "p_partkey")).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    d = catalog.QUERIES["quote_places"](spark, str(tmp_path))
    assert d.count() == 10 and C.SAME in d._jdf.queryExecution().analyzed().toString()


def test_rows_of_equal_parcels_come_in_runs(spark, tmp_path):
    for t in os.listdir(SMALL):
        if t != "customer.parquet":
            os.symlink(f"{SMALL}/{t}", tmp_path / t)
    key = 17 + 20 * (F.col("id") % 50) + 1000 * F.expr("id div 50")
    c = spark.range(150).select(key.alias("c_custkey"), F.lit(1).alias("c_nationkey"))
    c.coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, other in (("zone_overlay_shares", "p_partkey"), ("slivers", "p_partkey"), ("polygon_points", "o_orderkey")):
            rows = [(r["c_custkey"] % 1000 if other == "p_partkey" else 0, r[other], r["c_custkey"]) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()]
            runs = sum(a[:2] != b[:2] for a, b in zip(rows, [(None, None), *rows]))
            assert len(rows) == len(set(rows)) >= 3 * runs > 0 and runs == len({r[:2] for r in rows}), name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
