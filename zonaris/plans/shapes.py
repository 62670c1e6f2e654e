"""Queries of repair, coverages simplified along shared borders, and vector tiles of areas and lines. They join `catalog.QUERIES`."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonaris.functions import geometry as G
from zonaris.functions import planar as L
from zonaris.functions import tiles as V
from zonaris.operators import arcs as A
from zonaris.operators import classes as C
from zonaris.operators import polygons as P
from zonaris.operators import tiles as T
from zonaris.plans.catalog import CELL, ORACLE_SQL, QUERIES, query, table
from zonaris.plans.polygons import NEAR, PART, SQUARE, buildings, parcels

_flat = lambda *v: F.array(*(x.cast("double") for x in v))


@query(f"""with {SQUARE} select c_custkey, case c_custkey%3 when 1 then s*s/2.0 else cast(s*s as double) end as area, c_custkey%3<>0 as was_repaired, case c_custkey%3 when 0 then 1 else 2 end as rings, true as stable from square""")
def repaired_polygons(spark, sf_dir):
    """G1: squares (doubled points, clockwise), bow-ties and overlapping rings made valid; area, whether that was a repair, and a hash that the start does not change."""
    p = parcels(spark, sf_dir).select("c_custkey", "x0", "y0", (F.col("x1") - F.col("x0")).alias("s"))
    x, y, s = F.col("x0"), F.col("y0"), F.col("s")
    square = F.array(_flat(x, y, x, y + s, x, y + s, x + s, y + s, x + s, y, x, y))
    bow = F.array(_flat(x, y, x + s, y + s, x + s, y, x, y + s))
    two = F.array(_flat(x, y, x + s, y, x + s, y + s, x, y + s), _flat(x + s / 2, y, x + s * 1.5, y, x + s * 1.5, y + s, x + s / 2, y + s))
    raw = F.when(F.col("c_custkey") % 3 == 0, square).when(F.col("c_custkey") % 3 == 1, bow).otherwise(two)
    turned = F.transform("raw", lambda r: F.concat(F.slice(r, 3, F.size(r) - 2), F.slice(r, 1, 2)))  # from the second point on
    fixed = lambda v: v.select(C.SAME, L.repaired("raw").alias("r"), L.repaired(turned).alias("t"))
    return C.each(p.select("c_custkey", raw.alias("raw")), ["raw"], lambda v: _judged(fixed(v))).select("c_custkey", "area", "was_repaired", "rings", "stable")


def _judged(d: DataFrame) -> DataFrame:
    key = lambda c: F.sha2(F.to_json(f"{c}.shape"), 256)
    return d.select(C.SAME, F.round("r.area", 6).alias("area"), "r.was_repaired", F.size("r.shape").alias("rings"), (key("r") == key("t")).alias("stable"))


def cells(spark, sf_dir) -> DataFrame:
    """A cell of a coverage for each supplier: 50 m, the middle of each side that has a neighbour moved by a function of the side, which both share."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    s = s.select("s_suppkey", (k % 20).alias("i"), F.expr("s_suppkey div 20 % 20").alias("j")).crossJoin(s.agg(F.max("s_suppkey").alias("most")))  # one row
    i, j = F.col("i"), F.col("j")
    x, y, number = i * 50, j * 50, lambda a, b: a + b * 20
    there = lambda a, b: a.between(0, 19) & b.between(0, 19) & ((F.col("most") >= 400) | number(a, b).between(1, F.col("most")))
    up = lambda a, b: F.when(there(a, b) & there(a - 1, b), ((a * 7 + b * 3) % 5 - 2) * 0.4).otherwise(0.0)
    flat = lambda a, b: F.when(there(a, b) & there(a, b - 1), ((a * 3 + b * 11) % 5 - 2) * 0.4).otherwise(0.0)
    ring = _flat(x, y, x + 25, y + flat(i, j), x + 50, y, x + 50 + up(i + 1, j), y + 25, x + 50, y + 50, x + 25, y + 50 + flat(i, j + 1), x, y + 50, x + up(i, j), y + 25)
    return s.select("s_suppkey", F.array(ring).alias("shape"))


def _there(i, j):
    return f"(({i}) between 0 and 19 and ({j}) between 0 and 19 and (most>=400 or ({i})+({j})*20 between 1 and most))"


def _kept(i, j, across, down, up):
    """A side's shift where both cells are there and the tolerance leaves it."""
    side = f"((({i})*{across}+({j})*{down})%5-2)*0.4"
    return f"case when abs({side})>tol and {_there(i, j)} and {_there(f'({i})-1' if up else i, j if up else f'({j})-1')} then {side} else 0 end"


@query(f"""with c as (select s_suppkey, s_suppkey%20 as i, s_suppkey//20%20 as j, max(s_suppkey) over () as most from supplier), t as (select * from (values (0,0.0),(1,0.5),(2,1.0)) v(level, tol))
select s_suppkey, level, round(cast(2500-25*({_kept("i", "j", 7, 3, True)})+25*({_kept("i+1", "j", 7, 3, True)})-25*({_kept("i", "j", 3, 11, False)})+25*({_kept("i", "j+1", 3, 11, False)}) as double),6) as area from c, t""")
def coverage_resolutions(spark, sf_dir):
    """Neighbouring cells at three tolerances; each side is simplified once for both, so what one gains the other loses."""
    d = A.simplified_shapes(cells(spark, sf_dir), "s_suppkey", [0.0, 0.5, 1.0], CELL)
    return d.select("s_suppkey", "level", F.round(G.measure("shape")["area"], 6).alias("area"))


_tile_area = G.shape_function(lambda c: float(sum(G.ring_area(p.astype(float)) for p in V.decoded(c)[0])), "double", pa.float64())
_tile_length = G.shape_function(lambda c: float(sum(np.hypot(*np.diff(p, axis=0).T).sum() for p in V.decoded(c)[0])), "double", pa.float64())
#: zoom 3 of a world of 1024 m: tiles of 128 m, 32 units a metre, a margin of 2 m
_TILE = "t as (select x as tx, y as ty, x*128-2 as a0, x*128+130 as a1, 1024-y*128-130 as b0, 1024-y*128+2 as b1 from range(0,8) q(x), range(0,8) r(y))"


@query(f"""with {PART}, {_TILE}, cut as (select c_custkey, tx, ty, sum(greatest(least(x1,a1)-greatest(x0,a0),0)*greatest(least(y1,b1)-greatest(y0,b0),0)) as m from part_of join t on x0<a1 and x1>a0 and y0<b1 and y1>b0 group by all)
select tx, ty, count(*) as n, round(cast(sum(m)*1024 as double),6) as units from cut where m>0 group by all""")
def area_tiles(spark, sf_dir):
    """Parcels clipped to the tiles of a zoom with a margin, in tile units; areas of what the commands decode to."""
    p = parcels(spark, sf_dir).groupBy(*P.SHAPED).agg(F.count("*").alias("n")).withColumn("kind", F.lit("area"))  # equal shapes give equal commands
    d = T.on_tiles(C.wide(p, "shape"), (0.0, 1024.0), 1024.0, {3: 0.0})
    return d.withColumn("a", _tile_area("commands")).groupBy("tx", "ty").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("a") * F.col("n")), 6).alias("units"))


@query("""with l as (select s_suppkey, (s_suppkey*53)%1000 as x0, (s_suppkey*53)%1000+20 as x1, (s_suppkey*29)%1000 as y from supplier), t as (select x as tx, y as ty, x*128-2 as a0, x*128+130 as a1, 1024-y*128-130 as b0, 1024-y*128+2 as b1 from range(0,8) q(x), range(0,8) r(y))
select tx, ty, least(count(*),3) as n, greatest(count(*)-3,0) as left_out from l join t on least(x1,a1)>greatest(x0,a0) and y>b0 and y<=b1 group by all""")
def line_tiles(spark, sf_dir):
    """Lines on tiles, at most three a tile; the layers are encoded."""
    k = F.col("s_suppkey")
    x, y = k * 53 % 1000, k * 29 % 1000
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.lit("line").alias("kind"), F.lit("road").alias("layer"), F.array(_flat(x, y, x + 10, y, x + 20, y)).alias("shape"), x.alias("x0"), y.alias("y0"), (x + 20).alias("x1"), y.alias("y1"))
    d = T.tile_table(T.on_tiles(s, (0.0, 1024.0), 1024.0, {3: 0.0}), "layer", "s_suppkey", F.lit(0), ["layer"], most=3)
    return d.where(F.octet_length("tile") > 0).select("tx", "ty", "n", "left_out")


@query(f"with {NEAR} select c_custkey, s_suppkey, round(distance,6) as length, distance>0 as apart from gap where distance<=30")
def shortest_lines(spark, sf_dir):
    """The shortest line between each parcel and the buildings within 30 m; none where they meet."""
    length = F.coalesce(G.line_length(F.col("line")), F.lit(0.0))
    drawn = lambda p: p.withColumn("line", G.shortest_line("l_shape", "r_shape")).withColumns({"length": F.round(length, 6), "apart": F.col("line").isNotNull()}).drop("line")
    d = P.within(parcels(spark, sf_dir), buildings(spark, sf_dir), 30.0, CELL, drawn)
    return d.select(F.col("l_c_custkey").alias("c_custkey"), F.col("r_s_suppkey").alias("s_suppkey"), "length", "apart")


@query(f"""with r as ({ORACLE_SQL["centroid_against_overlay"]}), k as (select *, case when overlay_zone is null and centroid_zone is null then 'no_zone' when centroid_zone is null then 'missed' when centroid_zone=overlay_zone then 'same' else 'differs' end as kind from r)
select kind, count(*) as n, round(count(*)*1.0/(select count(*) from k),8) as rate, round(sum(omitted_zones)*1.0/count(*),8) as omitted_zones, round(avg(omitted_area),6) as omitted_area, round(count(*) filter (where omitted_area>0.1)*1.0/count(*),8) as wrong from k group by 1""")
def centroid_error_rates(spark, sf_dir):
    """How often, by case, the zone of the centroid is that of the overlay, and what it omits."""
    d = QUERIES["centroid_against_overlay"](spark, sf_dir)
    a, b = F.col("centroid_zone"), F.col("overlay_zone")
    kind = F.when(a.isNull() & b.isNull(), "no_zone").when(a.isNull(), "missed").when(a == b, "same").otherwise("differs")
    g = d.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.round(F.avg("omitted_zones"), 8).alias("omitted_zones"), F.round(F.avg("omitted_area"), 6).alias("omitted_area"), F.round(F.count_if(F.col("omitted_area") > 0.1) / F.count("*"), 8).alias("wrong"))
    whole = d.agg(F.count("*").alias("whole"))  # one row
    return g.crossJoin(whole).select("kind", "n", F.round(F.col("n") / F.col("whole"), 8).alias("rate"), "omitted_zones", "omitted_area", "wrong")


@query(f"""with r as ({ORACLE_SQL["polygon_range_statistics"]}) select c_custkey, n, case when n=0 then 'no_buildings' when nearest=0 then 'built_on' when n<3 then 'sparse' else 'context' end as outcome, case when n>=3 then round(total*1.0/n,6) end as typical from r""")
def building_outcomes(spark, sf_dir):
    """What the buildings around a parcel allow to say: none, one on it, too few, or a typical size."""
    d = QUERIES["polygon_range_statistics"](spark, sf_dir)
    outcome = F.when(F.col("n") == 0, "no_buildings").when(F.col("nearest") == 0, "built_on").when(F.col("n") < 3, "sparse").otherwise("context")
    return d.select("c_custkey", "n", outcome.alias("outcome"), F.when(F.col("n") >= 3, F.round(F.col("total") / F.col("n"), 6)).alias("typical"))


@query(f"""with r as ({ORACLE_SQL["proximity_overlay"]}), c as (select c_custkey, severity, count(*) as n, min(distance) as nearest from r group by 1,2)
select c_custkey, case when bool_or(severity='high') then 'high' when bool_or(severity='medium') then 'medium' when bool_or(severity='low') then 'low' else 'info' end as status, round(min(nearest),6) as nearest, string_agg(severity||':'||n, ' ' order by severity) as classes from c group by 1""")
def risk_sections(spark, sf_dir):
    """Of each parcel the worst severity of what lies on or near it, the nearest, and the list of classes with their counts."""
    d = QUERIES["proximity_overlay"](spark, sf_dir).groupBy("c_custkey", "severity").agg(F.count("*").alias("n"), F.min("distance").alias("nearest"))
    rank = F.array_position(F.array(*(F.lit(x) for x in ("high", "medium", "low", "info"))), F.col("severity"))
    g = d.groupBy("c_custkey").agg(F.min_by("severity", rank).alias("status"), F.round(F.min("nearest"), 6).alias("nearest"), F.sort_array(F.collect_list(F.concat_ws(":", "severity", F.col("n").cast("string")))).alias("c"))  # at most four classes
    return g.select("c_custkey", "status", "nearest", F.concat_ws(" ", "c").alias("classes"))
