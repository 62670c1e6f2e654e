"""Queries on true polygons: L-shaped parcels, zones with a hole, buildings, acts. They join `catalog.QUERIES`.

The shapes fall into boxes, so SQL gives their areas exactly; general polygons are tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonaris.functions import geometry as G
from zonaris.operators import classes as C
from zonaris.operators import polygons as P
from zonaris.operators import spatial as S
from zonaris.plans.catalog import CELL, query, table
from zonaris.sources.shared import written

_ring = lambda *v: F.array(*(x.cast("double") for x in v))
#: arc area of a quarter circle of radius 1 drawn with 16 straight parts
QUARTER = "(8*sin(pi()/32))"


def parcels(spark, sf_dir) -> DataFrame:
    """A square without its upper right quarter for each customer."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.expr("(c_custkey * 37) % 1000").alias("x"), F.expr("(c_custkey * 91) % 1000").alias("y"), F.expr("5 + c_custkey % 20").alias("s"))
    x, y, s, h = F.col("x"), F.col("y"), F.col("s"), F.col("s") / 2
    return P.boxed(c.select("c_custkey", "c_nationkey", F.array(_ring(x, y, x + s, y, x + s, y + h, x + h, y + h, x + h, y + s, x, y + s)).alias("shape")))


def zones(spark, sf_dir) -> DataFrame:
    """A 50 m square with a 10 m hole for each supplier."""
    z = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.expr("(s_suppkey % 20) * 50").alias("x"), F.expr("(s_suppkey div 20 % 20) * 50").alias("y"))
    x, y = F.col("x"), F.col("y")
    outer, hole = (_ring(x + a, y + a, x + b, y + a, x + b, y + b, x + a, y + b) for a, b in ((0, 50), (20, 30)))
    return P.boxed(z.select("s_suppkey", "s_nationkey", F.array(outer, hole).alias("shape")))


def buildings(spark, sf_dir) -> DataFrame:
    b = table(spark, sf_dir, "supplier").select("s_suppkey", F.expr("(s_suppkey * 53) % 1000").alias("x"), F.expr("(s_suppkey * 29) % 1000").alias("y"), F.expr("2 + s_suppkey % 5").alias("s"))
    return P.boxed(b.select("s_suppkey", (F.col("s") * F.col("s")).alias("area"), G.box_shape(F.col("x"), F.col("y"), F.col("x") + F.col("s"), F.col("y") + F.col("s")).alias("shape")))


SQUARE = "square as (select c_custkey, c_nationkey, (c_custkey*37)%1000 as x, (c_custkey*91)%1000 as y, 5+c_custkey%20 as s from customer)"
PART = f"{SQUARE}, part_of as (select c_custkey, s, x as x0, y as y0, x+s as x1, y+s/2.0 as y1 from square union all select c_custkey, s, x, y+s/2.0, x+s/2.0, y+s from square)"
FRAME = "frame as (select s_suppkey, s_nationkey, (s_suppkey%20)*50 as x, ((s_suppkey//20)%20)*50 as y from supplier)"
BUILDING = "building as (select s_suppkey, (2+s_suppkey%5)*(2+s_suppkey%5) as area, (s_suppkey*53)%1000 as x0, (s_suppkey*29)%1000 as y0, (s_suppkey*53)%1000+2+s_suppkey%5 as x1, (s_suppkey*29)%1000+2+s_suppkey%5 as y1 from supplier)"


def _cut(a0, a1, b0, b1):
    return f"greatest(least({a1},{b1})-greatest({a0},{b0}),0)"


IN_FRAME = f"({_cut('p.x0', 'p.x1', 'f.x', 'f.x+50')}*{_cut('p.y0', 'p.y1', 'f.y', 'f.y+50')}-{_cut('p.x0', 'p.x1', 'f.x+20', 'f.x+30')}*{_cut('p.y0', 'p.y1', 'f.y+20', 'f.y+30')})"
MEET = f"""{PART}, {FRAME}, met as (select c_custkey, s_suppkey, f.x as fx, f.y as fy, max(0.75*s*s) as whole, sum({IN_FRAME}) as a from part_of p join frame f
  on p.x0<=f.x+50 and p.x1>=f.x and p.y0<=f.y+50 and p.y1>=f.y and not (p.x0>f.x+20 and p.x1<f.x+30 and p.y0>f.y+20 and p.y1<f.y+30) group by all)"""
SHARE = f"{MEET}, share as (select *, 100.0*a/whole as share, row_number() over (partition by c_custkey order by a desc, s_suppkey) as rn from met)"


@query(f"""with {SHARE} select c_custkey, s_suppkey, round(cast(a as double),6) as area, round(cast(share as double),6) as share, a<=1e-6 as touches, cast(rn as integer) as rank, rn=1 and a>1e-6 as dominant, share<0.1 as boundary,
share>5 and count(*) filter (where share>5) over (partition by c_custkey)>1 as multi from share""")
def polygon_overlay_shares(spark, sf_dir):
    """Every polygon parcel and zone that meet, with area, share, rank, dominance and the 0.1 % and 5 % thresholds."""
    d = P.overlay_shares(parcels(spark, sf_dir), zones(spark, sf_dir), "c_custkey", "s_suppkey", CELL)
    return d.select(F.col("l_c_custkey").alias("c_custkey"), F.col("r_s_suppkey").alias("s_suppkey"), F.round("area", 6).alias("area"), F.round("share", 6).alias("share"), "touches", "rank", "dominant", "boundary", "multi")


@query(f"""with {MEET}, spot as (select c_custkey, fx, fy, max(whole) as whole, max(a) as a, count(*) as n from met group by all)
select q.c_custkey, round(0.75*s*s,6) as whole, round(coalesce(cast(sum(a) as double),0),6) as covered, round(coalesce(cast(sum(a) filter (where n>1) as double),0),6) as overlap, round(0.75*s*s-coalesce(cast(sum(a) as double),0),6) as gap
from square q left join spot using (c_custkey) group by q.c_custkey, s""")
def polygon_coverage(spark, sf_dir):
    """A5: union, overlap and gap of the zones over each polygon parcel, cell by cell."""
    d = P.coverage(parcels(spark, sf_dir), zones(spark, sf_dir), "c_custkey", CELL)
    return d.select("c_custkey", *(F.round(c, 6).alias(c) for c in ("whole", "covered", "overlap", "gap")))


@query(f"with {MEET} select c_custkey, s_suppkey, round(cast(a as double),6) as area from (select *, row_number() over (partition by c_custkey, fx, fy order by s_suppkey desc) as rn from met where a>1e-6) where rn=1")
def priority_masked_areas(spark, sf_dir):
    """The newest zone keeps its area, older ones lose what newer ones have."""
    d = P.masked_areas(parcels(spark, sf_dir), zones(spark, sf_dir), "c_custkey", "s_suppkey", -F.col("s_suppkey"), CELL)
    return d.select("c_custkey", "s_suppkey", F.round("area", 6).alias("area"))


@query(f"""with {PART} select a.c_custkey as a, b.c_custkey as b, round(cast(sum({_cut('a.x0', 'a.x1', 'b.x0', 'b.x1')}*{_cut('a.y0', 'a.y1', 'b.y0', 'b.y1')}) as double),6) as area from part_of a join part_of b
on a.c_custkey<b.c_custkey and a.x0<b.x1 and b.x0<a.x1 and a.y0<b.y1 and b.y0<a.y1 group by 1,2 having sum({_cut('a.x0', 'a.x1', 'b.x0', 'b.x1')}*{_cut('a.y0', 'a.y1', 'b.y0', 'b.y1')})>0.01""")
def polygon_overlaps(spark, sf_dir):
    """Polygon parcels that share more than 0.01 square metres."""
    return P.self_overlaps(parcels(spark, sf_dir), "c_custkey", CELL, 0.01).withColumn("area", F.round("area", 6))


GAP = "sqrt(cast(pow(greatest(p.x0-b.x1,0,b.x0-p.x1),2)+pow(greatest(p.y0-b.y1,0,b.y0-p.y1),2) as double))"
NEAR = f"{PART}, {BUILDING}, gap as (select c_custkey, s_suppkey, max(area) as area, min({GAP}) as distance from part_of p join building b on p.x0-60<=b.x1 and p.x1+60>=b.x0 and p.y0-60<=b.y1 and p.y1+60>=b.y0 group by 1,2)"


@query(f"with {NEAR} select c_custkey, s_suppkey, round(distance,6) as distance, cast(rn as integer) as rank from (select *, row_number() over (partition by c_custkey order by cast(round(distance*1000) as bigint), case when distance=0 then 0 else 1 end, s_suppkey) as rn from gap where distance<=60) where rn<=3")
def polygon_nearest_k(spark, sf_dir):
    """The three nearest buildings within 60 m of a polygon, by millimetre, relation and key."""
    d = P.nearest_k(parcels(spark, sf_dir), buildings(spark, sf_dir), "c_custkey", "s_suppkey", 3, 60.0, CELL)
    return d.select(F.col("l_c_custkey").alias("c_custkey"), F.col("r_s_suppkey").alias("s_suppkey"), F.round("distance", 6).alias("distance"), "rank")


@query(f"with {NEAR} select q.c_custkey, count(s_suppkey) as n, sum(area) as total, min(area) as least, round(min(distance),6) as nearest from square q left join (select * from gap where distance<=40) g using (c_custkey) group by 1")
def polygon_range_statistics(spark, sf_dir):
    """Buildings within 40 m of each polygon: count, area, smallest, nearest."""
    d = P.range_statistics(parcels(spark, sf_dir), buildings(spark, sf_dir), "c_custkey", "area", 40.0, CELL)
    return d.withColumn("nearest", F.round("nearest", 6))


@query(f"with {PART} select c_custkey, o_orderkey from part_of p join (select o_orderkey, (o_orderkey*53)%1000+0.25 as x, (o_orderkey*29)%1000+0.25 as y from orders) o on o.x>p.x0 and o.x<p.x1 and o.y>p.y0 and o.y<p.y1")
def polygon_points(spark, sf_dir):
    """Points inside polygons, by ray casting."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.expr("(o_orderkey * 53) % 1000") + 0.25).alias("x"), (F.expr("(o_orderkey * 29) % 1000") + 0.25).alias("y"))
    return P.points_in(parcels(spark, sf_dir), o, CELL).select(F.col("l_c_custkey").alias("c_custkey"), F.col("r_o_orderkey").alias("o_orderkey"))


@query(f"""with {MEET}, mid as (select c_custkey, x+s*5/12.0 as cx, y+s*5/12.0 as cy from square)
select c_custkey, s_suppkey, round(cast(a as double),6) as area from (select m.*, row_number() over (partition by c_custkey order by round(a,6) desc, s_suppkey) as rn from met m join mid using (c_custkey)
 where cx>fx and cx<fx+50 and cy>fy and cy<fy+50 and not (cx>fx+20 and cx<fx+30 and cy>fy+20 and cy<fy+30)) where rn=1""")
def best_release(spark, sf_dir):
    """The zone that holds the parcel's centroid and shares the most with it."""
    return P.best_release(zones(spark, sf_dir), parcels(spark, sf_dir), "c_custkey", "s_suppkey", CELL).withColumn("area", F.round("area", 6))


@query(f"""with {SQUARE}, {FRAME} select c_custkey, s_suppkey from square p join frame f on p.x>=f.x and p.x+s<=f.x+50 and p.y>=f.y and p.y+s<=f.y+50
where not (p.x<f.x+30 and p.x+s>f.x+20 and p.y<f.y+30 and p.y+s/2.0>f.y+20) and not (p.x<f.x+30 and p.x+s/2.0>f.x+20 and p.y+s/2.0<f.y+30 and p.y+s>f.y+20)""")
def polygon_covers(spark, sf_dir):
    """Zones that hold a whole parcel."""
    return P.covering(zones(spark, sf_dir), parcels(spark, sf_dir), CELL).select(F.col("r_c_custkey").alias("c_custkey"), F.col("l_s_suppkey").alias("s_suppkey"))


@query(f"with {SQUARE} select c_custkey, round(0.75*s*s,6) as area, cast(4*s as double) as perimeter, round(x+s*5/12.0,6) as x, round(y+s*5/12.0,6) as y, round(0.75*s*s/100,8) as ares, round(0.75*s*s/10000,8) as hectares from square")
def polygon_measures(spark, sf_dir):
    """Area, perimeter, centroid, ares and hectares."""
    d = parcels(spark, sf_dir).select("c_custkey", G.measure("shape").alias("m"))
    return d.select("c_custkey", F.round("m.area", 6).alias("area"), "m.perimeter", F.round("m.x", 6).alias("x"), F.round("m.y", 6).alias("y"), F.round(F.col("m.area") / 100, 8).alias("ares"), F.round(F.col("m.area") / 10000, 8).alias("hectares"))


@query(f"with {SQUARE} select c_custkey, round(pow(s-2,2)-pow(s/2.0,2)+1-{QUARTER},6) as inner_area from square where s>5")
def setback(spark, sf_dir):
    """Parcels narrowed by 1 m; the inner corner of the L is rounded."""
    inner = lambda v: v.withColumn("inner", G.widened("shape", F.lit(-1.0))).select(C.SAME, F.round(G.measure("inner")["area"], 6).alias("inner_area"))
    return C.each(parcels(spark, sf_dir).where("x1 - x0 > 5"), ["shape"], inner).select("c_custkey", "inner_area")


@query(f"select s_suppkey, round(area+4*sqrt(area)*8+4*{QUARTER}*64,6) as wide_area, round(4*sqrt(area)*8+4*{QUARTER}*64,6) as ring_area from (select s_suppkey, pow(2+s_suppkey%5,2) as area from supplier)")
def buffer_ring(spark, sf_dir):
    """Buildings widened by 8 m with 16 parts a quarter circle, and the ring around them."""
    d = C.each(buildings(spark, sf_dir), ["shape"], lambda v: _ring_areas(v.select(C.SAME, "shape", G.widened("shape", F.lit(8.0)).alias("wide"))))
    return d.select("s_suppkey", "wide_area", "ring_area")


def _ring_areas(d: DataFrame) -> DataFrame:
    return d.select(C.SAME, F.round(G.measure("wide")["area"], 6).alias("wide_area"), F.round(G.measure(G.left_over("wide", "shape"))["area"], 6).alias("ring_area"))


@query(f"with {SHARE} select c_custkey, s_suppkey, round(cast(a as double),6) as shared, round(cast(whole-a as double),6) as left_over, round(cast(whole+2400-a as double),6) as united from share where a>1e-6")
def polygon_operations(spark, sf_dir):
    """Intersection, difference and union as shapes, measured."""
    area = lambda f: F.round(G.measure(f("l_shape", "r_shape"))["area"], 6)
    made = lambda p: P.met(p).where("not touches").withColumns({"shared": area(G.shared_shape), "left_over": area(G.left_over), "united": area(G.united)})
    d = P.pairs(parcels(spark, sf_dir), zones(spark, sf_dir), CELL, made)
    return d.select(F.col("l_c_custkey").alias("c_custkey"), F.col("r_s_suppkey").alias("s_suppkey"), "shared", "left_over", "united")


@query(f"with {SQUARE} select c_custkey, true as equal_hash, c_custkey%2=1 as was_repaired, 6 as points from square")
def canonical_shapes(spark, sf_dir):
    """Turned and doubled points give the same canonical form and hash; points on a line are left out."""
    d = parcels(spark, sf_dir)
    ring = F.col("shape")[0]
    turned = F.array(F.concat(F.slice(ring, 5, 8), F.slice(ring, 1, 4), F.slice(ring, 3, 2)))  # from another corner, last point twice
    raw = F.when(F.col("c_custkey") % 2 == 1, turned).otherwise(F.col("shape"))
    return C.each(d.select("c_custkey", "shape", raw.alias("raw")), ["shape", "raw"], _canonical).select("c_custkey", "equal_hash", "was_repaired", "points")


def _canonical(d: DataFrame) -> DataFrame:
    text = lambda c: F.sha2(F.to_json(c), 256)
    d = d.select(C.SAME, "shape", "raw", G.canonical("raw").alias("fixed"), G.canonical("shape").alias("same"))
    dense = F.array(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.array(*(v for v in _with_middle("fixed", i))))))
    return d.select(C.SAME, (text(F.col("fixed")) == text(F.col("same"))).alias("equal_hash"), (F.to_json("raw") != F.to_json("fixed")).alias("was_repaired"), (F.size(G.reduced(dense, F.lit(0.001))[0]) / 2).cast("int").alias("points"))


def _with_middle(name, i):
    """A corner of a six-cornered ring and the middle of the edge after it."""
    p, n = F.col(name)[0], (i + 1) % 6
    x, y, u, v = F.get(p, i * 2), F.get(p, i * 2 + 1), F.get(p, n * 2), F.get(p, n * 2 + 1)
    return x, y, (x + u) / 2, (y + v) / 2


@query(f"""with {PART}, tile as (select cx, cy, (cx+cy*3)%5 as class from range(0,21) a(cx), range(0,21) b(cy))
select c_custkey, cast(class as bigint) as class, round(cast(sum({_cut('p.x0', 'p.x1', 'cx*50', 'cx*50+50')}*{_cut('p.y0', 'p.y1', 'cy*50', 'cy*50+50')}) as double),6) as area, round(cast(sum(100*{_cut('p.x0', 'p.x1', 'cx*50', 'cx*50+50')}*{_cut('p.y0', 'p.y1', 'cy*50', 'cy*50+50')}/(0.75*s*s)) as double),6) as share
from part_of p join tile on p.x0<cx*50+50 and p.x1>cx*50 and p.y0<cy*50+50 and p.y1>cy*50 group by 1,2 having sum({_cut('p.x0', 'p.x1', 'cx*50', 'cx*50+50')}*{_cut('p.y0', 'p.y1', 'cy*50', 'cy*50+50')})>1e-6""")
def land_cover_shares(spark, sf_dir):
    """Land cover classes of each parcel, clipped."""
    return C.each(parcels(spark, sf_dir), P.SHAPED, lambda v: _land_cover(v, _cover(spark))).select("c_custkey", "class", "area", "share")


def _land_cover(parcels: DataFrame, cover: DataFrame) -> DataFrame:
    d = P.meeting(parcels, cover, CELL).where("not touches").groupBy(F.col(f"l_{C.SAME}").alias(C.SAME), F.col("r_class").alias("class")).agg(F.sum("area").alias("area"), F.first("l_shape").alias("shape"))
    return d.select(C.SAME, "class", F.round("area", 6).alias("area"), F.round(100 * F.col("area") / G.measure("shape")["area"], 6).alias("share"))


def _cover(spark) -> DataFrame:
    t = spark.range(22).select(F.col("id").alias("cx")).crossJoin(F.broadcast(spark.range(22).select(F.col("id").alias("cy"))))  # 484 tiles
    x, y = F.col("cx") * 50, F.col("cy") * 50
    return P.boxed(t.where("cx < 21 and cy < 21").select(F.expr("(cx + cy * 3) % 5").alias("class"), G.box_shape(x, y, x + 50, y + 50).alias("shape")))


@query(f"select s_suppkey, round(4*(2+s_suppkey%5)*4+4*{QUARTER}*16,6) as ring_area, round(4*(2+s_suppkey%5)*4+4*{QUARTER}*16,6) as classed from supplier where (s_suppkey*53)%1000>10 and (s_suppkey*29)%1000>10")
def ring_land_cover(spark, sf_dir):
    """The classes of the 4 m ring around each building add up to the ring."""
    d = C.each(buildings(spark, sf_dir).where("x0 > 10 and y0 > 10"), ["shape"], lambda v: _ring_classes(v, _cover(spark)))
    return d.select("s_suppkey", "ring_area", "classed")


def _ring_classes(d: DataFrame, cover: DataFrame) -> DataFrame:
    b = written(P.boxed(d.select(C.SAME, G.left_over(G.widened("shape", F.lit(4.0)), "shape").alias("shape"))), "rings")
    d = P.meeting(b, cover, CELL).where("not touches").groupBy(F.col(f"l_{C.SAME}").alias(C.SAME)).agg(F.sum("area").alias("classed"), F.first("l_shape").alias("ring"))
    return d.select(C.SAME, F.round(G.measure("ring")["area"], 6).alias("ring_area"), F.round("classed", 6).alias("classed"))


@query()
def forest_distance(spark, sf_dir):
    """The nearest forest tile of each building within 100 m, and how much forest lies within 8, 12 and 16 m."""
    forest = _cover(spark).where("class = 2").withColumn("tile", F.monotonically_increasing_id())
    return C.each(buildings(spark, sf_dir), P.SHAPED, lambda v: _forest(v, forest)).select("s_suppkey", "radius", "distance", "forest")


def _forest(b: DataFrame, forest: DataFrame) -> DataFrame:
    key = C.SAME
    near = P.nearest_k(b, forest, key, "tile", 1, 100.0, CELL).select(F.col(f"l_{key}").alias(key), F.round("distance", 6).alias("distance"))
    wide = b.select(key, "shape", F.explode(F.array(F.lit(8.0), F.lit(12.0), F.lit(16.0))).alias("radius"))
    wide = written(P.boxed(C.wide(wide, key, "radius").select(key, "radius", G.widened("shape", "radius").alias("shape"))), "widened")
    met = P.meeting(wide, forest, CELL).groupBy(F.col(f"l_{key}").alias(key), F.col("l_radius").alias("radius")).agg(F.round(F.sum("area"), 6).alias("forest"))
    return wide.select(key, "radius").join(met, [key, "radius"], "left").join(near, key, "left").select(key, "radius", "distance", F.coalesce("forest", F.lit(0.0)).alias("forest"))


@query(f"""with {SHARE}, mid as (select c_custkey, x+s*5/12.0 as cx, y+s*5/12.0 as cy from square),
dom as (select c_custkey, s_suppkey as overlay_zone, a from share where rn=1 and a>1e-6),
cen as (select c_custkey, min(s_suppkey) as centroid_zone from mid, frame where cx>x and cx<x+50 and cy>y and cy<y+50 and not (cx>x+20 and cx<x+30 and cy>y+20 and cy<y+30) group by 1),
n as (select c_custkey, count(*) filter (where a>1e-6) as k, sum(a) as t from share group by 1)
select q.c_custkey, centroid_zone, overlay_zone, greatest(coalesce(k,0)-case when centroid_zone is null then 0 else 1 end,0) as omitted_zones, round(cast(coalesce(t,0)-coalesce(c.a,0) as double),6) as omitted_area
from square q left join cen using (c_custkey) left join dom using (c_custkey) left join n using (c_custkey) left join share c on c.c_custkey=q.c_custkey and c.s_suppkey=centroid_zone""")
def centroid_against_overlay(spark, sf_dir):
    """What assigning a parcel to the zone of its centroid omits, against the overlay."""
    d = C.each(parcels(spark, sf_dir), P.SHAPED, lambda v: _omitted(v, zones(spark, sf_dir)))
    return d.select("c_custkey", "centroid_zone", "overlay_zone", "omitted_zones", "omitted_area")


def _omitted(p: DataFrame, z: DataFrame) -> DataFrame:
    key = C.SAME
    share = P.overlay_shares(p, z, key, "s_suppkey", CELL).select(F.col(f"l_{key}").alias(key), F.col("r_s_suppkey").alias("s_suppkey"), "area", "rank", "dominant", "touches")
    at = p.withColumn("m", G.measure("shape")).select(key, F.col("m.x").alias("x"), F.col("m.y").alias("y"))
    cen = P.points_in(z, at, CELL).groupBy(F.col(f"r_{key}").alias(key)).agg(F.min("l_s_suppkey").alias("centroid_zone"))
    of = share.groupBy(key).agg(F.max(F.when(F.col("dominant"), F.col("s_suppkey"))).alias("overlay_zone"), F.count_if(~F.col("touches")).alias("k"), F.sum("area").alias("t"))
    d = p.select(key).join(cen, key, "left").join(of, key, "left").join(share.select(key, F.col("s_suppkey").alias("centroid_zone"), "area"), [key, "centroid_zone"], "left")
    omitted = F.greatest(F.coalesce("k", F.lit(0)) - F.col("centroid_zone").isNotNull().cast("int"), F.lit(0))
    return d.select(key, "centroid_zone", "overlay_zone", omitted.alias("omitted_zones"), F.round(F.coalesce("t", F.lit(0.0)) - F.coalesce("area", F.lit(0.0)), 6).alias("omitted_area"))


@query(f"with {SHARE}, z as (select s_suppkey from supplier where s_suppkey%7<=3 and s_suppkey%7+2>3) select c_custkey, s_suppkey, round(cast(a as double),6) as area from share semi join z using (s_suppkey) where a>1e-6")
def overlay_at_state(spark, sf_dir):
    """Overlay with the zones that a pinned registry state holds (state_from <= 3 < state_to)."""
    z = zones(spark, sf_dir).withColumns({"state_from": F.col("s_suppkey") % 7, "state_to": F.col("s_suppkey") % 7 + 2}).where("state_from <= 3 and (state_to is null or state_to > 3)")
    d = P.meeting(parcels(spark, sf_dir), z, CELL).where("not touches")
    return d.select(F.col("l_c_custkey").alias("c_custkey"), F.col("r_s_suppkey").alias("s_suppkey"), F.round("area", 6).alias("area"))


@query(f"""with {MEET}, act as (select n_nationkey, n_nationkey%3<>0 as has_shape from nation),
hit as (select c_custkey, s_nationkey as n_nationkey, count(*) as zones, count(*) filter (where a>1e-6) as real from met join supplier using (s_suppkey) group by all)
select q.c_custkey, a.n_nationkey, coalesce(zones,0) as zones, coalesce(real,0) as real_zones, h.n_nationkey is not null as by_shape from square q join act a on true left join hit h on h.c_custkey=q.c_custkey and h.n_nationkey=a.n_nationkey
where (has_shape and h.n_nationkey is not null) or (not has_shape and q.c_nationkey=a.n_nationkey)""")
def acts_of_parcels(spark, sf_dir):
    """Acts that concern a parcel: by shape where the act has one, else by its code, with counts of the zones that meet it."""
    p, acts = parcels(spark, sf_dir), table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") % 3 != 0).alias("has_shape"))
    seen = lambda v: P.meeting(v, zones(spark, sf_dir), CELL).groupBy(F.col(f"l_{C.SAME}").alias(C.SAME), F.col("r_s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("zones"), F.count_if(~F.col("touches")).alias("real_zones"))
    hit = C.each(p.select("c_custkey", *P.SHAPED), P.SHAPED, seen).select("c_custkey", "n_nationkey", "zones", "real_zones")
    shaped = hit.join(F.broadcast(acts.where("has_shape")), "n_nationkey").select("c_custkey", "n_nationkey", "zones", "real_zones", F.lit(True).alias("by_shape"))
    coded = p.select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(F.broadcast(acts.where("not has_shape")), "n_nationkey").join(hit, ["c_custkey", "n_nationkey"], "left")
    return shaped.unionByName(coded.select("c_custkey", "n_nationkey", F.coalesce("zones", F.lit(0)).alias("zones"), F.coalesce("real_zones", F.lit(0)).alias("real_zones"), F.col("zones").isNotNull().alias("by_shape")))


@query(f"""with {PART}, {FRAME}, act as (select * from frame where s_suppkey%5<>0), b as (select c_custkey, x as x0, y as y0, x+s as x1, y+s as y1 from square), m as (
select b.c_custkey, f.s_suppkey, f.x, f.y from b join act f on b.x0<=f.x+50 and b.x1>=f.x and b.y0<=f.y+50 and b.y1>=f.y),
r as (select m.c_custkey, m.s_suppkey, sum({IN_FRAME.replace('f.', 'm.')}) as area, bool_or(p.x0<=m.x+50 and p.x1>=m.x and p.y0<=m.y+50 and p.y1>=m.y and not (p.x0>m.x+20 and p.x1<m.x+30 and p.y0>m.y+20 and p.y1<m.y+30)) as meets from m join part_of p using (c_custkey) group by 1,2)
select c_custkey, s_suppkey, round(cast(area as double),6) as area, case when area>1e-6 then 'accepted' when meets then 'contact_only' else 'apart' end as verdict from r union all select null, s_suppkey, 0.0, 'no_geometry' from frame where s_suppkey%5=0""")
def act_verdicts(spark, sf_dir):
    """Each act against each parcel, accepted or rejected with a reason."""
    acts = zones(spark, sf_dir).withColumn("shape", F.when(F.col("s_suppkey") % 5 != 0, F.col("shape"))).drop(*S.BOX)
    return P.judged_contact(P.boxed(acts), parcels(spark, sf_dir), "c_custkey", "s_suppkey", CELL).withColumn("area", F.round("area", 6))


@query(f"""with {MEET}, hit as (select c_custkey, count(*) filter (where a>1e-6) as n, count(*) as seen from met join supplier using (s_suppkey) where s_nationkey%2=0 group by 1)
select q.c_custkey, coalesce(n,0) as n, case when coalesce(n,0)>0 then 'found' when c_nationkey%4=3 then 'unavailable' when coalesce(seen,0)>0 then 'contact_only' else 'empty' end as status from square q left join hit using (c_custkey)""")
def layer_observation(spark, sf_dir):
    """Whether a layer has something on a parcel: found, mere contact, empty, or unavailable where the layer is incomplete."""
    p = parcels(spark, sf_dir)
    z = zones(spark, sf_dir).where("s_nationkey % 2 = 0")
    d = C.each(p, P.SHAPED, lambda v: P.meeting(v, z, CELL).groupBy(F.col(f"l_{C.SAME}").alias(C.SAME)).agg(F.count_if(~F.col("touches")).alias("n"), F.count("*").alias("seen")), "left")
    n, seen = F.coalesce("n", F.lit(0)), F.coalesce("seen", F.lit(0))
    status = F.when(n > 0, "found").when(F.col("c_nationkey") % 4 == 3, "unavailable").when(seen > 0, "contact_only").otherwise("empty")
    return d.select("c_custkey", n.alias("n"), status.alias("status"))


@query(f"""with {NEAR} select c_custkey, s_suppkey, round(distance,6) as distance, case when distance=0 then 'inside' when distance<=10 then 'near' else 'around' end as relation,
case when distance=0 and s_suppkey%3=0 then 'high' when distance=0 then 'medium' when distance<=10 then 'low' else 'info' end as severity from gap where distance<=30""")
def proximity_overlay(spark, sf_dir):
    """Protected objects on or near a parcel, with relation and severity."""
    d = P.within(parcels(spark, sf_dir), buildings(spark, sf_dir), 30.0, CELL)
    at, sure = F.col("distance") == 0, F.col("r_s_suppkey") % 3 == 0
    severity = F.when(at & sure, "high").when(at, "medium").when(F.col("distance") <= 10, "low").otherwise("info")
    relation = F.when(at, "inside").when(F.col("distance") <= 10, "near").otherwise("around")
    return d.select(F.col("l_c_custkey").alias("c_custkey"), F.col("r_s_suppkey").alias("s_suppkey"), F.round("distance", 6).alias("distance"), relation.alias("relation"), severity.alias("severity"))


@query(f"""with {PART}, strip as (select n_nationkey, n_regionkey, n_nationkey*40-3-n_nationkey%3 as y0, n_nationkey*40+3+n_nationkey%3 as y1 from nation)
select c_custkey, n_nationkey, n_regionkey, round(cast(sum((p.x1-p.x0)*{_cut('p.y0', 'p.y1', 't.y0', 't.y1')}) as double),6) as charged from part_of p join strip t on p.y0<t.y1 and p.y1>t.y0 group by all having sum((p.x1-p.x0)*{_cut('p.y0', 'p.y1', 't.y0', 't.y1')})>1e-6""")
def network_zones(spark, sf_dir):
    """Protection strips of networks on parcels, by rank of their kind; an area that strips share is charged once."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", (F.col("n_nationkey") * 40).alias("at"), (3 + F.col("n_nationkey") % 3).alias("half"))
    strips = P.boxed(n.select("n_nationkey", "n_regionkey", G.box_shape(F.lit(-10), F.col("at") - F.col("half"), F.lit(1100), F.col("at") + F.col("half")).alias("shape")))
    d = P.masked_areas(parcels(spark, sf_dir), strips, "c_custkey", "n_nationkey", F.col("n_regionkey"), CELL)
    return d.join(F.broadcast(n.select("n_nationkey", "n_regionkey")), "n_nationkey").select("c_custkey", "n_nationkey", "n_regionkey", F.round("area", 6).alias("charged"))


@query(f"""with {FRAME}, p as (select n_nationkey, n_nationkey%5*200+30 as x0, n_nationkey//5*200+30 as y0, n_nationkey%5*200+230 as x1, n_nationkey//5*200+230 as y1 from nation), pair as (select f.s_suppkey, p.n_nationkey, {IN_FRAME} as area, f.s_nationkey%4 as f, p.n_nationkey%3 as t from frame f, p)
select s_suppkey, n_nationkey, cast(area as double) as area, case when f=t then 'agrees' when f=3 then 'unknown' when f>t then 'conflicts' else 'partly' end as result, case when f=t then 'high' when f=3 then 'none' else 'medium' end as confidence from pair where area>1e-6""")
def zone_pair_rules(spark, sf_dir):
    """Overlapping zones of two kinds of plan, judged by a rule table; what it does not list is unknown."""
    n = F.col("n_nationkey")
    x, y = n % 5 * 200 + 30, F.expr("n_nationkey div 5") * 200 + 30
    general = P.boxed(table(spark, sf_dir, "nation").select("n_nationkey", (n % 3).alias("t"), G.box_shape(x, y, x + 200, y + 200).alias("shape")))
    rules = [(f, t, "agrees" if f == t else "conflicts" if f > t else "partly", "high" if f == t else "medium") for f in range(3) for t in range(3)]
    table_of_rules = spark.createDataFrame(rules, "f int, t int, result string, confidence string")
    pair = P.meeting(zones(spark, sf_dir).withColumn("f", F.col("s_nationkey") % 4), general, CELL).where("not touches")
    pair = pair.select(F.col("l_s_suppkey").alias("s_suppkey"), F.col("r_n_nationkey").alias("n_nationkey"), F.round("area", 6).alias("area"), F.col("l_f").alias("f"), F.col("r_t").alias("t"))
    return pair.join(F.broadcast(table_of_rules), ["f", "t"], "left").select("s_suppkey", "n_nationkey", "area", F.coalesce("result", F.lit("unknown")).alias("result"), F.coalesce("confidence", F.lit("none")).alias("confidence"))


_BOUND = "bound as (select n_nationkey, min((s_suppkey%20)*50)+10 as x0, min(((s_suppkey//20)%20)*50) as y0, max((s_suppkey%20)*50)+40 as x1, max(((s_suppkey//20)%20)*50)+50 as y1 from supplier join nation on s_nationkey=n_nationkey group by 1)"
_FRAMES_IN = f"({_cut('x0', 'x1', 'x', 'x+50')}*{_cut('y0', 'y1', 'y', 'y+50')}-{_cut('x0', 'x1', 'x+20', 'x+30')}*{_cut('y0', 'y1', 'y+20', 'y+30')})"


@query(f"""with {FRAME}, {_BOUND}, spot as (select s_nationkey as n_nationkey, x, y, count(*) as n from frame group by all),
part as (select *, {_FRAMES_IN} as area from spot join bound using (n_nationkey)),
total as (select n_nationkey, max((x1-x0)*(y1-y0)) as whole, sum(area) as covered, coalesce(sum(area) filter (where n>1),0) as overlap, sum(2400-area) as outside from part group by 1)
select n_nationkey, cast(whole as double) as whole, cast(covered as double) as covered, cast(overlap as double) as overlap, cast(outside as double) as outside, cast(whole-covered as double) as gap, whole-covered<=0.1 as complete from total""")
def topology_check(spark, sf_dir):
    """Gap, overlap and area outside the boundary of each nation's zones; the boundary is the box of its suppliers, 10 m short on two sides."""
    z = zones(spark, sf_dir).withColumnRenamed("s_nationkey", "n_nationkey")
    box = z.groupBy("n_nationkey").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    acts = box.select("n_nationkey", G.box_shape(F.col("x0") + 10, F.col("y0"), F.col("x1") - 10, F.col("y1")).alias("shape"))
    d = P.topology(acts, z, "n_nationkey", CELL)
    return d.select("n_nationkey", *(F.round(c, 6).alias(c) for c in ("whole", "covered", "overlap", "outside", "gap")), "complete")


@query(f"with {SQUARE} select c_custkey, round(0.75/0.875,6) as solidity, round(0.75,6) as fill, round(4*pi()*0.75/16,6) as compactness, cast(1 as bigint) as parts from square")
def shape_descriptors(spark, sf_dir):
    """Share of the convex hull, of the box and of a circle."""
    d = C.each(parcels(spark, sf_dir), ["shape"], lambda v: v.withColumn("d", G.descriptors("shape")))
    return d.select("c_custkey", *(F.round(f"d.{n}", 6).alias(n) for n in ("solidity", "fill", "compactness")), "d.parts")


@query(f"with {SQUARE} select c_custkey, round(0.75*s*s*0.6,4) as first_part, round(0.75*s*s*0.4,4) as second_part from square")
def halved_parcels(spark, sf_dir):
    """Parcels cut 60 to 40 by an upright or level line."""
    d = parcels(spark, sf_dir).select("c_custkey", "shape", (F.col("c_custkey") % 2 == 0).alias("upright"))
    return C.each(d, ["shape", "upright"], lambda v: _halves(v.select(C.SAME, G.halved("shape", F.lit(0.6), "upright").alias("h")))).select("c_custkey", "first_part", "second_part")


def _halves(d: DataFrame) -> DataFrame:
    return d.select(C.SAME, *(F.round(G.measure(F.col("h")[i])["area"], 4).alias(n) for i, n in enumerate(("first_part", "second_part"))))


@query(f"with {SQUARE} select c_custkey, true as inside, 1 as parts from square")
def sample_points(spark, sf_dir):
    """A point that is surely inside, and one for each part."""
    found = lambda v: v.withColumn("s", G.samples("shape")).select(C.SAME, G.holds("shape", F.col("s.inner.x"), F.col("s.inner.y")).alias("inside"), F.size("s.parts").alias("parts"))
    return C.each(parcels(spark, sf_dir), ["shape"], found).select("c_custkey", "inside", "parts")


@query(f"with {SQUARE} select c_custkey, cast(s*ceil(s/2.0-0.25)+ceil(s/2.0-0.25)*(s-ceil(s/2.0-0.25)) as bigint) as pixels, round(s*sqrt(2.0),6) as axis, cast(x as double) as x0 from square")
def pixel_masks(spark, sf_dir):
    """Grid cells of 1 m inside each parcel, and the long axis of its profile."""
    d = C.each(parcels(spark, sf_dir), ["shape"], lambda v: _masks(v.select(C.SAME, G.pixels("shape", F.lit(1.0), F.lit(0.25)).alias("p"), G.long_axis("shape").alias("a"))))
    return d.select("c_custkey", "pixels", "axis", F.col("axis_x0").alias("x0"))


def _masks(d: DataFrame) -> DataFrame:
    return d.select(C.SAME, F.size("p").cast("bigint").alias("pixels"), F.round("a.length", 6).alias("axis"), F.col("a.x0").alias("axis_x0"))


@query("select s_suppkey, case when s_suppkey%4<2 then 3 end as points, case when s_suppkey%4<2 then 7.0 end as length from supplier")
def repaired_lines(spark, sf_dir):
    """Lines without repeated points; lines of one point or with a coordinate that is not finite are refused."""
    k = F.col("s_suppkey")
    x = k.cast("double")
    good = F.array(x, x, x, x, x + 3, x, x + 3, x, x + 3, x + 4)
    line = F.when(k % 4 < 2, good).when(k % 4 == 2, F.array(x, x, x, x)).otherwise(F.array(x, F.lit(float("nan")), x, x + 1))
    d = table(spark, sf_dir, "supplier").select(k, G.repaired_line(line).alias("l"))
    return d.select("s_suppkey", F.when(F.col("l").isNotNull(), (F.size("l") / 2).cast("int")).alias("points"), G.line_length(F.col("l")).alias("length"))


@query(f"with {FRAME}, p as (select event_id, (user_id*13)%1000+0.25 as x, (user_id*7)%1000+0.25 as y from events) select event_id, count(s_suppkey) as zones from p left join frame f on p.x>f.x and p.x<f.x+50 and p.y>f.y and p.y<f.y+50 and not (p.x>f.x+20 and p.x<f.x+30 and p.y>f.y+20 and p.y<f.y+30) group by 1")
def point_coverage(spark, sf_dir):
    """Coverage of points; each place is looked up once and its answer shared by all rows that ask for it."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") * 13 % 1000 + 0.25).alias("x"), (F.col("user_id") * 7 % 1000 + 0.25).alias("y"))
    places = zones(spark, sf_dir).groupBy(*P.SHAPED).agg(F.count("*").alias("n"))
    found = P.points_in(places, e.select("x", "y").distinct(), CELL).groupBy(F.col("r_x").alias("x"), F.col("r_y").alias("y")).agg(F.sum("l_n").alias("zones"))
    return e.join(found, ["x", "y"], "left").groupBy("event_id").agg(F.sum(F.coalesce("zones", F.lit(0))).alias("zones"))  # an event that comes again is one row
