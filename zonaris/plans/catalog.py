"""Queries that apply the operators to the driver's tables, each with the SQL that gives the same rows.

The tables have no geometry; parcels, zones and points are boxes and points computed from keys (`parcels`, `zones`,
`points`), by the same integer arithmetic in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonaris.functions import text as T
from zonaris.operators import aggregates as A
from zonaris.operators import classes as C
from zonaris.operators import search as S
from zonaris.operators import spatial as G
from zonaris.operators import temporal as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
CELL = 50.0


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    x, y, side = F.expr("(c_custkey * 37) % 1000"), F.expr("(c_custkey * 91) % 1000"), F.expr("5 + c_custkey % 20")
    return c.select("c_custkey", x.alias("x0"), y.alias("y0"), (x + side).alias("x1"), (y + side).alias("y1"))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    x, y = F.expr("(p_partkey % 20) * 50"), F.expr("(p_partkey div 20 % 20) * 50")
    return p.select("p_partkey", "p_brand", x.alias("x0"), y.alias("y0"), (x + 50).alias("x1"), (y + 50).alias("y1"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", "s_acctbal", F.expr("(s_suppkey * 53) % 1000").alias("x"), F.expr("(s_suppkey * 29) % 1000").alias("y"))


PARCEL = "parcel as (select c_custkey, (c_custkey*37)%1000 as x0, (c_custkey*91)%1000 as y0, (c_custkey*37)%1000+5+c_custkey%20 as x1, (c_custkey*91)%1000+5+c_custkey%20 as y1 from customer)"
ZONE = "zone as (select p_partkey, p_brand, (p_partkey%20)*50 as x0, ((p_partkey//20)%20)*50 as y0, (p_partkey%20)*50+50 as x1, ((p_partkey//20)%20)*50+50 as y1 from part)"
POINT = "point as (select s_suppkey, s_acctbal, (s_suppkey*53)%1000 as x, (s_suppkey*29)%1000 as y from supplier)"
OVERLAY = f"""{PARCEL}, {ZONE}, pair as (
  select c_custkey, p_partkey, p_brand, p.x0 as px0, p.y0 as py0, p.x1 as px1, p.y1 as py1, z.x0 as zx0, z.y0 as zy0, z.x1 as zx1, z.y1 as zy1,
    greatest(least(p.x1,z.x1)-greatest(p.x0,z.x0),0)*greatest(least(p.y1,z.y1)-greatest(p.y0,z.y0),0) as a, (p.x1-p.x0)*(p.y1-p.y0) as whole
  from parcel p join zone z on p.x0<=z.x1 and z.x0<=p.x1 and p.y0<=z.y1 and z.y0<=p.y1),
share as (select *, a <= 0 as touches, cast(a as double) as area, least(100.0, 100.0*a/whole) as share,
    row_number() over (partition by c_custkey order by a desc, p_partkey) as rank from pair)"""


def _shares(spark: SparkSession, sf_dir: str, work: Callable[[DataFrame], DataFrame] = lambda d: d, give: Callable[[DataFrame, DataFrame], DataFrame] = C.spread) -> DataFrame:
    """c_custkey with the columns that `work` gives for the overlay of its box; boxes that several parcels have are laid over the zones once (key l_same_as).
    `give` gives the parcels of a box its rows."""
    values, members = C.classed(parcels(spark, sf_dir), G.BOX)
    return give(work(G.overlay_shares(values, zones(spark, sf_dir), C.SAME, "p_partkey", CELL)).withColumnsRenamed({f"l_{C.SAME}": C.SAME}), members)


@query(f"with {OVERLAY} select c_custkey, p_partkey, p_brand, area, round(share,6) as share, touches, cast(rank as integer) as rank, rank=1 and not touches as dominant from share")
def zone_overlay_shares(spark, sf_dir):
    """Every parcel and zone that meet, with area, share, contact, rank and dominance."""
    d = _shares(spark, sf_dir, lambda s: s.withColumn("share", F.round("share", 6)), C.spread_in_runs)
    return d.select("c_custkey", F.col("r_p_partkey").alias("p_partkey"), F.col("r_p_brand").alias("p_brand"), "area", "share", "touches", "rank", "dominant")


@query(f"with {OVERLAY} select c_custkey, p_brand, area from share where rank=1 and not touches")
def zone_dominant(spark, sf_dir):
    """The zone that takes most of each parcel."""
    return _shares(spark, sf_dir, lambda s: s.where("dominant")).select("c_custkey", F.col("r_p_brand").alias("p_brand"), "area")


@query(f"""with {OVERLAY}, clip as (select distinct c_custkey, greatest(px0,zx0) as x0, greatest(py0,zy0) as y0, least(px1,zx1) as x1, least(py1,zy1) as y1 from share where not touches),
u as (select c_custkey, sum((x1-x0)*(y1-y0)) as ua from clip group by 1),
s as (select c_custkey, sum(share) as total, max(whole) as whole, bool_or(touches) as t from share group by 1)
select c_custkey, round(total,4) as total, round(100.0*coalesce(ua,0)/whole,4) as covered, round(greatest(0,total-100.0*coalesce(ua,0)/whole),4) as overlap,
  (total-100.0*coalesce(ua,0)/whole > 0.1 or 100.0*coalesce(ua,0)/whole < 99.9 or t) as review from s left join u using (c_custkey)""")
def zone_coverage(spark, sf_dir):
    """Union coverage and overlap of each parcel."""
    d = _shares(spark, sf_dir, lambda s: G.coverage(s, C.SAME))
    return d.select("c_custkey", *(F.round(c, 4).alias(c) for c in ("total", "covered", "overlap")), "review")


@query(f"with {OVERLAY}, s as (select *, share<0.5 and area<1.0 as small from share) select c_custkey, p_partkey, small and sum(case when small then 0 else 1 end) over (partition by c_custkey) > 0 as sliver from s")
def slivers(spark, sf_dir):
    """zones below both bounds, unless all of a parcel's are."""
    d = _shares(spark, sf_dir, lambda s: G.split_slivers(s, f"l_{C.SAME}"), C.spread_in_runs)
    return d.select("c_custkey", F.col("r_p_partkey").alias("p_partkey"), "sliver")


@query(f"with {PARCEL} select a.c_custkey as a, b.c_custkey as b, (least(a.x1,b.x1)-greatest(a.x0,b.x0))*(least(a.y1,b.y1)-greatest(a.y0,b.y0)) as area from parcel a join parcel b on a.c_custkey<b.c_custkey and a.x0<b.x1 and b.x0<a.x1 and a.y0<b.y1 and b.y0<a.y1")
def parcel_overlaps(spark, sf_dir):
    """Parcels that overlap each other."""
    return G.self_overlaps(parcels(spark, sf_dir), "c_custkey", CELL, 0.01)


DIST = "sqrt(cast(pow(greatest(p.x0-s.x,0,s.x-p.x1),2)+pow(greatest(p.y0-s.y,0,s.y-p.y1),2) as double))"


@query(f"""with {PARCEL}, {POINT}, d as (select c_custkey, s_suppkey, {DIST} as distance from parcel p, point s)
select c_custkey, s_suppkey, round(distance,6) as distance, cast(rn as integer) as rank from (select *, row_number() over (partition by c_custkey order by distance, s_suppkey) as rn from d where distance<=100) where rn<=3""")
def nearest_k_within(spark, sf_dir):
    """The three nearest suppliers within 100 m."""
    d = G.nearest_k(parcels(spark, sf_dir), points(spark, sf_dir), "c_custkey", "s_suppkey", 3, 100.0, CELL)
    return d.select(F.col("l_c_custkey").alias("c_custkey"), F.col("r_s_suppkey").alias("s_suppkey"), F.round("distance", 6).alias("distance"), "rank")


@query(f"""with {PARCEL}, {POINT}, d as (select c_custkey, s_suppkey, {DIST} as distance from parcel p, point s),
b as (select * from (select *, row_number() over (partition by c_custkey order by cast(round(distance*1000) as bigint), s_suppkey) as rn from d where distance<=500) where rn=1)
select p.c_custkey, s_suppkey as nearest, round(distance,6) as distance, case when distance<=25 then 25.0 when distance<=50 then 50.0 when distance<=100 then 100.0 when distance<=250 then 250.0 when distance<=500 then 500.0 end as radius,
case when s_suppkey is null then 'no_match' else 'match' end as status from parcel p left join b using (c_custkey)""")
def nearest_supplier(spark, sf_dir):
    """The nearest supplier by expanding radius, with a millimetre tie bucket."""
    d = G.nearest_expanding(parcels(spark, sf_dir), points(spark, sf_dir), "c_custkey", "s_suppkey", (25, 50, 100, 250, 500), CELL)
    return d.withColumn("distance", F.round("distance", 6))


@query(f"""with {PARCEL}, {POINT}, r as (select unnest([50.0,100.0,200.0]) as radius), d as (select c_custkey, s_acctbal, {DIST} as distance from parcel p, point s)
select p.c_custkey, r.radius, count(d.distance) as n, round(sum(s_acctbal),2) as sum_value, round(quantile_cont(s_acctbal,0.5),4) as median_value, round(min(distance),6) as min_distance, round(max(distance),6) as max_distance
from parcel p cross join r left join d on d.c_custkey=p.c_custkey and d.distance<=r.radius group by 1,2""")
def ring_statistics(spark, sf_dir):
    """Supplier balances within 50, 100 and 200 m."""
    d = G.ring_statistics(parcels(spark, sf_dir), points(spark, sf_dir), "c_custkey", "s_acctbal", (50, 100, 200), CELL)
    return d.select("c_custkey", "radius", "n", F.round("sum_value", 2).alias("sum_value"), F.round("median_value", 4).alias("median_value"), F.round("min_distance", 6).alias("min_distance"), F.round("max_distance", 6).alias("max_distance"))


@query(f"with {ZONE}, {POINT} select s_suppkey, p_partkey, p_brand from point s join zone z on s.x>=z.x0 and s.x<=z.x1 and s.y>=z.y0 and s.y<=z.y1")
def point_in_zone(spark, sf_dir):
    """The zones that hold each point."""
    p = points(spark, sf_dir).withColumns({"x0": F.col("x"), "x1": F.col("x"), "y0": F.col("y"), "y1": F.col("y")})
    return C.paired(p, zones(spark, sf_dir), G.BOX, G.BOX, lambda a, b: G.box_join(a, b, CELL)).select(F.col("l_s_suppkey").alias("s_suppkey"), F.col("r_p_partkey").alias("p_partkey"), F.col("r_p_brand").alias("p_brand"))


VERSION = "version as (select o_custkey, o_orderkey, o_orderstatus, o_totalprice, o_orderdate as valid_from, lead(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey) as valid_to from orders)"


def _versions(spark, sf_dir):
    return V.with_intervals(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey")


@query(f"with {VERSION} select o_custkey, o_orderkey, o_orderstatus from (select *, row_number() over (partition by o_custkey order by valid_from desc, o_orderkey desc) as rn from version where valid_from<=timestamp '1996-07-01' and (valid_to is null or valid_to>timestamp '1996-07-01')) where rn=1")
def as_of_version(spark, sf_dir):
    """Each customer's version on a day."""
    d = _versions(spark, sf_dir).select("o_custkey", "o_orderkey", "o_orderstatus", "valid_from", "valid_to")
    return V.version_as_of(d, "o_custkey", F.lit("1996-07-01").cast("timestamp"), "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus")


@query("with s as (select o_custkey, o_orderkey, case when o_orderstatus='P' then 0 else 1 end as act_count from orders where o_orderkey<=(select max(o_orderkey)//2 from orders)), l as (select *, row_number() over (partition by o_custkey order by o_orderkey desc) as rn from s) select o_custkey, o_orderkey, act_count from l where rn=1 and act_count>0")
def as_of_state(spark, sf_dir):
    """The latest summary up to the state in the middle of the table; tombstones hide older ones."""
    d = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "P", 0).otherwise(1).alias("act_count"))
    middle = (d.agg(F.max("o_orderkey")).first()[0] or 0) // 2
    return V.state_as_of(d, "o_custkey", "o_orderkey", middle, "act_count")


@query("with s as (select o_custkey, o_orderkey, case when o_orderstatus='P' then 0 else 1 end as act_count from orders where o_orderkey<=(select max(o_orderkey) from orders)), l as (select *, row_number() over (partition by o_custkey order by o_orderkey desc) as rn from s) select o_custkey, o_orderkey, act_count from l where rn=1 and act_count>0")
def as_of_last_state(spark, sf_dir):
    """The same, pinned at the table's last state, so that every order takes part."""
    d = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "P", 0).otherwise(1).alias("act_count"))
    last = d.agg(F.max("o_orderkey")).first()[0]
    return V.state_as_of(d, "o_custkey", "o_orderkey", last, "act_count")


@query("select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as rn from orders) where rn=1")
def latest_per_key(spark, sf_dir):
    """Each customer's latest order."""
    return V.latest_per_key(table(spark, sf_dir, "orders"), "o_custkey", [F.desc("o_orderdate"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("with o as (select o_custkey as k, count(*) as h from orders where o_orderdate<timestamp '1996-01-01' group by 1), n as (select o_custkey as k, count(*) as h from orders where o_orderdate>=timestamp '1994-01-01' group by 1) select coalesce(o.k,n.k) as k, case when o.k is null then 'new' when n.k is null then 'missing' when o.h=n.h then 'unchanged' else 'changed' end as change from o full join n on o.k=n.k")
def snapshot_diff(spark, sf_dir):
    """What changed between two snapshots, by a count of rows."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k")
    at = lambda d: d.groupBy("k").agg(F.count("*").alias("h"))
    return V.snapshot_diff(at(o.where("o_orderdate < timestamp'1996-01-01'")), at(o.where("o_orderdate >= timestamp'1994-01-01'")), "k", "h")


@query("""with o as (select o_custkey as k, md5(string_agg(o_orderkey||':'||o_orderstatus, ',' order by o_orderkey)) as h from orders where o_orderdate<timestamp '1996-01-01' group by 1), n as (select o_custkey as k, md5(string_agg(o_orderkey||':'||o_orderstatus, ',' order by o_orderkey)) as h from orders where o_orderdate<timestamp '1996-03-01' group by 1)
select coalesce(o.k,n.k) as k, case when o.k is null then 'new' when n.k is null then 'missing' when o.h=n.h then 'unchanged' else 'changed' end as change from o full join n on o.k=n.k""")
def snapshot_content(spark, sf_dir):
    """What changed between two snapshots, by a hash of each key's sorted content (a key's rows are one record's parts, so few)."""
    part = F.struct("o_orderkey", "o_orderstatus")
    content = F.md5(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(part)), lambda x: F.concat(x["o_orderkey"], F.lit(":"), x["o_orderstatus"]))))
    at = lambda day: table(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit(day).cast("timestamp")).groupBy(F.col("o_custkey").alias("k"))
    d = at("1996-01-01").agg(content.alias("old")).join(at("1996-03-01").agg(content.alias("new")), "k", "full")
    change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "missing").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return d.select("k", change.alias("change"))


@query("with c as (select o_custkey, o_orderstatus, o_orderdate, o_orderkey, lag(o_orderstatus) over (partition by o_custkey order by o_orderdate, o_orderkey) as b from orders) select o_custkey, o_orderstatus, o_orderdate as valid_from, lead(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey) as valid_to from c where b is null or b<>o_orderstatus")
def scd2_history(spark, sf_dir):
    """History of each customer's status; repeats change nothing."""
    return V.history(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderstatus", "o_orderkey")


@query("with d as (select o_orderkey, 4 as declared from orders), g as (select l_orderkey, count(*) as n_rows, count(distinct l_linenumber) as n_items from lineitem group by 1) select o_orderkey, declared, coalesce(n_rows,0) as n_rows, coalesce(n_items,0) as n_items, coalesce(n_rows,0)=declared and coalesce(n_rows,0)=coalesce(n_items,0) as complete from d left join g on o_orderkey=l_orderkey")
def listing_completeness(spark, sf_dir):
    """Whether an order lists what it declares, each item once."""
    d = table(spark, sf_dir, "orders").select("o_orderkey", F.lit(4).alias("total"))
    return V.listing_complete(table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), d, "o_orderkey", "l_linenumber", "total")


@query("with r as (select c_custkey as k, c_nationkey from customer), l as (select distinct o_custkey as k from orders), m as (select c_nationkey, count(*) as n_missing from r where k not in (select k from l) group by 1) select r.c_nationkey, count(*) as n_registered, coalesce(max(n_missing),0) as n_missing, coalesce(max(n_missing),0) > greatest(5, floor(count(*)*0.1)) as blocked from r left join m using (c_nationkey) group by 1")
def registry_withdrawals(spark, sf_dir):
    """Customers that the orders no longer name, guarded by nation."""
    return V.withdrawals(table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "k"), table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k"), "k", "c_nationkey")


@query("select l_returnflag, grouping(l_returnflag)=1 as is_total, count(*) as n, sum(l_quantity) as qty from lineitem group by grouping sets ((l_returnflag),())")
def grouping_sets_total(spark, sf_dir):
    """A4: groups and their total in one pass."""
    d = table(spark, sf_dir, "lineitem")
    return d.groupingSets([["l_returnflag"], []], "l_returnflag").agg((F.grouping("l_returnflag") == 1).alias("is_total"), F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


@query("""with g as (select l_orderkey, sum(l_extendedprice*(1+l_tax)*(1-l_discount)) as m from lineitem where l_linenumber<=6 group by 1), s as (select o_orderkey, o_totalprice as whole, m as measured, 100.0*m/o_totalprice as share from orders left join g on o_orderkey=l_orderkey)
select o_orderkey, round(whole,2) as whole, round(measured,1) as measured, round(share,3) as share, case when measured is null then 'no_zones' when abs(share-100)>0.1 then 'share_sum_out_of_tolerance' else '' end as reasons, measured is not null and abs(share-100)<=0.1 as is_complete from s""")
def share_completeness(spark, sf_dir):
    """Order totals against their lines; unknown is not zero."""
    li = table(spark, sf_dir, "lineitem").where("l_linenumber <= 6").select(F.col("l_orderkey").alias("o_orderkey"), F.expr("l_extendedprice*(1+l_tax)*(1-l_discount)").alias("part"))
    d = A.share_completeness(li, table(spark, sf_dir, "orders"), "o_orderkey", "part", "o_totalprice")
    return d.select("o_orderkey", F.round("whole", 2).alias("whole"), F.round("measured", 1).alias("measured"), F.round("share", 3).alias("share"), "reasons", "is_complete")


@query("select o_orderpriority, count(*) as n, count(*) filter (where o_orderstatus='F') as n_f, count(distinct o_custkey) filter (where o_totalprice>100000) as n_rich from orders group by 1")
def filtered_counts(spark, sf_dir):
    """A1 to A3: counts and distinct counts with filters."""
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("n_f"), F.countDistinct(F.when(F.col("o_totalprice") > 100000, F.col("o_custkey"))).alias("n_rich"))


@query("select c_custkey, exists(select 1 from orders where o_custkey=c_custkey) as has_order, exists(select 1 from orders where o_custkey=c_custkey and o_orderstatus='P') as has_pending, (select count(*) from orders where o_custkey=c_custkey) as n_orders from customer")
def exists_flags(spark, sf_dir):
    """EXISTS flags and correlated counts by one aggregation and a left join."""
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.max((F.col("o_orderstatus") == "P")).alias("p"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(g, "c_custkey", "left").select("c_custkey", F.col("n_orders").isNotNull().alias("has_order"), F.coalesce("p", F.lit(False)).alias("has_pending"), F.coalesce("n_orders", F.lit(0)).alias("n_orders"))


@query("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey=c_custkey and o_orderstatus='P')")
def anti_join_missing(spark, sf_dir):
    """Customers without a pending order."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left_anti")


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey=c_custkey and o_totalprice>300000) or exists (select 1 from nation where n_nationkey=c_nationkey and n_regionkey=0) or c_acctbal<0")
def semi_any_of(spark, sf_dir):
    """Rows that meet any of three conditions, each a semi join."""
    c = table(spark, sf_dir, "customer")
    rich = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    near = table(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("c_nationkey"))
    return c.join(rich, "c_custkey", "left_semi").select("c_custkey").union(c.join(near, "c_nationkey", "left_semi").select("c_custkey")).union(c.where("c_acctbal < 0").select("c_custkey")).distinct()


@query("select c_custkey, o_orderkey, o_totalprice from customer left join (select *, row_number() over (partition by o_custkey order by o_totalprice desc nulls last, o_orderkey) as rn from orders) on o_custkey=c_custkey and rn=1")
def lateral_top1(spark, sf_dir):
    """Each customer's dearest order, or none, by one partial maximum."""
    best = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_totalprice", -F.col("o_orderkey"))).alias("o"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(best, "c_custkey", "left").select("c_custkey", "o.o_orderkey", "o.o_totalprice")


@query("select o_custkey, case min(case o_orderstatus when 'P' then 0 when 'O' then 1 when 'F' then 2 else 3 end) when 0 then 'P' when 1 then 'O' when 2 then 'F' else 'unknown' end as status from orders group by 1")
def status_worst_of(spark, sf_dir):
    """The status that comes first in the precedence."""
    return A.worst_of(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", ("P", "O", "F"))


@query("with g as (select l_orderkey, bool_or(l_returnflag='R') as r, bool_and(l_linestatus='F') as f, count(*) as n from lineitem group by 1) select o_orderkey, case when n is null then 'unknown' when r then 'returned' when f then 'final' when n>5 then 'manual_review' else 'open' end as status from orders left join g on o_orderkey=l_orderkey")
def status_cascade(spark, sf_dir):
    """A cascade of conditions over aggregated flags."""
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.col("l_returnflag") == "R").alias("r"), F.min(F.col("l_linestatus") == "F").alias("f"), F.count("*").alias("n"))
    s = F.when(F.col("n").isNull(), "unknown").when(F.col("r"), "returned").when(F.col("f"), "final").when(F.col("n") > 5, "manual_review").otherwise("open")
    return table(spark, sf_dir, "orders").select("o_orderkey").join(g, "o_orderkey", "left").select("o_orderkey", s.alias("status"))


@query("select l_partkey, count(distinct l_returnflag) as n_values, count(*) as n_rows from lineitem group by 1 having count(distinct l_returnflag)>1")
def conflict_groups(spark, sf_dir):
    """Parts with conflicting flags."""
    return A.conflict_groups(table(spark, sf_dir, "lineitem"), "l_partkey", "l_returnflag")


@query("select user_id, arg_min(event_type, (ts, event_id)) filter (where event_type is not null) as event_type, arg_min(value, (ts, event_id)) filter (where value is not null) as value from events group by 1")
def coalesce_dedupe(spark, sf_dir):
    """One row for each user, each field from its first known value."""
    return A.coalesce_dedupe(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_type", "value"])


@query("select event_id, user_id, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn=1")
def upsert_last_wins(spark, sf_dir):
    """What a merge of two batches leaves; nothing is deleted."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value", "ts")
    return V.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 <> 0 or event_id is null"), "user_id", [F.desc("ts"), F.desc("event_id")]).select("event_id", "user_id", "value")


INTERVAL = "iv as (select user_id, epoch_us(ts)//1000000 as s, epoch_us(ts)//1000000 + 1800 as e from events)"
MERGED = "m0 as (select *, max(e) over (partition by user_id order by s, e rows between unbounded preceding and 1 preceding) as r from iv), m1 as (select *, sum(case when r is null or s>r then 1 else 0 end) over (partition by user_id order by s, e rows unbounded preceding) as g from m0), merged as (select user_id, min(s) as s, max(e) as e from m1 group by user_id, g)"


def _intervals(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"), (F.unix_seconds(F.col("ts").cast("timestamp")) + 1800).alias("e"))


@query(f"with {INTERVAL}, {MERGED} select user_id, s, e from merged")
def interval_merge(spark, sf_dir):
    """Half-hour intervals around events, merged for each user."""
    return A.merge_intervals(_intervals(spark, sf_dir), "user_id", "s", "e")


@query(f"with {INTERVAL}, {MERGED} select user_id, e as s, n as e from (select user_id, e, lead(s) over (partition by user_id order by s) as n from merged) where n is not null")
def interval_gaps(spark, sf_dir):
    """The holes between them."""
    return A.interval_gaps(_intervals(spark, sf_dir), "user_id", "s", "e")


@query("select l_returnflag, round(quantile_cont(l_extendedprice,0.5),4) as p50, round(quantile_cont(l_extendedprice,0.9),4) as p90, round(avg(l_quantity),6) as mean_qty, max(l_quantity) as max_qty from lineitem group by 1")
def percentiles_r7(spark, sf_dir):
    """Exact percentiles with linear interpolation."""
    d = table(spark, sf_dir, "lineitem")
    p = A.percentiles(d, "l_returnflag", "l_extendedprice", (0.5, 0.9)).withColumnRenamed("l_returnflag", "of")
    d = d.groupBy("l_returnflag").agg(F.round(F.avg("l_quantity"), 6).alias("mean_qty"), F.max("l_quantity").alias("max_qty"))
    d = d.join(F.broadcast(p), F.col("l_returnflag").eqNullSafe(F.col("of")), "left")
    return d.select("l_returnflag", F.round("p0", 4).alias("p50"), F.round("p1", 4).alias("p90"), "mean_qty", "max_qty")


@query("select l_suppkey, l_extendedprice from (select l_suppkey, l_extendedprice, row_number() over (partition by l_suppkey order by l_extendedprice) as rn, count(*) over (partition by l_suppkey) as n from lineitem) where rn=greatest(1,ceil(n*0.95::decimal(10,4)))")
def percentile_nearest_rank(spark, sf_dir):
    """The nearest-rank 95th percentile of each supplier's prices."""
    return A.nearest_rank(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice", 0.95)


@query("with c as (select l_returnflag as k, case when l_quantity<2 then 0 when l_quantity<5 then 1 when l_quantity<10 then 2 when l_quantity<15 then 3 when l_quantity<30 then 4 else 5 end as class from lineitem), e as (select distinct k, unnest(range(6)) as class from c), g as (select k, class, count(*) as n from c group by all) select e.k as l_returnflag, cast(e.class as integer) as class, coalesce(n,0) as n, round(100.0*coalesce(n,0)/sum(coalesce(n,0)) over (partition by e.k),6) as share from e left join g on e.k=g.k and e.class=g.class")
def slope_classes(spark, sf_dir):
    """Fixed classes with counts and shares, empty ones included."""
    d = A.class_histogram(table(spark, sf_dir, "lineitem"), F.col("l_quantity"), (0, 2, 5, 10, 15, 30), "l_returnflag")
    return d.withColumn("share", F.round("share", 6))


@query("with a as (select l_returnflag, radians(fmod(l_extendedprice,360)) as r from lineitem), g as (select l_returnflag, sum(sin(r)) as s, sum(cos(r)) as c, count(*) as n from a group by 1) select l_returnflag, round(fmod(degrees(atan2(s,c))+360,360),5) as mean_deg, round(sqrt(s*s+c*c)/n,8) as resultant, n from g")
def circular_mean(spark, sf_dir):
    """Circular mean and resultant length."""
    d = A.circular_mean(table(spark, sf_dir, "lineitem"), F.col("l_extendedprice") % 360, "l_returnflag")
    return d.select("l_returnflag", F.round("mean_deg", 5).alias("mean_deg"), F.round("resultant", 8).alias("resultant"), "n")


@query("""with g as (select lang, count(*) as n, count(*) filter (where quality=1) as k from documents join labels using (doc_id) group by 1), p as (select lang, n, k, k*1.0/n as p from g)
select lang, n, k, round((p+3.841458820694124/(2*n)-1.959963984540054*sqrt(p*(1-p)/n+3.841458820694124/(4.0*n*n)))/(1+3.841458820694124/n),8) as lo, round(least(1.0,(p+3.841458820694124/(2*n)+1.959963984540054*sqrt(p*(1-p)/n+3.841458820694124/(4.0*n*n)))/(1+3.841458820694124/n)),8) as hi from p""")
def wilson_by_group(spark, sf_dir):
    """Wilson intervals of the share of good documents by language."""
    g = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("k"))
    lo, hi = A.wilson(F.col("k"), F.col("n"))
    return g.select("lang", "n", "k", F.round(lo, 8).alias("lo"), F.round(hi, 8).alias("hi"))


LABELLED = "lab as (select lang, quality=1 as y, n_chars>1000 as g, toxic=1 as t, (doc_id%97)/100.0 as p from documents join labels using (doc_id))"


def _labelled(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select("lang", (F.col("quality") == 1).alias("y"), (F.col("n_chars") > 1000).alias("g"), (F.col("toxic") == 1).alias("t"), (F.expr("doc_id % 97") / 100).alias("p"))


@query(f"with {LABELLED}, c as (select lang, count(*) filter (where y and g) as tp, count(*) filter (where not y and g) as fp, count(*) filter (where y and not g) as fn, count(*) filter (where not y and not g) as tn from lab group by 1) select lang, tp, fp, fn, tn, round(tp/nullif(tp+fp,0),8) as precision, round(tp/nullif(tp+fn,0),8) as recall, round(2*tp/nullif(2*tp+fp+fn,0),8) as f1 from c")
def confusion_f1(spark, sf_dir):
    """Confusion counts, precision, recall and F1."""
    d = A.confusion(_labelled(spark, sf_dir), F.col("y"), F.col("g"), "lang")
    return d.select("lang", "tp", "fp", "fn", "tn", *(F.round(c, 8).alias(c) for c in ("precision", "recall", "f1")))


@query(f"with {LABELLED}, c as (select lang, count(*) as n, count(*) filter (where y=t) as s, count(*) filter (where y) as a, count(*) filter (where t) as b from lab group by 1), e as (select *, (a*b+(n-a)*(n-b))*1.0/(n*n) as ch from c) select lang, n, round(case when ch>=1 then 1.0 else (s*1.0/n-ch)/(1-ch) end,8) as kappa from e")
def kappa(spark, sf_dir):
    """Agreement of two annotations."""
    return A.cohen_kappa(_labelled(spark, sf_dir), F.col("y"), F.col("t"), "lang").withColumn("kappa", F.round("kappa", 8))


@query(f"with {LABELLED}, b as (select cast(least(floor(p*10),9) as integer) as bin, p, case when y then 1.0 else 0.0 end as y from lab) select bin, count(*) as n, round(avg(p),8) as mean_p, round(avg(y),8) as rate, round(sum((p-y)*(p-y)),6) as brier_sum from b group by 1")
def reliability_table(spark, sf_dir):
    """Reliability by bin."""
    d = A.reliability(_labelled(spark, sf_dir), F.col("p"), F.col("y"))
    return d.select("bin", "n", F.round("mean_p", 8).alias("mean_p"), F.round("rate", 8).alias("rate"), F.round("brier_sum", 6).alias("brier_sum"))


@query(f"with {LABELLED}, b as (select cast(least(floor(p*10),9) as integer) as bin, p, case when y then 1.0 else 0.0 end as y from lab), r as (select bin, count(*) as n, avg(p) as mp, avg(y) as ry, sum((p-y)*(p-y)) as bs from b group by 1) select sum(n)::bigint as n, round(sum(bs)/sum(n),8) as brier, round(sum(n*abs(mp-ry))/sum(n),8) as ece from r")
def brier_ece(spark, sf_dir):
    """Brier score and expected calibration error."""
    d = A.calibration_errors(A.reliability(_labelled(spark, sf_dir), F.col("p"), F.col("y")))
    return d.select("n", F.round("brier", 8).alias("brier"), F.round("ece", 8).alias("ece"))


@query("with g as (select l_returnflag, count(*) as n, regr_slope(l_extendedprice,l_quantity) as a, regr_intercept(l_extendedprice,l_quantity) as b, regr_sxx(l_extendedprice,l_quantity) as sxx, regr_syy(l_extendedprice,l_quantity) as syy, regr_sxy(l_extendedprice,l_quantity) as sxy from lineitem group by 1) select l_returnflag, n, round(a,4) as slope, round(b,3) as intercept, round(sqrt((syy-sxy*sxy/sxx)/n),3) as rmse from g")
def affine_fit(spark, sf_dir):
    """Least-squares line and its error."""
    d = A.affine_fit(table(spark, sf_dir, "lineitem"), F.col("l_quantity"), F.col("l_extendedprice"), "l_returnflag")
    return d.select("l_returnflag", "n", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("rmse", 3).alias("rmse"))


@query("select o_orderkey, case when o_orderdate is null then 'unknown_time' when o_orderdate>timestamp '1998-01-01'+interval 1 day then 'future' when o_orderdate<timestamp '1998-01-01'-interval 365 day then 'stale' else 'fresh' end as freshness from orders")
def freshness(spark, sf_dir):
    """fresh, stale, future or unknown; equal to the limit is fresh."""
    now, at = F.lit("1998-01-01").cast("timestamp"), F.col("o_orderdate")
    f = F.when(at.isNull(), "unknown_time").when(at > now + F.expr("interval 1 day"), "future").when(at < now - F.expr("interval 365 days"), "stale").otherwise("fresh")
    return table(spark, sf_dir, "orders").select("o_orderkey", f.alias("freshness"))


@query("select p_partkey, lower(p_name) as folded, len(list_filter(string_split_regex(lower(p_name),'[^a-z0-9]+'), lambda x: x<>'')) as n_tokens from part")
def fold_tokenize(spark, sf_dir):
    """Folded labels and their tokens."""
    return table(spark, sf_dir, "part").select("p_partkey", S.fold(F.col("p_name")).alias("folded"), F.size(S.tokens(F.col("p_name"))).cast("bigint").alias("n_tokens"))


TRI = "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({0}),'[^a-z0-9]+'), lambda w: w<>''), lambda w: list_transform(range(1, len(w)+2), lambda i: substr('  '||w||' ', i, 3)))))"


@query(f"""with a as (select n_nationkey, n_name, {TRI.format('n_name')} as t from nation)
select x.n_nationkey as a, y.n_nationkey as b, round(len(list_intersect(x.t,y.t))*1.0/(len(x.t)+len(y.t)-len(list_intersect(x.t,y.t))),8) as similarity from a x join a y on x.n_nationkey<y.n_nationkey where len(list_intersect(x.t,y.t))>0""")
def trigram_pairs(spark, sf_dir):
    """Trigram similarity of nation names, through shared trigrams."""
    d = S.trigram_join(table(spark, sf_dir, "nation"), "n_nationkey", "n_name")
    return d.withColumn("similarity", F.round("similarity", 8))


@query(f"""with q as (select n_nationkey, n_name from nation), a as (select s_suppkey, s_name, {TRI.format('s_name')} as t from supplier), b as (select n_nationkey, {TRI.format("'supplier '||n_nationkey")} as t from q),
s as (select n_nationkey, s_suppkey, len(list_intersect(a.t,b.t))*1.0/(len(a.t)+len(b.t)-len(list_intersect(a.t,b.t))) as sim from a, b where len(list_intersect(a.t,b.t))>0)
select n_nationkey, s_suppkey, round(sim,8) as similarity, cast(rn as integer) as rank from (select *, row_number() over (partition by n_nationkey order by round(sim,8) desc, s_suppkey) as rn from s) where rn<=3""")
def trigram_top_k(spark, sf_dir):
    """The three suppliers whose names are most like each query."""
    q = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("supplier "), F.col("n_nationkey").cast("string")).alias("text"))
    return S.trigram_top_k(q, "n_nationkey", "text", table(spark, sf_dir, "supplier"), "s_suppkey", "s_name", 3)


@query("select c_custkey, substr(md5(concat_ws('|', c_name, cast(c_nationkey as varchar))),1,16) as stable_id from customer")
def stable_ids(spark, sf_dir):
    """Ids from hashed content."""
    return table(spark, sf_dir, "customer").select("c_custkey", S.stable_id("c_name", F.col("c_nationkey").cast("string")).alias("stable_id"))


@query("select date_trunc('hour', ts) as hour, event_type, count(*) as n, round(sum(value),4) as total, count(*) > 20 as limited from events group by 1,2")
def fixed_window_limit(spark, sf_dir):
    """Counts in fixed windows against a limit."""
    d = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return d.select(F.col("w.start").alias("hour"), "event_type", "n", "total", (F.col("n") > 20).alias("limited"))


@query("select user_id, event_id, count(*) over (partition by user_id order by epoch_us(ts) range between 59999999 preceding and current row) as in_window from events")
def sliding_rates(spark, sf_dir):
    """Events of a user in the last 60 seconds, at each event."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(us).rangeBetween(-59_999_999, 0)
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.count("*").over(w).alias("in_window"))


@query("select doc_id, md5(text) as hash, octet_length(encode(text)) as n_bytes from documents")
def manifest_hashes(spark, sf_dir):
    """Content hashes (MD5) and sizes."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("hash"), F.octet_length("text").cast("bigint").alias("n_bytes"))


@query()
def html_records(spark, sf_dir):
    """Title, language and counts of links and paragraphs of pages."""
    return T.html_records(table(spark, sf_dir, "pages"), "page_id", "html")


@query()
def quantities(spark, sf_dir):
    """Numbers with units in documents."""
    return T.quantities(table(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def doc_segments(spark, sf_dir):
    """Spans that tile each document, without overlap or structure."""
    return T.segments(table(spark, sf_dir, "documents"), "doc_id", "text")
