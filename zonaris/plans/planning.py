"""Further queries over the driver's tables: evaluation, registry, rasters, tiles, streams. They join `catalog.QUERIES`."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from zonaris.operators import aggregates as A
from zonaris.operators import evaluation as E
from zonaris.operators import raster as R
from zonaris.operators import spatial as G
from zonaris.plans.catalog import CELL, INTERVAL, PARCEL, _intervals, parcels, points, query, table
from zonaris.streaming import windows as W


@query("select c_nationkey, min((c_custkey*37)%1000) as x0, min((c_custkey*91)%1000) as y0, max((c_custkey*37)%1000+5+c_custkey%20) as x1, max((c_custkey*91)%1000+5+c_custkey%20) as y1 from customer group by 1")
def extent_by_nation(spark, sf_dir):
    """The extent of each nation's parcels."""
    d = parcels(spark, sf_dir).join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    return G.extent(d, "c_nationkey")


@query("select s_nationkey, round(avg((s_suppkey*53)%1000),6) as x, round(avg((s_suppkey*29)%1000),6) as y, count(*) as n from supplier group by 1")
def centroid_by_nation(spark, sf_dir):
    """A10: the centroid of each nation's points."""
    d = points(spark, sf_dir).join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey")
    return d.groupBy("s_nationkey").agg(F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"), F.count("*").alias("n"))


@query("select p_partkey, p_brand || case when rn>1 then '-'||rn else '' end as identifier, n>1 as duplicated from (select p_partkey, p_brand, row_number() over (partition by p_brand, p_size order by p_partkey) as rn, count(*) over (partition by p_brand, p_size) as n from part)")
def duplicate_suffix(spark, sf_dir):
    """Repeated identifiers get a running suffix."""
    w = Window.partitionBy("p_brand", "p_size")
    d = table(spark, sf_dir, "part").withColumns({"rn": F.row_number().over(w.orderBy("p_partkey")), "n": F.count("*").over(w)})
    return d.select("p_partkey", F.concat("p_brand", F.when(F.col("rn") > 1, F.concat(F.lit("-"), "rn")).otherwise("")).alias("identifier"), (F.col("n") > 1).alias("duplicated"))


@query("select o_orderpriority, case when o_orderstatus='P' then 'pending' when o_totalprice<50000 then 'too_small' when o_totalprice>400000 then 'too_large' else '' end as reason, count(*) as n, max(o_orderdate) as latest from orders group by 1,2")
def layer_statistics(spark, sf_dir):
    """Rows accepted and rejected by reason in each layer."""
    reason = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_totalprice") < 50000, "too_small").when(F.col("o_totalprice") > 400000, "too_large").otherwise("")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority", reason.alias("reason")).agg(F.count("*").alias("n"), F.max("o_orderdate").alias("latest"))


@query("with a as (select distinct o_custkey as k, o_orderpriority as g from orders where o_orderdate<timestamp '1996-01-01'), b as (select distinct o_custkey as k, o_orderpriority as g from orders where o_orderdate>=timestamp '1995-01-01') select coalesce(a.g,b.g) as g, count(*) as n_union, count(*) filter (where a.k is null) as n_added, count(*) filter (where b.k is null) as n_removed, round((count(*) filter (where a.k is null or b.k is null))*1.0/count(*),8) as drift from a full join b on a.k=b.k and a.g=b.g group by 1")
def drift_rate(spark, sf_dir):
    """Symmetric difference over union of two key sets, by group."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("g"), "o_orderdate")
    d = E.drift(o.where("o_orderdate < timestamp'1996-01-01'"), o.where("o_orderdate >= timestamp'1995-01-01'"), "k", "g")
    return d.withColumn("drift", F.round("drift", 8))


@query("""with o as (select o_custkey as k, count(*) as n, sum(cast(round(o_totalprice*100) as bigint)) as cents from orders where o_orderdate<timestamp '1995-01-01' group by 1), w as (select o_custkey as k, count(*) as n, sum(cast(round(o_totalprice*100) as bigint)) as cents from orders where o_orderdate>=timestamp '1995-01-01' group by 1),
a as (select k, 'n' as field, cast(n as bigint) as v from o union all select k, 'cents', cast(cents as bigint) from o), b as (select k, 'n' as field, cast(n as bigint) as v from w union all select k, 'cents', cast(cents as bigint) from w)
select coalesce(a.k,b.k) as k, coalesce(a.field,b.field) as field, case when a.k is null then 'unexpected' when b.k is null then 'missing' when abs(a.v-b.v)<=2 then 'equal' else 'different' end as verdict from a full join b on a.k=b.k and a.field=b.field""")
def field_comparison(spark, sf_dir):
    """Two runs compared field by field with a tolerance."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k")
    run = lambda d: d.groupBy("k").agg(F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"))
    return E.compare_fields(run(o.where("o_orderdate < timestamp'1995-01-01'")), run(o.where("o_orderdate >= timestamp'1995-01-01'")), "k", ["n", "cents"], 2)


@query("""with t as (select distinct l_orderkey as k, l_linenumber as v from lineitem where l_returnflag='A'), p as (select distinct l_orderkey as k, l_linenumber as v from lineitem where l_linestatus='F' and l_quantity>10),
c as (select coalesce(t.k,p.k) as k, count(t.k) as n_true, count(p.k) as n_found, count(*) filter (where t.k is not null and p.k is not null) as n_both from t full join p on t.k=p.k and t.v=p.v group by 1)
select k as l_orderkey, n_true, n_found, n_both, case when n_true=0 then 'fp' when n_found=0 then 'fn' when n_both=n_true and n_both=n_found then 'exact' when n_both>0 then 'partial' else 'wrong' end as verdict from c""")
def extraction_verdicts(spark, sf_dir):
    """Expected values against found values, one verdict for each key."""
    d = table(spark, sf_dir, "lineitem")
    return E.verdicts(d.where("l_returnflag = 'A'"), d.where("l_linestatus = 'F' and l_quantity > 10"), "l_orderkey", "l_linenumber")


@query("select f.field, count(*) as total, count(*) filter (where f.ok) as known, round(100.0*(count(*) filter (where f.ok))/count(*),6) as percent from (select 'text' as field, text is not null and text<>'' as ok from documents union all select 'lang', lang is not null from documents union all select 'source', source is not null from documents union all select 'long', n_chars>1000 from documents) f group by 1")
def completeness_matrix(spark, sf_dir):
    """Known and total values of every field in one scan."""
    c = {"text": F.col("text").isNotNull() & (F.col("text") != ""), "lang": F.col("lang").isNotNull(), "source": F.col("source").isNotNull(), "long": F.col("n_chars") > 1000}
    return E.completeness(table(spark, sf_dir, "documents"), c).withColumn("percent", F.round("percent", 6))


@query("""with l as (select lang, quality=1 as a, toxic=1 as b from documents join labels using (doc_id)), c as (select lang, count(*) filter (where a and not b) as only_a, count(*) filter (where b and not a) as only_b from l group by 1)
select lang, only_a, only_b, case when only_a+only_b=0 then 1.0 else round(least(1.0, 2*list_sum(list_transform(range(0, least(only_a,only_b)+1), lambda k: exp(lgamma(only_a+only_b+1)-lgamma(k+1)-lgamma(only_a+only_b-k+1)-(only_a+only_b)*ln(2))))),6) end as p from c""")
def mcnemar_exact(spark, sf_dir):
    """Exact two-sided McNemar test of two annotations."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    c = d.groupBy("lang").agg(F.count_if((F.col("quality") == 1) & (F.col("toxic") != 1)).alias("only_a"), F.count_if((F.col("toxic") == 1) & (F.col("quality") != 1)).alias("only_b"))
    return c.withColumn("p", F.round(E.mcnemar(F.col("only_a"), F.col("only_b")), 6))


@query("select event_type, count(value) as n, round(quantile_cont(value,0.5),6) as p50, round(quantile_cont(value,0.95),6) as p95, max(value) as largest from events group by 1")
def latency_summary(spark, sf_dir):
    """Median, 95th percentile and maximum."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("value").alias("n"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"), F.max("value").alias("largest"))


@query(f"with {INTERVAL}, d as (select distinct user_id, s, e from iv) select user_id, s, e from (select *, max(e) over (partition by user_id order by s, e desc rows between unbounded preceding and 1 preceding) as r from d) where r is null or e>r")
def outermost_intervals(spark, sf_dir):
    """Intervals that no other interval contains."""
    return A.outermost(_intervals(spark, sf_dir).distinct(), "user_id", "s", "e").select("user_id", "s", "e")


@query("select event_id, last_value(case when value>50 then event_type end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as heading from events")
def heading_carried_forward(spark, sf_dir):
    """The last heading before each row."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", F.last(F.when(F.col("value") > 50, F.col("event_type")), ignorenulls=True).over(w).alias("heading"))


@query("select l_orderkey, l_linenumber, (select max(o_orderdate) from orders where o_custkey=l_suppkey and o_orderdate<=l_shipdate) as since from lineitem")
def as_of_join(spark, sf_dir):
    """The latest version at or before each probe, by one union and a running maximum."""
    probe = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("k"), F.col("l_shipdate").alias("t"))
    version = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("since"))
    return E.as_of(probe, version, "k", "t", "since").select("l_orderkey", "l_linenumber", "since")


@query("select o_custkey, o_orderkey, cast(rn as integer) as rank, n>3 as truncated from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc nulls last, o_orderkey) as rn, count(*) over (partition by o_custkey) as n from orders) where rn<=3")
def top_k_truncated(spark, sf_dir):
    """The first three of each group, and whether there were more."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey")
    d = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rank"), F.lead("o_orderkey", 1).over(w).isNotNull().alias("more"))
    d = d.where("rank <= 3")
    return d.withColumn("truncated", F.max((F.col("rank") == 3) & F.col("more")).over(Window.partitionBy("o_custkey"))).drop("more")


@query("select o_custkey, string_agg(o_orderstatus, ',' order by d, k) as statuses from (select o_custkey, o_orderstatus, min(o_orderdate) as d, min(o_orderkey) as k from orders group by 1,2) group by 1")
def ordered_dedupe(spark, sf_dir):
    """Distinct statuses in the order of their first appearance; no more than there are statuses are gathered."""
    f = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.min("o_orderdate").alias("d"), F.min("o_orderkey").alias("k"))
    return f.groupBy("o_custkey").agg(F.concat_ws(",", F.sort_array(F.collect_list(F.struct("d", "k", "o_orderstatus")))["o_orderstatus"]).alias("statuses"))


@query("with active as (select distinct user_id from events where event_type='purchase' and event_id%50=0), new as (select user_id, min(event_id) as event_id from events where event_type='click' group by 1) select user_id, event_id from new where user_id not in (select user_id from active)")
def insert_or_ignore(spark, sf_dir):
    """U8: one new job for each scope that has no active one."""
    e = table(spark, sf_dir, "events")
    new = e.where("event_type = 'click'").groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    return new.join(e.where("event_type = 'purchase' and event_id % 50 = 0").select("user_id"), "user_id", "left_anti")


@query("select o_custkey, o_orderkey, o_orderkey=max(o_orderkey) over (partition by o_custkey) as is_active from orders")
def activate_latest(spark, sf_dir):
    """One active release in each scope, by an aggregation and a join on the scope."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    top = o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("top"))
    return o.join(top, "o_custkey").select("o_custkey", "o_orderkey", (F.col("o_orderkey") == F.col("top")).alias("is_active"))


@query("select o_custkey, o_orderkey, sum(cast(round(o_totalprice*100) as bigint)) over (partition by o_custkey order by o_orderdate desc, o_orderkey rows unbounded preceding) > 50000000 as pruned from orders")
def cache_prune(spark, sf_dir):
    """Entries beyond a size limit, newest first."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).over(w) > 50_000_000).alias("pruned"))


@query(f"with {PARCEL}, p as (select a.c_custkey as a, b.c_custkey as b from parcel a join parcel b on a.c_custkey<b.c_custkey and a.x0<b.x1 and b.x0<a.x1 and a.y0<b.y1 and b.y0<a.y1) select a as c_custkey from p union select b from p")
def overlapping_identifiers(spark, sf_dir):
    """Every parcel that overlaps another."""
    d = G.self_overlaps(parcels(spark, sf_dir), "c_custkey", CELL, 0.01)
    return d.select(F.explode(F.array("a", "b")).alias("c_custkey")).distinct()


@query("""with g as (select p_partkey//40 as i, p_partkey%40 as j, p_retailprice as z from part), o(di,dj,wx,wy) as (values (-1,-1,-1,-1),(-1,0,0,-2),(-1,1,1,-1),(0,-1,-2,0),(0,0,0,0),(0,1,2,0),(1,-1,-1,1),(1,0,0,2),(1,1,1,1)),
s as (select i-di as i, j-dj as j, sum(wx*z)/8 as gx, sum(wy*z)/8 as gy, count(*) as n from g, o group by 1,2)
select g.i, g.j, case when n=9 then round(degrees(atan(sqrt(gx*gx+gy*gy))),4) end as slope from g join s on g.i=s.i and g.j=s.j""")
def slope_grid(spark, sf_dir):
    """Slope in degrees by Horn's 3 x 3 weights; null where a neighbour is missing."""
    g = table(spark, sf_dir, "part").select(F.expr("p_partkey div 40").alias("i"), F.expr("p_partkey % 40").alias("j"), F.col("p_retailprice").alias("z"))
    return R.gradient(g, "i", "j", "z").select("i", "j", F.round("slope", 4).alias("slope"))


@query("with p as (select s_suppkey, 14+((s_suppkey*53)%1000)/100.0+0.0003 as lon, 49+((s_suppkey*29)%1000)*0.006+0.0002 as lat from supplier) select cast(floor((lon+180)/360*4096) as bigint) as tx, cast(floor((1-asinh(tan(radians(lat)))/pi())/2*4096) as bigint) as ty, count(*) as n from p group by 1,2")
def tile_counts(spark, sf_dir):
    """Points for each web-mercator tile of zoom 12."""
    p = table(spark, sf_dir, "supplier").select((14 + F.expr("s_suppkey * 53 % 1000") / 100 + 0.0003).alias("lon"), (49 + F.expr("s_suppkey * 29 % 1000") * 0.006 + 0.0002).alias("lat"))
    tx, ty = R.tile(F.col("lon"), F.col("lat"), 12)
    return p.groupBy(tx.alias("tx"), ty.alias("ty")).agg(F.count("*").alias("n"))


@query("""with p as (select c_custkey, (c_custkey*37)%1000 as x0, (c_custkey*91)%1000 as y0, 5+c_custkey%20 as s from customer)
select c_custkey, '{"type":"Feature","id":'||c_custkey||',"bbox":['||x0||','||y0||','||(x0+s)||','||(y0+s)||']}' as feature from p""")
def geojson_features(spark, sf_dir):
    """Features as GeoJSON text."""
    d = parcels(spark, sf_dir)
    return d.select("c_custkey", F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("c_custkey").alias("id"), F.array("x0", "y0", "x1", "y1").alias("bbox"))).alias("feature"))


@query("select date_trunc('month', o_orderdate) as m, cast(round(sum(case o_orderstatus when 'F' then cast(o_totalprice as decimal(18,3)) when 'P' then cast(o_totalprice*0.5 as decimal(18,3)) else 0 end),2) as double) as charged from orders group by 1")
def charge_ledger_decimal(spark, sf_dir):
    """Period sums with a charge that depends on status, in decimals, where half cents have one rounding."""
    p = F.col("o_totalprice")
    charge = F.when(F.col("o_orderstatus") == "F", p.cast("decimal(18,3)")).when(F.col("o_orderstatus") == "P", (p * 0.5).cast("decimal(18,3)")).otherwise(F.lit(0).cast("decimal(18,3)"))
    return table(spark, sf_dir, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("m")).agg(F.round(F.sum(charge), 2).cast("double").alias("charged"))


@query("select date_trunc('hour', ts) as hour, event_type, count(*) as n from events group by 1,2")
def stream_window_counts(spark, sf_dir):
    """Counts in fixed windows, kept up to date by a stream over the files of events."""
    e = W.file_stream(spark, f"{sf_dir}/events.parquet")
    return W.latest_by_batch(W.window_counts(e, "ts", "1 hour", "event_type"), ["hour", "event_type"])


@query("select user_id, min(event_id) as event_id from events group by 1")
def stream_first_of_key(spark, sf_dir):
    """U8: the least id of each key by a stream that keeps one state for each key."""
    e = W.file_stream(spark, f"{sf_dir}/events.parquet")
    return W.latest_by_batch(e.groupBy("user_id").agg(F.min("event_id").alias("event_id")), ["user_id"])
