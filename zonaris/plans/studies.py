"""Queries of evaluation studies, number rules, grids and projections. They join `catalog.QUERIES`."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonaris.functions import numbers as N
from zonaris.operators import aggregates as A
from zonaris.operators import studies as U
from zonaris.plans.catalog import query, table


@query("""with t as (select l_linenumber, count(*) filter (where l_returnflag='A' and l_quantity>40) as a, count(*) filter (where l_returnflag='A' and l_quantity<=40) as b, count(*) filter (where l_returnflag='R' and l_quantity>40) as c, count(*) filter (where l_returnflag='R' and l_quantity<=40) as d from lineitem group by 1)
select l_linenumber, a, round(least(1.0,(select sum(exp(lgamma(a+b+1)+lgamma(c+d+1)+lgamma(a+c+1)+lgamma(b+d+1)-lgamma(a+b+c+d+1)-lgamma(x+1)-lgamma(a+b-x+1)-lgamma(a+c-x+1)-lgamma(d-a+x+1))) from (select unnest(range(a,least(a+b,a+c)+1)) as x))),6) as p from t""")
def fisher_exact(spark, sf_dir):
    """Fisher's exact test, upper tail."""
    li = table(spark, sf_dir, "lineitem")
    large = F.col("l_quantity") > 40
    of = lambda f, big: F.count_if((F.col("l_returnflag") == f) & big)
    t = li.groupBy("l_linenumber").agg(of("A", large).alias("a"), of("A", ~large).alias("b"), of("R", large).alias("c"), of("R", ~large).alias("d"))
    return t.select("l_linenumber", "a", F.round(U.fisher_upper(F.col("a"), F.col("b"), F.col("c"), F.col("d")), 6).alias("p"))


POISSON = "+".join(f"cast(u>={p!r} as integer)" for p in U._POISSON)


@query(f"""with c as (select o_custkey as k, sum(cast(o_orderstatus='F' as integer)) as b, sum(cast(o_orderstatus='O' as integer)) as c, count(*) as n from orders group by 1),
r as (select round, k, b, c, n, case when round=0 then 1 else {POISSON} end as w from (select *, cast(('0x'||substr(md5('7:'||round||':'||k),1,8)) as bigint)/4294967296.0 as u from c, range(0,101) t(round))),
s as (select round, sum(c*w)*1.0/sum(n*w)-sum(b*w)*1.0/sum(n*w) as d, count(*) as m from r group by 1)
select max(m) as n_clusters, round(max(d) filter (where round=0),8) as difference, round(quantile_cont(d,0.025) filter (where round>0),8) as low, round(quantile_cont(d,0.975) filter (where round>0),8) as high from s""")
def bootstrap_difference(spark, sf_dir):
    """A seeded cluster bootstrap of the difference of two shares, clusters being customers."""
    hit = lambda s: (F.col("o_orderstatus") == s).cast("int")
    d = U.cluster_bootstrap(table(spark, sf_dir, "orders"), "o_custkey", hit("F"), hit("O"), 100, 7)
    return d.select("n_clusters", *(F.round(c, 8).alias(c) for c in ("difference", "low", "high")))


BINS = "bins as (select cast(least(floor(l_quantity/2.5),19) as integer) as k, count(*) as n, sum(cast(l_extendedprice>40000 or l_linenumber%5=0 as integer)) as good from lineitem group by 1)"


def _bins(spark, sf_dir) -> DataFrame:
    good = ((F.col("l_extendedprice") > 40000) | (F.col("l_linenumber") % 5 == 0)).cast("int")
    k = F.least(F.floor(F.col("l_quantity") / 2.5), F.lit(19)).cast("int")
    return table(spark, sf_dir, "lineitem").groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.sum(good).alias("good"))


@query(f"""with {BINS}, m as (select i.k as i, j.k as j, (select sum(good)*1.0/sum(n) from bins where k between i.k and j.k) as m from bins i join bins j on i.k<=j.k)
select b.k, b.n, round((select max(x) from (select i, min(m) as x from m where i<=b.k and j>=b.k group by i)),8) as fit from bins b""")
def isotonic_fit(spark, sf_dir):
    """Pooled adjacent violators over score bins."""
    d = U.isotonic(_bins(spark, sf_dir).withColumn("rate", F.col("good") / F.col("n")), "k", "rate", "n")
    return d.select("k", "n", F.round("fit", 8).alias("fit"))


@query(f"with {BINS}, c as (select k, sum(good) over (order by k desc) as g, sum(n) over (order by k desc) as t, sum(n) over () as a from bins), o as (select * from c where 1.0*g/t>=0.6) select k as threshold, round(1.0*g/t,8) as precision, round(1.0*t/a,8) as coverage from o where k=(select min(k) from o)")
def threshold_choice(spark, sf_dir):
    """The least threshold whose precision is enough, and what it covers."""
    d = U.threshold_for(_bins(spark, sf_dir), "k", "good", "n", 0.6)
    return d.select("threshold", F.round("precision", 8).alias("precision"), F.round("coverage", 8).alias("coverage"))


@query()
def logistic_weights(spark, sf_dir):
    """A logistic fit with an L2 pull and sign bounds."""
    li = table(spark, sf_dir, "lineitem")
    y = (F.col("l_quantity") + 10 * F.col("l_linenumber") > 60).cast("int")
    w = U.logistic_fit(li, [F.col("l_quantity") / 25, F.col("l_linenumber") / 4, F.col("l_tax")], y, [0, 0, 0, 0], 1.0, [0, 1, 1, -1])
    return spark.createDataFrame([(i, round(x, 5)) for i, x in enumerate(w)], "i int, weight double")


@query("select k, n, mean_p, rate, round(rate-mean_p,8) as error, n<30 as thin, rate<lag(rate) over (order by k) as falls from (select k, n, round((k+0.5)/20,8) as mean_p, round(1.0*good/n,8) as rate from bins)".replace("select k, n, mean_p", f"with {BINS} select k, n, mean_p", 1))
def calibration_bands(spark, sf_dir):
    """Errors of each band, bands that are thin, and where the rate falls against the order."""
    d = _bins(spark, sf_dir).select("k", "n", F.round((F.col("k") + 0.5) / 20, 8).alias("mean_p"), F.round(F.col("good") / F.col("n"), 8).alias("rate"))
    return d.select("*", F.round(F.col("rate") - F.col("mean_p"), 8).alias("error"), (F.col("n") < 30).alias("thin"), (F.col("rate") < F.lag("rate").over(Window.orderBy("k"))).alias("falls"))


_AT = "p as (select (s_suppkey*53%1000)/100.0 as x, (s_suppkey*s_suppkey*29%1000)/100.0 as y, (s_suppkey*7%11-5)/10.0 as e, (s_suppkey*3%7-3)/10.0 as g from supplier), q as (select cast(x as double) as x, cast(y as double) as y, cast(2*x-y+5+e as double) as u, cast(0.5*x+3*y-7+g as double) as v from p)"
_SUMS = "s as (select count(*) as n, sum(x) as sx, sum(y) as sy, sum(x*x) as xx, sum(x*y) as xy, sum(y*y) as yy, sum(u) as su, sum(x*u) as xu, sum(y*u) as yu, sum(v) as sv, sum(x*v) as xv, sum(y*v) as yv from q)"
_DET = "(xx*(yy*n-sy*sy)-xy*(xy*n-sy*sx)+sx*(xy*sy-yy*sx))"
_A, _B, _C = (
    lambda w: f"((x{w}*(yy*n-sy*sy)-xy*(y{w}*n-sy*s{w})+sx*(y{w}*sy-yy*s{w}))/det)",
    lambda w: f"((xx*(y{w}*n-sy*s{w})-x{w}*(xy*n-sy*sx)+sx*(xy*s{w}-y{w}*sx))/det)",
    lambda w: f"((xx*(yy*s{w}-y{w}*sy)-xy*(xy*s{w}-y{w}*sx)+x{w}*(xy*sy-yy*sx))/det)",
)


@query(f"""with {_AT}, {_SUMS}, d as (select *, {_DET} as det from s), f as (select n, {_A("u")} as a, {_B("u")} as b, {_C("u")} as c, {_A("v")} as d, {_B("v")} as e, {_C("v")} as f from d)
select max(n) as n, {", ".join(f"round(max({c}),5) as {c}" for c in "abcdef")}, round(sqrt(avg(pow(a*x+b*y+c-u,2)+pow(d*x+e*y+f-v,2))),4) as rmse from f, q""")
def affine_plane_fit(spark, sf_dir):
    """A plane affine transform by least squares from points that are off by a function of their key, and its rmse."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(k, ((k * 53 % 1000) / 100).alias("x"), ((k * k * 29 % 1000) / 100).alias("y"))
    u, v = N.affine((2.0, -1.0, 5.0, 0.5, 3.0, -7.0), F.col("x"), F.col("y"))
    d = U.affine_plane(s.select("x", "y", (u + (k * 7 % 11 - 5) / 10).alias("u"), (v + (k * 3 % 7 - 3) / 10).alias("v")), "x", "y", "u", "v")
    return d.select("n", *(F.round(c, 5).alias(c) for c in "abcdef"), F.round("rmse", 4).alias("rmse"))


@query("""with a as (select l_orderkey as s, l_suppkey%3 as z, l_returnflag as p, l_linestatus||l_linenumber%2 as v, l_linenumber%4>0 as src from lineitem), t as (select s, z, p, max(v) as v from a group by all), f as (select s, z, p, max(v) as v, bool_and(src) as src from a where s%5>0 group by all)
select t.p, case when f.v is null then 'missing' when not f.src then 'no_source' when f.v=t.v then 'exact' when left(f.v,1)=left(t.v,1) then 'partial' else 'wrong' end as verdict, count(*) as n from t left join f using (s,z,p) group by all""")
def parameter_verdicts(spark, sf_dir):
    """Verdicts by sample, zone and parameter; a value without its source does not count as found."""
    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("s"), (F.col("l_suppkey") % 3).alias("z"), F.col("l_returnflag").alias("p"), F.concat("l_linestatus", F.col("l_linenumber") % 2).alias("v"), (F.col("l_linenumber") % 4 > 0).alias("src"))
    t = a.groupBy("s", "z", "p").agg(F.max("v").alias("t"))
    f = a.where("s % 5 > 0").groupBy("s", "z", "p").agg(F.max("v").alias("f"), F.bool_and("src").alias("src"))
    verdict = F.when(F.col("f").isNull(), "missing").when(~F.col("src"), "no_source").when(F.col("f") == F.col("t"), "exact").when(F.left("f", F.lit(1)) == F.left("t", F.lit(1)), "partial").otherwise("wrong")
    return t.join(f, ["s", "z", "p"], "left").groupBy("p", verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("""with v as (select o_custkey%10 as item, case when o_orderkey%4>0 then cast(o_totalprice/100000 as integer) end as a, case when o_orderkey%5>0 then cast(o_totalprice/100000+(o_orderkey%7=0)::integer as integer) end as b from orders)
select item, count(*) as n, round(avg(cast((a is null)=(b is null) as integer)),8) as presence, round(avg(cast(a=b as integer)) filter (where a is not null and b is not null),8) as exact, round(avg(abs(a-b)) filter (where a is not null and b is not null),8) as mae,
round(1.0*count(*) filter (where a is not null and b is not null and a<>b and item>=5)/nullif(count(*) filter (where item>=5),0),8) as false_confidence from v group by 1""")
def annotator_agreement(spark, sf_dir):
    """Agreement of two annotators on presence and value, mean error, and wrong values held with confidence."""
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    near = lambda c: F.round(c).cast("int")
    v = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 10).alias("item"), F.when(k % 4 > 0, near(price / 100000)).alias("a"), F.when(k % 5 > 0, near(price / 100000 + (k % 7 == 0).cast("int"))).alias("b"))
    a, b = F.col("a"), F.col("b")
    both = a.isNotNull() & b.isNotNull()
    sure = F.col("item") >= 5
    return v.groupBy("item").agg(
        F.count("*").alias("n"), F.round(F.avg((a.isNull() == b.isNull()).cast("int")), 8).alias("presence"), F.round(F.avg(F.when(both, (a == b).cast("int"))), 8).alias("exact"), F.round(F.avg(F.when(both, F.abs(a - b))), 8).alias("mae"),
        F.round(F.try_divide(F.count_if(both & (a != b) & sure), F.count_if(sure)), 8).alias("false_confidence"),
    )


@query("with m as (select 'precision' as name, round(1.0*count(*) filter (where o_orderstatus='F')/count(*),8) as value from orders union all select 'recall', round(1.0*count(*) filter (where o_orderstatus='O')/count(*),8) from orders union all select 'latency', round(max(o_totalprice),2) from orders), g as (select * from (values ('precision','least',0.3),('recall','least',0.9),('latency','most',1000000.0),('coverage','least',0.5)) t(g,side,bound)) select g as name, value, side, cast(bound as double) as bound, coalesce(case when side='least' then value>=bound else value<=bound end,false) as passed from g left join m on name=g")
def acceptance_gate(spark, sf_dir):
    """Metrics against the bounds of a gate; a metric that is missing does not pass."""
    o = table(spark, sf_dir, "orders")
    share = lambda s: F.round(F.count_if(F.col("o_orderstatus") == s) / F.count("*"), 8)
    m = o.agg(share("F").alias("precision"), share("O").alias("recall"), F.round(F.max("o_totalprice"), 2).alias("latency")).unpivot([], ["precision", "recall", "latency"], "name", "value")
    return U.gate(m, "name", "value", {"precision": 0.3, "recall": 0.9, "coverage": 0.5}, {"latency": 1_000_000})


@query("""with a as (select l_orderkey as k, sum(l_linenumber) as v from lineitem where l_returnflag<>'N' group by 1), b as (select l_orderkey as k, sum(l_linenumber) as v from lineitem where l_linestatus='F' or l_returnflag='A' group by 1)
select case when b.k is null then 'only_old' when a.k is null then 'only_new' when a.v=b.v then 'same' when abs(a.v-b.v)<=2 then 'close' else 'apart' end as outcome, count(*) as n from a full join b on a.k=b.k group by 1""")
def shadow_comparison(spark, sf_dir):
    """A new engine beside the old one, outcome by outcome."""
    v = lambda c, n: table(spark, sf_dir, "lineitem").where(c).groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_linenumber").alias(n))
    d = v("l_returnflag <> 'N'", "a").join(v("l_linestatus = 'F' or l_returnflag = 'A'", "b"), "k", "full")
    a, b = F.col("a"), F.col("b")
    o = F.when(b.isNull(), "only_old").when(a.isNull(), "only_new").when(a == b, "same").when(F.abs(a - b) <= 2, "close").otherwise("apart")
    return d.groupBy(o.alias("outcome")).agg(F.count("*").alias("n"))


@query("select c_nationkey, c_custkey from (select c_nationkey, c_custkey, row_number() over (partition by c_nationkey order by md5('7:'||c_custkey), c_custkey) as rn from customer) where rn<=3")
def seeded_sample(spark, sf_dir):
    """Three rows of each group drawn by a seeded hash: the sampling operator of a study."""
    w = Window.partitionBy("c_nationkey").orderBy(F.md5(F.concat(F.lit("7:"), F.col("c_custkey"))), "c_custkey")
    return table(spark, sf_dir, "customer").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("c_nationkey", "c_custkey")


@query("with g as (select p_partkey%40 as j, p_partkey//40 as i, p_retailprice as z from part), o as (select i, j, z, z+case when (i*7+j)%11=0 then 0.8 else 0.1 end as w from g) select i, count(*) as n, count(*) filter (where abs(round(z-w,6))>0.5) as differing, count(*) filter (where abs(round(z-w,6))>0.5)>0 as review from o group by 1")
def terrain_cross_check(spark, sf_dir):
    """Cells where two sources of elevation differ by more than 0.5 m."""
    k = F.col("p_partkey")
    g = table(spark, sf_dir, "part").select(F.expr("p_partkey div 40").alias("i"), (k % 40).alias("j"), F.col("p_retailprice").alias("z"))
    d = g.withColumn("w", F.col("z") + F.when((F.col("i") * 7 + F.col("j")) % 11 == 0, 0.8).otherwise(0.1))
    far = F.count_if(F.abs(F.round(F.col("z") - F.col("w"), 6)) > 0.5)
    return d.groupBy("i").agg(F.count("*").alias("n"), far.alias("differing"), (far > 0).alias("review"))


@query("select l_suppkey%50 as point, count(*) as n, count(distinct l_returnflag) as codes, case when count(distinct l_returnflag)=1 then 'single' when count(*) filter (where l_returnflag='A')*2>count(*) then 'majority' else 'mixed' end as outcome, string_agg(distinct l_returnflag, ',' order by l_returnflag) as list from lineitem group by 1")
def code_summary(spark, sf_dir):
    """The codes that a point answered with, and whether they agree."""
    f = F.col("l_returnflag")
    one = F.countDistinct(f)
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 50).alias("point")).agg(F.count("*").alias("n"), one.alias("codes"), F.when(one == 1, "single").when(F.count_if(f == "A") * 2 > F.count("*"), "majority").otherwise("mixed").alias("outcome"), F.concat_ws(",", F.sort_array(F.collect_set(f))).alias("list"))


@query("select l_returnflag, cast(floor(((l_quantity*37)%360+22.5)/45) as integer)%8 as sector, count(*) as n, round(1.0*count(*)/sum(count(*)) over (partition by l_returnflag),8) as share from lineitem group by 1,2")
def sector_histogram(spark, sf_dir):
    """Angles in eight sectors around north."""
    angle = F.col("l_quantity") * 37 % 360
    d = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", (F.floor((angle + 22.5) / 45) % 8).cast("int").alias("sector")).agg(F.count("*").alias("n"))
    return d.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("l_returnflag")), 8))


@query("""with b as (select o_custkey as k, o_orderkey as a, o_orderkey+400 as b from orders where o_orderkey%2=0), c as (select o_custkey as k, o_orderkey as a, o_orderkey+150 as b from orders where o_orderkey%2=1), p as (select k, a as p from b union select k, b from b union select k, a from c union select k, b from c),
s as (select k, p, lead(p) over (partition by k order by p) as q from p), o as (select s.k, p, q from s where q is not null and exists (select 1 from b where b.k=s.k and b.a<=p and b.b>=q) and not exists (select 1 from c where c.k=s.k and c.a<=p and c.b>=q)),
g as (select *, sum(cast(coalesce(lq,-1)<>p as integer)) over (partition by k order by p) as g from (select *, lag(q) over (partition by k order by p) as lq from o)) select k, min(p) as a, max(q) as b from g group by k, g""")
def interval_subtraction(spark, sf_dir):
    """Intervals without others."""
    o = table(spark, sf_dir, "orders")
    of = lambda odd, n: o.where(F.col("o_orderkey") % 2 == odd).select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("a"), (F.col("o_orderkey") + n).alias("b"))
    return U.subtract_intervals(of(0, 400), of(1, 150), "k", "a", "b")


@query("select l_orderkey, l_linenumber, l_partkey, case when l_returnflag<>'N' and l_linenumber*1000+l_partkey%1000-last<=1500 then last end as noun_at from (select *, last_value(case when l_returnflag='N' then l_linenumber*1000+l_partkey%1000 end ignore nulls) over (partition by l_orderkey order by l_linenumber*1000+l_partkey%1000, l_suppkey rows between unbounded preceding and 1 preceding) as last from (select *, count(*) over (partition by l_orderkey, l_linenumber*1000+l_partkey%1000) as twins from lineitem) where twins=1)")
def noun_before_value(spark, sf_dir):
    """The nearest noun before each value, within a gap."""
    at = F.col("l_linenumber") * 1000 + F.col("l_partkey") % 1000
    li = table(spark, sf_dir, "lineitem").withColumn("at", at)
    li = li.withColumn("twins", F.count("*").over(Window.partitionBy("l_orderkey", "at"))).where("twins = 1")
    return U.previous_within(li, "l_orderkey", "at", F.col("l_returnflag") == "N", 1500).select("l_orderkey", "l_linenumber", "l_partkey", "noun_at")


GRID = "g as (select p_partkey//40 as i, p_partkey%40 as j, p_retailprice as z from part where p_partkey%97<>5)"


@query(f"""with {GRID}, p as (select c_custkey, (c_custkey*7%410)/10.0 as x, (c_custkey*3%500)/10.0 as y from customer), n as (select c_custkey, cast(floor(y) as bigint)+di as i, cast(floor(x) as bigint)+dj as j, (1-abs(y-floor(y)-di))*(1-abs(x-floor(x)-dj)) as w from p, range(0,2) a(di), range(0,2) b(dj))
select c_custkey, case when count(*)=count(z) then round(cast(sum(w*z) as double),6) end as z from n left join g on g.i=n.i and g.j=n.j where w>0 group by 1""")
def bilinear_samples(spark, sf_dir):
    """Bilinear samples of a grid, null where a needed cell is missing."""
    k = F.col("p_partkey")
    g = table(spark, sf_dir, "part").where("p_partkey % 97 <> 5").select(F.expr("p_partkey div 40").alias("i"), (k % 40).alias("j"), F.col("p_retailprice").alias("z"))
    c = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(c, (c * 7 % 410 / 10).alias("x"), (c * 3 % 500 / 10).alias("y"))
    return U.bilinear(p, g, "c_custkey").withColumn("z", F.round("z", 6))


def _tm():
    e, r = N._E, N.SCALE * N.RADIUS
    ath = lambda v: f"(0.5*ln((1+{v})/(1-{v})))"
    sinh = lambda v: f"((exp({v})-exp(-({v})))/2)"
    cosh = lambda v: f"((exp({v})+exp(-({v})))/2)"
    east = "+".join(["eta"] + [f"{a!r}*cos({2*j}*xi)*{sinh(f'{2*j}*eta')}" for j, a in enumerate(N.FORWARD, 1)])
    north = "+".join(["xi"] + [f"{a!r}*sin({2*j}*xi)*{cosh(f'{2*j}*eta')}" for j, a in enumerate(N.FORWARD, 1)])
    return f"""with p as (select event_id, radians(14+(event_id*7%1000)/100.0-19) as lam, sin(radians(49+(event_id*3%590)/100.0)) as sf from events), q as (select event_id, lam, {ath('sf')}-{e!r}*{ath(f'({e!r}*sf)')} as u from p), t as (select event_id, lam, {sinh('u')} as t from q),
x as (select event_id, atan2(t,cos(lam)) as xi, {ath('(sin(lam)/sqrt(1+t*t))')} as eta from t) select event_id, round({N.EAST!r}+{r!r}*({east}),3) as x, round({N.NORTH!r}+{r!r}*({north}),3) as y, true as back from x"""


@query(_tm())
def plane_coordinates(spark, sf_dir):
    """Degrees to the plane system 1992 and back."""
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").select(k, (14 + k * 7 % 1000 / 100).alias("lon"), (49 + k * 3 % 590 / 100).alias("lat"))
    x, y = N.to_plane(F.col("lon"), F.col("lat"))
    e = e.select("*", x.alias("x"), y.alias("y"))
    lon, lat = N.to_degrees(F.col("x"), F.col("y"))
    same = (F.abs(lon - F.col("lon")) < 1e-8) & (F.abs(lat - F.col("lat")) < 1e-8)
    return e.select("event_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), same.alias("back"))


@query("""with t as (select s_suppkey, 5+s_suppkey%4 as z, s_suppkey%32 as x, s_suppkey*3%32 as y from supplier), e as (select *, 2*pi()*6378137.0/pow(2,z) as size, pi()*6378137.0 as half from t)
select s_suppkey, round(x*size-half,3) as x0, round(half-(y+1)*size,3) as y0, round((x+1)*size-half,3) as x1, round(half-y*size,3) as y1, cast(floor((x*37-500)/16.0)*16 as bigint) as sx0, cast(ceil((x*37-500+90)/16.0)*16 as bigint) as sx1, cast(ceil((x*37-500+90)/16.0)-floor((x*37-500)/16.0) as bigint) as pixels from e""")
def tile_envelopes(spark, sf_dir):
    """Envelopes of tiles, a box moved outwards to a grid, and the pixels of the aligned window."""
    k = F.col("s_suppkey")
    t = table(spark, sf_dir, "supplier").select(k, (5 + k % 4).alias("z"), (k % 32).alias("x"), (k * 3 % 32).alias("y"))
    b = F.col("x") * 37 - 500
    s = N.snapped(b, b, b + 90, b + 90, 16)
    box = N.tile_envelope(F.col("z"), F.col("x"), F.col("y"))
    return t.select("s_suppkey", *(F.round(c, 3).alias(n) for c, n in zip(box, ("x0", "y0", "x1", "y1"), strict=True)), s[0].cast("bigint").alias("sx0"), s[2].cast("bigint").alias("sx1"), ((s[2] - s[0]) / 16).cast("bigint").alias("pixels"))


@query("""select l_orderkey, l_linenumber, round_even(l_quantity/2,0)+0.0 as half_even, greatest(l_quantity-25,0) as clamped, round(l_quantity*1e6/1e6/100,8) as ratio, case when l_linenumber%3=0 then l_orderkey+1 end as whole, case when l_quantity<=10 then 'high' when l_quantity<=25 then 'medium' when l_quantity<=40 then 'low' else 'extreme' end as period,
case when l_quantity>=40 then 3 when l_quantity>=20 then 2 when l_quantity>=10 then 1 else 0 end as theme from lineitem""")
def number_rules(spark, sf_dir):
    """Half-even rounding, clamps, units, whole numbers from text, classes by period and by breaks."""
    q, k = F.col("l_quantity"), F.col("l_linenumber")
    raw = F.when(k % 3 == 0, F.concat(F.lit(" "), F.col("l_orderkey") + 1)).when(k % 3 == 1, "-5").otherwise("x1")
    years = F.when(q <= 10, 10).when(q <= 25, 100).when(q <= 40, 500).otherwise(1000)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", N.even(q / 2).alias("half_even"), F.greatest(q - 25, F.lit(0.0)).alias("clamped"), F.round(q / 100, 8).alias("ratio"), N.positive_int(raw).alias("whole"), N.return_period(years).alias("period"), N.theme_class(q, [10, 20, 40]).alias("theme"))


@query("""select o_orderkey, case o_orderkey%4 when 0 then (o_orderkey%60)||' min' when 1 then (1+o_orderkey%40)||' h' when 2 then (2+o_orderkey%300)||' d' else 'unknown' end as age, case when o_orderkey%2=0 then (o_orderkey%900)||'.5 m²' else '1.25 ha' end as area, case when o_orderkey%3=2 then null else 'v'||o_orderkey end as found,
case o_orderkey%3 when 0 then strftime(o_orderdate,'%Y-%m-%d') when 1 then strftime(o_orderdate,'%Y-%m-%d') end as version from orders""")
def labels_and_aliases(spark, sf_dir):
    """Ages and areas in words, values under one of several names, versions in several spellings."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    age = F.when(k % 4 == 0, k % 60 * 60).when(k % 4 == 1, (1 + k % 40) * 3600).when(k % 4 == 2, (2 + k % 300) * 86400)
    props = F.when(k % 3 == 0, F.create_map(F.lit("ID_Plan"), F.concat(F.lit("v"), k), F.lit("b"), F.lit("x"))).when(k % 3 == 1, F.create_map(F.lit("idplan"), F.lit(" "), F.lit("NAZWA"), F.concat(F.lit("v"), k))).otherwise(F.create_map(F.lit("c"), F.lit("z")))
    raw = F.when(k % 3 == 0, F.date_format(d, "yyyyMMdd")).when(k % 3 == 1, F.date_format(d, "dd.MM.yyyy")).otherwise("soon")
    return table(spark, sf_dir, "orders").select("o_orderkey", N.age_label(age).alias("age"), N.area_label(F.when(k % 2 == 0, k % 900 + 0.5).otherwise(12500.0)).alias("area"), N.by_alias(props, ["id_plan", "IDPLAN", "nazwa"]).alias("found"), F.date_format(N.version_of(raw), "yyyy-MM-dd").alias("version"))


@query("""select p_partkey, case when p_partkey%3<2 then 'PL.ZIPPZP.'||p_partkey end as space, case when p_partkey%3<2 then 'POG_1' end as local, case when p_partkey%3=0 then '2024-05-01' end as version from part""")
def reference_ids(spark, sf_dir):
    """Namespace, local id and version of a reference id or link."""
    k = F.col("p_partkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit("https://x.example/id/PL.ZIPPZP."), k, F.lit("/POG_1/2024-05-01"))).when(k % 3 == 1, F.concat(F.lit("PL.ZIPPZP."), k, F.lit("/POG_1"))).otherwise("nothing")
    part = lambda i: F.nullif(F.regexp_extract(raw, r"(PL\.[A-Z]+\.\d+)/([^/]+)(?:/(\d{4}-\d{2}-\d{2}))?$", i), F.lit(""))
    return table(spark, sf_dir, "part").select("p_partkey", part(1).alias("space"), part(2).alias("local"), part(3).alias("version"))


@query("select * from (values ('c_acctbal','number',true),('c_custkey','key',true),('c_mktsegment','text',true),('c_name','text',true),('c_nationkey','key',true)) t(path,target,used), (select count(*) as present from customer)")
def mapped_paths(spark, sf_dir):
    """Leaf paths of a schema, the pattern that each falls under, and in how many rows it is present."""
    c = table(spark, sf_dir, "customer")
    patterns = spark.createDataFrame([("^.*key$", "key", 1), ("^c_acct.*", "number", 2), ("^c_(name|mkt.*)$", "text", 3), ("^unused$", "none", 4)], "pattern string, target string, turn int")
    seen = c.agg(*(F.count(n).alias(n) for n in c.columns)).unpivot([], c.columns, "path", "present")
    d = seen.join(F.broadcast(patterns), F.expr("path rlike pattern"), "left")
    return d.groupBy("path", "present").agg(F.min_by("target", "turn").alias("target"), (F.count("turn") > 0).alias("used"))
