"""Queries of grids in blocks, budgets that refuse and imports in stages. They join `catalog.QUERIES`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonaris.operators import blocks as B
from zonaris.operators import budgets as U
from zonaris.operators import releases as R
from zonaris.plans.catalog import ORACLE_SQL, query, table
from zonaris.sources.shared import new_folder

N = 16


def grid(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.expr("p_partkey div 40").alias("i"), (k % 40).alias("j"), F.col("p_retailprice").alias("z"))


@query(ORACLE_SQL["slope_grid"])
def slope_blocks(spark, sf_dir):
    """The slopes of `slope_grid` from blocks of 16 x 16 cells that exchange their edges."""
    b = B.blocks_of(grid(spark, sf_dir), N)
    got = B.cells_of(B.slopes(b, N), N, "slope")
    return grid(spark, sf_dir).select("i", "j").join(got, ["i", "j"], "left").select("i", "j", F.round("z", 4).alias("slope"))


@query("select p_partkey//40 as i, p_partkey%40 as j, p_retailprice as z from part where p_partkey//40 between 3 and 40 and p_partkey%40 between 5 and 20")
def grid_window(spark, sf_dir):
    """A window of a grid that is stored in blocks; only its folders and blocks are read."""
    path = new_folder(spark, "grid")
    B.write_blocks(B.blocks_of(grid(spark, sf_dir), N), path)
    d = B.cells_of(B.window(spark, path, 3, 5, 40, 20, N), N)
    return d.where("i between 3 and 40 and j between 5 and 20").select("i", "j", "z")


@query()
def adaptive_profiles(spark, sf_dir):
    """Profiles of the grid along a line for each supplier, halved until the ground between two points is within 5 of straight."""
    b = B.blocks_of(grid(spark, sf_dir), N)
    k = F.col("s_suppkey")
    lines = table(spark, sf_dir, "supplier").select(k, (k % 30).cast("double").alias("x0"), (k % 4).cast("double").alias("y0"), ((k * 7) % 39).cast("double").alias("x1"), ((k * 3) % 5).cast("double").alias("y1"))
    return B.profiles(lines, b, N, "s_suppkey", 5.0, 8.0, 0.2)


@query("""with recursive e as (select o_custkey as budget, o_orderkey as entry, round(o_totalprice,2) as amount, row_number() over (partition by o_custkey order by o_orderkey) as i from orders), step as (
select budget, entry, i, amount<=300000 as ok, case when amount<=300000 then amount else 0 end as held from e where i=1 union all
select e.budget, e.entry, e.i, p.held+e.amount<=300000, case when p.held+e.amount<=300000 then p.held+e.amount else p.held end from step p join e on e.budget=p.budget and e.i=p.i+1)
select budget, entry, case when ok then 'admitted' else 'refused' end as outcome, round(cast(held as double),2) as held from step""")
def budget_admission(spark, sf_dir):
    """Orders as reservations on their customer's budget, admitted in order; those that do not fit are refused, later ones still judged; each entry comes twice."""
    o = table(spark, sf_dir, "orders")
    e = o.select(F.col("o_custkey").alias("budget"), F.col("o_orderkey").alias("entry"), F.col("o_orderkey").alias("at"), F.lit("reserve").alias("kind"), F.col("o_orderkey").cast("string").alias("ref"), F.round("o_totalprice", 2).alias("amount"))
    limits = o.select(F.col("o_custkey").alias("budget"), F.lit(300000).alias("amount_limit")).distinct()
    d = U.admitted(e.union(e), limits, 2**40)
    return d.select("budget", "entry", "outcome", F.col("held").cast("double").alias("held"))


@query("""with n as (select count(*) as z, count(*) filter (where s_acctbal<-900) as low from supplier), a as (select count(*) as acts from nation), s as (select * from (values (1,'activated',1),(2,'unchanged',1),(3,'refused',null),(4,'activated',2),(5,'activated',3)) v(step, status, number))
select step, status, cast(number as integer) as number, case when step=3 then z else z-low end as zones_read, case step when 3 then 0 else (select count(*) from supplier where not s_acctbal<-900 and (step<>4 or s_suppkey%50<>1)) end as shown, acts from s, n, a""".replace("case when step=3 then z else z-low end as zones_read", "case step when 4 then (select count(*) from supplier where s_suppkey%50<>1) when 5 then z else z end as zones_read"))
def import_release(spark, sf_dir):
    """Two layers imported in stages: shown, unchanged when run again, refused by the gate, shown with fewer zones, rolled back."""
    root = new_folder(spark, "store")
    zones = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    acts = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rules = {"zones": [("missing_id", F.col("s_suppkey").isNull()), ("low", F.col("s_acctbal") < -900)]}
    gate = R.Gate(rejected=0.5, required=("zones", "acts"))
    bad = {**rules, "zones": [("all", F.lit(True))]}
    fewer = zones.where("s_suppkey % 50 <> 1")
    out = [R.run_import(spark, root, {"zones": z, "acts": acts}, r, gate) for z, r in ((zones, rules), (zones.repartition(3), rules), (zones, bad), (fewer, rules))] + [R.roll_back(spark, root)]
    rows = []
    for step, o in enumerate(out, 1):
        shown = R.read(spark, root, "zones", o.number).count() if o.number else 0
        rows.append((step, o.status, o.number, o.layers["zones"]["read"], shown, o.layers["acts"]["read"]))
    return spark.createDataFrame(rows, "step int, status string, number int, zones_read bigint, shown bigint, acts bigint")
