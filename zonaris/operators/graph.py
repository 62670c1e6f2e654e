"""Connected components of pairs, for groups that overlaps or shared keys chain together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonaris.sources.shared import written


def groups(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(node, leader) for every node of `pairs`; the leader is the least node of its component.

    Nodes take the least leader of their neighbours, then the leader's own leader, until nothing changes: the second step halves
    the way that is left, so a chain of n pairs takes about log n rounds. Each round is written to the shared folder.
    """
    e = pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    e = written(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "pairs")
    now = written(e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("leader")), "leaders")
    while True:
        seen = e.join(now.select(F.col("u").alias("v"), F.col("leader").alias("of_v")), "v").groupBy("u").agg(F.min("of_v").alias("near"))
        step = now.join(seen, "u").select("u", F.least("leader", "near").alias("leader"))
        jump = step.alias("s").join(now.select(F.col("u").alias("leader"), F.col("leader").alias("up")), "leader", "left")
        new = written(jump.select("u", F.least("leader", F.coalesce("up", "leader")).alias("leader")), "leaders")
        changed = new.join(now.select("u", F.col("leader").alias("old")), "u").where("leader <> old").limit(1).count()
        now = new
        if not changed:
            return now.select(F.col("u").alias("node"), "leader")
