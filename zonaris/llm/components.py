"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

#: Parts into which the rows of one node are dealt, so that a node with many neighbours is no task of its own.
PARTS = 64


def with_least(edges: DataFrame, parts: int = PARTS) -> DataFrame:
    """`edges` (u, v) with `m`, the least v of each u: least of each part of a node's rows, then of its parts, then back."""
    d = edges.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(parts)))
    least = d.groupBy("u", "part").agg(F.min("v").alias("p"))
    whole = least.groupBy("u").agg(F.min("p").alias("m"))
    return d.join(least.join(whole, "u").select("u", "part", "m"), ["u", "part"]).select("u", "v", "m")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) for every node of `edges`; comp is the least node of its component.

    Each step links nodes to the least of their neighbours, so no neighbourhood is ever gathered in one place and a chain
    of n links takes about log n steps. Every step is written to the shared folder. Loops and repeated edges are allowed;
    rows with a null end are ignored; further columns, of any name, are ignored. No edges: no rows.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    e = materialize(e, "edges")
    seen = None
    while True:
        # large star: every larger neighbour of u moves to the least node that u knows, itself included
        both = with_least(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = both.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        # small star: the smaller neighbours of u, and u itself, move to the least of them
        small = with_least(large).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v")
        e = materialize(small.distinct(), "edges")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()
