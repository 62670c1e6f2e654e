"""Tables of vector tiles from shapes and lines, by zoom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonaris.functions import tiles as T

EXTENT, MARGIN = 4096, 64


def on_tiles(features: DataFrame, origin: tuple[float, float], world: float, zooms: dict[int, float], extent: int = EXTENT, margin: int = MARGIN) -> DataFrame:
    """`features` once for each zoom and tile (z, tx, ty) that they reach, margin included, with `commands` (tile units, clipped).

    `features` has kind (`area` or `line`), shape (rings, or lines) and its box x0, y0, x1, y1. The world is a square of side `world` whose upper
    left corner is `origin`; zoom z has 2**z tiles a side. `zooms` gives each zoom's tolerance in tile units: coarse zooms are generalised. A feature of which
    nothing is left on a tile, or with a null shape, has no row there.
    """
    left, top = origin
    d = features.select("*", F.explode(F.create_map(*(F.lit(v) for z, t in zooms.items() for v in (int(z), float(t))))).alias("z", "tolerance"))
    side = F.lit(float(world)) / F.pow(F.lit(2.0), F.col("z"))
    pad = side * margin / extent
    last = F.pow(F.lit(2.0), F.col("z")).cast("bigint") - 1
    at = lambda v: F.greatest(F.lit(0), F.least(last, F.floor(v / side)))
    d = d.dropna(subset=["shape", "x0", "y0", "x1", "y1"])
    d = d.withColumn("tx", F.explode(F.sequence(at(F.col("x0") - pad - left), at(F.col("x1") + pad - left))))
    d = d.withColumn("ty", F.explode(F.sequence(at(top - F.col("y1") - pad), at(top - F.col("y0") + pad))))
    bx, by = left + F.col("tx") * side, top - F.col("ty") * side
    made = T.geometry("kind", "shape", bx, by - side, bx + side, by, F.lit(extent), F.lit(margin), "tolerance")
    return d.withColumn("commands", made).where("commands is not null").drop("tolerance")


def tile_table(placed: DataFrame, layer: str, key: str, rank: Column, properties: list[str], most: int = 10_000, extent: int = EXTENT) -> DataFrame:
    """(z, tx, ty, layer, n, left_out, tile): one encoded layer for each tile and value of `layer`.

    A tile holds the first `most` features by `rank` and key, which bounds a row and is what a map shows; how many were left out is told beside it.
    """
    w = Window.partitionBy("z", "tx", "ty", layer)
    d = placed.withColumn("place", F.row_number().over(w.orderBy(rank, key)))
    props = F.array(*(F.struct(F.lit(p).alias("k"), F.col(p).cast("string").alias("v")) for p in properties)) if properties else F.array().cast("array<struct<k:string,v:string>>")
    row = F.struct("place", F.col(key).cast("bigint").alias("id"), "kind", "commands", props.alias("properties"))
    g = d.groupBy("z", "tx", "ty", F.col(layer).alias("layer")).agg(F.count_if(F.col("place") <= most).alias("n"), F.count_if(F.col("place") > most).alias("left_out"), F.sort_array(F.collect_list(F.when(F.col("place") <= most, row))).alias("rows"))
    return g.select("z", "tx", "ty", "layer", "n", "left_out", T.encoded_layer("layer", "rows", F.lit(extent)).alias("tile"))
