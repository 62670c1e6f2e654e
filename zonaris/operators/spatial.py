"""Overlay, nearest and range joins of rectangles and points, by grid cells.

Geometries are axis-parallel boxes (x0, y0, x1, y1) or points (x, y) in a metric plane; `polygons` refines the same joins for
shapes. Every join deals both sides by grid cells and joins equal cells. A box lies on the grid level whose cells are at least its
size, so it touches at most four of them, and shows there and on the coarser levels that the other side uses; a pair meets
on the coarser level of the two, in the cell that holds the lower-left corner of the boxes' intersection, so it comes once and no distinct is
needed. Refinement is column arithmetic, inside code generation.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonaris.operators import classes as C
from zonaris.sources.shared import written

BOX = ("x0", "y0", "x1", "y1")
REAL_SHARE, TOLERANCE = 1e-6, 0.1


def _level(size: float, margin: float) -> Column:
    wide = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) + 2 * margin
    return F.greatest(F.ceil(F.log2(F.greatest(wide, F.lit(size)) / size)), F.lit(0)).cast("int")


def cells(df: DataFrame, size: float, levels: Sequence[int], margin: float = 0.0) -> DataFrame:
    """`df` once for each cell (cl, cx, cy) that its box, widened by `margin`, touches on its own level (`own`) and the coarser ones of
    `levels`; rows with a null corner go."""
    d = df.dropna(subset=list(BOX)).withColumn("own", _level(size, margin))
    d = d.withColumn("cl", F.explode(F.filter(F.array(*(F.lit(x) for x in levels)), lambda x: x >= F.col("own"))))
    cell = F.lit(float(size)) * F.pow(F.lit(2.0), F.col("cl"))
    at = lambda c, by: F.floor((F.col(c) + by) / cell)
    d = d.withColumn("cx", F.explode(F.sequence(at("x0", -margin), at("x1", margin))))
    return d.withColumn("cy", F.explode(F.sequence(at("y0", -margin), at("y1", margin))))


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumnsRenamed({c: prefix + c for c in df.columns})


def box_join(left: DataFrame, right: DataFrame, size: float, margin: float = 0.0) -> DataFrame:
    """All pairs (columns l_*, r_*) whose boxes, the left one widened by `margin`, touch or overlap."""
    used = left.select(_level(size, margin).alias("x")).union(right.select(_level(size, 0.0).alias("x"))).distinct().where("x is not null")
    levels = sorted(r["x"] for r in used.collect()) or [0]  # about log2 of the largest extent
    a = _prefixed(cells(left, size, levels, margin), "l_")
    b = _prefixed(cells(right, size, levels), "r_")
    meet = (F.col("l_cl") == F.col("r_cl")) & (F.col("l_cx") == F.col("r_cx")) & (F.col("l_cy") == F.col("r_cy"))
    touch = (
        (F.col("l_x0") - margin <= F.col("r_x1"))
        & (F.col("r_x0") <= F.col("l_x1") + margin)
        & (F.col("l_y0") - margin <= F.col("r_y1"))
        & (F.col("r_y0") <= F.col("l_y1") + margin)
    )
    cell = F.lit(float(size)) * F.pow(F.lit(2.0), F.col("l_cl"))
    corner = (F.floor(F.greatest(F.col("l_x0") - margin, "r_x0") / cell) == F.col("l_cx")) & (F.floor(F.greatest(F.col("l_y0") - margin, "r_y0") / cell) == F.col("l_cy"))
    once = F.col("l_cl") == F.greatest("l_own", "r_own")
    return a.join(b, meet & once & touch & corner).drop(*(f"{s}_{c}" for s in "lr" for c in ("cl", "cx", "cy", "own")))


def box_area(x0: str, y0: str, x1: str, y1: str) -> Column:
    return (F.col(x1) - F.col(x0)) * (F.col(y1) - F.col(y0))


def shared_area() -> Column:
    """Area that the two boxes of a `box_join` row share; 0 for mere contact."""
    w = F.least("l_x1", "r_x1") - F.greatest("l_x0", "r_x0")
    h = F.least("l_y1", "r_y1") - F.greatest("l_y0", "r_y0")
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def overlay_shares(parcels: DataFrame, zones: DataFrame, key: str, zone_key: str, size: float) -> DataFrame:
    """One row for each parcel and zone that touch: area, share in percent, whether it only touches, rank and dominance.

    An area above 1e-6 is a real share, capped at 100; anything less is boundary contact with area and share 0. Rank is
    by area, then zone key; the first real share dominates. Contact never becomes a share.
    """
    pair = box_join(parcels, zones, size).withColumn("area", shared_area())
    whole = box_area("l_x0", "l_y0", "l_x1", "l_y1")
    pair = pair.withColumn("touches", F.col("area") <= REAL_SHARE)
    pair = pair.withColumn("area", F.when(F.col("touches"), 0.0).otherwise(F.col("area").cast("double")))
    pair = pair.withColumn("share", F.least(F.lit(100.0), 100.0 * F.col("area") / whole))
    by = Window.partitionBy(f"l_{key}").orderBy(F.desc("area"), f"r_{zone_key}")
    pair = pair.withColumn("rank", F.row_number().over(by))
    return pair.withColumn("dominant", (F.col("rank") == 1) & ~F.col("touches"))


def coverage(shares: DataFrame, key: str) -> DataFrame:
    """For each parcel of `overlay_shares`: sum of shares, covered percentage, overlap percentage and review flag.

    Covered is the area of the union of the clipped zones; it is measured exactly over the grid that the clips' own
    edges span, so equal and overlapping zones count once. Shares are never scaled to 100.
    """
    clip = shares.where("not touches").select(
        F.col(f"l_{key}").alias(key), F.greatest("l_x0", "r_x0").alias("x0"), F.greatest("l_y0", "r_y0").alias("y0"), F.least("l_x1", "r_x1").alias("x1"), F.least("l_y1", "r_y1").alias("y1"), box_area("l_x0", "l_y0", "l_x1", "l_y1").alias("whole")
    )
    union = union_area(clip.select(key, *BOX), key)
    sums = shares.groupBy(F.col(f"l_{key}").alias(key)).agg(F.sum("share").alias("total"), F.max(F.col("touches").cast("int")).alias("any_touch"), F.max(box_area("l_x0", "l_y0", "l_x1", "l_y1")).alias("whole"))
    out = sums.join(union, key, "left").withColumn("covered", 100.0 * F.coalesce("union_area", F.lit(0.0)) / F.col("whole"))
    out = out.withColumn("overlap", F.greatest(F.lit(0.0), F.col("total") - F.col("covered")))
    return out.withColumn("review", (F.col("overlap") > TOLERANCE) | (F.col("covered") < 100 - TOLERANCE) | (F.col("any_touch") == 1)).select(key, "total", "covered", "overlap", "review")


def union_area(boxes: DataFrame, key: str) -> DataFrame:
    """(key, union_area) of the distinct boxes of each key: slabs between neighbouring x edges, merged in y by a running maximum.

    A key's boxes are expected to be few, as those that clip one parcel are; nothing but windows is used.
    """
    d = boxes.distinct()
    edge = d.select(key, F.explode(F.array("x0", "x1")).alias("x")).distinct()
    slab = edge.withColumn("x_next", F.lead("x").over(Window.partitionBy(key).orderBy("x"))).where("x_next is not null")
    part = slab.join(d, key).where("x0 <= x and x1 >= x_next").select(key, "x", "x_next", "y0", "y1")
    before = Window.partitionBy(key, "x").orderBy("y0", "y1").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("y1") - F.greatest("y0", F.coalesce(F.max("y1").over(before), F.col("y0"))))
    return part.withColumn("h", new).groupBy(key).agg(F.sum((F.col("x_next") - F.col("x")) * F.col("h")).cast("double").alias("union_area"))


def self_overlaps(boxes: DataFrame, key: str, size: float, least: float) -> DataFrame:
    """(a, b, area) with a < b for every two boxes that share more than `least`."""
    pair = C.paired(boxes, boxes, BOX, BOX, lambda a, b: box_join(a, b, size).withColumn("area", shared_area()).where(F.col("area") > least))
    return pair.where(F.col(f"l_{key}") < F.col(f"r_{key}")).select(F.col(f"l_{key}").alias("a"), F.col(f"r_{key}").alias("b"), "area")


def point_distance(x: str, y: str, box: Sequence[str] = ("l_x0", "l_y0", "l_x1", "l_y1")) -> Column:
    """Distance from a box to a point, 0 inside."""
    dx = F.greatest(F.col(box[0]) - F.col(x), F.lit(0), F.col(x) - F.col(box[2]))
    dy = F.greatest(F.col(box[1]) - F.col(y), F.lit(0), F.col(y) - F.col(box[3]))
    return F.sqrt((dx * dx + dy * dy).cast("double"))


def within(parcels: DataFrame, points: DataFrame, radius: float, size: float) -> DataFrame:
    """All pairs of a box (l_*) and a point (r_*) at most `radius` apart, with `distance`."""
    p = points.withColumns({"x0": F.col("x"), "x1": F.col("x"), "y0": F.col("y"), "y1": F.col("y")})
    return box_join(parcels, p, size, margin=radius).withColumn("distance", point_distance("r_x", "r_y")).where(F.col("distance") <= radius)


def nearest_k(parcels: DataFrame, points: DataFrame, key: str, point_key: str, k: int, radius: float, size: float) -> DataFrame:
    """The k nearest points of each parcel within `radius`; ties by point key."""
    by = Window.partitionBy(f"l_{C.OWN}").orderBy("distance", f"r_{point_key}")
    first = Window.partitionBy("x", "y").orderBy(point_key)  # of points in one place no more than the k first can be among the nearest
    points = points.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k).drop("place")
    values, members = C.classed(parcels, BOX, C.OWN)
    near = within(values, points, radius, size).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return C.spread(near.drop(*(f"l_{c}" for c in BOX)), C.prefixed(members, "l_"), f"l_{C.OWN}")


def nearest_expanding(parcels: DataFrame, points: DataFrame, key: str, point_key: str, radii: Sequence[float], size: float) -> DataFrame:
    """The nearest point of each parcel and the first radius that holds it; parcels without one have `no_match`.

    Radius by radius, only parcels without a match go on, on a grid as wide as the radius. Distances count in millimetres, then the
    point key decides, so that rounding noise cannot. What is left after a step is written to the shared folder. Of points in one place
    the least key goes before the others, and parcels of equal box find the same point.
    """
    first = points.groupBy("x", "y").agg(F.min(point_key).alias(point_key))
    d = C.each(parcels.select(key, *BOX), BOX, lambda v: _nearest_expanding(v, first, C.OWN, point_key, radii, size), name=C.OWN)
    return d.select(key, "nearest", "distance", "radius", "status")


def _nearest_expanding(parcels: DataFrame, points: DataFrame, key: str, point_key: str, radii: Sequence[float], size: float) -> DataFrame:
    left, found = parcels.select(key, *BOX), []
    best = F.min(F.struct(F.round(F.col("distance") * 1000).cast("bigint").alias("mm"), F.col(f"r_{point_key}").alias("id"), "distance")).alias("best")
    for r in sorted(radii):
        hit = written(within(left, points, r, max(size, 2.0 * r)).groupBy(F.col(f"l_{key}").alias(key)).agg(best), "nearest")
        found.append(hit.select(key, "best", F.lit(float(r)).alias("radius")))
        left = left.join(hit, key, "left_anti")
    every = reduce(DataFrame.unionByName, found)
    out = parcels.select(key).join(every, key, "left")
    return out.select(key, F.col("best.id").alias("nearest"), F.col("best.distance").alias("distance"), "radius", F.when(F.col("best").isNull(), "no_match").otherwise("match").alias("status"))


def ring_statistics(parcels: DataFrame, points: DataFrame, key: str, value: str, radii: Sequence[float], size: float) -> DataFrame:
    """Count, sum, median, least and largest distance of the points within each radius of each parcel.

    A ring without points has count 0 and nulls elsewhere: unknown is not zero.
    """
    d = C.each(parcels.select(key, *BOX), BOX, lambda v: _ring_statistics(v, points, C.OWN, value, radii, size), name=C.OWN)
    return d.select(key, "radius", "n", "sum_value", "median_value", "min_distance", "max_distance")


def _ring_statistics(parcels: DataFrame, points: DataFrame, key: str, value: str, radii: Sequence[float], size: float) -> DataFrame:
    pair = within(parcels, points, max(radii), size).withColumn("radius", F.explode(F.array(*(F.lit(float(r)) for r in radii)))).where("distance <= radius")
    got = pair.groupBy(F.col(f"l_{key}").alias(key), "radius").agg(F.count("*").alias("n"), F.sum(f"r_{value}").alias("sum_value"), F.percentile(f"r_{value}", F.lit(0.5)).alias("median_value"), F.min("distance").alias("min_distance"), F.max("distance").alias("max_distance"))
    every = parcels.select(key, F.explode(F.array(*(F.lit(float(r)) for r in radii))).alias("radius"))
    return every.join(got, [key, "radius"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def split_slivers(shares: DataFrame, key: str, percent: float = 0.5, area: float = 1.0) -> DataFrame:
    """`shares` with `sliver`: below both bounds, unless all rows of the parcel are."""
    small = (F.col("share") < percent) & (F.col("area") < area)
    solid = F.sum((~small).cast("int")).over(Window.partitionBy(key))
    return shares.withColumn("sliver", small & (solid > 0))


def extent(boxes: DataFrame, key: str) -> DataFrame:
    """(key, x0, y0, x1, y1): the box around each key's boxes."""
    return boxes.groupBy(key).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
