"""Simplification of neighbouring shapes without gaps or overlaps: an arc table.

Rings are cut at nodes, the points where borders part: where three shapes meet, or one leaves the border of another. What lies
between two nodes is an arc. Neighbours hold the same arc, one of them backwards, so an arc in its least direction is a key; each is
simplified once, by tolerance, and rings are put together again from their arcs. Everything is joins and groups of rows of
points, arcs or rings; only the cutting of one ring and the simplification of one arc are Arrow functions.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonaris.functions import geometry as G
from zonaris.functions import planar as L
from zonaris.operators import spatial as S

DIGITS = 6  # points are snapped to micrometres


def _cut(x: list[float], y: list[float], node: list[bool]) -> list[dict]:
    """Arcs of a ring in order: seq, forward, line (x, y, ...), and whether the ring has fewer than three."""
    p = list(zip(x, y, strict=True))
    at = [i for i, n in enumerate(node) if n]
    if at:
        parts = [[*p[a:b]] if a < b else [*p[a:], *p[:b]] for a, b in zip(at, [*(i + 1 for i in at[1:]), at[0] + 1], strict=True)]
        if len(at) == 1:
            parts = [[*p[at[0] :], *p[: at[0] + 1]]]
    else:  # a ring that meets no other, or the same one: from its least point, in its least direction
        k = min(range(len(p)), key=lambda i: p[i])
        parts = [[*p[k:], *p[:k], p[k]]]
    out = []
    for seq, part in enumerate(parts):
        forward = part <= part[::-1]
        out.append({"seq": seq, "forward": forward, "line": [c for q in (part if forward else part[::-1]) for c in q], "few": len(parts) < 3})
    return out


_arc = pa.list_(pa.struct([("seq", pa.int32()), ("forward", pa.bool_()), ("line", pa.list_(pa.float64())), ("few", pa.bool_())]))
cut = G.shape_function(_cut, "array<struct<seq:int,forward:boolean,line:array<double>,few:boolean>>", _arc)


def _simplified(line: list[float], few: bool, tolerances: list[float]) -> list[list[float]]:
    """The arc at each tolerance. A closed arc keeps three points, and an arc of a ring of two keeps its farthest, so that no ring is lost."""
    p = np.array(line).reshape(-1, 2)
    out = []
    for tolerance in tolerances:
        far = 1 + int(np.argmax(((p[1:-1] - p[0]) ** 2).sum(1))) if len(p) > 2 else 0
        if (p[0] == p[-1]).all() and len(p) > 3:
            a, b = L.simplified_line(p[: far + 1], tolerance), L.simplified_line(p[far:], tolerance)
            q = np.vstack([a[:-1], b])
            if len(q) < 4:
                off = L.W._to_edge(p[:, 0], p[:, 1], *p[0], *p[far])
                keep = sorted({0, far, int(np.argmax(off)), len(p) - 1})
                q = p[keep]
        else:
            q = L.simplified_line(p, tolerance)
            if few and len(q) == 2 and len(p) > 2:
                off = L.W._to_edge(p[:, 0], p[:, 1], *p[0], *p[-1])
                q = p[[0, int(np.argmax(off)), len(p) - 1]] if off.max() > 0 else q
        out.append(q.ravel().tolist())
    return out


_lines = pa.list_(pa.list_(pa.float64()))
simplified = G.shape_function(_simplified, "array<array<double>>", _lines)


def ring_points(shapes: DataFrame, key: str, size: float) -> DataFrame:
    """(key, ring, i, t, x, y): the points of all rings in order (i, t), with a point wherever a corner of some ring lies on an edge.

    Corners and edges meet by the grid of boxes of cell size `size`.
    """
    rings = shapes.select(key, F.posexplode("shape").alias("ring", "flat"))
    n = F.floor(F.size("flat") / 2).cast("int")
    same = (F.get("flat", F.lit(0)) == F.get("flat", 2 * n - 2)) & (F.get("flat", F.lit(1)) == F.get("flat", 2 * n - 1))
    rings = rings.withColumn("n", n - F.when(same & (n > 1), 1).otherwise(0)).where("n >= 3")
    at = lambda k: F.round(F.get("flat", k), DIGITS)
    ends = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(i.alias("i"), at(i * 2).alias("x"), at(i * 2 + 1).alias("y"), at((i + 1) % F.col("n") * 2).alias("u"), at((i + 1) % F.col("n") * 2 + 1).alias("v")))
    e = rings.select(key, "ring", F.inline(ends)).where("x <> u or y <> v")
    box = [F.least("x", "u").alias("x0"), F.least("y", "v").alias("y0"), F.greatest("x", "u").alias("x1"), F.greatest("y", "v").alias("y1")]
    corner = e.select("x", "y").distinct()
    corner = corner.select(F.col("x").alias("vx"), F.col("y").alias("vy"), *(F.col(c).alias(f"{c}{k}") for k in (0, 1) for c in "xy"))
    d = S.box_join(e.select("*", *box), corner, size)
    dx, dy = F.col("l_u") - F.col("l_x"), F.col("l_v") - F.col("l_y")
    px, py = F.col("r_vx") - F.col("l_x"), F.col("r_vy") - F.col("l_y")
    t = (px * dx + py * dy) / (dx * dx + dy * dy)
    on = (F.abs(dx * py - dy * px) <= 0.75 * 10.0**-DIGITS * F.hypot(dx, dy)) & (t > 0) & (t < 1)
    on = on & ~((F.col("r_vx") == F.col("l_u")) & (F.col("r_vy") == F.col("l_v"))) & ~((F.col("r_vx") == F.col("l_x")) & (F.col("r_vy") == F.col("l_y")))
    inner = d.where(on).select(F.col(f"l_{key}").alias(key), F.col("l_ring").alias("ring"), F.col("l_i").alias("i"), t.alias("t"), F.col("r_vx").alias("x"), F.col("r_vy").alias("y"))
    return e.select(key, "ring", "i", F.lit(0.0).alias("t"), "x", "y").union(inner)


def arcs_of(shapes: DataFrame, key: str, size: float) -> DataFrame:
    """(key, ring, seq, forward, line, few): the arcs of all rings, `line` in its least direction."""
    points = ring_points(shapes, key, size)
    ordered = points.groupBy(key, "ring").agg(F.sort_array(F.collect_list(F.struct("i", "t", "x", "y"))).alias("p"))  # one ring, as in its input row
    n = F.size("p")
    near = F.transform("p", lambda q, i: F.struct(q["x"].alias("x"), q["y"].alias("y"), F.array(F.get("p", (i + 1) % n), F.get("p", (i + n - 1) % n)).alias("near")))
    step = ordered.select(F.inline(near)).select("x", "y", F.explode("near").alias("q")).select("x", "y", F.col("q.x").alias("u"), F.col("q.y").alias("v"))
    nodes = step.distinct().groupBy("x", "y").agg(F.count("*").alias("ways")).where("ways <> 2").select("x", "y", F.lit(True).alias("node"))
    marked = points.join(nodes, ["x", "y"], "left").groupBy(key, "ring").agg(F.sort_array(F.collect_list(F.struct("i", "t", "x", "y", F.coalesce("node", F.lit(False)).alias("node")))).alias("p"))
    return marked.select(key, "ring", F.inline(cut(F.col("p.x"), F.col("p.y"), F.col("p.node"))))


def simplified_shapes(shapes: DataFrame, key: str, tolerances: Sequence[float], size: float) -> DataFrame:
    """(key, level, shape): each shape at each tolerance (level counts them from 0), neighbours along the same lines.

    `shapes` has `key` (unique) and `shape`; rings should be valid (`planar.repaired`). Shapes that are equal, or lie on each other, share their arcs,
    too. No ring is lost; borders nearer to each other than the tolerance may cross, which leaves all sums of areas as they are. A null shape, or one
    without rings, gives no rows.
    """
    arcs = arcs_of(shapes, key, size)
    lines = arcs.groupBy("line").agg(F.max("few").alias("few"))
    lines = lines.select("line", simplified("line", "few", F.array(*(F.lit(float(t)) for t in tolerances))).alias("levels"))
    d = arcs.join(lines, "line").select(key, "ring", "seq", "forward", F.posexplode("levels").alias("level", "flat"))
    count = F.floor(F.size("flat") / 2).cast("int")
    step = lambda k: F.when(F.col("forward"), k).otherwise(count - 1 - k)
    points = F.flatten(F.transform(F.sequence(F.lit(0), count - 2), lambda k: F.array(F.get("flat", step(k) * 2), F.get("flat", step(k) * 2 + 1))))  # the last point begins the next arc
    rings = d.select(key, "ring", "level", "seq", points.alias("points")).groupBy(key, "ring", "level").agg(F.flatten(F.sort_array(F.collect_list(F.struct("seq", "points")))["points"]).alias("flat"))
    return rings.groupBy(key, "level").agg(F.sort_array(F.collect_list(F.struct("ring", "flat")))["flat"].alias("shape"))
