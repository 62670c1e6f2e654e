"""Polygons as columns: measures, overlays and buffers in Arrow functions.

A shape is array<array<double>>: rings of x, y, x, y, ... that need not repeat their first point. A point belongs to a shape when
it lies inside an odd number of its rings, so holes and further parts are just more rings, whatever their direction.

Measures, shared areas, distances and masks of whole batches are in `sweep`; what gives new shapes is here, a shape at a time.

Overlays cut the plane into slabs at every vertex and crossing. Inside a slab no two edges cross, so the intervals between
neighbouring edges are trapezoids, and for each of them it is known which shapes it belongs to. Areas of any set expression
(shared, united, left over, masked by rank) are sums of trapezoids.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from zonaris.functions.sweep import apart, cover, holds, masked_areas, measure, meet, shared  # noqa: F401  (one place for all polygon functions)

SHAPE = "array<array<double>>"
EPS = 1e-9
Rings = list[np.ndarray]


def rings_of(shape: list[list[float]] | None) -> Rings:
    """Rings as (n, 2) arrays without a repeated last point; rings of fewer than three points go."""
    out = []
    for r in shape or []:
        p = np.asarray(r, float).reshape(-1, 2)
        if len(p) > 1 and (p[0] == p[-1]).all():
            p = p[:-1]
        if len(p) >= 3:
            out.append(p)
    return out


def edges_of(rings: Rings) -> np.ndarray:
    """(n, 4): x1, y1, x2, y2 of all edges."""
    return np.concatenate([np.hstack([p, np.roll(p, -1, 0)]) for p in rings]) if rings else np.zeros((0, 4))


def _crossings(e: np.ndarray) -> np.ndarray:
    """y of the points where edges cross or touch."""
    d = e[:, 2:] - e[:, :2]
    i, j = np.triu_indices(len(e), 1)
    meet = (np.minimum(e[i, 0], e[i, 2]) <= np.maximum(e[j, 0], e[j, 2])) & (np.minimum(e[j, 0], e[j, 2]) <= np.maximum(e[i, 0], e[i, 2]))
    meet &= (np.minimum(e[i, 1], e[i, 3]) <= np.maximum(e[j, 1], e[j, 3])) & (np.minimum(e[j, 1], e[j, 3]) <= np.maximum(e[i, 1], e[i, 3]))
    i, j = i[meet], j[meet]
    cross = d[i, 0] * d[j, 1] - d[i, 1] * d[j, 0]
    ok = np.abs(cross) > 1e-15
    i, j, cross = i[ok], j[ok], cross[ok]
    w = e[j, :2] - e[i, :2]
    t = (w[:, 0] * d[j, 1] - w[:, 1] * d[j, 0]) / cross
    u = (w[:, 0] * d[i, 1] - w[:, 1] * d[i, 0]) / cross
    on = (t >= -EPS) & (t <= 1 + EPS) & (u >= -EPS) & (u <= 1 + EPS)
    return e[i[on], 1] + t[on] * d[i[on], 1]


def trapezoids(shapes: list[Rings]) -> tuple[np.ndarray, np.ndarray]:
    """(n, 6) of y low, y high, left and right x at the low end, at the high end; and (n, shapes) of memberships."""
    every = [edges_of(s) for s in shapes]
    e, of = np.concatenate(every), np.repeat(np.arange(len(shapes)), [len(x) for x in every])
    if not len(e):
        return np.zeros((0, 6)), np.zeros((0, len(shapes)), bool)
    y = np.unique(np.concatenate([e[:, 1], e[:, 3], _crossings(e)]))
    y = y[np.concatenate(([True], np.diff(y) > EPS))]
    up = e[:, 1] != e[:, 3]
    e, of = e[up], of[up]
    flip = e[:, 1] > e[:, 3]
    e[flip] = e[flip][:, [2, 3, 0, 1]]
    slope = (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])
    boxes, members = [], []
    for lo, hi in zip(y[:-1], y[1:], strict=True):
        mid = (lo + hi) / 2
        on = np.flatnonzero((e[:, 1] <= mid) & (e[:, 3] >= mid))
        if len(on) < 2:
            continue
        on = on[np.argsort(e[on, 0] + (mid - e[on, 1]) * slope[on], kind="stable")]
        inside = np.cumsum(of[on][:, None] == np.arange(len(shapes)), 0)[:-1] % 2 == 1
        a, b = (e[on, 0] + (v - e[on, 1]) * slope[on] for v in (lo, hi))
        some = inside.any(1)
        boxes.append(np.column_stack([np.full(len(on) - 1, lo), np.full(len(on) - 1, hi), a[:-1], a[1:], b[:-1], b[1:]])[some])
        members.append(inside[some])
    return (np.concatenate(boxes), np.concatenate(members)) if boxes else (np.zeros((0, 6)), np.zeros((0, len(shapes)), bool))


def areas_of(t: np.ndarray) -> np.ndarray:
    return np.maximum((t[:, 1] - t[:, 0]) * ((t[:, 3] - t[:, 2]) + (t[:, 5] - t[:, 4])) / 2, 0)


def area_where(shapes: list[Rings], member: Callable[[np.ndarray], np.ndarray]) -> float:
    """Area of the points whose memberships (n, shapes) meet a condition."""
    t, m = trapezoids(shapes)
    return float(areas_of(t)[member(m)].sum()) if len(t) else 0.0


def shape_where(shapes: list[Rings], member: Callable[[np.ndarray], np.ndarray]) -> list[list[float]]:
    """The same points as a shape."""
    t, m = trapezoids(shapes)
    t = t[member(m)] if len(t) else t
    rings = outline(t)
    return [[a, lo, b, lo, d, hi, c, hi] for lo, hi, a, b, c, d in t[areas_of(t) > EPS].tolist()] if rings is None else rings


def outline(t: np.ndarray) -> list[list[float]] | None:
    """The boundary rings of trapezoids that do not overlap; null where rounding keeps a ring from closing.

    Sides are kept; level sides that two trapezoids share cancel. Each ring goes on from an end to any side that starts there: whichever is
    taken where rings touch, the odd rule gives the same points.
    """
    point: dict[tuple[float, float], tuple[float, float]] = {}
    next_: dict[tuple[float, float], list[tuple[float, float]]] = {}
    level: dict[float, dict[float, int]] = {}

    def at(x: float, y: float) -> tuple[float, float]:
        key = (round(x, 7) + 0.0, round(y, 7) + 0.0)
        point.setdefault(key, (x, y))
        return key

    def add(p: tuple[float, float], q: tuple[float, float]) -> None:
        if p != q:
            next_.setdefault(p, []).append(q)

    for lo, hi, a, b, c, d in t.tolist():
        p, q, r, s = at(a, lo), at(b, lo), at(d, hi), at(c, hi)
        add(q, r), add(s, p)
        for y, x0, x1, way in ((p[1], p[0], q[0], 1), (r[1], s[0], r[0], -1)):
            marks = level.setdefault(y, {})
            marks[x0] = marks.get(x0, 0) + way
            marks[x1] = marks.get(x1, 0) - way
    for y, marks in level.items():
        xs, n = sorted(marks), 0
        for x0, x1 in zip(xs, xs[1:], strict=False):
            n += marks[x0]
            if n:
                add(*(((x0, y), (x1, y)) if n > 0 else ((x1, y), (x0, y))))
    rings = []
    for start in list(next_):
        while next_.get(start):
            ring, here = [start], next_[start].pop()
            while here != start:
                if not next_.get(here):
                    return None
                ring.append(here)
                here = next_[here].pop()
            p = np.array([point[k] for k in ring])
            back, ahead = p - np.roll(p, 1, 0), np.roll(p, -1, 0) - p
            turn = np.abs(back[:, 0] * ahead[:, 1] - back[:, 1] * ahead[:, 0]) > 1e-9 * (np.abs(back).sum(1) + np.abs(ahead).sum(1) + 1e-3)
            if turn.sum() >= 3:
                rings.append(p[turn].ravel().tolist())
    return rings


def contains(rings: Rings, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether each point lies inside; on the boundary either way."""
    e = edges_of(rings)
    if not len(e):
        return np.zeros(len(x), bool)
    over = (e[:, 1][None] > y[:, None]) != (e[:, 3][None] > y[:, None])
    with np.errstate(divide="ignore", invalid="ignore"):
        at = e[:, 0] + (y[:, None] - e[:, 1]) * (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])
    return (over & (x[:, None] < at)).sum(1) % 2 == 1


def _to_edges(p: np.ndarray, e: np.ndarray) -> float:
    """Least distance of points to edges."""
    d = e[:, 2:] - e[:, :2]
    w = p[:, None] - e[None, :, :2]
    t = np.clip((w * d).sum(2) / np.maximum((d * d).sum(1), 1e-300), 0, 1)
    return float(np.sqrt((((w - t[..., None] * d) ** 2).sum(2)).min()))


def distance(a: Rings, b: Rings) -> float | None:
    """Least distance, 0 where they meet; null if one is empty."""
    if not a or not b:
        return None
    p, q = np.concatenate(a), np.concatenate(b)
    if contains(a, q[:, 0], q[:, 1]).any() or contains(b, p[:, 0], p[:, 1]).any():
        return 0.0
    e, f = edges_of(a), edges_of(b)
    d = min(_to_edges(q, e), _to_edges(p, f))
    if d > EPS and _cross(e, f):
        return 0.0
    return d if d > EPS else 0.0


def _cross(e: np.ndarray, f: np.ndarray) -> bool:
    side = lambda a, p: (a[:, None, 2] - a[:, None, 0]) * (p[None, :, 1] - a[:, None, 1]) - (a[:, None, 3] - a[:, None, 1]) * (p[None, :, 0] - a[:, None, 0])
    one = side(e, f[:, :2]) * side(e, f[:, 2:]) < 0
    two = (side(f, e[:, :2]) * side(f, e[:, 2:]) < 0).T
    return bool((one & two).any())


def _strokes(rings: Rings, radius: float, quarter: int) -> list[Rings]:
    """What lies within `radius` of the boundary: a rectangle for each edge, a regular polygon around each vertex."""
    turn = np.arange(4 * quarter) * (np.pi / 2 / quarter)
    circle = radius * np.column_stack([np.cos(turn), np.sin(turn)])
    out = [[p + circle] for r in rings for p in r]
    e = edges_of(rings)
    d = e[:, 2:] - e[:, :2]
    long = np.hypot(d[:, 0], d[:, 1])
    for (x1, y1, x2, y2), (dx, dy), n in zip(e, d, long, strict=True):
        if n > 0:
            nx, ny = -dy / n * radius, dx / n * radius
            out.append([np.array([[x1 + nx, y1 + ny], [x2 + nx, y2 + ny], [x2 - nx, y2 - ny], [x1 - nx, y1 - ny]])])
    return out


def buffered(rings: Rings, radius: float, quarter: int = 16) -> list[list[float]]:
    """The shape widened (radius above 0) or narrowed (below 0); arcs have `quarter` straight parts a quarter circle."""
    if radius == 0 or not rings:
        return [r.ravel().tolist() for r in rings]
    near = _strokes(rings, abs(radius), quarter)
    return shape_where([rings, *near], lambda m: m.any(1) if radius > 0 else m[:, 0] & ~m[:, 1:].any(1))


def ring_area(p: np.ndarray) -> float:
    q = np.roll(p, -1, 0)
    return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() / 2)


def simplified(p: np.ndarray, tolerance: float) -> np.ndarray:
    """A ring without points nearer than `tolerance` to the line between kept ones, cut at its first and farthest point; at least a triangle."""
    keep = np.zeros(len(p) + 1, bool)
    closed = np.vstack([p, p[:1]])
    far = int(np.argmax(((p - p[0]) ** 2).sum(1)))
    keep[[0, far, len(p)]] = True
    todo = [(0, far), (far, len(p))]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        e = np.concatenate([closed[a], closed[b]])[None]
        d = np.array([_to_edges(closed[k : k + 1], e) for k in range(a + 1, b)])
        at = int(np.argmax(d))
        if d[at] > tolerance:
            keep[a + 1 + at] = True
            todo += [(a, a + 1 + at), (a + 1 + at, b)]
    out = closed[:-1][keep[:-1]]
    return out if len(out) >= 3 else p


def shape_function(work: Callable, kind: str, typ: pa.DataType) -> Callable[..., Column]:
    """A column function; `work` gets a value of each argument, shapes as lists of flat rings, and is null where the first is."""

    def column(*cols: str | Column) -> Column:
        @F.arrow_udf(kind)
        def run(*args: pa.Array) -> pa.Array:
            return pa.array([None if r[0] is None else work(*r) for r in zip(*(a.to_pylist() for a in args), strict=True)], typ)

        return run(*cols)

    return column


_shape = pa.list_(pa.list_(pa.float64()))
_f = pa.float64()


def _measure(s):
    rings = rings_of(s)
    t, m = trapezoids([rings])
    w = areas_of(t)
    total = float(w.sum())
    long = sum(float(np.hypot(*(np.roll(p, -1, 0) - p).T).sum()) for p in rings)
    if total <= 0:
        return {"area": 0.0, "perimeter": long, "x": None, "y": None}
    cx = cy = 0.0
    for lo, hi, a, b, c, d in t.tolist():
        p = np.array([[a, lo], [b, lo], [d, hi], [c, hi]])
        q = np.roll(p, -1, 0)
        k = p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]
        cx, cy = cx + float(((p[:, 0] + q[:, 0]) * k).sum()) / 6, cy + float(((p[:, 1] + q[:, 1]) * k).sum()) / 6
    return {"area": total, "perimeter": long, "x": cx / total, "y": cy / total}


#: what two shapes share, and the first without the second, as shapes
shared_shape = shape_function(lambda a, b: shape_where([rings_of(a), rings_of(b)], lambda m: m.all(1)), SHAPE, _shape)
left_over = shape_function(lambda a, b: shape_where([rings_of(a), rings_of(b)], lambda m: m[:, 0] & ~m[:, 1]), SHAPE, _shape)
united = shape_function(lambda a, b: shape_where([rings_of(a), rings_of(b)], lambda m: m.any(1)), SHAPE, _shape)


def _nearest(p: np.ndarray, e: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(distance, point, foot) of the point and place on an edge that are nearest; in parts, so that memory is bounded."""
    best = (np.inf, p[0], p[0])
    d = e[:, 2:] - e[:, :2]
    for part in np.array_split(p, max(1, len(p) * len(e) // 1_000_000)):
        w = part[:, None] - e[None, :, :2]
        t = np.clip((w * d).sum(2) / np.maximum((d * d).sum(1), 1e-300), 0, 1)
        gap = np.hypot(*np.moveaxis(w - t[..., None] * d, 2, 0))
        i, j = np.unravel_index(int(np.argmin(gap)), gap.shape)
        if gap[i, j] < best[0]:
            best = (float(gap[i, j]), part[i], e[j, :2] + t[i, j] * d[j])
    return best


def _shortest(a, b):
    """The line from the first shape to the second; null where they meet or one is empty."""
    a, b = rings_of(a), rings_of(b)
    if not a or not b or not distance(a, b):
        return None
    one, two = _nearest(np.concatenate(a), edges_of(b)), _nearest(np.concatenate(b), edges_of(a))
    p, q = (one[1], one[2]) if one[0] <= two[0] else (two[2], two[1])
    return [float(v) for v in (*p, *q)]


#: the shortest line between two shapes (x, y, x, y), from the first one; null where they meet
shortest_line = shape_function(_shortest, "array<double>", pa.list_(_f))
#: a shape widened or narrowed by a radius
widened = shape_function(lambda s, r: buffered(rings_of(s), r), SHAPE, _shape)
#: a shape without the points that a tolerance allows to leave out
reduced = shape_function(lambda s, tol: [simplified(p, tol).ravel().tolist() for p in rings_of(s)], SHAPE, _shape)


def _covers(a, b, slack):
    return area_where([rings_of(buffered(rings_of(a), slack) if slack else a), rings_of(b)], lambda m: m[:, 1] & ~m[:, 0]) <= 1e-6


#: whether the first shape, widened by `slack`, holds the whole second one
covers = shape_function(_covers, "boolean", pa.bool_())


def _repaired(s):
    """Rings without repeated points, outer ones counted by the odd rule, each from its least point and against the clock."""
    out = []
    for p in rings_of(s):
        p = p[np.any(np.roll(p, 1, 0) != p, axis=1)]
        if len(p) >= 3 and abs(ring_area(p)) > EPS:
            p = p if ring_area(p) > 0 else p[::-1]
            out.append(np.roll(p, -int(np.lexsort((p[:, 1], p[:, 0]))[0]), 0).ravel().tolist())
    return sorted(out)


#: a shape in its canonical form: equal polygons have equal text
canonical = shape_function(_repaired, SHAPE, _shape)


def _masked(parcel, zones):
    """One row of `sweep.masked_areas` without a cell: for each zone, in order of its rank, the area inside the parcel that no zone before it has."""
    m = lambda k: lambda x: x[:, 0] & x[:, k + 1] & ~x[:, 1 : k + 1].any(1)
    rings = [rings_of(parcel), *(rings_of(z) for z in zones or [])]
    t, member = trapezoids(rings)
    w = areas_of(t)
    return [float(w[m(k)(member)].sum()) if len(t) else 0.0 for k in range(len(rings) - 1)]


def _cover(parcel, zones):
    """One row of `sweep.cover` without a cell."""
    rings = [rings_of(parcel), *(rings_of(z) for z in zones or [])]
    t, m = trapezoids(rings)
    w, n = areas_of(t), m[:, 1:].sum(1)
    pick = lambda c: float(w[c].sum()) if len(t) else 0.0
    return {"whole": pick(m[:, 0]), "covered": pick(m[:, 0] & (n > 0)), "overlap": pick(m[:, 0] & (n > 1)), "outside": pick(~m[:, 0] & (n > 0))}


def _hull(p: np.ndarray) -> np.ndarray:
    """The convex hull, against the clock."""
    p = np.unique(p, axis=0)

    def half(points):
        out: list[np.ndarray] = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1])) if len(p) > 2 else p


def _descriptors(s):
    rings = rings_of(s)
    m = _measure(s)
    if not m["area"]:
        return None
    hull, p = _hull(np.concatenate(rings)), np.concatenate(rings)
    wide, high = np.ptp(p[:, 0]), np.ptp(p[:, 1])
    return {"solidity": m["area"] / abs(ring_area(hull)), "compactness": float(4 * np.pi * m["area"] / m["perimeter"] ** 2), "fill": float(m["area"] / (wide * high)), "parts": len(rings)}


#: share of the convex hull, of a circle with the same perimeter and of the box, and the number of rings
descriptors = shape_function(_descriptors, "solidity double, compactness double, fill double, parts bigint", pa.struct([("solidity", _f), ("compactness", _f), ("fill", _f), ("parts", pa.int64())]))


def _halved(s, fraction, upright):
    """The part of a shape left of (or below) the line that gives it `fraction` of the area, and the rest."""
    rings = rings_of(s)
    turned = [p[:, ::-1] for p in rings] if upright else rings
    t, _ = trapezoids([turned])
    if not len(t):
        return None
    slabs, of = np.unique(t[:, :2], axis=0, return_inverse=True)
    low, high = np.bincount(of, t[:, 3] - t[:, 2]), np.bincount(of, t[:, 5] - t[:, 4])  # widths at both ends of each slab
    area = (slabs[:, 1] - slabs[:, 0]) * (low + high) / 2
    k = min(int(np.searchsorted(np.cumsum(area), fraction * area.sum())), len(area) - 1)
    rest, tall = fraction * area.sum() - area[:k].sum(), slabs[k, 1] - slabs[k, 0]
    bend = (high[k] - low[k]) / tall
    part = rest / low[k] if abs(bend) < 1e-12 else (np.sqrt(max(low[k] ** 2 + 2 * bend * rest, 0)) - low[k]) / bend
    at = slabs[k, 0] + part
    q = np.concatenate(turned)
    (x0, y0), (x1, _) = q.min(0) - 1, q.max(0) + 1
    half = np.array([(x0, y0), (x1, y0), (x1, at), (x0, at)])
    cut = [rings, [half[:, ::-1] if upright else half]]
    return [shape_where(cut, lambda m: m.all(1)), shape_where(cut, lambda m: m[:, 0] & ~m[:, 1])]


#: a shape cut in two by an upright or level line so that the first part has a fraction of the area
halved = shape_function(_halved, "array<array<array<double>>>", pa.list_(pa.list_(pa.list_(pa.float64()))))


def _samples(s):
    """A point inside: the middle of the longest part of the line half way up; and the centroid of each ring."""
    rings = rings_of(s)
    t, _ = trapezoids([rings])
    if not len(t):
        return None
    best = t[int(np.argmax(areas_of(t)))]
    inner = {"x": float((best[2] + best[3] + best[4] + best[5]) / 4), "y": float((best[0] + best[1]) / 2)}
    parts = [_measure([p.ravel().tolist()]) for p in rings]
    return {"inner": inner, "parts": [{"x": m["x"], "y": m["y"]} for m in parts if m["x"] is not None]}


_point = pa.struct([("x", _f), ("y", _f)])
#: sample points of a shape: one that is surely inside, and the centroid of every ring
samples = shape_function(_samples, "inner struct<x:double,y:double>, parts array<struct<x:double,y:double>>", pa.struct([("inner", _point), ("parts", pa.list_(_point))]))


def _pixels(s, step, offset):
    """Cells (i, j) of a grid whose sample point (i + offset, j + offset) * step lies inside."""
    rings = rings_of(s)
    if not rings:
        return []
    p = np.concatenate(rings)
    (x0, y0), (x1, y1) = (p.min(0) / step - offset), (p.max(0) / step - offset)
    i, j = np.arange(int(np.floor(x0)), int(np.ceil(x1)) + 1), np.arange(int(np.floor(y0)), int(np.ceil(y1)) + 1)
    out = []
    for row in j:  # one row of the grid at a time
        inside = contains(rings, (i + offset) * step, np.full(len(i), (row + offset) * step))
        out += [{"i": int(a), "j": int(row)} for a in i[inside]]
    return out


#: the mask of a shape on a grid
pixels = shape_function(_pixels, "array<struct<i:bigint,j:bigint>>", pa.list_(pa.struct([("i", pa.int64()), ("j", pa.int64())])))


def _axis(s):
    """The two corners that are farthest apart, the lower left one first."""
    rings = rings_of(s)
    if not rings:
        return None
    h = _hull(np.concatenate(rings))
    d = ((h[:, None] - h[None]) ** 2).sum(2)
    a, b = np.unravel_index(int(np.argmax(d)), d.shape)
    (x0, y0), (x1, y1) = sorted((h[a].tolist(), h[b].tolist()))
    return {"x0": x0, "y0": y0, "x1": x1, "y1": y1, "length": float(np.sqrt(d[a, b]))}


#: the longest line between two corners of a shape, along which a profile is drawn
long_axis = shape_function(_axis, "x0 double, y0 double, x1 double, y1 double, length double", pa.struct([(n, _f) for n in ("x0", "y0", "x1", "y1", "length")]))


def repaired_line(line: Column) -> Column:
    """A line (x, y, x, y, ...) without points that repeat the one before them; null with fewer than two points or a coordinate that is not finite."""
    n = F.floor(F.size(line) / 2).cast("int")
    points = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.struct(F.get(line, i * 2).alias("x"), F.get(line, i * 2 + 1).alias("y")))
    kept = F.filter(points, lambda p, i: (i == 0) | ~p.eqNullSafe(F.get(points, i - 1)))
    bad = F.exists(kept, lambda p: p["x"].isNull() | p["y"].isNull() | F.isnan(p["x"]) | F.isnan(p["y"]) | (F.abs(p["x"]) == float("inf")) | (F.abs(p["y"]) == float("inf")))
    return F.when((F.size(kept) > 1) & ~bad, F.flatten(F.transform(kept, lambda p: F.array(p["x"], p["y"]))))


def line_length(line: Column) -> Column:
    at = lambda i: F.get(line, i)
    parts = F.transform(F.sequence(F.lit(1), (F.size(line) / 2 - 1).cast("int")), lambda i: F.hypot(at(i * 2) - at(i * 2 - 2), at(i * 2 + 1) - at(i * 2 - 1)))
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def box_shape(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A rectangle as a shape."""
    return F.array(F.array(*(c.cast("double") for c in (x0, y0, x1, y0, x1, y1, x0, y1))))


def extent_of(shape: str | Column) -> list[Column]:
    """x0, y0, x1, y1 of a shape, inside code generation."""
    flat = F.flatten(shape if isinstance(shape, Column) else F.col(shape))
    x, y = F.filter(flat, lambda v, i: i % 2 == 0), F.filter(flat, lambda v, i: i % 2 == 1)
    return [F.array_min(x).alias("x0"), F.array_min(y).alias("y0"), F.array_max(x).alias("x1"), F.array_max(y).alias("y1")]
