"""Overlay and distance of whole Arrow batches of polygons at once.

The rings of a batch are flat coordinates with offsets, and stay so: all edges of all rows are arrays, with the row (group) and
the shape within the row (layer) beside them. Work goes over the batch, never over its rows.

* Crossings: edges are swept in order of their lower end; of each, only those that begin before it ends are looked at, along
  the axis on which a row's edges overlap less. For n edges and k overlaps that takes O(n log n + k).
* Areas: the plane of each row is cut into slabs at its vertices and crossings. Between neighbouring edges of a slab lie
  trapezoids, and the exclusive or of the layers' bits from the left tells which shapes a trapezoid belongs to. Where only the common
  part of two shapes counts, edges outside the window of their boxes are dropped or laid on its border before.
* Distances: an upper bound comes from one vertex on each side; only edges nearer than the bound meet in the sweep.

Slabs and overlaps are expanded in parts of `PART` entries, so memory is bounded whatever the outlines are.

A shape is as in `geometry`: rings under the odd rule. Rings of fewer than three points, or with a coordinate that is null or not finite,
are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9
CONTACT = 1e-6
PART = 1 << 21
#: A row with more layers than bits is split off by the callers.
LAYERS = 62


@dataclass
class Edges:
    """Edges sorted by group and layer; `ring` numbers the rings of the batch."""

    group: np.ndarray
    layer: np.ndarray
    ring: np.ndarray
    x0: np.ndarray
    y0: np.ndarray
    x1: np.ndarray
    y1: np.ndarray

    def __len__(self) -> int:
        return len(self.group)

    def take(self, at: np.ndarray) -> Edges:
        return Edges(*(v[at] for v in vars(self).values()))


def expand(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, value) of all values of the ranges start .. start + count - 1."""
    of = np.repeat(np.arange(len(count)), count)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + start[of]


def parts_of(count: np.ndarray, most: int = PART) -> Iterator[slice]:
    """Slices of consecutive entries with about `most` together."""
    total = np.cumsum(count)
    at = 0
    while at < len(count):
        before = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + most, "right")))
        yield slice(at, end)
        at = end


def ring_edges(rings: pa.ListArray, group: np.ndarray, layer: np.ndarray) -> Edges:
    """Edges of a column of rings that belong to the groups and layers given."""
    c = pc.list_flatten(rings).to_numpy(zero_copy_only=False).astype(float)
    ring = pc.list_parent_indices(rings).to_numpy().astype(np.int64)
    size = np.bincount(ring, minlength=len(rings))
    inner = np.arange(len(c)) - np.repeat(np.cumsum(size) - size, size)
    first = np.flatnonzero((inner % 2 == 0) & (inner + 1 < size[ring]))
    x, y, ring = c[first], c[np.minimum(first + 1, max(0, len(c) - 1))], ring[first]
    finite = np.ones(len(rings), bool)
    finite[ring[~(np.isfinite(x) & np.isfinite(y))]] = False

    def ends(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.bincount(r, minlength=len(rings))
        stop = np.cumsum(n)
        return stop - n, stop - 1

    start, last = ends(ring)
    closing = np.flatnonzero(last > start)
    closing = last[closing][(x[last[closing]] == x[start[closing]]) & (y[last[closing]] == y[start[closing]])]
    keep = np.ones(len(ring), bool)
    keep[closing] = False
    keep &= (np.bincount(ring, keep, len(rings)) >= 3)[ring] & finite[ring]
    x, y, ring = x[keep], y[keep], ring[keep]
    start, last = ends(ring)
    after = np.arange(1, len(ring) + 1)
    after[last[start <= last]] = start[start <= last]
    return Edges(group[ring], layer[ring], ring, x, y, x[after], y[after])


def edges_of(*columns: pa.Array) -> Edges:
    """Edges of the shapes of several columns: the group is the row, the layer the column."""
    found = []
    for k, col in enumerate(columns):
        row = pc.list_parent_indices(col).to_numpy().astype(np.int64)
        found.append(ring_edges(pc.list_flatten(col), row, np.full(len(row), k, np.int64)))
    return joined(found)


def joined(found: list[Edges]) -> Edges:
    """One table of edges, sorted by group and layer, rings renumbered."""
    base = 0
    shifted = []
    for e in found:
        shifted.append(replace(e, ring=e.ring + base))
        base += int(e.ring.max(initial=-1)) + 1
    every = Edges(*(np.concatenate([getattr(e, n) for e in shifted]) for n in vars(shifted[0])))
    return every.take(np.lexsort((every.ring, every.layer, every.group)))


def _least(values: np.ndarray, group: np.ndarray, n: int, pick=np.minimum, empty: float = np.inf) -> np.ndarray:
    """Least (or other) value of each group; groups are sorted."""
    out = np.full(n, empty)
    if len(group):
        starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        out[group[starts]] = pick.reduceat(values, starts)
    return out


def extents(e: Edges, n: int) -> np.ndarray:
    """(n, 4): x0, y0, x1, y1 of each group; infinite and inverted where it has no edges."""
    return np.column_stack([_least(e.x0, e.group, n), _least(e.y0, e.group, n), _least(e.x0, e.group, n, np.maximum, -np.inf), _least(e.y0, e.group, n, np.maximum, -np.inf)])


def overlaps(group: np.ndarray, lo: np.ndarray, hi: np.ndarray, most: int = PART) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i, j), i before j, of the same group whose intervals [lo, hi] meet, each once, in parts by ascending group."""
    n = len(group)
    order = np.lexsort((lo, group))
    g, a, b = group[order], lo[order], hi[order]
    both = np.lexsort((np.repeat([0, 1], n), np.concatenate((a, b)), np.concatenate((g, g))))
    begun = np.cumsum(both < n)
    end = np.empty(n, np.int64)
    end[both[both >= n] - n] = begun[both >= n]
    count = end - np.arange(n) - 1
    for part in parts_of(count, most):
        of, j = expand(np.arange(part.start, part.stop) + 1, count[part])
        yield order[of + part.start], order[j]


def crossings(e: Edges, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(group, y) of the points where two edges of a group cross or touch."""
    if not len(e):
        return np.zeros(0, np.int64), np.zeros(0)
    xl, xh, yl, yh = np.minimum(e.x0, e.x1), np.maximum(e.x0, e.x1), np.minimum(e.y0, e.y1), np.maximum(e.y0, e.y1)
    box = extents(e, n)
    with np.errstate(invalid="ignore", divide="ignore"):
        across = np.bincount(e.group, xh - xl, n) / (box[:, 2] - box[:, 0]) < np.bincount(e.group, yh - yl, n) / (box[:, 3] - box[:, 1])
    turn = across[e.group]
    groups, ys = [], []
    dx, dy = e.x1 - e.x0, e.y1 - e.y0
    for i, j in overlaps(e.group, np.where(turn, xl, yl), np.where(turn, xh, yh)):
        meet = (xl[i] <= xh[j]) & (xl[j] <= xh[i]) & (yl[i] <= yh[j]) & (yl[j] <= yh[i])
        i, j = i[meet], j[meet]
        cross = dx[i] * dy[j] - dy[i] * dx[j]
        ok = np.abs(cross) > 1e-15
        i, j, cross = i[ok], j[ok], cross[ok]
        wx, wy = e.x0[j] - e.x0[i], e.y0[j] - e.y0[i]
        t, u = (wx * dy[j] - wy * dx[j]) / cross, (wx * dy[i] - wy * dx[i]) / cross
        on = (t >= -EPS) & (t <= 1 + EPS) & (u >= -EPS) & (u <= 1 + EPS)
        groups.append(e.group[i[on]])
        ys.append(e.y0[i[on]] + t[on] * dy[i[on]])
    return np.concatenate(groups), np.concatenate(ys)


@dataclass
class Trapezoids:
    """Parts of slabs between neighbouring edges: group, layers (bits), y and x of the four corners."""

    group: np.ndarray
    member: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    a: np.ndarray  # left and right at the low end, left and right at the high end
    b: np.ndarray
    c: np.ndarray
    d: np.ndarray

    def areas(self) -> np.ndarray:
        return np.maximum((self.hi - self.lo) * ((self.b - self.a) + (self.d - self.c)) / 2, 0)


def trapezoids(e: Edges, n: int, most: int = PART) -> Iterator[Trapezoids]:
    """All trapezoids that belong to some layer, in parts."""
    if not len(e):
        return
    cg, cy = crossings(e, n)
    m = len(e)
    g, y = np.concatenate((e.group, e.group, cg)), np.concatenate((e.y0, e.y1, cy))
    order = np.lexsort((y, g))
    gs, ys = g[order], y[order]
    new = np.concatenate(([True], (gs[1:] != gs[:-1]) | (np.diff(ys) > EPS)))
    number = np.empty(len(g), np.int64)
    number[order] = np.cumsum(new) - 1
    level = ys[new]  # y of each cut; a slab has the number of the cut below it
    low, high = np.minimum(number[:m], number[m : 2 * m]), np.maximum(number[:m], number[m : 2 * m])
    up = np.flatnonzero(high > low)
    low, high = low[up], high[up]
    flip = e.y0[up] > e.y1[up]
    xa, xb = np.where(flip, e.x1[up], e.x0[up]), np.where(flip, e.x0[up], e.x1[up])
    ya, yb = np.where(flip, e.y1[up], e.y0[up]), np.where(flip, e.y0[up], e.y1[up])
    slope = (xb - xa) / (yb - ya)
    bit, group = np.uint64(1) << e.layer[up].astype(np.uint64), e.group[up]
    active = np.cumsum(np.bincount(low, minlength=len(level) + 1) - np.bincount(high, minlength=len(level) + 1))[: len(level)]
    for part in parts_of(active, most):
        on = np.flatnonzero((low < part.stop) & (high > part.start))
        first = np.maximum(low[on], part.start)
        of, slab = expand(first, np.minimum(high[on], part.stop) - first)
        k = on[of]
        at, to = level[slab], level[slab + 1]
        p, q = xa[k] + (at - ya[k]) * slope[k], xa[k] + (to - ya[k]) * slope[k]
        s = np.lexsort((p + q, slab))
        k, slab, p, q = k[s], slab[s], p[s], q[s]
        inside = np.bitwise_xor.accumulate(bit[k])
        start = np.flatnonzero(np.concatenate(([True], slab[1:] != slab[:-1])))
        base = np.concatenate(([np.uint64(0)], inside[start[1:] - 1]))
        inside ^= np.repeat(base, np.diff(np.concatenate((start, [len(slab)]))))
        i = np.flatnonzero((slab[1:] == slab[:-1]) & (inside[:-1] > 0))
        yield Trapezoids(group[k[i]], inside[i], level[slab[i]], level[slab[i] + 1], p[i], p[i + 1], q[i], q[i + 1])


def window(e: Edges, box: np.ndarray) -> Edges:
    """Edges that matter for what lies inside each group's box (x0, y0, x1, y1), cut at its low and high end; those left of it on its border."""
    b = box[e.group]
    yl, yh, xl, xh = np.minimum(e.y0, e.y1), np.maximum(e.y0, e.y1), np.minimum(e.x0, e.x1), np.maximum(e.x0, e.x1)
    at = np.flatnonzero((yh > b[:, 1]) & (yl < b[:, 3]) & (xl <= b[:, 2]) & (b[:, 0] < b[:, 2]))
    e, b, xh = e.take(at), b[at], xh[at]
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = (e.x1 - e.x0) / (e.y1 - e.y0)
        y0, y1 = np.clip(e.y0, b[:, 1], b[:, 3]), np.clip(e.y1, b[:, 1], b[:, 3])
        x0 = np.where(y0 == e.y0, e.x0, e.x0 + (y0 - e.y0) * slope)
        x1 = np.where(y1 == e.y1, e.x1, e.x0 + (y1 - e.y0) * slope)
    left = xh <= b[:, 0]
    return replace(e, x0=np.where(left, b[:, 0], x0), x1=np.where(left, b[:, 0], x1), y0=y0, y1=y1)


def near_origin(e: Edges, n: int) -> tuple[Edges, np.ndarray]:
    """The same edges, each group moved to its lower left corner; and that corner."""
    box = extents(e, n)
    x, y = box[e.group, 0], box[e.group, 1]
    return replace(e, x0=e.x0 - x, x1=e.x1 - x, y0=e.y0 - y, y1=e.y1 - y), box[:, :2]


def common_window(e: Edges, n: int, layers: tuple[int, ...] = (0, 1)) -> np.ndarray:
    """The box that the extents of the layers share."""
    boxes = [extents(e.take(e.layer == k), n) for k in layers]
    return np.column_stack([np.maximum.reduce([b[:, k] for b in boxes]) if k < 2 else np.minimum.reduce([b[:, k] for b in boxes]) for k in range(4)])


def shared_areas(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Area of what the two shapes of each row share."""
    n = len(left)
    e, _ = near_origin(edges_of(left, right), n)
    return _shared(e, n)


def _shared(e: Edges, n: int) -> np.ndarray:
    out = np.zeros(n)
    for t in trapezoids(window(e, common_window(e, n)), n):
        both = t.member == 3
        out += np.bincount(t.group[both], t.areas()[both], n)
    return out


def _to_edge(px, py, x0, y0, x1, y1) -> np.ndarray:
    dx, dy = x1 - x0, y1 - y0
    t = np.clip(((px - x0) * dx + (py - y0) * dy) / np.maximum(dx * dx + dy * dy, 1e-300), 0, 1)
    return np.hypot(px - x0 - t * dx, py - y0 - t * dy)


def _box_gap(box: np.ndarray, x0, y0, x1, y1) -> np.ndarray:
    """Distance of boxes to the boxes of edges."""
    gx = np.maximum(np.maximum(box[:, 0] - np.maximum(x0, x1), np.minimum(x0, x1) - box[:, 2]), 0)
    gy = np.maximum(np.maximum(box[:, 1] - np.maximum(y0, y1), np.minimum(y0, y1) - box[:, 3]), 0)
    return np.hypot(gx, gy)


def _first_of(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Index of the least value of each group; -1 for none."""
    out = np.full(n, -1)
    at = np.lexsort((values, group))
    starts = at[np.concatenate(([True], group[at][1:] != group[at][:-1]))] if len(at) else at
    out[group[starts]] = starts
    return out


def inside(e: Edges, group: np.ndarray, x: np.ndarray, y: np.ndarray, most: int = PART) -> np.ndarray:
    """Whether each point lies inside the shape of its group's edges; on the boundary either way."""
    out = np.zeros(len(group), bool)
    n = int(max(e.group.max(initial=-1), group.max(initial=-1))) + 1
    size = np.bincount(e.group, minlength=n)
    start = np.cumsum(size) - size
    for part in parts_of(size[group], most):
        of, k = expand(start[group[part]], size[group[part]])
        px, py = x[part][of], y[part][of]
        over = (e.y0[k] > py) != (e.y1[k] > py)
        with np.errstate(divide="ignore", invalid="ignore"):
            right = px < e.x0[k] + (py - e.y0[k]) * (e.x1[k] - e.x0[k]) / (e.y1[k] - e.y0[k])
        out[part] = np.bincount(of, over & right, part.stop - part.start) % 2 == 1
    return out


def distances(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Least distance of the two shapes of each row, 0 where they meet; NaN where one is empty."""
    n = len(left)
    e, _ = near_origin(edges_of(left, right), n)
    return _distances(e, n)


def _distances(e: Edges, n: int) -> np.ndarray:
    sides = [e.take(e.layer == k) for k in (0, 1)]
    boxes = [extents(s, n) for s in sides]
    full = np.isfinite(boxes[0][:, 0]) & np.isfinite(boxes[1][:, 0])
    sides = [s.take(full[s.group]) for s in sides]
    out = np.where(full, np.inf, np.nan)
    # one vertex on each side, the one nearest to the other's box, bounds the distance
    for (s, o), box in zip((sides, sides[::-1]), boxes[::-1], strict=True):
        if len(s):
            at = _first_of(_box_gap(box[s.group], s.x0, s.y0, s.x0, s.y0), s.group, n)[o.group]
            out = np.fmin(out, np.where(full, _least(_to_edge(s.x0[at], s.y0[at], o.x0, o.y0, o.x1, o.y1), o.group, n), np.nan))
    bound = out * (1 + 1e-9) + EPS
    close = joined([s.take(_box_gap(b[s.group], s.x0, s.y0, s.x1, s.y1) <= bound[s.group]) for s, b in zip(sides, boxes[::-1], strict=True)])
    if len(close):
        half = bound[close.group] / 2
        xl, xh, yl, yh = np.minimum(close.x0, close.x1), np.maximum(close.x0, close.x1), np.minimum(close.y0, close.y1), np.maximum(close.y0, close.y1)
        for i, j in overlaps(close.group, yl - half, yh + half):
            ok = (close.layer[i] != close.layer[j]) & (xl[i] - xh[j] <= 2 * half[i]) & (xl[j] - xh[i] <= 2 * half[i])
            i, j = i[ok], j[ok]
            a, b = close.take(i), close.take(j)
            d = np.minimum.reduce([_to_edge(b.x0, b.y0, a.x0, a.y0, a.x1, a.y1), _to_edge(b.x1, b.y1, a.x0, a.y0, a.x1, a.y1), _to_edge(a.x0, a.y0, b.x0, b.y0, b.x1, b.y1), _to_edge(a.x1, a.y1, b.x0, b.y0, b.x1, b.y1)])
            side = lambda p, q, x, y: (p.x1 - p.x0) * (y - p.y0) - (p.y1 - p.y0) * (x - p.x0)
            cross = (side(a, b, b.x0, b.y0) * side(a, b, b.x1, b.y1) < 0) & (side(b, a, a.x0, a.y0) * side(b, a, a.x1, a.y1) < 0)
            out = np.fmin(out, np.where(full, _least(np.where(cross, 0.0, d), close.group[i], n), np.nan))
    # boundaries apart: one shape holds the other's ring wholly or not at all
    for s, o in (sides, sides[::-1]):
        first = np.flatnonzero(np.concatenate(([True], s.ring[1:] != s.ring[:-1]))) if len(s) else np.zeros(0, np.int64)
        first = first[out[s.group[first]] > EPS]
        held = inside(o, s.group[first], s.x0[first], s.y0[first])
        out[s.group[first][held]] = 0.0
    return np.where(out <= EPS, 0.0, out)


def _numbers(values: np.ndarray, null: pa.Array | None = None) -> pa.Array:
    bad = np.isnan(values)
    return pa.array(values, mask=bad if null is None else bad | pc.is_null(null).to_numpy(zero_copy_only=False))


def batch_function(work: Callable[..., pa.Array], kind: str, once: bool = False) -> Callable[..., Column]:
    """A column function whose `work` gets whole Arrow columns. With `once` Spark keeps it out of filters below its own projection, so that it is
    computed once for each row."""

    def column(*cols: str | Column) -> Column:
        run = _typed(work, kind, len(cols))
        return (run.asNondeterministic() if once else run)(*cols)

    return column


def _typed(work: Callable[..., pa.Array], kind: str, n: int):
    if n == 1:

        def run(a: pa.Array) -> pa.Array:
            return work(a)
    elif n == 2:

        def run(a: pa.Array, b: pa.Array) -> pa.Array:
            return work(a, b)
    else:

        def run(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
            return work(a, b, c)

    return F.arrow_udf(run, kind)


def _meet(left: pa.Array, right: pa.Array) -> pa.Array:
    n = len(left)
    e, _ = near_origin(edges_of(left, right), n)
    area = _shared(e, n)
    meets = area > CONTACT
    open_ = ~meets  # only these may meet without an area
    meets[open_] = _distances(e.take(open_[e.group]), n)[open_] == 0
    return pa.StructArray.from_arrays([pa.array(area), pa.array(meets)], names=["area", "meets"], mask=pc.is_null(left))


def _measure(shapes: pa.Array) -> pa.Array:
    n = len(shapes)
    e, corner = near_origin(edges_of(shapes), n)
    long = np.bincount(e.group, np.hypot(e.x1 - e.x0, e.y1 - e.y0), n)
    area, mx, my = np.zeros(n), np.zeros(n), np.zeros(n)
    for t in trapezoids(e, n):
        area += np.bincount(t.group, t.areas(), n)
        for (px, py), (qx, qy) in (((t.a, t.lo), (t.b, t.lo)), ((t.b, t.lo), (t.d, t.hi)), ((t.d, t.hi), (t.c, t.hi)), ((t.c, t.hi), (t.a, t.lo))):
            k = (px * qy - qx * py) / 6
            mx += np.bincount(t.group, (px + qx) * k, n)
            my += np.bincount(t.group, (py + qy) * k, n)
    with np.errstate(divide="ignore", invalid="ignore"):
        x, y = np.where(area > 0, mx / area + corner[:, 0], np.nan), np.where(area > 0, my / area + corner[:, 1], np.nan)
    return pa.StructArray.from_arrays([pa.array(area), pa.array(long), _numbers(x), _numbers(y)], names=["area", "perimeter", "x", "y"], mask=pc.is_null(shapes))


def _holds(shapes: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
    xs, ys = (v.cast(pa.float64()).to_numpy(zero_copy_only=False) for v in (x, y))
    return pa.array(inside(edges_of(shapes), np.arange(len(shapes)), xs, ys), mask=pc.is_null(shapes).to_numpy(zero_copy_only=False))


#: area, perimeter and centroid (x, y) of a shape, its rings by the odd rule
measure = batch_function(_measure, "area double, perimeter double, x double, y double")
#: area of what two shapes share
shared = batch_function(lambda a, b: _numbers(shared_areas(a, b), a), "double", once=True)
#: area of what two shapes share, and whether they meet at all
meet = batch_function(_meet, "area double, meets boolean", once=True)
#: least distance of two shapes, 0 where they meet
apart = batch_function(lambda a, b: _numbers(distances(a, b)), "double", once=True)
#: whether a shape holds a point (x, y)
holds = batch_function(_holds, "boolean")


def _with_lists(piece: pa.Array, zones: pa.Array, cell: pa.Array | None) -> tuple[Edges, np.ndarray, np.ndarray]:
    """Edges of a shape (layer 0), a box x0, y0, x1, y1 (layer 1) and a list of shapes (layers from 2 on) of each row, cut to the box; the
    sizes of the lists; and which rows have too many layers (they are left out)."""
    n = len(piece)
    size = pc.fill_null(pc.list_value_length(zones), 0).to_numpy().astype(np.int64)
    found = [edges_of(piece)]
    row = pc.list_parent_indices(zones).to_numpy().astype(np.int64)
    shapes = pc.list_flatten(zones)
    place = np.arange(len(row)) - (np.cumsum(size) - size)[row]
    of = pc.list_parent_indices(shapes).to_numpy().astype(np.int64)
    found.append(ring_edges(pc.list_flatten(shapes), row[of], place[of] + 2))
    if cell is not None:
        b = pc.list_flatten(cell).to_numpy(zero_copy_only=False).reshape(-1, 4)
        x0, y0, x1, y1 = b.T
        ring = pa.ListArray.from_arrays(pa.array(np.arange(0, 8 * n + 1, 8), pa.int32()), pa.array(np.column_stack([x0, y0, x1, y0, x1, y1, x0, y1]).ravel()))
        found.append(ring_edges(ring, np.arange(n), np.ones(n, np.int64)))
    e = joined(found)
    many = size > LAYERS - 2
    e = e.take(~many[e.group])
    if cell is not None:
        e = window(e, b)
    return near_origin(e, n)[0], size, many


def _bits(t: Trapezoids) -> np.ndarray:
    """Of each trapezoid, how many zones (layers from 2 on) it lies in."""
    return np.bitwise_count(t.member >> np.uint64(2))


def _cover(piece: pa.Array, zones: pa.Array, cell: pa.Array) -> pa.Array:
    n = len(piece)
    e, _, many = _with_lists(piece, zones, cell)
    out = np.zeros((4, n))
    for t in trapezoids(e, n):
        area, zones_in = t.areas(), _bits(t)
        here = (t.member >> np.uint64(1)) & np.uint64(1) == 1
        own = here & (t.member & np.uint64(1) == 1)
        for k, pick in enumerate((own, own & (zones_in > 0), own & (zones_in > 1), here & ~own & (zones_in > 0))):
            out[k] += np.bincount(t.group[pick], area[pick], n)
    names = ["whole", "covered", "overlap", "outside"]
    for i in np.flatnonzero(many):
        _one_by_one(piece, zones, cell, int(i), lambda m: (m[:, 0], m[:, 0] & (m[:, 1:].sum(1) > 0), m[:, 0] & (m[:, 1:].sum(1) > 1), ~m[:, 0] & (m[:, 1:].sum(1) > 0)), out[:, i])
    return pa.StructArray.from_arrays([pa.array(v) for v in out], names=names)


def _masked(piece: pa.Array, zones: pa.Array, cell: pa.Array) -> pa.Array:
    n = len(piece)
    e, size, many = _with_lists(piece, zones, cell)
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()))
    for t in trapezoids(e, n):
        pick = (t.member & np.uint64(3) == 3) & (t.member > 3)
        above = t.member[pick] >> np.uint64(2)
        first = np.bitwise_count((above & (~above + np.uint64(1))) - np.uint64(1))  # zones before the first one here
        out += np.bincount(start[t.group[pick]] + first, t.areas()[pick], len(out))
    for i in np.flatnonzero(many):
        _one_by_one(piece, zones, cell, int(i), lambda m: (m[:, 0] & m[:, k] & ~m[:, 1:k].any(1) for k in range(1, m.shape[1])), out[start[i] : start[i] + size[i]])
    return pa.ListArray.from_arrays(pa.array(np.concatenate((start, [len(out)])), pa.int32()), pa.array(out))


def _one_by_one(piece: pa.Array, zones: pa.Array, cell: pa.Array, i: int, picks: Callable, out: np.ndarray) -> None:
    """A row with more zones than bits, by `geometry.trapezoids`: areas inside the cell of the members that `picks` tells."""
    from zonaris.functions import geometry as G

    x0, y0, x1, y1 = cell[i].as_py()
    rings = [G.rings_of(piece[i].as_py()), *(G.rings_of(z) for z in zones[i].as_py()), [np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)], float)]]
    t, m = G.trapezoids(rings)
    w = G.areas_of(t) * m[:, -1] if len(t) else np.zeros(0)
    for k, pick in enumerate(picks(m[:, :-1])):
        out[k] = float(w[pick].sum()) if len(t) else 0.0


#: of a shape and a list of others inside a cell [x0, y0, x1, y1]: its area, the area that they cover, that two or more cover, and theirs outside
cover = batch_function(_cover, "whole double, covered double, overlap double, outside double")
#: area inside a shape and a cell of each shape of a list that no shape before it in the list has
masked_areas = batch_function(_masked, "array<double>")
