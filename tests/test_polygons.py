"""Polygon functions against clipping, sampling and closed forms that do not use them."""

from __future__ import annotations

import math
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from zonaris.functions import geometry as G
from zonaris.functions import sweep as W
from zonaris.operators import polygons as P


def star(rng, x, y, r, n=7):
    """A star-shaped polygon, mostly not convex."""
    turn = np.sort(rng.uniform(0, 2 * np.pi, n))
    far = r * rng.uniform(0.3, 1, n)
    return np.column_stack([x + far * np.cos(turn), y + far * np.sin(turn)]).ravel().tolist()


def clip(subject, convex):
    """Sutherland and Hodgman: a polygon inside a convex one."""
    out = [tuple(p) for p in subject]
    for (ax, ay), (bx, by) in zip(convex, convex[1:] + convex[:1], strict=True):
        side = lambda p: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)  # noqa: B023, E731
        new = []
        for p, q in zip(out, out[1:] + out[:1], strict=True):
            a, b = side(p), side(q)
            if a >= 0:
                new.append(p)
            if a * b < 0:
                new.append((p[0] + (q[0] - p[0]) * a / (a - b), p[1] + (q[1] - p[1]) * a / (a - b)))
        out = new
        if not out:
            return 0.0
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(out, out[1:] + out[:1], strict=True)) / 2)


@pytest.mark.parametrize("seed", range(20))
def test_shared_area_is_that_of_clipping(seed):
    rng = np.random.default_rng(seed)
    a = star(rng, 0, 0, 10)
    t = np.sort(rng.uniform(0, 2 * np.pi, 6))
    b = [(3 + 7 * math.cos(x), 2 + 7 * math.sin(x)) for x in t]
    flat = [c for p in b for c in p]
    want = clip(np.array(a).reshape(-1, 2).tolist(), b)
    rings = G.rings_of([a]), G.rings_of([flat])
    assert G.area_where(list(rings), lambda m: m.all(1)) == pytest.approx(want, abs=1e-7)
    parts = {n: G._measure(G.shape_where(list(rings), f))["area"] for n, f in (("both", lambda m: m.all(1)), ("any", lambda m: m.any(1)), ("one", lambda m: m[:, 0] & ~m[:, 1]))}
    whole = [abs(G.ring_area(r[0])) for r in rings]
    assert parts["both"] == pytest.approx(want, abs=1e-5)
    assert parts["any"] == pytest.approx(sum(whole) - want, abs=1e-5) and parts["one"] == pytest.approx(whole[0] - want, abs=1e-5)


@pytest.mark.parametrize("seed", range(6))
def test_buffers_hold_what_is_near(seed):
    rng = np.random.default_rng(seed)
    s = G.rings_of([star(rng, 0, 0, 10)])
    wide, thin = G.rings_of(G.buffered(s, 2.0)), G.rings_of(G.buffered(s, -0.7))
    x, y = rng.uniform(-13, 13, 400), rng.uniform(-13, 13, 400)
    inside, edges = G.contains(s, x, y), G.edges_of(s)
    far = np.array([G._to_edges(np.array([[a, b]]), edges) for a, b in zip(x, y, strict=True)])
    sure = np.abs(far - 2.0) > 0.02
    assert (G.contains(wide, x, y) == (inside | (far < 2.0)))[sure].all()
    sure = np.abs(far - 0.7) > 0.02
    assert (G.contains(thin, x, y) == (inside & (far > 0.7)))[sure].all()


def test_distance_of_apart_touching_nested_and_crossing_shapes():
    box = lambda x, y, s: G.rings_of([[x, y, x + s, y, x + s, y + s, x, y + s]])
    frame = G.rings_of([[0, 0, 10, 0, 10, 10, 0, 10], [2, 2, 8, 2, 8, 8, 2, 8]])
    assert G.distance(box(0, 0, 1), box(4, 5, 1)) == pytest.approx(5.0)
    assert G.distance(box(0, 0, 1), box(1, 0, 1)) == 0 and G.distance(box(0, 0, 9), box(3, 3, 1)) == 0
    assert G.distance(frame, box(4, 4, 1)) == pytest.approx(2.0) and G.distance(frame, box(1, 4, 2)) == 0
    cross = G.rings_of([[0, 4, 10, 4, 10, 5, 0, 5]]), G.rings_of([[4, 0, 5, 0, 5, 10, 4, 10]])
    assert G.distance(*cross) == 0 and G.distance([], box(0, 0, 1)) is None


def test_masks_cover_and_halves_add_up():
    rng = np.random.default_rng(1)
    parcel, zones = [star(rng, 0, 0, 10, 9)], [[star(rng, *rng.uniform(-6, 6, 2), 8)] for _ in range(4)]
    masked, c = G._masked(parcel, zones), G._cover(parcel, zones)
    assert sum(masked) == pytest.approx(c["covered"], abs=1e-7) and 0 < c["covered"] <= c["whole"]
    for upright in (True, False):
        a, b = G._halved(parcel, 0.3, upright)
        assert G._measure(a)["area"] == pytest.approx(0.3 * c["whole"], rel=1e-6) and G._measure(b)["area"] == pytest.approx(0.7 * c["whole"], rel=1e-6)
    assert len(G._pixels(parcel, 0.1, 0.5)) * 0.01 == pytest.approx(c["whole"], rel=0.03)


def test_split_of_sixty_to_forty_and_a_misleading_centroid(spark):
    """A parcel of two zones, 60 to 40; and one whose centroid lies in the smaller part of its zones."""
    box = lambda x0, y0, x1, y1: [[float(v) for v in (x0, y0, x1, y0, x1, y1, x0, y1)]]
    p = P.boxed(spark.createDataFrame([(1, box(0, 0, 1000, 1000))], "k int, shape array<array<double>>"))
    z = P.boxed(spark.createDataFrame([(1, box(-10, -10, 600, 2000)), (2, box(600, -10, 2000, 2000)), (3, box(1000, 0, 1200, 100)), (4, None)], "z int, shape array<array<double>>"))
    got = {r["r_z"]: (round(r["share"], 6), r["touches"], r["dominant"]) for r in P.overlay_shares(p, z, "k", "z", 100.0).collect()}
    assert got == {1: (60.0, False, True), 2: (40.0, False, False), 3: (0.0, True, False)}
    c = P.coverage(p, z, "k", 100.0).first()
    assert (round(c["whole"]), round(c["covered"]), round(c["overlap"])) == (1_000_000, 1_000_000, 0)
    m = {r["z"]: round(r["area"]) for r in P.masked_areas(p, z, "k", "z", -F.col("z"), 100.0).collect()}
    assert m == {1: 600_000, 2: 400_000}


def test_large_and_small_shapes_meet_once(spark):
    """A zone as large as the map and small parcels lie on different grid levels."""
    box = lambda x, y, s: [[float(v) for v in (x, y, x + s, y, x + s, y + s, x, y + s)]]
    rng = np.random.default_rng(3)
    small = [(i, box(*rng.uniform(0, 5000, 2), rng.uniform(1, 40))) for i in range(200)]
    large = [(i, box(*rng.uniform(-500, 3000, 2), rng.choice([30, 400, 6000]))) for i in range(12)]
    a = P.boxed(spark.createDataFrame(small, "k int, shape array<array<double>>"))
    b = P.boxed(spark.createDataFrame(large, "z int, shape array<array<double>>"))
    got = sorted((r["l_k"], r["r_z"]) for r in P.meeting(a, b, 50.0).collect())
    meets = lambda s, t: s[0] <= t[0] + t[2] - t[0] and s[0] <= t[4] and t[0] <= s[4] and s[1] <= t[5] and t[1] <= s[5]
    assert got == sorted((i, j) for i, s in small for j, t in large if meets(s[0], t[0]))


def star_shape(rng):
    return [star(rng, *rng.uniform(-8, 8, 2), rng.uniform(1, 10), rng.integers(3, 12)) for _ in range(rng.integers(1, 4))]


def grid_shape(rng):
    """Rings of whole coordinates: shared corners, edges on each other, self-crossings."""
    return [rng.integers(0, 5, 2 * rng.integers(3, 8)).astype(float).tolist() for _ in range(rng.integers(1, 3))]


SHAPES = pa.list_(pa.list_(pa.float64()))


@pytest.mark.parametrize("make", [star_shape, grid_shape])
@pytest.mark.parametrize("part", [50, 1 << 21])
def test_batches_equal_single_shapes(make, part, monkeypatch):
    rng = np.random.default_rng(5)
    a = [make(rng) for _ in range(150)] + [None, [], [[0.0, 0, 1, 1]], [[0.0, 0, 1, 1, float("nan"), 3]], make(rng)]
    b = [make(rng) for _ in range(154)] + [None]
    left, right = pa.array(a, SHAPES).slice(3), pa.array(b, SHAPES).slice(3)
    monkeypatch.setattr(W, "PART", part)
    good = [[r for r in (s or []) if np.isfinite(r).all()] for s in a[3:]]
    rings = [(G.rings_of(x), G.rings_of(y)) for x, y in zip(good, b[3:], strict=True)]
    assert W.shared_areas(left, right) == pytest.approx([G.area_where(list(r), lambda m: m.all(1)) for r in rings], abs=1e-7)
    far = [G.distance(*r) for r in rings]
    assert W.distances(left, right) == pytest.approx([np.nan if d is None else d for d in far], abs=1e-7, nan_ok=True)
    for got, s in zip(W._measure(left).to_pylist(), a[3:], strict=True):
        want = None if s is None else G._measure([r for r in s if np.isfinite(r).all()])
        assert got == (None if want is None else pytest.approx(want, abs=1e-7))
    met = W._meet(left, right).to_pylist()
    assert [None if m is None else m["meets"] for m in met] == [None if s is None else d is not None and d < 1e-9 or m["area"] > 1e-6 for s, d, m in zip(a[3:], far, met, strict=True)]


def test_masks_and_covers_of_batches(monkeypatch):
    rng = np.random.default_rng(6)
    pieces = [star_shape(rng) for _ in range(40)]
    zones = [[star_shape(rng) for _ in range(rng.integers(0, 6))] for _ in range(40)]
    whole, quarter = [-50.0, -50.0, 50.0, 50.0], [0.0, -50.0, 50.0, 0.0]
    arrays = pa.array(pieces, SHAPES), pa.array(zones, pa.list_(SHAPES))
    cells = lambda c: pa.array([c] * 40, pa.list_(pa.float64()))
    clip_to = lambda s: G.shape_where([G.rings_of(s), [np.array([(0, -50), (50, -50), (50, 0), (0, 0)], float)]], lambda m: m.all(1))
    for _ in range(2):  # with the bits, and row by row
        assert W._masked(*arrays, cells(whole)).to_pylist() == [pytest.approx(G._masked(p, z), abs=1e-6) for p, z in zip(pieces, zones, strict=True)]
        assert W._cover(*arrays, cells(whole)).to_pylist() == [pytest.approx(G._cover(p, z), abs=1e-6) for p, z in zip(pieces, zones, strict=True)]
        got = W._cover(*arrays, cells(quarter)).to_pylist()
        assert got == [pytest.approx(G._cover(clip_to(p), [clip_to(x) for x in z]), abs=1e-4) for p, z in zip(pieces, zones, strict=True)]
        monkeypatch.setattr(W, "LAYERS", 3)


def test_a_thousand_vertices_take_a_few_milliseconds():
    t = np.linspace(0, 2 * np.pi, 1000, endpoint=False)
    far = 10 + np.sin(7 * t) + 0.3 * np.sin(40 * t)
    outline = lambda x: [np.column_stack([x + far * np.cos(t), far * np.sin(t)]).ravel().tolist()]
    a, b = (pa.array([outline(x)] * 20, SHAPES) for x in (0.0, 4.0))
    W.shared_areas(a, b)
    start = time.perf_counter()
    W.shared_areas(a, b)
    assert (time.perf_counter() - start) / 20 < 0.05  # 5 ms on an idle core


def test_a_pair_is_measured_once(spark):
    p = P.boxed(spark.createDataFrame([(1, [[0.0, 0.0, 9.0, 0.0, 9.0, 9.0]])], "k int, shape array<array<double>>"))
    for d in (P.meeting(p, p, 50.0), P.within(p, p, 5.0, 50.0), P.self_overlaps(p, "k", 50.0, 0.1)):
        assert d._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("ArrowEvalPython") == 1


def test_shortest_lines_join_the_boundaries():
    rng = np.random.default_rng(9)
    for _ in range(60):
        a, b = star_shape(rng), [star(rng, *rng.uniform(-30, 30, 2), 6) for _ in range(2)]
        line, far = G._shortest(a, b), G.distance(G.rings_of(a), G.rings_of(b))
        assert (line is None) == (far == 0)
        if line:
            p, q = np.array(line[:2]), np.array(line[2:])
            assert np.hypot(*(p - q)) == pytest.approx(far) and G._to_edges(p[None], G.edges_of(G.rings_of(a))) < 1e-9 and G._to_edges(q[None], G.edges_of(G.rings_of(b))) < 1e-9
    assert G._shortest([], [[0.0, 0, 1, 0, 1, 1]]) is None
